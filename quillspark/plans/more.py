"""Registered queries of the repository scan, the audit's totals, imports, proof and review, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit, benchmark, evidence, judgment, reporting, review
from ..sources import repository
from . import bindings as b
from .catalog import BAD, JUDGED, RUNS, SAMPLES, VERDICT, judged, registered, samples, verdict

# a repository: pages stand for files, by their number
_KINDS = ("src/p{}.test.ts", "node_modules/p{}.test.js", "E2E/p{}.spec.ts", "src/p{}.ts", "lib/p{}.spec.tsx", "docs/p{}.md", "src/p{}.cy.ts", "tmp/p{}.test.js", "src/Test.p{}.ts", "web/p{}.test.jsx")
_MODULES = ("vitest", "@jest/globals", "playwright", "bun:test", "./a", "@wdio/cli")
_PATH = "replace([" + ", ".join(f"'{k}'" for k in _KINDS) + "][page_id % 10 + 1], '{}', page_id::VARCHAR)"
_MODULE = "[" + ", ".join(f"'{m}'" for m in _MODULES) + "][(page_id // 10) % 6 + 1]"
FILES = f"SELECT page_id, {_PATH} AS path, {_MODULE} AS m, (page_id // 10) % 5 = 0 AS two FROM pages"


def files(spark, sf_dir):
    n = F.col("page_id")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    path = F.replace(pick(_KINDS, n % 10), F.lit("{}"), n.cast("string"))
    source = F.concat(F.lit("import x from '"), pick(_MODULES, F.floor(n / 10) % 6), F.lit("';\n"), F.when(F.floor(n / 10) % 5 == 0, "const j = require( 'jest' )\n").otherwise(""))
    return b.table(spark, sf_dir, "pages").select("page_id", path.alias("path"), source.alias("source"))


@registered(f"""SELECT path, reason, CASE WHEN reason = 'e2e-v1' THEN CASE WHEN regexp_matches(path, '^E2E/') THEN 'e2e-path-segment' || CASE WHEN used <> '' THEN ',' || used ELSE '' END WHEN path LIKE '%.cy.ts' THEN 'e2e-file-suffix' || CASE WHEN used <> '' THEN ',' || used ELSE '' END ELSE used END ELSE '' END AS evidence
  FROM (SELECT path, used, CASE WHEN path LIKE 'tmp/%' THEN 'configured-exclude' WHEN path LIKE 'node_modules/%' THEN 'default-exclude' WHEN path LIKE 'E2E/%' OR path LIKE '%.cy.ts' THEN 'e2e-v1' WHEN path LIKE '%.md' THEN 'unsupported-extension'
    WHEN NOT regexp_matches(path, '[.](test|spec)[.](js|jsx|ts|tsx)$') THEN 'not-test-file' WHEN used <> '' THEN 'e2e-v1' END AS reason
    FROM (SELECT path, CASE WHEN m IN ('playwright', '@wdio/cli') THEN 'e2e-framework-import:' || m ELSE '' END AS used FROM ({FILES}) f) u) r""")
def repository_scan(spark, sf_dir):
    return repository.discovered(files(spark, sf_dir), exclude=("tmp/**",))


@registered(f"SELECT path, CASE WHEN m = '@jest/globals' OR (two AND m NOT IN ('vitest', 'bun:test')) THEN 'jest' WHEN two THEN 'unknown' WHEN m = 'vitest' THEN 'vitest' WHEN m = 'bun:test' THEN 'bun' ELSE 'jest' END AS framework FROM ({FILES}) f")
def framework_attribution(spark, sf_dir):
    return repository.frameworks(files(spark, sf_dir), ["jest"])


_DEPENDENCIES = ('{"dependencies":{"vitest":"1","left":"2"}}', '{"devDependencies":{"@jest/globals":"1","jest-cli":"2","x":"1"},"dependencies":{"@vitest/ui":"1"}}', '{"name":"x"}', "not json")


@registered("SELECT folder, framework, dependency FROM (SELECT p_partkey AS folder, p_size % 4 AS k FROM part) p JOIN (VALUES (0, 'vitest', 'vitest'), (1, 'jest', '@jest/globals'), (1, 'jest', 'jest-cli'), (1, 'vitest', '@vitest/ui')) d(k, framework, dependency) ON p.k = d.k")
def package_scan(spark, sf_dir):
    rows = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("folder"), F.get(F.array(*[F.lit(x) for x in _DEPENDENCIES]), (F.col("p_size") % 4).cast("int")).alias("json"))
    return repository.package_evidence(rows)


# cases with modifiers and bundles: a part's line items are its fragments
MODIFIERS = "CASE p_size % 6 WHEN 0 THEN ['skip'] WHEN 1 THEN ['only', 'todo', 'skip'] WHEN 2 THEN ['only'] ELSE [] END"
BUNDLES = "SELECT l_partkey AS case_id, count(*) AS fragments, sum(strlen(strftime(l_shipdate, '%Y-%m-%d') || l_returnflag))::BIGINT AS bytes, count(*) FILTER (l_quantity > 45) AS truncated, sha256(string_agg(strftime(l_shipdate, '%Y-%m-%d') || ':' || l_orderkey || ':' || sha256(strftime(l_shipdate, '%Y-%m-%d') || l_returnflag), chr(10) ORDER BY strftime(l_shipdate, '%Y-%m-%d'), l_orderkey, sha256(strftime(l_shipdate, '%Y-%m-%d') || l_returnflag))) AS hash FROM lineitem WHERE l_partkey % 10 <> 3 GROUP BY 1"
CASES = f"SELECT p_partkey AS case_id, CASE WHEN list_filter({MODIFIERS}, lambda m: m IN ('skip', 'todo'))[1] IS NOT NULL THEN list_filter({MODIFIERS}, lambda m: m IN ('skip', 'todo'))[1] WHEN v.case_id IS NULL THEN 'evidence-unavailable' END AS skipped, fragments, bytes, truncated, hash FROM part LEFT JOIN ({BUNDLES}) v ON p_partkey = v.case_id"


def bundles(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").where("l_partkey % 10 <> 3").select(F.col("l_partkey").alias("case_id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("path"), F.col("l_orderkey").alias("start"), F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), "l_returnflag").alias("text"), (F.col("l_quantity") > 45).alias("truncated"))
    return audit.bundle_totals(rows)


def cases(spark, sf_dir):
    lists = F.array(*[F.array(*[F.lit(x) for x in xs]).cast("array<string>") for xs in (("skip",), ("only", "todo", "skip"), ("only",), (), (), ())])
    return audit.with_bundles(b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.get(lists, (F.col("p_size") % 6).cast("int")).alias("modifiers")), bundles(spark, sf_dir))


@registered(CASES)
def case_bundles(spark, sf_dir):
    return cases(spark, sf_dir).drop("modifiers")


@registered(f"""SELECT (SELECT count(*) FROM pages WHERE page_id % 4 = 0) AS files, (SELECT count(*) FROM pages WHERE page_id % 4 <> 0) AS excluded, count(*) AS test_cases, count(hash) AS evidence_bundles, coalesce(sum(fragments), 0)::BIGINT AS evidence_fragments,
  coalesce(sum(truncated), 0)::BIGINT AS evidence_truncated, (SELECT count(*) FROM events) AS diagnostics, (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') AS unsupported_framework_files FROM ({CASES}) c""")
def audit_totals(spark, sf_dir):
    scanned = b.table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 4 != 0, "x").alias("reason"))
    found = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("path"), F.when(F.col("event_type") == "error", "unsupported-framework").otherwise("other").alias("code"))
    return audit.audit_totals(scanned, cases(spark, sf_dir), found)


# outcomes: every case, in order, with a state by its number
OUTCOMES = f"""SELECT c.case_id AS ord, CASE WHEN skipped IS NOT NULL THEN 'skipped' ELSE ['completed', 'cached', 'failed', 'not-cached', 'completed'][c.case_id % 5 + 1] END AS state, skipped, verdict, pinned, 'm' || (c.case_id % 3) AS model, c.case_id * 7 % 1000 AS tokens
  FROM ({CASES}) c LEFT JOIN ({VERDICT[3]}) v ON c.case_id = v.case_id LEFT JOIN ({b.CASES_SQL}) p ON c.case_id = p.case_id"""


def outcomes(spark, sf_dir):
    n = F.col("case_id")
    state = F.when(F.col("skipped").isNotNull(), "skipped").otherwise(F.get(F.array(*[F.lit(x) for x in ("completed", "cached", "failed", "not-cached", "completed")]), (n % 5).cast("int")))
    rows = cases(spark, sf_dir).select("case_id", "skipped").join(verdict(spark, sf_dir).select("case_id", "verdict"), "case_id", "left").join(b.cases(spark, sf_dir).select("case_id", "pinned"), "case_id", "left")
    return rows.select(n.alias("ord"), state.alias("state"), "skipped", "verdict", "pinned", F.concat(F.lit("m"), (n % 3).cast("string")).alias("model"), (n * 7 % 1000).alias("tokens"))


@registered(f"""SELECT count(*) FILTER (state = 'completed') AS evaluated, count(*) FILTER (state = 'cached') AS cached, count(*) FILTER (state = 'not-cached') AS not_cached, count(*) FILTER (state = 'failed') AS failed,
  count(*) FILTER (skipped = 'skip') AS skipped_skip, count(*) FILTER (skipped = 'todo') AS skipped_todo, count(*) FILTER (skipped = 'evidence-unavailable') AS skipped_evidence_unavailable, coalesce(sum(tokens) FILTER (state = 'completed'), 0)::BIGINT AS input_tokens,
  count(*) FILTER (a AND verdict = 'misleading') AS misleading, count(*) FILTER (a AND verdict = 'weak') AS weak, count(*) FILTER (a AND verdict = 'needs-review') AS needs_review, count(*) FILTER (a AND verdict = 'healthy') AS healthy,
  count(*) FILTER (a AND NOT pinned) AS model_mismatches, arg_min(model, ord) FILTER (a) AS responded_model FROM (SELECT *, state IN ('completed', 'cached') AS a FROM ({OUTCOMES}) o) x""")
def outcome_totals(spark, sf_dir):
    return audit.outcome_totals(outcomes(spark, sf_dir))


@registered(f"SELECT count(*) AS discovered, count(*) FILTER (state IN ('completed', 'cached')) AS judged, coalesce(count(*) FILTER (state IN ('completed', 'cached')) / nullif(count(*), 0)::DOUBLE, 0) AS judged_share, count(*) FILTER (state = 'failed') AS not_evaluated, count(*) FILTER (state = 'skipped') AS skipped FROM ({OUTCOMES}) o")
def coverage(spark, sf_dir):
    return audit.coverage(outcomes(spark, sf_dir))


_SEVERITY = "CASE user_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END"


@registered(f"SELECT code, sum(n)::BIGINT AS n, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities FROM (SELECT event_type AS code, {_SEVERITY} AS severity, count(*) AS n FROM events GROUP BY 1, 2) e GROUP BY code")
def diagnostics_by_code(spark, sf_dir):
    return audit.diagnostics_by_code(b.table(spark, sf_dir, "events").select(F.col("event_type").alias("code"), F.expr(_SEVERITY).alias("severity")))


@registered("SELECT count(ms) AS n, sum(ms)::BIGINT AS total, avg(ms) AS mean, min(ms) AS least, max(ms) AS most FROM (SELECT CASE WHEN l_linenumber < 6 THEN l_suppkey END AS ms FROM lineitem) l")
def latency_summary(spark, sf_dir):
    return audit.latency_summary(b.table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") < 6, F.col("l_suppkey")).alias("ms")))


_LAST = f"SELECT identity, max(id) AS id, arg_max(state, id) AS state, arg_max(cache_key, id) AS cache_key FROM (SELECT id, identity, CASE WHEN state = 'pending' THEN 'skipped' ELSE state END AS state, cache_key FROM ({b.WORK_SQL}) w) s GROUP BY 1"


@registered(f"SELECT identity, id, state, cache_key FROM ({_LAST}) l WHERE (state = 'completed' AND id % 5 <> 0 AND id % 7 <> 0) OR (state = 'cached' AND id % 7 <> 0 AND cache_key IS NOT NULL) OR (state = 'failed' AND id % 2 = 0) OR (state = 'skipped' AND id % 3 = 0)")
def settled_items(spark, sf_dir):
    log = b.work_items(spark, sf_dir).select("id", "identity", F.when(F.col("state") == "pending", "skipped").otherwise(F.col("state")).alias("state"), "cache_key")
    last = log.groupBy("identity").agg(F.max(F.struct("id", "state", "cache_key")).alias("r")).select("identity", "r.*")
    children = log.selectExpr("id", "id % 5 <> 0 AS has_attempt", "id % 7 <> 0 AS has_judgment", "id % 2 = 0 AS has_error", "id % 3 = 0 AS has_skip")
    return audit.settled(last, children)


@registered(f"""SELECT c.case_id, CASE WHEN skipped IS NOT NULL THEN 'skipped' WHEN c.case_id % 4 = 1 THEN 'reused' WHEN 'k' || (c.case_id % 50) IN (SELECT 'k' || (o_custkey % 37) FROM orders) THEN 'cached' ELSE 'evaluate' END AS step FROM ({CASES}) c""")
def evaluation_plan(spark, sf_dir):
    rows = cases(spark, sf_dir).select("case_id", "skipped", F.concat(F.lit("k"), (F.col("case_id") % 50).cast("string")).alias("cache_key"))
    keys = b.table(spark, sf_dir, "orders").select(F.concat(F.lit("k"), (F.col("o_custkey") % 37).cast("string")).alias("cache_key"))
    return audit.evaluation_plan(rows, rows.where("case_id % 4 = 1").select("case_id"), keys)


@registered(f"""SELECT j.case_id, j.dimension, j.level, s.ms, CASE WHEN j.case_id % 4 = 0 THEN 'cached' ELSE 'fresh' END AS cache_status, coalesce(fragments, 0) AS fragments, coalesce(bytes, 0) AS bytes, coalesce(truncated, 0) AS truncated FROM ({JUDGED[3]}) j
  LEFT JOIN (SELECT p_partkey AS case_id, p_size AS ms FROM part WHERE p_partkey % 3 = 0) s ON j.case_id = s.case_id LEFT JOIN ({BUNDLES}) v ON j.case_id = v.case_id""")
def report_rows(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    latency = part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("case_id"), F.col("p_size").alias("ms"))
    cache = part.where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("case_id"), F.lit("cached").alias("cache_status"))
    return audit.report_rows(judged(spark, sf_dir).select("case_id", "dimension", "level"), latency, cache, bundles(spark, sf_dir))


@registered("""SELECT l_orderkey, CASE WHEN NOT has THEN 'missing:q3' WHEN extra THEN 'unasked:q9' WHEN l_orderkey % 6 = 0 THEN 'not-finite' END AS problem FROM (SELECT l_orderkey, bool_or(l_linenumber = 3) AS has, bool_or(l_linenumber = 7) AS extra FROM lineitem GROUP BY 1) x""")
def answer_check(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("n"), F.bool_or(F.col("l_linenumber") == 3).alias("has"), F.bool_or(F.col("l_linenumber") == 7).alias("extra"))
    none = F.array().cast("array<string>")
    ids = F.concat(F.array(F.lit("q1")), F.when(F.col("has"), F.array(F.lit("q3"))).otherwise(none), F.when(F.col("extra"), F.array(F.lit("q9"))).otherwise(none))
    # of every sixth order the value is no number, none or too large
    odd = F.get(F.array(F.lit(float("nan")), F.lit(None).cast("double"), F.lit(float("inf"))), (F.col("l_orderkey") / 6 % 3).cast("int"))
    value = F.when(F.col("l_orderkey") % 6 == 0, odd).otherwise(F.col("n").cast("double"))
    return rows.select("l_orderkey", audit.answer_problem(ids, F.array(F.lit("q1"), F.lit("q3")), F.array(value)).alias("problem"))


@registered("SELECT doc_id, CASE WHEN ceil((n * 9 + 600) / 3.0::DOUBLE) > 64000 THEN 'total' WHEN ceil((n * 9 + 300) / 3.0::DOUBLE) > 32000 THEN 'state-and-question' END AS over FROM (SELECT doc_id, strlen(coalesce(text, '')) AS n FROM documents) d")
def request_budget(spark, sf_dir):
    state = F.octet_length(F.coalesce("text", F.lit(""))).cast("long") * 9
    return b.table(spark, sf_dir, "documents").select("doc_id", evidence.over_request_budget(state, F.array(F.lit(300).cast("long"), F.lit(200).cast("long"), F.lit(100).cast("long"))).alias("over"))


@registered("""SELECT id, sum(tokens) OVER (ORDER BY t RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW)::BIGINT AS tokens FROM (SELECT event_id AS id, user_id AS tokens, epoch_ms(ts) AS t FROM events) e""")
def budget_window_tokens(spark, sf_dir):
    return audit.tokens_within(b.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("tokens"), "ts"), 3_600_000)


@registered("SELECT n, 1 + n % 7 AS x FROM (SELECT p_partkey AS n, (SELECT count(*) FROM part) AS t FROM part) p WHERE n % greatest(1, t // 20) = 0 OR n = t")
def progress_marks(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    return audit.progress_marks(part.select(F.col("p_partkey").alias("n"), (1 + F.col("p_partkey") % 7).alias("x")), part.count())


@registered("SELECT doc_id, sha256('{\"request\":' || to_json(lang) || ',\"source\":\"' || sha256(coalesce(text, '')) || '\",\"rubricVersion\":\"v2\",\"slot\":\"-\"}') AS key FROM documents")
def cache_keys(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", evidence.cache_key(F.col("lang"), F.coalesce("text", F.lit("")), "v2", "-").alias("key"))


# imports between numbered files: some resolved before, some by their key alone, some by a key that two files share
_TARGETS = "SELECT DISTINCT 'src/m' || (l_suppkey % 50) || CASE WHEN l_suppkey % 5 = 0 THEN '/index.ts' ELSE '.ts' END AS path, 'test/t' || (l_partkey % 40) || '.test.ts' AS importer, '../src/m' || (l_suppkey % 50) AS specifier FROM lineitem WHERE l_linenumber = 1 UNION SELECT 'src/m' || k || '.js', 'x', 'y' FROM (VALUES (3), (4), (11)) v(k)"
_IMPORTS = "SELECT DISTINCT 'test/t' || (l_partkey % 40) || '.test.ts' AS importer, CASE l_linenumber % 3 WHEN 0 THEN '../src/m' || (l_suppkey % 50) WHEN 1 THEN '../src/m' || (l_suppkey % 50) || '.js' ELSE 'bare' || (l_suppkey % 9) END AS specifier FROM lineitem WHERE l_linenumber > 1"
_KEY = "regexp_replace(regexp_replace({}, '[.](ts|tsx|js|jsx|mts|cts|mjs|cjs)$', ''), '/index$', '')"
_RESOLVED = f"""WITH t AS ({_TARGETS}), i AS ({_IMPORTS}), k AS (SELECT {_KEY.format('path')} AS key, min(path) AS sole FROM (SELECT DISTINCT path FROM t) p GROUP BY 1 HAVING count(*) = 1), e AS (SELECT importer, specifier, min(path) AS exact FROM t GROUP BY 1, 2)
  SELECT i.importer, i.specifier, coalesce(exact, sole) AS path FROM i LEFT JOIN e ON i.importer = e.importer AND i.specifier = e.specifier LEFT JOIN k ON starts_with(i.specifier, '../') AND {_KEY.format("substr(i.specifier, 4)")} = k.key"""


def targets(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    made = lines.selectExpr("concat('src/m', l_suppkey % 50, CASE WHEN l_suppkey % 5 = 0 THEN '/index.ts' ELSE '.ts' END) AS path", "concat('test/t', l_partkey % 40, '.test.ts') AS importer", "concat('../src/m', l_suppkey % 50) AS specifier")
    return made.distinct().unionByName(spark.createDataFrame([(f"src/m{k}.js", "x", "y") for k in (3, 4, 11)], "path string, importer string, specifier string"))


def imports(spark, sf_dir):
    return b.table(spark, sf_dir, "lineitem").where("l_linenumber > 1").selectExpr("concat('test/t', l_partkey % 40, '.test.ts') AS importer", "CASE l_linenumber % 3 WHEN 0 THEN concat('../src/m', l_suppkey % 50) WHEN 1 THEN concat('../src/m', l_suppkey % 50, '.js') ELSE concat('bare', l_suppkey % 9) END AS specifier").distinct()


@registered(_RESOLVED)
def resolved_imports(spark, sf_dir):
    return evidence.resolved_imports(imports(spark, sf_dir), targets(spark, sf_dir))


@registered(f"SELECT importer, string_agg(key, ',' ORDER BY key) AS keys FROM (SELECT DISTINCT importer, {_KEY.format('path')} AS key FROM ({_RESOLVED}) r WHERE path IS NOT NULL) k GROUP BY importer")
def mocked_targets(spark, sf_dir):
    return evidence.mocked_targets(imports(spark, sf_dir), targets(spark, sf_dir))


_EXISTING = "SELECT 'f' || p_partkey || ['.ts', '.tsx', '.js', '/index.ts', '.mts', ''][p_size % 6 + 1] AS path FROM part"
_ASKED = "SELECT 'f' || p_partkey || CASE p_partkey % 3 WHEN 0 THEN '.js' WHEN 1 THEN '' ELSE '.mjs' END AS base, 'f' || p_partkey AS stem, p_partkey % 3 AS k, p_size % 6 AS e FROM part"


@registered(f"""SELECT base, stem || CASE WHEN k = 0 THEN ['.ts', '.tsx', '.js'][e + 1] WHEN k = 1 THEN ['.ts', '.tsx', '.js', '/index.ts', '.mts', ''][e + 1] ELSE '.mts' END AS path FROM ({_ASKED}) a WHERE (k = 0 AND e < 3) OR k = 1 OR (k = 2 AND e = 4)""")
def probed_files(spark, sf_dir):
    part = b.table(spark, sf_dir, "part")
    ends = F.get(F.array(*[F.lit(x) for x in (".ts", ".tsx", ".js", "/index.ts", ".mts", "")]), (F.col("p_size") % 6).cast("int"))
    stem = F.concat(F.lit("f"), F.col("p_partkey").cast("string"))
    asked = part.select(F.concat(stem, F.get(F.array(F.lit(".js"), F.lit(""), F.lit(".mjs")), (F.col("p_partkey") % 3).cast("int"))).alias("base"))
    return evidence.probed(asked, part.select(F.concat(stem, ends).alias("path")))


# proof: nations' suppliers stand for observations of runs
_OBSERVED = "SELECT p_partkey AS case_id, p_partkey % 2 = 0 AS prescriptive, CASE WHEN p_size % 3 = 0 THEN 'expected-to-keep-passing' ELSE 'expected-to-fail' END AS expected, ['passed', 'failed', 'passed', 'passed', 'passed', NULL, 'passed'][p_size % 7 + 1] AS k0, ['failed', 'passed', 'failed', 'timed-out', 'failed', 'failed', NULL, 'failed'][p_partkey % 8 + 1] AS k1, ['passed', 'failed', 'runner-error', 'passed', NULL][p_size % 5 + 1] AS k2 FROM part"
_PROOF = f"""SELECT case_id, reason IS NULL AS proven, reason FROM (SELECT case_id, CASE WHEN k0 IS NULL OR k0 <> 'passed' THEN 'baseline-failed' WHEN prescriptive AND expected <> 'expected-to-fail' THEN 'incoherent-declaration' WHEN k1 IS NULL THEN 'base-under-mutation: no observation' WHEN k1 = 'timed-out' THEN 'base-under-mutation timed-out'
  WHEN (k1 = 'passed') <> (expected = 'expected-to-keep-passing') THEN 'prediction-not-held' WHEN NOT prescriptive THEN NULL WHEN k2 IS NULL THEN 'variant-under-mutation: no observation' WHEN k2 = 'runner-error' THEN 'variant-under-mutation runner-error' WHEN k2 <> 'passed' THEN 'operator-did-not-hide-defect' END AS reason FROM ({_OBSERVED}) o) r"""


def decisions(spark, sf_dir):
    part, pick = b.table(spark, sf_dir, "part"), lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    known = part.select(F.col("p_partkey").alias("case_id"), (F.col("p_partkey") % 2 == 0).alias("prescriptive"), F.when(F.col("p_size") % 3 == 0, "expected-to-keep-passing").otherwise("expected-to-fail").alias("expected"))
    kinds = [("baseline", pick(("passed", "failed", "passed", "passed", "passed", None, "passed"), F.col("p_size") % 7)), ("base-under-mutation", pick(("failed", "passed", "failed", "timed-out", "failed", "failed", None, "failed"), F.col("p_partkey") % 8)), ("variant-under-mutation", pick(("passed", "failed", "runner-error", "passed", None), F.col("p_size") % 5))]
    seen = part.select(F.col("p_partkey").alias("case_id"), F.explode(F.array(*[F.struct(F.lit(n).alias("label"), k.alias("kind")) for n, k in kinds])).alias("o")).select("case_id", "o.*").where("kind IS NOT NULL")
    return review.proof_decisions(known, seen)


@registered(_PROOF)
def proof(spark, sf_dir):
    return decisions(spark, sf_dir)


@registered(f"SELECT count(*) AS n, count(*) FILTER (proven) AS proven, count(*) FILTER (NOT proven) AS unproven FROM ({_PROOF}) p")
def proof_tally(spark, sf_dir):
    return review.proof_tally(decisions(spark, sf_dir))


@registered(f"SELECT count(*) FILTER (proven) AS proven, count(*) FILTER (NOT proven) AS unproven, (SELECT string_agg(reason, ',' ORDER BY reason) FROM (SELECT DISTINCT reason FROM ({_PROOF}) q WHERE reason IS NOT NULL) d) AS reasons FROM ({_PROOF}) p")
def proof_split(spark, sf_dir):
    return review.proof_split(decisions(spark, sf_dir))


@registered(f"SELECT regexp_replace(reason, ':.*$', '') AS reason, count(*) AS n FROM ({_PROOF}) p WHERE reason IS NOT NULL GROUP BY 1")
def exclusions(spark, sf_dir):
    return review.exclusions(decisions(spark, sf_dir))


_RUNS = "SELECT p_partkey AS case_id, p_partkey % 2 = 0 AS prescriptive, 'a ' || p_type || ' b' AS production, p_name AS test, CASE WHEN p_size % 4 <> 0 THEN split_part(p_type, ' ', 1) END AS anchor, split_part(p_name, ' ', 1) AS t FROM part"


@registered(f"""WITH x AS (SELECT *, CASE WHEN anchor IS NULL THEN 'unrealizable:no-mutation-declared' WHEN length(production) - length(replace(production, anchor, '')) <> length(anchor) OR (prescriptive AND length(test) - length(replace(test, t, '')) <> length(t)) THEN 'unrealizable:mutation-anchor-not-found' END AS bad FROM ({_RUNS}) r)
  SELECT case_id, bad AS label, NULL AS production, NULL AS test FROM x WHERE bad IS NOT NULL UNION ALL SELECT case_id, 'baseline', production, test FROM x WHERE bad IS NULL
  UNION ALL SELECT case_id, 'base-under-mutation', replace(production, anchor, 'MUTED'), test FROM x WHERE bad IS NULL UNION ALL SELECT case_id, 'variant-under-mutation', replace(production, anchor, 'MUTED'), replace(test, t, 'weaker') FROM x WHERE bad IS NULL AND prescriptive""")
def oracle_plan(spark, sf_dir):
    rows = b.table(spark, sf_dir, "part").selectExpr("p_partkey AS case_id", "p_partkey % 2 = 0 AS prescriptive", "concat('a ', p_type, ' b') AS production", "p_name AS test", "p_size", "split_part(p_type, ' ', 1) AS anchor", "split_part(p_name, ' ', 1) AS test_anchor")
    recipes = rows.where("p_size % 4 <> 0").select("case_id", "anchor", F.lit("MUTED").alias("replacement"), "test_anchor", F.lit("weaker").alias("test_replacement"))
    return review.oracle_runs(rows.select("case_id", "prescriptive", "production", "test"), recipes)


@registered("SELECT p_partkey, CASE WHEN length(p_name) - length(replace(p_name, t, '')) = length(t) THEN replace(p_name, t, repeat(t, 3)) END AS repeated FROM (SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS t FROM part) p")
def repeated_block(spark, sf_dir):
    return b.table(spark, sf_dir, "part").select("p_partkey", review.repeated_block(F.col("p_name"), F.split_part("p_name", F.lit(" "), F.lit(1)), 3).alias("repeated"))


# review: an assessment of every fifth case's first dimension
_ASSESSED = f"""SELECT case_id, dimension, level, ['weak', 'strong', 'misleading', 'acceptable'][case_id % 4 + 1] AS reviewer_level, case_id % 3 = 0 AS acceptable, case_id % 2 = 0 AS prescriptive, (case_id % 10) / 10.0::DOUBLE AS uncertainty,
  ['Context is OMITTED', 'fine', NULL, 'Unclear wording', 'ok'][case_id % 5 + 1] AS notes, ['saw a Missing Import', 'x', 'the rubric wording', NULL][case_id % 4 + 1] AS reasoning FROM ({JUDGED[3]}) j WHERE dimension = 'falsifiability'"""
_COMPARED = f"""SELECT case_id, dimension, CASE WHEN level = reviewer_level THEN 'agreement' WHEN regexp_matches(lower(coalesce(notes, '')), 'context|missing|omitted') OR regexp_matches(lower(coalesce(reasoning, '')), 'missing import|missing context') THEN 'context-selection-error'
  WHEN uncertainty >= 0.5 OR regexp_matches(lower(coalesce(notes, '')), 'unclear|ambiguity|interpretation') OR contains(lower(coalesce(reasoning, '')), 'rubric wording') THEN 'rubric-ambiguity' WHEN acceptable <> prescriptive THEN 'unsupported-disagreement' ELSE 'likely-model-error' END AS kind FROM ({_ASSESSED}) a"""


def compared(spark, sf_dir):
    n, pick = F.col("case_id"), lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    levels = judged(spark, sf_dir).where("dimension = 'falsifiability'").select("case_id", "dimension", "level")
    assessed = levels.select(
        "case_id", "dimension", pick(("weak", "strong", "misleading", "acceptable"), n % 4).alias("reviewer_level"), (n % 3 == 0).alias("acceptable"), (n % 2 == 0).alias("prescriptive"), ((n % 10) / 10).alias("uncertainty"),
        pick(("Context is OMITTED", "fine", None, "Unclear wording", "ok"), n % 5).alias("notes"), pick(("saw a Missing Import", "x", "the rubric wording", None), n % 4).alias("reasoning"),
    )
    return review.review_comparison(assessed, levels)


@registered(_COMPARED)
def review_compare(spark, sf_dir):
    return compared(spark, sf_dir)


@registered(f"SELECT k.kind, count(c.kind) AS n FROM (VALUES {', '.join(f'({k!r})' for k in review.KINDS)}) k(kind) LEFT JOIN ({_COMPARED}) c ON k.kind = c.kind GROUP BY k.kind")
def review_summary(spark, sf_dir):
    return review.review_summary(compared(spark, sf_dir))


@registered("SELECT p_partkey, sha256('{\"p_partkey\":' || p_partkey || ',\"p_brand\":' || to_json(p_brand) || '}') AS payload_hash, p_brand FROM part")
def blind_payload(spark, sf_dir):
    return review.blind_payload(b.table(spark, sf_dir, "part"), ["p_partkey", "p_brand"])


# fixed values: which dimension each mutation operator is about
_OPERATORS = dict(enumerate((*b.DIMENSIONS, b.DIMENSIONS[0])))
_OUTCOME = f"SELECT c.case_id AS ord, c.case_id, {b.DIMENSION_SQL}[CASE WHEN c.operator < 7 THEN c.operator + 1 ELSE 1 END] AS dimension, (verdict = 'healthy') = prescriptive AS correct FROM ({b.CASES_SQL}) c JOIN ({VERDICT[3]}) v ON c.case_id = v.case_id"


def selection_rows(spark, sf_dir):
    operators = spark.createDataFrame(list(_OPERATORS.items()), "operator long, dimension string")
    rows = b.cases(spark, sf_dir).join(F.broadcast(operators), "operator").join(verdict(spark, sf_dir).select("case_id", "verdict"), "case_id")
    return rows.select(F.col("case_id").alias("ord"), "case_id", "dimension", ((F.col("verdict") == "healthy") == F.col("prescriptive")).alias("correct"))


@registered(f"SELECT ord, case_id, dimension, correct FROM (SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY ord) AS r, list_position({b.DIMENSION_SQL}, dimension) AS p FROM ({_OUTCOME}) o) x ORDER BY r, p LIMIT 60")
def review_stratified(spark, sf_dir):
    return review.review_selection(selection_rows(spark, sf_dir), "stratified", b.DIMENSIONS, limit=60)


@registered(f"SELECT * FROM ({_OUTCOME}) o WHERE NOT correct")
def review_disagreements(spark, sf_dir):
    return review.review_selection(selection_rows(spark, sf_dir), "disagreements", b.DIMENSIONS)


@registered("SELECT CASE count(DISTINCT p_brand || '/' || p_container) WHEN 0 THEN 'none' WHEN 1 THEN min(p_brand || '/' || p_container) ELSE 'mixed' END AS identity, CASE WHEN count(DISTINCT p_mfgr) = 1 THEN min(p_mfgr) WHEN count(DISTINCT p_mfgr) > 1 THEN 'mixed' END AS model FROM (SELECT 'v3' AS p_brand, 'r2' AS p_container, 'm' || (p_size % 2) AS p_mfgr FROM part) p")
def version_identity(spark, sf_dir):
    return review.version_identity(b.table(spark, sf_dir, "part").select(F.lit("v3").alias("policy"), F.lit("r2").alias("rubric"), F.concat(F.lit("m"), (F.col("p_size") % 2).cast("string")).alias("model")))


_MEANS = f"SELECT {b.DIMENSION_SQL}[l_linenumber] AS dimension, count(*) AS n, round(avg(floor(l_extendedprice) * 0.042::DOUBLE / 1e6), 9) AS usd, avg(l_suppkey) AS ms, CASE WHEN count(*) < 5 THEN 'below-minimum' ELSE 'computed' END AS kind FROM lineitem WHERE l_linenumber <> 4 GROUP BY 1"


def means(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").where("l_linenumber <> 4").select(b.dimension_id(F.col("l_linenumber")).alias("dimension"), F.floor("l_extendedprice").alias("tokens"), F.col("l_suppkey").alias("ms"))
    return review.sampled_means(rows).withColumn("usd", F.round("usd", 9))


@registered(_MEANS)
def cost_latency(spark, sf_dir):
    return means(spark, sf_dir)


@registered(f"""SELECT (row_number() OVER (ORDER BY list_position({b.DIMENSION_SQL}, d.dimension)) - 1)::BIGINT AS position, d.dimension, n, usd, ms, kind, agreeing, pairs FROM (SELECT unnest({b.DIMENSION_SQL}) AS dimension) d LEFT JOIN ({_MEANS}) m ON d.dimension = m.dimension LEFT JOIN
  (SELECT dimension, (sum(a) // 2)::BIGINT AS agreeing, (sum(n * (n - 1)) // 2)::BIGINT AS pairs FROM (SELECT dimension, case_id, sum(c) AS n, sum(c * (c - 1)) AS a FROM (SELECT dimension, case_id, CASE WHEN status = 'judged' THEN 'judged:' || level ELSE status END AS k, count(*) AS c FROM ({SAMPLES}) s GROUP BY 1, 2, 3) x GROUP BY 1, 2) y GROUP BY 1) t ON d.dimension = t.dimension""")
def metrics_report(spark, sf_dir):
    return review.full_metrics(b.DIMENSIONS, means(spark, sf_dir), benchmark.stability(samples(spark, sf_dir)))


# report queries
_ROWS = f"SELECT v.case_id, c.name, c.path, v.verdict FROM ({VERDICT[3]}) v JOIN ({b.CASES_SQL}) c ON v.case_id = c.case_id"


def rows(spark, sf_dir):
    return b.cases(spark, sf_dir).select("case_id", "name", "path").join(verdict(spark, sf_dir).select("case_id", "verdict"), "case_id")


_FILTERED = f"SELECT * FROM ({_ROWS}) r WHERE starts_with(path, 'Brand#1') AND verdict IN ('misleading', 'weak', 'needs-review') AND case_id IN (SELECT case_id FROM ({JUDGED[3]}) j WHERE dimension = 'assertion-strength')"


def filtered(spark, sf_dir):
    known = rows(spark, sf_dir).where(F.col("path").startswith("Brand#1"))
    return reporting.selected(known, statuses=("misleading", "weak", "needs-review"), with_dimension=judged(spark, sf_dir).where("dimension = 'assertion-strength'"))


@registered(f"""SELECT count(*) AS judged, count(*) FILTER (verdict = 'misleading') AS misleading, count(*) FILTER (verdict = 'weak') AS weak, count(*) FILTER (verdict = 'needs-review') AS needs_review, count(*) FILTER (verdict = 'healthy') AS healthy,
  coalesce(count(*) FILTER (verdict IN {BAD}) / nullif(count(*), 0)::DOUBLE, 0) AS needs_change_share, coalesce(count(*) FILTER (verdict = 'needs-review') / nullif(count(*), 0)::DOUBLE, 0) AS needs_review_share FROM ({_FILTERED}) f""")
def query_summary(spark, sf_dir):
    return reporting.summary(filtered(spark, sf_dir))


@registered(f"""SELECT path, count(*) AS n, string_agg(name || ':' || verdict || ':' || coalesce(found, ''), '|' ORDER BY name || ':' || verdict || ':' || coalesce(found, '')) AS tests FROM ({_FILTERED}) f LEFT JOIN (SELECT case_id, string_agg(dimension || '=' || level, '+' ORDER BY dimension || '=' || level) AS found FROM ({JUDGED[3]}) j WHERE status = 'judged' AND level IN {BAD} GROUP BY 1) d ON f.case_id = d.case_id WHERE verdict IN {BAD} GROUP BY path""")
def worklist_files(spark, sf_dir):
    return reporting.file_worklist(filtered(spark, sf_dir), judged(spark, sf_dir).where("status = 'judged' AND level IN ('misleading', 'weak')"))


@registered(f"""SELECT path, count(*) AS n, string_agg(line, '|' ORDER BY line) AS tests FROM (SELECT path, name || ':' || dimension || ':' || coalesce(reason, '') AS line FROM ({_ROWS}) r JOIN ({JUDGED[3]}) j ON r.case_id = j.case_id WHERE status = 'needs-review') x GROUP BY path""")
def worklist_review(spark, sf_dir):
    return reporting.review_worklist(rows(spark, sf_dir), judged(spark, sf_dir).where("status = 'needs-review'").select("case_id", "dimension", "reason"))


@registered(f"SELECT * FROM ({_ROWS}) r WHERE case_id = 17 OR contains(lower(name), lower(split_part((SELECT min(p_name) FROM part), ' ', 1)))")
def query_test(spark, sf_dir):
    word = b.table(spark, sf_dir, "part").agg(F.min("p_name").alias("n")).first()["n"].split(" ")[0]
    found = rows(spark, sf_dir)
    return reporting.searched(found, "17").unionByName(reporting.searched(found, word.upper())).distinct()


@registered(f"""SELECT coalesce(x.case_id, y.case_id) AS case_id, coalesce(x.dimension, y.dimension) AS dimension, x.s AS before, y.s AS after FROM (SELECT case_id, dimension, coalesce(level, status) AS s FROM ({RUNS}) r WHERE run = 1994) x FULL JOIN (SELECT case_id, dimension, coalesce(level, status) AS s FROM ({RUNS}) r WHERE run = 1995) y
  ON x.case_id = y.case_id AND x.dimension = y.dimension WHERE x.s IS DISTINCT FROM y.s""")
def diff_dimensions(spark, sf_dir):
    runs = judgment.judge(b.run_answers(spark, sf_dir), judgment.V3)
    return reporting.dimension_diff(runs.where("run = 1994"), runs.where("run = 1995"))


# folders by a part's size: src is no folder of its own, and a third level has small groups
_DIRS = "SELECT 'src/' || CASE WHEN p_size % 5 < 3 THEN 'a' ELSE 'b' || (p_size % 5) END AS g1, 't' || (p_size % 7) AS g2, 'src/' || CASE WHEN p_size % 5 < 3 THEN 'a' ELSE 'b' || (p_size % 5) END || '/t' || (p_size % 7) || '/' || p_partkey AS path FROM part"


@registered(f"""SELECT path, folder, folder = g1 AND o2 > 0 AS remainder FROM (SELECT *, max(CASE WHEN n1 * 12 >= t AND n2 >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY g1) AS o2, CASE WHEN n1 < 3 THEN '.' WHEN n1 * 12 >= t AND n2 >= 3 THEN g1 || '/' || g2 ELSE g1 END AS folder
  FROM (SELECT *, count(*) OVER () AS t, count(*) OVER (PARTITION BY g1) AS n1, count(*) OVER (PARTITION BY g1, g2) AS n2 FROM ({_DIRS}) d) x) y""")
def folder_drilldown(spark, sf_dir):
    path = F.expr("concat('src/', CASE WHEN p_size % 5 < 3 THEN 'a' ELSE concat('b', p_size % 5) END, '/t', p_size % 7, '/', p_partkey)")
    return reporting.drilled_folders(b.table(spark, sf_dir, "part").select(path.alias("path"), F.lit(1).cast("long").alias("n")))
