"""The registered queries of the reference's operators, each over its whole tables, with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches as batching
from ..operators import benchmark, evidence, judgment, reporting, workitems
from . import bindings as b

FLAGSHIP = "verdicts"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def registered(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)


POLICIES = {1: judgment.V1, 2: judgment.V2, 3: judgment.V3}
# The published policies once more, for the SQL, so that it doesn't follow the operators' numbers.
PUBLISHED = {
    1: judgment.Policy(version=1, applicability=0.5, confidence=0.6, acceptable=0.65, deficient=0.65, critical=0.5, cuts=(1.0, 2.0, 3.0)),
    2: judgment.Policy(version=2, applicability=0.5, confidence=None, acceptable=0.65, deficient=0.65, critical=0.5, cuts=(1.0, 2.0, 3.0)),
    3: judgment.Policy(version=3, applicability=0.5, confidence=None, acceptable=0.575, deficient=0.65, critical=0.5, cuts=(1.0, 2.0, 3.0)),
}
JUDGED = {v: judgment.judge_sql(b.ANSWERS_SQL, p) for v, p in PUBLISHED.items()}
RUNS = judgment.judge_sql(b.RUN_ANSWERS_SQL, PUBLISHED[3])
VERDICT = {v: judgment.verdicts_sql(JUDGED[v], b.CASES_SQL) for v in JUDGED}
SAMPLES = f"SELECT r.*, c.prescriptive, c.proven FROM ({RUNS}) r JOIN ({b.CASES_SQL}) c ON r.case_id = c.case_id"
BUCKET = "CASE WHEN status = 'judged' THEN level ELSE status END"
BAD = "('misleading', 'weak')"


def judged(spark: SparkSession, sf_dir: str, version: int = 3) -> DataFrame:
    return judgment.judge(b.answers(spark, sf_dir), POLICIES[version])


def verdict(spark: SparkSession, sf_dir: str, version: int = 3) -> DataFrame:
    return judgment.verdicts(judged(spark, sf_dir, version), b.cases(spark, sf_dir))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = judgment.judge(b.run_answers(spark, sf_dir), judgment.V3)
    return runs.join(b.cases(spark, sf_dir).select("case_id", "prescriptive", "proven"), "case_id")


@registered(f"SELECT case_id, dimension, coalesce(p0 BETWEEN 0 AND 1 AND p1 BETWEEN 0 AND 1 AND p2 BETWEEN 0 AND 1 AND p3 BETWEEN 0 AND 1 AND abs(p0 + p1 + p2 + p3 - 1) <= 0.02, false) AS valid FROM ({b.ANSWERS_SQL}) a")
def quartet_validate(spark, sf_dir):
    return b.answers(spark, sf_dir).select("case_id", "dimension", judgment.quartet_valid().alias("valid"))


def _judgments(version: int):
    @registered(f"SELECT case_id, dimension, status, level, reason, applicable FROM ({JUDGED[version]}) j")
    def query(spark, sf_dir):
        return judged(spark, sf_dir, version).select("case_id", "dimension", "status", "level", "reason", "applicable")

    del QUERIES["query"], ORACLE["query"]
    QUERIES[f"judge_v{version}"] = query
    ORACLE[f"judge_v{version}"] = f"SELECT case_id, dimension, status, level, reason, applicable FROM ({JUDGED[version]}) j"


for _v in POLICIES:
    _judgments(_v)


@registered(VERDICT[3])
def verdicts(spark, sf_dir):
    return verdict(spark, sf_dir)


@registered(f"SELECT case_id, dimension, coalesce(level, reason) AS finding FROM ({JUDGED[3]}) j WHERE status = 'needs-review' OR (status = 'judged' AND level IN {BAD})")
def findings(spark, sf_dir):
    return judged(spark, sf_dir).where(judgment.is_finding()).select("case_id", "dimension", F.coalesce("level", "reason").alias("finding"))


@registered(f"SELECT case_id, x.verdict AS before, y.verdict AS after FROM ({VERDICT[2]}) x JOIN ({VERDICT[3]}) y USING (case_id) WHERE x.verdict <> y.verdict")
def policy_flip(spark, sf_dir):
    # both policies judge one aggregation of the answers
    both = b.answers(spark, sf_dir)
    x, y = (judgment.verdicts(judgment.judge(both, POLICIES[v]), b.cases(spark, sf_dir)).withColumnRenamed("verdict", n) for v, n in ((2, "before"), (3, "after")))
    return x.join(y, "case_id").where("before <> after")


@registered(f"SELECT count(*) AS judged, coalesce(count(*) FILTER (verdict IN {BAD}) / nullif(count(*), 0)::DOUBLE, 0) AS needs_change_share, coalesce(count(*) FILTER (verdict = 'needs-review') / nullif(count(*), 0)::DOUBLE, 0) AS needs_review_share FROM ({VERDICT[3]}) v")
def headline_shares(spark, sf_dir):
    return judgment.headline(verdict(spark, sf_dir))


@registered(f"SELECT s.position::BIGINT AS position, s.verdict, coalesce(n, 0)::BIGINT AS n FROM (VALUES (0, 'misleading'), (1, 'weak'), (2, 'needs-review'), (3, 'healthy')) s(position, verdict) LEFT JOIN (SELECT verdict, count(*) AS n FROM ({VERDICT[3]}) v GROUP BY verdict) c ON s.verdict = c.verdict")
def status_breakdown(spark, sf_dir):
    return judgment.status_breakdown(verdict(spark, sf_dir))


_BUCKETS = f"SELECT dimension, count(*) AS n, {', '.join(f'count(*) FILTER (({BUCKET}) = {x!r}) AS {x.replace("-", "_")}' for x in reporting.BUCKETS)} FROM ({JUDGED[3]}) j GROUP BY dimension"
_DEFICIENT = f"SELECT *, misleading / n::DOUBLE + weak / n::DOUBLE AS deficient_share FROM ({_BUCKETS}) b"


@registered(_DEFICIENT)
def dimension_buckets(spark, sf_dir):
    return reporting.dimension_buckets(judged(spark, sf_dir))


@registered(f"SELECT dimension, deficient_share, row_number() OVER (ORDER BY deficient_share DESC, misleading + weak DESC, dimension) AS rank FROM ({_DEFICIENT}) d")
def dimensions_ranked(spark, sf_dir):
    return reporting.ranked_dimensions(judged(spark, sf_dir))


def _totals_sql(key: str) -> str:
    return f"SELECT {key} AS folder, count(*) AS n, count(*) FILTER (verdict IN {BAD}) AS bad, count(*) FILTER (verdict = 'needs-review') AS review, count(*) FILTER (verdict IN {BAD}) / count(*)::DOUBLE AS bad_share FROM ({VERDICT[3]}) v JOIN ({b.CASES_SQL}) c ON v.case_id = c.case_id GROUP BY 1"


def totals(spark, sf_dir, depth: int) -> DataFrame:
    return reporting.file_totals(verdict(spark, sf_dir), b.cases(spark, sf_dir), F.substring_index("path", "/", depth))


_FOLDER = "split_part(path, '/', 1)"
_FOLDER2 = "split_part(path, '/', 1) || '/' || split_part(path, '/', 2)"


@registered(f"SELECT * FROM ({_totals_sql(_FOLDER2)}) t WHERE bad > 0 ORDER BY bad DESC, bad_share DESC, folder LIMIT 10")
def top_files(spark, sf_dir):
    return reporting.top_files(totals(spark, sf_dir, 2))


@registered(f"SELECT CASE WHEN r <= 12 THEN folder ELSE 'Other' END AS folder, sum(n)::BIGINT AS n, sum(bad)::BIGINT AS bad, sum(review)::BIGINT AS review FROM (SELECT *, row_number() OVER (ORDER BY n DESC, folder) AS r FROM ({_totals_sql(_FOLDER2)}) t) x GROUP BY 1")
def folders_with_other(spark, sf_dir):
    return reporting.folders_with_other(totals(spark, sf_dir, 2))


_CELLS = f"SELECT {_FOLDER} AS folder, dimension, count(*) AS n, count(*) FILTER (({BUCKET}) IN {BAD}) AS bad, count(*) FILTER (({BUCKET}) IN {BAD}) / count(*)::DOUBLE AS bad_share FROM ({JUDGED[3]}) j JOIN ({b.CASES_SQL}) c ON j.case_id = c.case_id WHERE applicable GROUP BY 1, 2"


def cells(spark, sf_dir):
    return reporting.heat_cells(judged(spark, sf_dir), b.cases(spark, sf_dir), F.substring_index("path", "/", 1))


@registered(_CELLS)
def folder_heatmap(spark, sf_dir):
    return cells(spark, sf_dir)


@registered(f"SELECT folder, string_agg(dimension, ',' ORDER BY r) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY bad_share DESC, bad DESC, dimension) AS r FROM ({_CELLS}) c WHERE bad > 0) x WHERE r <= 3 GROUP BY folder")
def worst_dimensions(spark, sf_dir):
    return reporting.worst_dimensions(cells(spark, sf_dir))


@registered(f"""SELECT c.path, v.case_id, v.verdict, f.findings FROM ({VERDICT[3]}) v JOIN ({b.CASES_SQL}) c ON v.case_id = c.case_id LEFT JOIN (
  SELECT case_id, string_agg(dimension || ':' || coalesce(level, reason), ',' ORDER BY dimension || ':' || coalesce(level, reason)) AS findings FROM ({JUDGED[3]}) j
  WHERE status = 'needs-review' OR (status = 'judged' AND level IN {BAD}) GROUP BY case_id) f ON v.case_id = f.case_id WHERE v.verdict IN {BAD}""")
def worklist(spark, sf_dir):
    return reporting.worklist(judged(spark, sf_dir), verdict(spark, sf_dir), b.cases(spark, sf_dir))


@registered(f"SELECT case_id, path FROM ({b.CASES_SQL}) c WHERE contains(lower(name), 'the') OR contains(lower(name), '1')")
def test_search(spark, sf_dir):
    name = F.lower("name")
    return b.cases(spark, sf_dir).where(name.contains("the") | name.contains("1")).select("case_id", "path")


@registered(f"SELECT *, (SELECT count(*) FROM ({VERDICT[3]}) t) AS total, (SELECT count(*) FROM ({VERDICT[3]}) t) - least(greatest((SELECT count(*) FROM ({VERDICT[3]}) t) - 20, 0), 10) AS omitted FROM ({VERDICT[3]}) v ORDER BY case_id LIMIT 10 OFFSET 20")
def paginate(spark, sf_dir):
    return reporting.page(verdict(spark, sf_dir), [F.col("case_id")], 20, 10)


_RANK = "CASE {0} WHEN 'healthy' THEN 0 WHEN 'needs-review' THEN 1 WHEN 'weak' THEN 2 ELSE 3 END"


@registered(f"""SELECT coalesce(x.case_id, y.case_id) AS case_id, CASE WHEN x.case_id IS NULL THEN 'added' WHEN y.case_id IS NULL THEN 'removed' WHEN {_RANK.format("y.verdict")} < {_RANK.format("x.verdict")} THEN 'improved'
  WHEN {_RANK.format("y.verdict")} > {_RANK.format("x.verdict")} THEN 'regressed' ELSE 'same' END AS change FROM ({VERDICT[2]}) x FULL JOIN ({VERDICT[3]}) y ON x.case_id = y.case_id""")
def status_diff(spark, sf_dir):
    return reporting.status_diff(verdict(spark, sf_dir, 2), verdict(spark, sf_dir))


_LAST = f"SELECT identity, max(id) AS id, arg_max(state, id) AS state, arg_max(value, id) AS value FROM ({b.WORK_SQL}) w GROUP BY identity"
_CACHE = f"SELECT cache_key, max(id) AS source_id, arg_max(value, id) AS value FROM ({b.WORK_SQL}) w WHERE state = 'completed' AND cache_key IS NOT NULL GROUP BY cache_key"


@registered(_LAST)
def last_state(spark, sf_dir):
    return workitems.last_states(b.work_items(spark, sf_dir))


@registered(f"SELECT * FROM ({_LAST}) l WHERE state IN ('completed', 'cached', 'failed')")
def terminal_items(spark, sf_dir):
    return workitems.terminal(b.work_items(spark, sf_dir))


@registered(f"SELECT identity FROM ({_LAST}) l WHERE state NOT IN ('completed', 'cached', 'failed')")
def resume_outstanding(spark, sf_dir):
    return workitems.outstanding(b.work_items(spark, sf_dir))


@registered(f"SELECT w.id, w.cache_key, c.source_id, c.value FROM ({b.WORK_SQL}) w JOIN ({_CACHE}) c ON w.cache_key = c.cache_key WHERE w.state = 'pending'")
def cache_lookup(spark, sf_dir):
    log = b.work_items(spark, sf_dir)
    return workitems.cache_hits(log.where("state = 'pending'"), log)


@registered(f"SELECT count(*) AS items, {', '.join(f'count(*) FILTER (state = {s!r}) AS {s}' for s in ('pending', 'running', 'completed', 'cached', 'failed'))} FROM ({_LAST}) l")
def evaluation_totals(spark, sf_dir):
    return workitems.state_totals(b.work_items(spark, sf_dir))


@registered("SELECT run, recorded, row_number() OVER (ORDER BY recorded DESC, run DESC) <= 5 AS kept FROM (SELECT strftime(o_orderdate, '%Y-%m') AS run, max(o_orderdate) AS recorded FROM orders GROUP BY 1) r")
def retention(spark, sf_dir):
    runs = b.table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("run")).agg(F.max("o_orderdate").alias("recorded"))
    return workitems.retained(runs)


@registered(f"SELECT id, identity, count(*) OVER (PARTITION BY identity ORDER BY epoch_ms(ts) RANGE BETWEEN 86399999 PRECEDING AND CURRENT ROW) AS n FROM ({b.WORK_SQL}) w")
def budget_window_requests(spark, sf_dir):
    return workitems.requests_within(b.work_items(spark, sf_dir), 86400)


@registered(f"""WITH RECURSIVE s AS (SELECT identity AS key, row_number() OVER (PARTITION BY identity ORDER BY id) AS r, CASE WHEN state = 'failed' THEN 'throttled' WHEN state = 'pending' THEN 'neutral' ELSE 'clean' END AS signal FROM ({b.WORK_SQL}) w),
  f AS (SELECT key, 0::BIGINT AS r, 8::BIGINT AS "limit", 0::BIGINT AS streak FROM (SELECT DISTINCT key FROM s) k UNION ALL
    SELECT f.key, s.r, CASE WHEN signal = 'throttled' THEN greatest(1, f."limit" // 2) WHEN signal = 'clean' AND f."limit" < 8 AND streak >= 4 THEN f."limit" + 1 ELSE f."limit" END,
      CASE WHEN signal = 'throttled' THEN 0 WHEN signal = 'neutral' THEN streak WHEN f."limit" >= 8 OR streak >= 4 THEN 0 ELSE streak + 1 END FROM f JOIN s ON s.key = f.key AND s.r = f.r + 1)
  SELECT key, arg_max("limit", r) AS "limit", arg_max(streak, r) AS streak FROM f GROUP BY key""")
def throttle_fold(spark, sf_dir):
    signal = F.when(F.col("state") == "failed", "throttled").when(F.col("state") == "pending", "neutral").otherwise("clean")
    return workitems.throttle_limits(b.work_items(spark, sf_dir).select(F.col("identity").alias("key"), F.col("id").alias("ord"), signal.alias("signal")))


_FRAGMENTS = "SELECT source AS bundle, doc_id AS ord, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents"


def fragments(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select(F.col("source").alias("bundle"), F.col("doc_id").alias("ord"), "text")


# the fragment that overflows is cut after the last line that ends within what is left
@registered("""WITH f AS (SELECT source AS bundle, doc_id AS ord, text, strlen(text) AS n, sum(strlen(text)) OVER (PARTITION BY source ORDER BY doc_id) AS cum FROM documents),
  o AS (SELECT *, min(ord) FILTER (cum > 16384) OVER (PARTITION BY bundle) AS first FROM f),
  c AS (SELECT bundle, ord, 16384 - cum + n AS rest, unnest(range(1, len(string_split(text, chr(10))))) AS k, string_split(text, chr(10)) AS lines FROM o WHERE ord = first),
  l AS (SELECT bundle, ord, max(w) AS w FROM (SELECT bundle, ord, rest, strlen(array_to_string(lines[1:k], chr(10))) + 1 AS w FROM c) x WHERE w <= rest GROUP BY 1, 2)
  SELECT o.bundle, o.ord, CASE WHEN first IS NULL OR o.ord < first THEN 'keep' WHEN w > 0 THEN 'cut' ELSE 'omit' END AS action,
    (CASE WHEN first IS NULL OR o.ord < first THEN n ELSE coalesce(w, 0) END)::BIGINT AS bytes FROM o LEFT JOIN l ON o.bundle = l.bundle AND o.ord = l.ord""")
def budget_fill(spark, sf_dir):
    return evidence.budget_fill(fragments(spark, sf_dir), 16_384)


@registered("""SELECT count(*) AS n, count(*) FILTER (hit) AS cache_hits, sum(n)::BIGINT AS n_bytes, count(*) FILTER (ceil(n / 3.0::DOUBLE) > 2000) AS over_ceiling,
  coalesce(sum(floor(n / 4.8::DOUBLE)) FILTER (NOT hit), 0)::BIGINT AS tokens_min, coalesce(sum(ceil(n / 3.0::DOUBLE)) FILTER (NOT hit), 0)::BIGINT AS tokens_max,
  round(coalesce(sum(floor(n / 4.8::DOUBLE)) FILTER (NOT hit), 0) * 0.042::DOUBLE / 1e6, 9) AS usd_min, round(coalesce(sum(ceil(n / 3.0::DOUBLE)) FILTER (NOT hit), 0) * 2 * 0.042::DOUBLE / 1e6, 9) AS usd_max
  FROM (SELECT strlen(text) AS n, doc_id % 3 = 0 AS hit FROM documents WHERE text IS NOT NULL) d""")
def estimate(spark, sf_dir):
    rows = b.table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.octet_length("text").cast("long").alias("n_bytes"), (F.col("doc_id") % 3 == 0).alias("hit"))
    return evidence.token_estimate(rows, 2000)


@registered("SELECT doc_id, sha256(regexp_replace(text, '\\r\\n?', chr(10), 'g')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", evidence.content_hash(F.col("text")).alias("content_hash"))


@registered(f"""SELECT case_id, 'tc:v1:' || sha256('{{"version":1,"path":' || to_json(path) || ',"ancestry":[{{"kind":"describe","name":' || to_json(brand) || ',"ordinal":0}},{{"kind":"test","name":' || to_json(name) || ',"ordinal":' || (case_id % 4) || '}}],"sourceHash":"' || sha256(name)
  || '","parameter":' || CASE WHEN case_id % 3 = 0 THEN '{{"index":' || (case_id % 5) || ',"valueHash":"' || sha256(brand) || '"}}' ELSE 'null' END || '}}') AS identity FROM (SELECT *, split_part(path, '/', 1) AS brand FROM ({b.CASES_SQL}) c) x""")
def case_identity(spark, sf_dir):
    brand, step = F.split_part("path", F.lit("/"), F.lit(1)), lambda k, n, o: F.struct(F.lit(k).alias("kind"), n.alias("name"), o.cast("int").alias("ordinal"))
    ancestry = F.array(step("describe", brand, F.lit(0)), step("test", F.col("name"), F.col("case_id") % 4))
    parameter = F.when(F.col("case_id") % 3 == 0, F.struct((F.col("case_id") % 5).cast("int").alias("index"), F.sha2(brand, 256).alias("valueHash")))
    return b.cases(spark, sf_dir).select("case_id", evidence.case_identity(F.col("path"), ancestry, F.sha2("name", 256), parameter).alias("identity"))


def _text(x: str) -> str:
    """A SQL literal; DuckDB takes backslashes as they are."""
    return "'" + x.replace("'", "''") + "'"


_GLOBS = {"**/en/*": "^(.*/)?en/[^/]*$", "*.html": "(^|/)[^/]*\\.html$", "*example.{com,net}/**": "^[^/]*example\\.(com|net)/.*$", "**/en/**": "^(.*/)?en/.*$", "m.?asino*/{e": "^m\\.[^/]asino[^/]*/\\{e$"}


# the expressions are written by hand, not made by the operator
@registered(f"SELECT page_id, {', '.join(f'regexp_matches(path, {_text(r)}) AS g{i}' for i, r in enumerate(_GLOBS.values()))} FROM ({b.PATHS_SQL}) p")
def glob_match(spark, sf_dir):
    return b.paths(spark, sf_dir).select("page_id", *[evidence.matches_glob(F.col("path"), g).alias(f"g{i}") for i, g in enumerate(_GLOBS)])


_ODD_PATHS = ("src/a.map", "x/.env.local", "dist", "src/build", "src/build/x.js", "a/secrets/k", "node_modules/m/i.js", "lib/x.d.ts", "id_rsa.pub", "a/b.min.js", "src/ok.ts", "coverage/x", "a/.git/config", "k.pem")
_ODD_SQL = "[" + ", ".join(f"'{x}'" for x in _ODD_PATHS) + "][page_id % 15]"


@registered(f"""SELECT page_id, CASE WHEN regexp_matches(path, '(^|/)[.]env[^/]*$') THEN 'deny-list:.env*' WHEN regexp_matches(path, '[.]pem$') THEN 'deny-list:*.pem' WHEN regexp_matches(path, '[.]key$') THEN 'deny-list:*.key'
  WHEN regexp_matches(path, '[.]p12$') THEN 'deny-list:*.p12' WHEN regexp_matches(path, '[.]pfx$') THEN 'deny-list:*.pfx' WHEN regexp_matches(path, '(^|/)id_rsa[^/]*$') THEN 'deny-list:id_rsa*' WHEN regexp_matches(path, '(^|/)secrets/') THEN 'deny-list:**/secrets/**'
  WHEN regexp_matches(path, '(^|/)[.]git/') THEN 'deny-list:**/.git/**' WHEN regexp_matches(path, '(^|/)node_modules/') THEN 'deny-list:**/node_modules/**' WHEN regexp_matches(path, '(^|/)dist/') THEN 'deny-list:**/dist/**' WHEN regexp_matches(path, '(^|/)build/') THEN 'deny-list:**/build/**'
  WHEN regexp_matches(path, '(^|/)coverage/') THEN 'deny-list:**/coverage/**' WHEN regexp_matches(path, '(^|/)vendor/') THEN 'deny-list:**/vendor/**' WHEN regexp_matches(path, '[.]min[.]js$') THEN 'deny-list:*.min.js' WHEN regexp_matches(path, '[.]map$') THEN 'deny-list:*.map'
  WHEN regexp_matches(path, '[.]d[.]ts$') THEN 'deny-list:*.d.ts' WHEN regexp_matches(path, '[.]html$') THEN 'deny-list:*.html' END AS rule FROM (SELECT page_id, coalesce({_ODD_SQL}, path) AS path FROM ({b.PATHS_SQL}) p) x""")
def deny_rule(spark, sf_dir):
    odd = F.get(F.array(*[F.lit(x) for x in _ODD_PATHS]), (F.col("page_id") % 15 - 1).cast("int"))
    return b.paths(spark, sf_dir).select("page_id", evidence.denied_by(F.coalesce(odd, F.col("path")), (*evidence.DENIED, "*.html")).alias("rule"))


_SPEC_SQL = "CASE page_id % 5 WHEN 0 THEN './' WHEN 1 THEN '@/' WHEN 2 THEN '@s/' WHEN 3 THEN '#' ELSE '' END || path"


def specifiers(spark, sf_dir):
    lead = F.element_at(F.array(*[F.lit(x) for x in ("./", "@/", "@s/", "#", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    return b.paths(spark, sf_dir).select("page_id", F.concat(lead, "path").alias("specifier"))


@registered(f"SELECT page_id, CASE WHEN regexp_matches(s, '^\\.{{1,2}}(/|$)|^/') THEN 'relative' WHEN regexp_matches(s, '^(@/|~/|#)') THEN 'alias' ELSE 'bare' END AS class FROM (SELECT page_id, {_SPEC_SQL} AS s FROM ({b.PATHS_SQL}) p) x")
def specifier_class(spark, sf_dir):
    return specifiers(spark, sf_dir).select("page_id", evidence.specifier_class(F.col("specifier")).alias("class"))


_PATTERNS = [("@/*", 0, 0), ("@s/*", 0, 1), ("#*", 1, 2), ("@s/blog.*", 0, 3), ("*", 2, 4)]


@registered(f"""SELECT specifier, pattern FROM (SELECT *, row_number() OVER (PARTITION BY specifier ORDER BY source, -length(prefix), ord) AS r FROM (SELECT DISTINCT {_SPEC_SQL} AS specifier FROM ({b.PATHS_SQL}) p) s
  JOIN (SELECT *, split_part(pattern, '*', 1) AS prefix FROM (VALUES {', '.join(str(x) for x in _PATTERNS)}) v(pattern, source, ord)) a ON starts_with(specifier, prefix)) x WHERE r = 1""")
def alias_match(spark, sf_dir):
    return evidence.alias_matches(specifiers(spark, sf_dir).select("specifier"), spark.createDataFrame(_PATTERNS, "pattern string, source int, ord int"))


# leads with .., a root, a drive, backslashes; null where the path leaves the root or is none
@registered(f"SELECT page_id, CASE page_id % 7 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 'x/y/' || p ELSE p END AS path FROM (SELECT page_id, array_to_string(list_filter(string_split(path, '/'), lambda x: x NOT IN ('', '.')), '/') AS p FROM ({b.PATHS_SQL}) p) q")
def path_normalize(spark, sf_dir):
    leads = F.array(*[F.lit(x) for x in ("a/../", "./", "/", "C:", "..\\", "x//y\\", "")])
    return b.paths(spark, sf_dir).select("page_id", evidence.normal_path(F.concat(F.get(leads, (F.col("page_id") % 7).cast("int")), "path")).alias("path"))


_FILE = "CASE WHEN x % 3 = 0 THEN 'tests/f' || x WHEN x % 7 = 1 THEN 'src/setup' || x ELSE 'src/f' || x END || '.ts'"
_EDGES = f"SELECT DISTINCT {_FILE.replace('x', 'a').replace('src/f', 'src/f')} AS a, {_FILE.replace('x', 'b')} AS b, './s' || (b % 4) AS specifier FROM (SELECT l_suppkey AS a, (l_partkey * 7 + l_orderkey) % 97 + l_suppkey // 10 AS b FROM lineitem) n"


@registered(f"""WITH e AS (SELECT * FROM ({_EDGES}) z WHERE a <> b), h AS (SELECT a AS start, b AS target, 1 AS hop, a AS importer, specifier FROM e UNION ALL
  SELECT x.a, y.b, 2, y.a, y.specifier FROM e x JOIN e y ON x.b = y.a WHERE regexp_matches(x.b, '^tests/|setup'))
  SELECT start, target, hop::BIGINT AS hop, importer, specifier FROM (SELECT *, row_number() OVER (PARTITION BY start, target ORDER BY hop, importer, specifier) AS r FROM h WHERE start <> target) q WHERE r = 1""")
def two_hop(spark, sf_dir):
    # imports stand as edges between suppliers' numbers
    file = lambda x: F.concat(F.when(F.col(x) % 3 == 0, "tests/f").when(F.col(x) % 7 == 1, "src/setup").otherwise("src/f"), F.col(x).cast("string"), F.lit(".ts"))
    numbers = b.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey AS a", "(l_partkey * 7 + l_orderkey) % 97 + l_suppkey div 10 AS b")
    return evidence.two_hops(numbers.select(file("a").alias("a"), file("b").alias("b"), F.concat(F.lit("./s"), (F.col("b") % 4).cast("string")).alias("specifier")))


@registered("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def dedupe_first(spark, sf_dir):
    return evidence.first_by(b.table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@registered("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS ordinal FROM conversations")
def sibling_ordinal(spark, sf_dir):
    return evidence.ordinals(b.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), ["conv_id", "role"], ["turn"])


@registered("SELECT doc_id, CASE WHEN (length(text) - length(replace(text, ' the ', ''))) = 5 THEN replace(text, ' the ', ' a ') END AS changed FROM documents")
def occurrence_replace(spark, sf_dir):
    return b.table(spark, sf_dir, "documents").select("doc_id", evidence.replace_once(F.col("text"), " the ", " a ").alias("changed"))


_VOTES = f"SELECT dimension, case_id, prescriptive, t, f, CASE WHEN t > f THEN true WHEN f > t THEN false END AS deficient FROM (SELECT dimension, case_id, prescriptive, count(*) FILTER (level IN {BAD}) AS t, count(*) FILTER (level NOT IN {BAD}) AS f FROM ({SAMPLES}) s WHERE status = 'judged' GROUP BY 1, 2, 3) v"
_MATRIX = f"SELECT dimension, count(*) FILTER (deficient AND NOT prescriptive) AS tp, count(*) FILTER (deficient AND prescriptive) AS fp, count(*) FILTER (NOT deficient AND NOT prescriptive) AS fn, count(*) FILTER (NOT deficient AND prescriptive) AS tn, count(*) FILTER (deficient IS NULL) AS split FROM ({_VOTES}) v GROUP BY dimension"


@registered(_VOTES)
def majority_votes(spark, sf_dir):
    return benchmark.votes(samples(spark, sf_dir))


@registered(_MATRIX)
def confusion(spark, sf_dir):
    return benchmark.confusion(benchmark.votes(samples(spark, sf_dir)))


def _rate_sql(n: str, d: str, name: str) -> str:
    return f"CASE WHEN {d} > 0 THEN ({n}) / ({d})::DOUBLE END AS {name}, CASE WHEN {d} = 0 THEN 'not-computable' WHEN {d} < 5 THEN 'below-minimum' ELSE 'computed' END AS {name}_kind"


@registered(f"SELECT dimension, CASE WHEN fp + tn > 0 THEN precision END AS precision, CASE WHEN fp + tn > 0 THEN precision_kind ELSE 'not-computable' END AS precision_kind, recall, recall_kind, fpr, fpr_kind FROM (SELECT *, {_rate_sql('tp', 'tp + fp', 'precision')}, {_rate_sql('tp', 'tp + fn', 'recall')}, {_rate_sql('fp', 'fp + tn', 'fpr')} FROM ({_MATRIX}) m) r")
def rates(spark, sf_dir):
    return benchmark.rates(benchmark.confusion(benchmark.votes(samples(spark, sf_dir))))


@registered(f"SELECT dimension, count(*) AS n, count(*) FILTER (status = 'needs-review') AS review, count(*) FILTER (status = 'needs-review') / count(*)::DOUBLE AS review_share FROM ({SAMPLES}) s WHERE proven AND status <> 'not-applicable' GROUP BY dimension")
def routing(spark, sf_dir):
    return benchmark.routing(samples(spark, sf_dir))


@registered(f"SELECT dimension, count(*) AS n, round(avg(pow(m - CASE WHEN prescriptive THEN 0 ELSE 1 END, 2)), 9) AS brier FROM (SELECT dimension, case_id, prescriptive, avg(deficient_mass) AS m FROM ({SAMPLES}) s WHERE deficient_mass IS NOT NULL GROUP BY 1, 2, 3) c GROUP BY dimension")
def calibration(spark, sf_dir):
    return benchmark.calibration(samples(spark, sf_dir))


@registered(f"SELECT dimension, (sum(a) // 2)::BIGINT AS agreeing, (sum(n * (n - 1)) // 2)::BIGINT AS pairs FROM (SELECT dimension, case_id, sum(c) AS n, sum(c * (c - 1)) AS a FROM (SELECT dimension, case_id, CASE WHEN status = 'judged' THEN 'judged:' || level ELSE status END AS k, count(*) AS c FROM ({SAMPLES}) s GROUP BY 1, 2, 3) x GROUP BY 1, 2) y GROUP BY dimension")
def stability(spark, sf_dir):
    return benchmark.stability(samples(spark, sf_dir))


def _outcomes_sql(version: int) -> str:
    return f"SELECT c.case_id, v.verdict, prescriptive, proven FROM ({b.CASES_SQL}) c LEFT JOIN ({VERDICT[version]}) v ON c.case_id = v.case_id"


@registered(f"""SELECT coalesce(x.case_id, y.case_id) AS case_id, CASE WHEN x.case_id IS NULL THEN 'missing-in-baseline' WHEN y.case_id IS NULL THEN 'missing-in-candidate' WHEN x.prescriptive <> y.prescriptive THEN 'fixture-changed'
  WHEN NOT x.proven THEN 'unproven-in-baseline' WHEN NOT y.proven THEN 'unproven-in-candidate' WHEN x.verdict IS NULL THEN 'not-sampled-in-baseline' WHEN y.verdict IS NULL THEN 'not-sampled-in-candidate'
  WHEN x.verdict = y.verdict THEN 'agreement' WHEN (x.verdict = 'healthy') = x.prescriptive AND (y.verdict = 'healthy') <> y.prescriptive THEN 'regression' ELSE 'disagreement' END AS outcome
  FROM ({_outcomes_sql(2)}) x FULL JOIN ({_outcomes_sql(3)}) y ON x.case_id = y.case_id""")
def compare_runs(spark, sf_dir):
    run = lambda v: b.cases(spark, sf_dir).join(verdict(spark, sf_dir, v), "case_id", "left")
    return benchmark.compare(run(2), run(3))


@registered(f"SELECT case_id, dimension, row_number() OVER (PARTITION BY dimension ORDER BY case_id) AS round FROM ({JUDGED[3]}) j WHERE status = 'needs-review'")
def stratified(spark, sf_dir):
    rows = judged(spark, sf_dir).where("status = 'needs-review'").select("case_id", "dimension")
    return benchmark.stratified(rows, ["case_id"])


@registered("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def json_props(spark, sf_dir):
    return b.table(spark, sf_dir, "events").select("event_id", "event_type", F.get_json_object("props", "$.k").alias("k"))


@registered(f"""WITH RECURSIVE f AS (SELECT split_part(path, '/', 1) AS folder, split_part(path, '/', 2) AS file, count(*) AS n FROM ({b.CASES_SQL}) c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY file) AS k FROM f),
  s AS (SELECT folder, file, k, 0::BIGINT AS chunk, n AS total FROM r WHERE k = 1 UNION ALL SELECT r.folder, r.file, r.k, CASE WHEN total > 0 AND total + n > 40 THEN chunk + 1 ELSE chunk END, CASE WHEN total > 0 AND total + n > 40 THEN n ELSE total + n END FROM s JOIN r ON r.folder = s.folder AND r.k = s.k + 1)
  SELECT folder, file, chunk FROM s""")
def batches(spark, sf_dir):
    """Files of each folder in chunks of at most 40 cases."""
    files = b.cases(spark, sf_dir).groupBy(F.substring_index("path", "/", 1).alias("folder"), F.element_at(F.split("path", "/"), 2).alias("file")).agg(F.count("*").alias("n"))
    return batching.chunks(files, 40)


from . import batched, configured, corpora, kept, linked, more, nested, requested, scanned, trees, varied  # noqa: E402, F401  # register their queries
