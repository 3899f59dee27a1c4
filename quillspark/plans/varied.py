"""Registered queries over tables in which every branch of a rule occurs, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import capped_list
from ..operators import audit, benchmark, evidence, judgment, reporting, resume, review
from . import bindings as b
from .catalog import ORACLE, RUNS, SAMPLES, VERDICT, registered, samples, verdict
from .configured import _DIR, _FILE
from .more import _MEANS, means

# answers whose shares are off by a little, by more, below 0, missing or no number
_P0 = "CASE case_id % 6 WHEN 0 THEN p0 + 0.0195 WHEN 1 THEN p0 + 0.03 WHEN 2 THEN -0.1 WHEN 3 THEN NULL WHEN 4 THEN CAST('NaN' AS DOUBLE) ELSE p0 END"


@registered(ORACLE["quartet_validate"].replace(b.ANSWERS_SQL, f"SELECT case_id, dimension, {_P0} AS p0, p1, p2, p3 FROM ({b.ANSWERS_SQL}) o"))
def quartet_boundaries(spark, sf_dir):
    return b.answers(spark, sf_dir).withColumn("p0", F.expr(_P0)).select("case_id", "dimension", judgment.quartet_valid().alias("valid"))


# few cases are sampled for the sixth dimension, and only descriptive ones for the seventh; nothing for the third
_SAMPLED = f"NOT (dimension = '{b.DIMENSIONS[5]}' AND case_id % 500 <> 1) AND NOT (dimension = '{b.DIMENSIONS[6]}' AND prescriptive) AND dimension <> '{b.DIMENSIONS[2]}'"
_FEW = f"SELECT * FROM ({SAMPLES}) f WHERE {_SAMPLED}"


def _of_few(name: str) -> str:
    return ORACLE[name].replace(SAMPLES, _FEW)


@registered(_of_few("rates"))
def rates_few(spark, sf_dir):
    return benchmark.rates(benchmark.confusion(benchmark.votes(samples(spark, sf_dir).where(_SAMPLED))))


@registered(f"""SELECT (list_position({b.DIMENSION_SQL}, d.dimension) - 1)::BIGINT AS position, d.dimension, tp, fp, fn, tn, split, precision, precision_kind, recall, recall_kind, fpr, fpr_kind, c.n AS calibrated, brier, r.n AS routed, review, review_share, agreeing, pairs, m.n AS priced, usd, ms, kind
FROM (SELECT unnest({b.DIMENSION_SQL}) AS dimension) d LEFT JOIN ({_of_few('confusion')}) x USING (dimension) LEFT JOIN ({_of_few('rates')}) y USING (dimension) LEFT JOIN ({_of_few('calibration')}) c USING (dimension)
LEFT JOIN ({_of_few('routing')}) r USING (dimension) LEFT JOIN ({_of_few('stability')}) s USING (dimension) LEFT JOIN ({_MEANS}) m USING (dimension)""")
def metrics_all(spark, sf_dir):
    # one aggregation of the samples gives the votes, from which confusion and rates follow
    few = samples(spark, sf_dir).where(_SAMPLED)
    matrix = benchmark.confusion(benchmark.votes(few))
    named = lambda df, **names: df.withColumnsRenamed(names)
    tables = (matrix, benchmark.rates(matrix), named(benchmark.calibration(few), n="calibrated"), named(benchmark.routing(few), n="routed"), benchmark.stability(few), named(means(spark, sf_dir), n="priced"))
    return review.full_metrics(b.DIMENSIONS, *tables)


# few samples of the fifth dimension
_SOME = "l_linenumber <> 4 AND (l_linenumber <> 5 OR l_orderkey < 4)"


@registered(f"""SELECT {b.DIMENSION_SQL}[l_linenumber] AS dimension, count(*) AS n, round(avg(floor(l_extendedprice) * 0.042 / 1e6), 9) AS usd, avg(l_suppkey) AS ms, CASE WHEN count(*) < 5 THEN 'below-minimum' ELSE 'computed' END AS kind FROM lineitem WHERE {_SOME} GROUP BY 1""")
def cost_latency_few(spark, sf_dir):
    rows = b.table(spark, sf_dir, "lineitem").where(_SOME).select(b.dimension_id(F.col("l_linenumber")).alias("dimension"), F.floor("l_extendedprice").alias("tokens"), F.col("l_suppkey").alias("ms"))
    return review.sampled_means(rows).withColumn("usd", F.round("usd", 9))


_LAST_RUN = "(SELECT max(run) FROM runs)"


@registered(f"""WITH runs AS MATERIALIZED (SELECT run, case_id, dimension, coalesce(level, status) AS s FROM ({RUNS}) r)
SELECT coalesce(x.case_id, y.case_id) AS case_id, coalesce(x.dimension, y.dimension) AS dimension, x.s AS before, y.s AS after
FROM (SELECT * FROM runs WHERE run = {_LAST_RUN} - 1) x FULL JOIN (SELECT * FROM runs WHERE run = {_LAST_RUN}) y ON x.case_id = y.case_id AND x.dimension = y.dimension WHERE x.s IS DISTINCT FROM y.s""")
def diff_last_runs(spark, sf_dir):
    """The newest run that has rows, and the one before."""
    runs = judgment.judge(b.run_answers(spark, sf_dir), judgment.V3)
    last = b.table(spark, sf_dir, "lineitem").agg(F.year(F.max("l_shipdate")).alias("y")).first()["y"]
    return reporting.dimension_diff(runs.where(F.col("run") == last - 1), runs.where(F.col("run") == last))


@registered(ORACLE["status_diff"].replace(f"({VERDICT[2]}) x", f"(SELECT * FROM ({VERDICT[2]}) x0 WHERE case_id % 13 <> 0) x").replace(f"({VERDICT[3]}) y", f"(SELECT * FROM ({VERDICT[3]}) y0 WHERE case_id % 17 <> 0) y"))
def status_diff_runs(spark, sf_dir):
    """Two runs of which each lacks cases of the other."""
    return reporting.status_diff(verdict(spark, sf_dir, 2).where("case_id % 13 <> 0"), verdict(spark, sf_dir).where("case_id % 17 <> 0"))


# a customer's orders are the outcomes of a run; some were not sampled
_POLICY = "CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 5 = 1 THEN o_orderkey % 2 + 2 ELSE 3 END"
_MODEL = "CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 7 = 1 THEN concat('m', o_orderkey % 3) ELSE 'm1' END"


@registered(f"""SELECT c_custkey AS run, CASE WHEN count(p) = 0 THEN 'none' WHEN count(DISTINCT p) = 1 THEN min(p) || '/r' ELSE 'mixed' END AS identity, CASE WHEN count(DISTINCT m) = 1 THEN min(m) WHEN count(DISTINCT m) > 1 THEN 'mixed' END AS model
FROM customer LEFT JOIN (SELECT o_custkey, ({_POLICY})::VARCHAR AS p, {_MODEL} AS m FROM orders) o ON o_custkey = c_custkey GROUP BY 1""")
def version_identities(spark, sf_dir):
    outcomes = b.table(spark, sf_dir, "orders").selectExpr("o_custkey AS run", f"{_POLICY} AS policy", "'r' AS rubric", f"{_MODEL} AS model")
    return resume.version_identities(b.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run")), outcomes)


_PINNED, _JUDGED = "event_id % 5 <> 0", "event_id % 7 <> 0"


@registered(f"""SELECT cache_key, max(id) AS item, arg_max('m' || id % 3, id) AS model, arg_max('c' || id, id) AS classification FROM ({b.WORK_SQL}) w
WHERE state = 'completed' AND cache_key IS NOT NULL AND id % 5 <> 0 AND id % 4 <> 1 AND id % 7 <> 0 GROUP BY 1""")
def cached_judgments(spark, sf_dir):
    events = b.table(spark, sf_dir, "events")
    attempts = events.where(_PINNED).selectExpr("event_id AS item", "concat('m', event_id % 3) AS model", "event_id % 4 <> 1 AS pinned")
    judgments = events.where(_JUDGED).selectExpr("event_id AS item", "concat('c', event_id) AS classification")
    return resume.cached_judgments(b.work_items(spark, sf_dir), attempts, judgments)


@registered("""SELECT o_orderkey AS request, CASE WHEN c_custkey IS NULL THEN 'not-found' WHEN c_custkey % 9 = 0 THEN 'legacy-root' WHEN o_orderkey % 4 = 0 THEN 'root-mismatch' WHEN c_custkey % 2 = 0 THEN 'finished' ELSE 'resumed' END AS outcome
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 11 <> 0""")
def resume_checks(spark, sf_dir):
    runs = b.table(spark, sf_dir, "customer").where("c_custkey % 11 <> 0").selectExpr("c_custkey AS run", "concat('/r', c_custkey) AS root", "c_custkey % 9 <> 0 AS canonical", "c_custkey % 2 = 0 AS finished")
    asked = b.table(spark, sf_dir, "orders").selectExpr("o_orderkey AS request", "o_custkey AS run", "CASE WHEN o_orderkey % 4 = 0 THEN '/other' ELSE concat('/r', o_custkey) END AS root")
    return resume.resume_checks(asked, runs)


@registered("SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'reused' ELSE o_orderstatus END AS state FROM orders")
def merged_outcomes(spark, sf_dir):
    orders = b.table(spark, sf_dir, "orders")
    row = lambda where, state: orders.where(where).select(F.col("o_orderkey").alias("ord"), state.alias("state"))
    return audit.merged_in_order(row("o_orderkey % 3 = 0", F.lit("reused")), row("o_orderkey % 3 <> 0", F.col("o_orderstatus")))


CUT = 300
_HEAD = f"substr(text, 1, {CUT})"
_LINES = f"list_max(list_filter(generate_series(1, length(h)), lambda i: strlen(substr(h, 1, i)) <= {CUT} AND substr(h, i, 1) = chr(10)))"
_BYTES = f"list_max(list_filter(generate_series(0, length(h)), lambda i: strlen(substr(h, 1, i)) <= {CUT}))"


@registered(f"""SELECT doc_id, strlen(content)::INT AS bytes, md5(content) AS content FROM (SELECT doc_id, CASE WHEN strlen(text) <= {CUT} THEN text ELSE substr(h, 1, coalesce({_LINES}, {_BYTES})) END AS content FROM (SELECT doc_id, text, {_HEAD} AS h FROM documents) d) c""")
def truncated_texts(spark, sf_dir):
    cut = evidence.cut_text(F.col("text"), CUT)
    return b.table(spark, sf_dir, "documents").select("doc_id", cut.alias("c")).select("doc_id", F.octet_length("c").alias("bytes"), F.md5(F.col("c").cast("binary")).alias("content"))


@registered("SELECT brand, array_to_string(CASE WHEN len(names) > 20 THEN list_append(names[:20], (len(names) - 20) || ' more') ELSE names END, ',') AS names FROM (SELECT p_brand AS brand, list(p_name ORDER BY p_name, p_partkey) AS names FROM part GROUP BY 1) p")
def capped_names(spark, sf_dir):
    listed = F.transform(F.sort_array(F.collect_list(F.struct("p_name", "p_partkey"))), lambda x: x["p_name"])
    rows = b.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(listed.alias("names"))
    return rows.select("brand", F.array_join(capped_list(F.col("names")), ",").alias("names"))


# patterns of aliases: exact ones, stars in the middle and at the end, two stars, and one that takes all
_PATTERNS = ((0, "/b"), (1, "/*"), (2, "/*.css"), (3, "/x/*"), (4, "/*/*"))
_SPECIFIER = "concat('@n', o_custkey % 30, CASE o_orderkey % 5 WHEN 0 THEN '/b' WHEN 1 THEN '/x/y.css' WHEN 2 THEN '/z' WHEN 3 THEN '/.css' ELSE '' END)"
PATTERNS = " UNION ALL ".join(f"SELECT '@n' || n_nationkey || '{p}' AS pattern, CASE WHEN n_nationkey % 6 = 0 AND {i} = 3 THEN 0 ELSE 1 END AS source, n_nationkey * 10 + {i} AS ord FROM nation" for i, p in _PATTERNS) + " UNION ALL SELECT '*', 2, 0"


@registered(f"""SELECT specifier, arg_min(pattern, (source, NOT exact, -length(prefix), ord)) AS pattern FROM (
  SELECT DISTINCT specifier, pattern, source, ord, exact, prefix FROM (SELECT {_SPECIFIER} AS specifier FROM orders) s JOIN (SELECT *, strpos(pattern, '*') = 0 AS exact, split_part(pattern, '*', 1) AS prefix, CASE WHEN strpos(pattern, '*') > 0 THEN split_part(pattern, '*', 2) ELSE '' END AS suffix FROM ({PATTERNS}) p WHERE length(pattern) - length(replace(pattern, '*', '')) < 2) q
  ON CASE WHEN exact THEN specifier = pattern ELSE starts_with(specifier, prefix) AND ends_with(specifier, suffix) AND length(specifier) >= length(prefix) + length(suffix) END) m GROUP BY specifier""")
def alias_precedence(spark, sf_dir):
    nation = b.table(spark, sf_dir, "nation")
    made = None
    for i, p in _PATTERNS:
        rows = nation.selectExpr(f"concat('@n', n_nationkey, '{p}') AS pattern", f"CASE WHEN n_nationkey % 6 = 0 AND {i} = 3 THEN 0 ELSE 1 END AS source", f"CAST(n_nationkey * 10 + {i} AS INT) AS ord")
        made = rows if made is None else made.unionByName(rows)
    every = b.table(spark, sf_dir, "region").where("r_regionkey = 0").selectExpr("'*' AS pattern", "2 AS source", "0 AS ord")
    return evidence.alias_matches(b.table(spark, sf_dir, "orders").selectExpr(f"{_SPECIFIER} AS specifier"), made.unionByName(every))


# packages with evidence of runners, in their scripts, dependencies, keys and the files beside them
_PACKAGES = ('{"scripts": {"test": "jest --ci"}}', '{"jest": {}, "devDependencies": {"@vitest/ui": "1"}}', '{"jest": null, "scripts": {"test": "node run.js"}}', '{"scripts": {"test": "bun  test"}, "jest": {"a": 1}}', '{"name": "plain"}', "{", '{"scripts": {"test": "vitest run"}}', '{"jest": true, "dependencies": {"left": "1"}}')
_KIND = "c_custkey % 8"
_HINT = f"CASE WHEN {_KIND} = 5 THEN NULL WHEN {_KIND} IN (1, 3, 6) OR c_custkey % 3 = 1 THEN NULL WHEN {_KIND} IN (0, 7) OR c_custkey % 3 = 2 THEN 'jest' END"


@registered(f"SELECT DISTINCT path, {_HINT} AS hint FROM (SELECT {_FILE} AS path, CASE WHEN o_orderkey % 10 <> 0 THEN o_custkey END AS k FROM orders) f LEFT JOIN customer ON c_custkey = k")
def framework_hints(spark, sf_dir):
    customer = b.table(spark, sf_dir, "customer")
    at = lambda name: F.concat(F.expr(_DIR), F.lit(f"/{name}"))
    package = customer.select(at("package.json").alias("path"), F.get(F.array(*[F.lit(p) for p in _PACKAGES]), F.expr(f"CAST({_KIND} AS INT)")).alias("text"))
    beside = [customer.where(w).select(at(n).alias("path"), F.lit("").alias("text")) for w, n in (("c_custkey % 3 = 1", "vitest.config.ts"), ("c_custkey % 3 = 2", "jest.config.cjs"))]
    return resume.framework_hints(b.table(spark, sf_dir, "orders").selectExpr(f"{_FILE} AS path"), package.unionByName(beside[0]).unionByName(beside[1]))


@registered(f"SELECT c.case_id, verdict, name, operator FROM ({VERDICT[3]}) v JOIN ({b.CASES_SQL}) c ON c.case_id = v.case_id WHERE verdict <> 'healthy'")
def selected_cases(spark, sf_dir):
    selected = verdict(spark, sf_dir).where("verdict <> 'healthy'").select("case_id", "verdict")
    return resume.selected_cases(selected, b.cases(spark, sf_dir).select("case_id", "name", "operator"))
