"""Entities of the audit bound to the star-schema tables by deterministic expressions; each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rubric's dimensions in order.
DIMENSIONS = ("falsifiability", "behavioral-focus", "refactor-resistance", "assertion-strength", "test-double-quality", "determinism-isolation", "diagnostic-quality")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dimension_id(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in DIMENSIONS]), n)


DIMENSION_SQL = "[" + ", ".join(f"'{x}'" for x in DIMENSIONS) + "]"


def _answered(lines: DataFrame, keys: list[str]) -> DataFrame:
    q = F.col("l_quantity")
    share = lambda c: F.count_if(c) / F.count("*")
    rows = lines.groupBy(*keys).agg(
        share(F.col("l_returnflag") != "R").alias("applicability"),
        share(q <= 12).alias("p0"), share((q > 12) & (q <= 25)).alias("p1"), share((q > 25) & (q <= 38)).alias("p2"), share(q > 38).alias("p3"),
    )
    return rows.withColumns({"score": F.col("p1") + 2 * F.col("p2") + 3 * F.col("p3"), "confidence": F.greatest("p0", "p1", "p2", "p3")})


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, dimension, applicability, p0..p3, score, confidence."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("case_id"), dimension_id(F.col("l_linenumber")).alias("dimension"), "l_quantity", "l_returnflag")
    return _answered(lines, ["case_id", "dimension"])


def run_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for each run, a year of shipping."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("run"), F.col("l_partkey").alias("case_id"), dimension_id(F.col("l_linenumber")).alias("dimension"), "l_quantity", "l_returnflag")
    return _answered(lines, ["run", "case_id", "dimension"])


def _answers_sql(extra: str, keys: str) -> str:
    n = "count(*)::DOUBLE"
    return f"""SELECT *, p1 + 2 * p2 + 3 * p3 AS score, greatest(p0, p1, p2, p3) AS confidence FROM (
      SELECT {extra} l_partkey AS case_id, {DIMENSION_SQL}[l_linenumber] AS dimension,
        count(*) FILTER (l_returnflag <> 'R') / {n} AS applicability, count(*) FILTER (l_quantity <= 12) / {n} AS p0,
        count(*) FILTER (l_quantity > 12 AND l_quantity <= 25) / {n} AS p1, count(*) FILTER (l_quantity > 25 AND l_quantity <= 38) / {n} AS p2,
        count(*) FILTER (l_quantity > 38) / {n} AS p3 FROM lineitem GROUP BY {keys}) a"""


ANSWERS_SQL = _answers_sql("", "1, 2")
RUN_ANSWERS_SQL = _answers_sql("year(l_shipdate)::BIGINT AS run,", "1, 2, 3")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id, name, path, pinned, operator, prescriptive, proven."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("case_id"), F.col("p_name").alias("name"), F.concat_ws("/", "p_brand", "p_type", "p_name").alias("path"),
        (F.col("p_size") % 17 != 0).alias("pinned"), (F.col("p_size") % 8).cast("long").alias("operator"),
        (F.col("p_partkey") % 2 == 0).alias("prescriptive"), (F.col("p_size") % 11 != 0).alias("proven"),
    )


CASES_SQL = "SELECT p_partkey AS case_id, p_name AS name, p_brand || '/' || p_type || '/' || p_name AS path, p_size % 17 <> 0 AS pinned, (p_size % 8)::BIGINT AS operator, p_partkey % 2 = 0 AS prescriptive, p_size % 11 <> 0 AS proven FROM part"

# The states that the event types stand for.
STATES = {"view": "pending", "click": "running", "purchase": "completed", "signup": "cached", "error": "failed"}


def work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, identity, state, cache_key, value: an append-only log."""
    state = F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in STATES.items()])
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("identity"), state.alias("state"), F.get_json_object("props", "$.k").alias("cache_key"), "value", "ts")


STATE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATES.items()) + " END"
WORK_SQL = f"SELECT event_id AS id, user_id AS identity, {STATE_SQL} AS state, json_extract_string(props, '$.k') AS cache_key, value, ts FROM events"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, path: urls without scheme, query and fragment."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", r"^[a-z]+://|[?#].*$", "").alias("path"))


PATHS_SQL = "SELECT page_id, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS path FROM pages"
