"""Registered queries of module references, paired answers and drilled heat maps, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import judgment, reporting
from ..sources import repository
from . import bindings as b
from .batched import _PATH
from .catalog import BAD, BUCKET, JUDGED, judged, registered

# what a page's file says, by its number: (where, text, specifier, kind); names that begin with no stand in comments and strings
_LINES = (
    ("true", "// import a from 'no1'\n/* require('no2')\n import 'no2b' */\nconst s = \"from 'no3'\", e = 'it\\'s from \"no4\"';\n", None, None),
    ("page_id % 2 = 0", "import x, {y} from 'm';\n", "m", "import"), ("page_id % 3 = 0", "export * from \"./e\";\n", "./e", "export"), ("page_id % 4 = 0", "import 'side'\n", "side", "import"),
    ("page_id % 5 = 0", "const l = await import( /* c */ './dyn' );\n", "./dyn", "dynamic"), ("page_id % 6 = 0", "const r = require(\"req\"); a.require('no5'); a.import('no6');\n", "req", "require"),
    ("page_id % 7 = 0", "const t = `import z from 'no7'`, n = require(`no8`), u = require(name);\n", None, None), ("page_id % 8 = 0", "export const q = 1;\nimport type {w} from\n  '../late';\n", "../late", "import"), ("page_id % 9 = 0", "export { default as d } from './last' // from 'no9'", "./last", "export"),
)
_TOLD = [(i, x) for i, x in enumerate(_LINES) if x[2]]


@registered(
    "SELECT path, (row_number() OVER (PARTITION BY path ORDER BY i) - 1)::INT AS ordinal, specifier, kind FROM ("
    + " UNION ALL ".join(f"SELECT 'p' || page_id AS path, {i} AS i, '{s}' AS specifier, '{k}' AS kind FROM pages WHERE {w}" for i, (w, _, s, k) in _TOLD)
    + ") r"
)
def module_references(spark, sf_dir):
    source = F.concat(*[F.when(F.expr(w), F.lit(t)).otherwise("") for w, t, _, _ in _LINES])
    return repository.module_references(b.table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("path"), source.alias("source")))


_QUESTION = f"concat({{}}, CASE l_linenumber % 2 WHEN 0 THEN '.applicable' ELSE CASE WHEN l_suppkey % 11 = 0 THEN '.other' ELSE '.quality' END END)"


@registered(f"""SELECT l_orderkey AS case_id, {b.DIMENSION_SQL}[l_partkey % 7 + 1] AS dimension, max(l_quantity) FILTER (l_linenumber % 2 = 0) AS applicable, max(l_quantity) FILTER (l_linenumber % 2 = 1) AS quality FROM lineitem
WHERE l_linenumber % 2 = 0 OR l_suppkey % 11 <> 0 GROUP BY 1, 2""")
def paired_answers(spark, sf_dir):
    named = b.table(spark, sf_dir, "lineitem").withColumn("d", b.dimension_id((F.col("l_partkey") % 7 + 1).cast("int")))
    return judgment.paired_answers(named.select(F.col("l_orderkey").alias("case_id"), F.expr(_QUESTION.format("d")).alias("question"), F.col("l_quantity").alias("value")))


# the heat map of adaptive folders: the largest are rows, the others together are Other
ROWS = 6
_PLACED = f"""SELECT case_id, CASE WHEN n1 < 3 THEN '.' WHEN n1 * 12 >= t AND n2 >= 3 THEN g2 ELSE g1 END AS folder FROM (SELECT *, count(*) OVER () AS t, count(*) OVER (PARTITION BY g1) AS n1, count(*) OVER (PARTITION BY g2) AS n2 FROM (
  SELECT p_partkey AS case_id, array_to_string(string_split({_PATH}, '/')[:2], '/') AS g1, array_to_string(string_split({_PATH}, '/')[:3], '/') AS g2 FROM part) d) s"""


@registered(f"""WITH placed AS MATERIALIZED ({_PLACED}), sized AS (SELECT folder, row_number() OVER (ORDER BY count(*) DESC, folder) AS r FROM placed GROUP BY folder)
SELECT CASE WHEN r <= {ROWS} THEN p.folder ELSE 'Other' END AS folder, dimension, count(*) AS n, count(*) FILTER (({BUCKET}) IN {BAD}) AS bad, count(*) FILTER (({BUCKET}) IN {BAD}) / count(*)::DOUBLE AS bad_share
FROM ({JUDGED[3]}) j JOIN placed p ON p.case_id = j.case_id JOIN sized s ON s.folder = p.folder WHERE applicable GROUP BY 1, 2""")
def drilled_heatmap(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.expr(_PATH).alias("path"))
    folders = reporting.drilled_folders(part.groupBy("path").agg(F.count("*").alias("n")))
    return reporting.drilled_cells(judged(spark, sf_dir), part.join(folders, "path").select("case_id", "folder"), ROWS)
