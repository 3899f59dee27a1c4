"""Registered queries of nested suites and parameter tables, with their DuckDB SQL.

Orders stand for suites of test files, their line items for the tests and hooks in them. Every third order is in one
file, so that this file grows with the table; the others are in files of bounded length.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import suites
from . import bindings as b
from .catalog import registered

# expressions that both engines read alike
_FILE = "CASE WHEN {k} % 3 = 0 THEN 'src/hot.test.ts' ELSE concat('src/c', CAST(floor({k} / 1024) AS BIGINT), '.test.ts') END"
_KINDS = ("beforeAll", "beforeEach", "afterEach", "afterAll")
_HOOK = "CASE {n} % 4 " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + " END"
_GROUP = "CAST(floor(o_orderkey / 64) AS BIGINT)"
#: (table, distinct, where, file, start, stop, kind, name): what each row of a table stands for.
_SPANS = (
    ("orders", False, "true", _FILE.format(k="o_orderkey"), "o_orderkey * 1000", "o_orderkey * 1000 + 990", "'suite'", "concat('order ', o_orderpriority)"),
    ("orders", False, "o_orderkey % 4 <> 0", _FILE.format(k="o_orderkey"), "o_orderkey * 1000 + 10", "o_orderkey * 1000 + 410", "'suite'", "'lines'"),
    ("orders", False, "o_orderkey % 4 = 1", _FILE.format(k="o_orderkey"), "o_orderkey * 1000 + 20", "o_orderkey * 1000 + 300", "'suite'", "'first'"),
    ("orders", True, f"o_orderkey % 3 = 0 OR {_GROUP} % 3 = 0", _FILE.format(k="o_orderkey"), f"{_GROUP} * 64000 - 3", f"{_GROUP} * 64000 + 63990", "'suite'", "'group'"),
    ("orders", False, "o_orderkey % 97 = 1", _FILE.format(k="o_orderkey"), "o_orderkey * 1000 + 995", "o_orderkey * 1000 + 997", _HOOK.format(n="o_custkey"), "'after the order'"),
    ("orders", False, "o_orderkey % 50000 = 3", _FILE.format(k="o_orderkey"), "o_orderkey * 1000 + 991", "o_orderkey * 1000 + 993", "'beforeEach'", "'rare'"),
    ("lines", False, "true", _FILE.format(k="l_orderkey"), "l_orderkey * 1000 + 55 * l_linenumber", "l_orderkey * 1000 + 55 * l_linenumber + 20", f"CASE WHEN l_partkey % 5 = 0 THEN {_HOOK.format(n='l_suppkey')} ELSE 'test' END", "l_returnflag"),
)
_NAMES = ("file", "start", "stop", "kind", "name")
# one line item for each order and number
_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY l_orderkey, l_linenumber) l"
SPANS = " UNION ALL ".join(f"SELECT {'DISTINCT ' if x[1] else ''}" + ", ".join(f"{e} AS {n}" for e, n in zip(x[3:], _NAMES)) + f" FROM {_LINES if x[0] == 'lines' else x[0]} WHERE {x[2]}" for x in _SPANS)
_SCOPED = f"""spans AS ({SPANS}), scoped AS (
  SELECT s.file, s.start, s.kind, s.name, max(p.start) AS scope FROM spans s LEFT JOIN spans p ON p.file = s.file AND p.kind = 'suite' AND p.start < s.start AND p.stop >= s.stop GROUP BY ALL)"""


def spans(spark, sf_dir):
    parts = []
    lines = b.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_partkey", "l_suppkey", "l_returnflag")])
    for source, distinct, where, *columns in _SPANS:
        rows = (lines if source == "lines" else b.table(spark, sf_dir, source)).where(where).selectExpr(*[f"CAST({e} AS BIGINT) AS {n}" if n in ("start", "stop") else f"{e} AS {n}" for e, n in zip(columns, _NAMES)])
        parts.append(rows.distinct() if distinct else rows)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@registered(f"""WITH RECURSIVE {_SCOPED}, around AS (
  SELECT file, start AS test, scope AS suite FROM scoped WHERE kind = 'test'
  UNION ALL SELECT a.file, a.test, s.scope FROM around a JOIN scoped s ON s.file = a.file AND s.start = a.suite
), levels AS (
  SELECT file, start, 0 AS level, scope FROM scoped WHERE kind NOT IN ('suite', 'test')
  UNION ALL SELECT l.file, l.start, l.level + 1, s.scope FROM levels l JOIN scoped s ON s.file = l.file AND s.start = l.scope
), hooks AS (SELECT h.file, h.start, h.kind, h.scope, l.level FROM scoped h JOIN (SELECT file, start, max(level) AS level FROM levels GROUP BY ALL) l ON l.file = h.file AND l.start = h.start)
SELECT a.file, a.test, row_number() OVER (PARTITION BY a.file, a.test ORDER BY h.level, h.start)::INT AS rank, h.kind AS hook, h.start AS hook_start, h.level::BIGINT AS hook_level
FROM around a JOIN hooks h ON h.file = a.file AND h.scope IS NOT DISTINCT FROM a.suite""")
def hook_inheritance(spark, sf_dir):
    return suites.inherited_hooks(spans(spark, sf_dir))


@registered(f"""WITH RECURSIVE {_SCOPED}, named AS (
  SELECT file, start, kind, scope, kind || ':' || name || '#' || (row_number() OVER (PARTITION BY file, scope, kind, name ORDER BY start) - 1) AS segment FROM scoped WHERE kind IN ('suite', 'test')
), walked AS (
  SELECT file, start AS test, 0::BIGINT AS depth, segment AS ancestry, scope FROM named WHERE kind = 'test'
  UNION ALL SELECT w.file, w.test, w.depth + 1, n.segment || '/' || w.ancestry, n.scope FROM walked w JOIN named n ON n.file = w.file AND n.start = w.scope
) SELECT file, test, depth, ancestry FROM walked WHERE scope IS NULL""")
def structural_ancestry(spark, sf_dir):
    return suites.ancestries(spans(spark, sf_dir))


# a part's test, in suites with up to three parameter tables; the sizes of the tables are digits of its numbers
_SIZES = ("p_partkey % 4", "p_size % 5", "CAST(floor(p_retailprice) AS BIGINT) % 3")


def _cell(t: int, i: str) -> str:
    return f"concat('t{t}r', {i}, ' ', p_brand)"


@registered(f"""WITH sized AS (SELECT p_partkey, p_brand, {', '.join(f'({s})::INT AS n{i}' for i, s in enumerate(_SIZES))}, p_partkey % 10 = 0 AS plain FROM part),
cases AS (
  SELECT p_partkey, p_brand, i0, i1, i2 FROM sized, unnest(CASE WHEN n0 = 3 THEN [-1] ELSE range(n0) END) a(i0), unnest(range(n1)) b(i1), unnest(range(n2)) c(i2) WHERE NOT plain
), counted AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY i0, i1, i2) - 1 AS ordinal FROM cases)
SELECT p_partkey, ordinal, list_filter([i0, i1, i2], lambda x: x >= 0)::INT[] AS digits, (CASE WHEN i0 < 0 THEN [] ELSE [{_cell(0, 'i0')}, '-'] END || [{_cell(1, 'i1')}, {_cell(2, 'i2')}, 'last']) AS values FROM counted
UNION ALL SELECT p_partkey, NULL, [], [] FROM sized WHERE plain""")
def parameter_cases(spark, sf_dir):
    # the first table's rows have two values, and every fourth test lacks it; every tenth has no table at all
    row = lambda t, i: F.concat(F.lit(f"t{t}r"), i.cast("string"), F.lit(" "), F.col("p_brand"))
    made = [F.when(F.expr(s) > 0, F.sequence(F.lit(0).cast("long"), F.expr(s) - 1)).otherwise(F.array().cast("array<bigint>")) for s in _SIZES]
    first = F.transform(made[0], lambda i: F.array(row(0, i), F.lit("-")))
    rest = F.array(F.transform(made[1], lambda i: F.array(row(1, i))), F.transform(made[2], lambda i: F.array(row(2, i), F.lit("last"))))
    tables = F.when(F.expr(f"{_SIZES[0]} = 3"), rest).otherwise(F.concat(F.array(first), rest))
    none = F.array().cast("array<array<array<string>>>")
    tests = b.table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 10 == 0, none).otherwise(tables).alias("tables"))
    return suites.parameter_cases(tests).select("p_partkey", "ordinal", "digits", "values")
