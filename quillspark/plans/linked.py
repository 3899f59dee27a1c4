"""Registered queries of bindings, exports and alias configuration, with their DuckDB SQL.

Customers stand for files that export two names: some declare them, most pass on those of the customer before, in chains
of ten and of a thousand, by name or by a star; some pass them on in a circle. Orders stand for snippets.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import declarations
from . import bindings as b
from .catalog import registered

# expressions that both engines read alike
_LONG = "CAST(floor(c_custkey / 1000) AS BIGINT) % 2 = 1 AND c_custkey % 1000 <> 0"
_ROUND = "CAST(floor(c_custkey / 100) AS BIGINT) % 20 = 5"
_PASSES = f"(({_ROUND}) OR ({_LONG}) OR c_custkey % 10 <> 0)"
_BACK = f"concat('f', CASE WHEN {_ROUND} THEN c_custkey - c_custkey % 100 + (c_custkey + 99) % 100 ELSE c_custkey - 1 END)"
#: (where, position, form, name, local, target)
_STATEMENTS = (
    (f"NOT {_PASSES}", "3", "modified", "'value'", "NULL", "NULL"),
    (f"NOT {_PASSES} AND c_custkey % 20 = 0", "1", "plain", "'inner'", "'inner'", "NULL"),
    (f"NOT {_PASSES}", "5", "list", "'other'", "'inner'", "NULL"),
    (f"NOT {_PASSES} AND c_nationkey % 2 = 0", "2", "default", "NULL", "CASE WHEN c_nationkey % 4 = 0 THEN 'made' END", "NULL"),
    (f"{_PASSES} AND c_custkey % 5 <> 2", "4", "from", "'value'", "'value'", _BACK),
    (f"{_PASSES} AND c_custkey % 5 = 2", "2", "star", "NULL", "NULL", _BACK),
    (f"{_PASSES} AND c_custkey % 3 = 1", "6", "from", "'other'", "CASE WHEN c_custkey % 9 = 1 THEN 'value' ELSE 'other' END", f"CASE WHEN c_custkey % 31 <> 4 THEN {_BACK} END"),
)
_NAMES = ("position", "form", "name", "local", "target")
EXPORTS = " UNION ALL ".join(
    f"SELECT concat('f', c_custkey) AS file, {p}::INT AS position, '{f}' AS form, ({n})::VARCHAR AS name, ({o})::VARCHAR AS local, ({t})::VARCHAR AS target FROM customer WHERE {w}" for w, p, f, n, o, t in _STATEMENTS
)


def exports(spark, sf_dir):
    out = None
    for where, p, form, *rest in _STATEMENTS:
        rows = b.table(spark, sf_dir, "customer").where(where).selectExpr("concat('f', c_custkey) AS file", f"{p} AS position", f"'{form}' AS form", *[f"CAST({e} AS STRING) AS {n}" for e, n in zip(rest, _NAMES[2:])])
        out = rows if out is None else out.unionByName(rows)
    return out


# what the files of the tests bind, and what an order's snippet uses of it
_BOUND = "concat('t', c_nationkey)"
_BINDINGS = (("concat('v', c_custkey)", "'value'", "named"), ("concat('d', c_custkey)", "NULL", "default"), ("concat('n', c_custkey)", "NULL", "namespace"))
_USES = (("concat('v', o_custkey)", "CASE WHEN o_orderkey % 2 = 0 THEN 'call' END"), ("concat('n', o_custkey)", "CASE WHEN o_orderkey % 3 = 0 THEN 'other' WHEN o_orderkey % 3 = 1 THEN 'value' END"), ("CASE WHEN o_orderkey % 4 = 0 THEN concat('d', o_custkey) ELSE 'unbound' END", "NULL"))
BINDINGS = " UNION ALL ".join(f"SELECT {_BOUND} AS file, {o} AS local, {i} AS imported, concat('f', c_custkey) AS specifier, '{k}' AS kind FROM customer" for o, i, k in _BINDINGS)
USES = " UNION ALL ".join(f"SELECT o_orderkey AS snippet, concat('t', c_nationkey) AS file, {n} AS name, {m} AS member FROM orders JOIN customer ON o_custkey = c_custkey" for n, m in _USES)
REFERENCES = f"""SELECT DISTINCT snippet, u.file, specifier, CASE kind WHEN 'namespace' THEN member WHEN 'default' THEN 'default' ELSE coalesce(imported, local) END AS exported
  FROM ({USES}) u JOIN ({BINDINGS}) b ON u.file = b.file AND u.name = b.local WHERE kind <> 'namespace' OR member IS NOT NULL"""


def references(spark, sf_dir):
    customer, orders = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "orders")
    bound = used = None
    for local, imported, kind in _BINDINGS:
        rows = customer.selectExpr(f"{_BOUND} AS file", f"{local} AS local", f"CAST({imported} AS STRING) AS imported", "concat('f', c_custkey) AS specifier", f"'{kind}' AS kind")
        bound = rows if bound is None else bound.unionByName(rows)
    both = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    for name, member in _USES:
        rows = both.selectExpr("o_orderkey AS snippet", f"{_BOUND} AS file", f"{name} AS name", f"CAST({member} AS STRING) AS member")
        used = rows if used is None else used.unionByName(rows)
    return declarations.references(used, bound)


@registered(REFERENCES)
def binding_references(spark, sf_dir):
    return references(spark, sf_dir)


_FOUND = f"""WITH RECURSIVE e AS MATERIALIZED ({EXPORTS}), named AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file, exported ORDER BY rank, ord) AS r FROM (
    SELECT file, 'default' AS exported, 0 AS rank, position AS ord, 'declaration' AS kind, coalesce(local, 'default') AS symbol, position, NULL AS target, NULL AS to_name FROM e WHERE form = 'default'
    UNION ALL SELECT file, name, 0, position, 'declaration', name, position, NULL, NULL FROM e WHERE form = 'modified'
    UNION ALL SELECT l.file, l.name, 1, l.position, 'declaration', l.local, d.position, NULL, NULL FROM e l JOIN e d ON l.file = d.file AND l.local = d.local AND d.form = 'plain' WHERE l.form = 'list'
    UNION ALL SELECT file, name, 2, position, 're-export', name, position, target, local FROM e WHERE form = 'from' AND position < coalesce((SELECT min(position) FROM e s WHERE s.form = 'star' AND s.file = e.file), 99)
  ) x) y WHERE r = 1
), stars AS MATERIALIZED (SELECT file, position, target FROM e WHERE form = 'star')"""
_WANTED = f"SELECT DISTINCT specifier AS file, exported FROM ({REFERENCES}) w"


@registered(f"""{_FOUND} SELECT w.file, w.exported, CASE WHEN n.kind IS NULL AND w.exported <> 'default' AND s.file IS NOT NULL THEN 're-export' ELSE n.kind END AS kind,
  CASE WHEN n.kind IS NULL AND w.exported <> 'default' AND s.file IS NOT NULL THEN w.exported ELSE n.symbol END AS symbol, CASE WHEN n.kind IS NULL AND w.exported <> 'default' THEN s.position ELSE n.position END AS position
  FROM ({_WANTED}) w LEFT JOIN named n ON n.file = w.file AND n.exported = w.exported LEFT JOIN stars s ON s.file = w.file""")
def exported_declarations(spark, sf_dir):
    wanted = references(spark, sf_dir).select(F.col("specifier").alias("file"), "exported")
    return declarations.exported_declarations(wanted, exports(spark, sf_dir))


@registered(f"""{_FOUND}, walk AS (
  SELECT file AS f0, exported AS e0, file, exported, 0::BIGINT AS hops FROM ({_WANTED}) w
  UNION ALL SELECT f0, e0, coalesce(n.target, CASE WHEN n.file IS NULL THEN s.target END), CASE WHEN n.file IS NULL THEN k.exported ELSE n.to_name END, hops + 1
  FROM walk k LEFT JOIN named n ON n.file = k.file AND n.exported = k.exported LEFT JOIN stars s ON s.file = k.file AND k.exported <> 'default'
  WHERE hops <= (SELECT 2 * count(*) FROM customer) AND ((n.kind = 're-export' AND n.target IS NOT NULL) OR (n.file IS NULL AND s.target IS NOT NULL))
), last AS (SELECT f0, e0, max(hops) AS hops, arg_max(file, hops) AS file, arg_max(exported, hops) AS exported FROM walk GROUP BY f0, e0)
SELECT f0 AS file, e0 AS exported, CASE WHEN l.hops > (SELECT 2 * count(*) FROM customer) THEN CASE WHEN EXISTS (SELECT 1 FROM walk k JOIN named n ON n.file = k.file AND n.exported = k.exported WHERE k.f0 = l.f0 AND k.e0 = l.e0) THEN 'cycle' ELSE 'missing' END WHEN n.kind = 'declaration' THEN 'declaration' ELSE 'missing' END AS state,
  CASE WHEN n.kind = 'declaration' THEN n.file END AS found_in, CASE WHEN n.kind = 'declaration' THEN n.symbol END AS symbol, CASE WHEN n.kind = 'declaration' THEN n.position END AS position, CASE WHEN n.kind = 'declaration' THEN l.hops END AS hops
FROM last l LEFT JOIN named n ON n.file = l.file AND n.exported = l.exported""")
def followed_declarations(spark, sf_dir):
    wanted = references(spark, sf_dir).select(F.col("specifier").alias("file"), "exported")
    return declarations.followed_declarations(wanted, exports(spark, sf_dir))
