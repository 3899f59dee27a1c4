"""Registered queries of alias configuration, with their DuckDB SQL.

Customers stand for folders with configurations and packages, nations for the configurations that theirs extend, orders
for the files to resolve for. The SQL works on what the configurations say; the operators read it from JSON texts.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import aliases
from . import bindings as b
from .catalog import registered

_DIR = "concat('a', c_custkey % 40, '/b', c_custkey)"
# expressions that both engines read alike: what a customer's configuration extends, and its baseUrl
_EXTENDS = "CASE c_custkey % 6 WHEN 0 THEN {0}concat('../../base', c_custkey % 25){1} WHEN 1 THEN {0}concat('../../base', c_custkey % 25, '.json'), '@t/x.json'{1} WHEN 2 THEN {0}'./missing', '../../../out.json', '/etc/x.json'{1} WHEN 3 THEN {0}'../../base3', concat('./../../base', c_custkey % 25, '.json'){1} END"
_BASE_URL = "CASE c_custkey % 4 WHEN 0 THEN '.' WHEN 1 THEN './src' WHEN 2 THEN CASE WHEN c_custkey % 8 = 2 THEN '../../../up' END END"
_NATION_EXTENDS = "CASE WHEN n_nationkey % 5 < 4 THEN {0}concat('./base', n_nationkey + 1, '.json'){1} WHEN n_nationkey < 10 THEN {0}concat('./base', n_nationkey - 4, '.json'){1} END"
_NATION_BASE = "CASE WHEN n_nationkey % 5 = 3 THEN 'lib' END"
# (columns that say so, patterns with their targets)
_OWN, _THEIRS = "c_custkey % 5 < 2", "n_nationkey % 5 = 2"

CONFIGURED = f"""SELECT {_DIR} || '/' || name AS path, {_DIR} AS folder, c_custkey % 23 <> 0 AS ok, CASE WHEN c_custkey % 23 <> 0 THEN {_BASE_URL} END AS base_url, CASE WHEN c_custkey % 23 <> 0 AND {_OWN} THEN 'own' END AS paths, CASE WHEN c_custkey % 23 <> 0 THEN {_EXTENDS.format('[', ']')} END AS extends
    FROM customer, (VALUES ('tsconfig.json', 0), ('jsconfig.json', 1)) n(name, i) WHERE (i = 0 AND c_custkey % 3 <> 1) OR (i = 1 AND (c_custkey % 3 = 1 OR c_custkey % 6 = 0))
  UNION ALL SELECT 'base' || n_nationkey || '.json', '', true, {_NATION_BASE}, CASE WHEN {_THEIRS} THEN 'theirs' END, {_NATION_EXTENDS.format('[', ']')} FROM nation"""
_CHAIN = f"""WITH RECURSIVE cfg AS MATERIALIZED ({CONFIGURED}), edges AS MATERIALIZED (
  SELECT path, i - 1 AS i, detail, CASE WHEN starts_with(detail, '@') THEN 'extends-node-modules' WHEN detail IN ('../../../out.json', '/etc/x.json') THEN 'extends-outside-root' WHEN detail = './missing' THEN 'extends-missing' END AS reason,
    regexp_extract(detail, 'base[0-9]+') || '.json' AS target FROM (SELECT path, unnest(extends) AS detail, generate_subscripts(extends, 1) AS i FROM cfg) e
), chain AS (
  SELECT path AS root, path, []::BIGINT[] AS place, [path] AS way FROM cfg WHERE folder <> ''
  UNION ALL SELECT c.root, e.target, list_append(c.place, -e.i), list_append(c.way, e.target) FROM chain c JOIN edges e ON e.path = c.path AND e.reason IS NULL WHERE NOT list_contains(c.way, e.target)
), full_chain AS (SELECT c.*, f.folder, f.ok, f.base_url, f.paths FROM chain c JOIN cfg f ON f.path = c.path
), merged AS (
  SELECT root, arg_min(base_url, place) FILTER (base_url IS NOT NULL) AS url, arg_min(folder, place) FILTER (base_url IS NOT NULL) AS url_folder, arg_min(path, place) FILTER (base_url IS NOT NULL) AS url_in,
    arg_min(paths, place) FILTER (paths IS NOT NULL) AS paths, arg_min(folder, place) FILTER (paths IS NOT NULL) AS paths_folder, arg_min(path, place) FILTER (paths IS NOT NULL) AS paths_in FROM full_chain GROUP BY root
), seen AS (
  SELECT *, CASE url WHEN '.' THEN url_folder WHEN './src' THEN url_folder || '/src' WHEN 'lib' THEN 'lib' END AS base, CASE WHEN url IS NULL THEN paths_folder WHEN url = '.' THEN url_folder WHEN url = './src' THEN url_folder || '/src' WHEN url = 'lib' THEN 'lib' END AS from_folder FROM merged
)"""
_IN = "CASE WHEN from_folder = '' THEN '' ELSE from_folder || '/' END"
# how far below the root a folder is
_DEPTH = "CASE WHEN from_folder = '' THEN 0 ELSE len(string_split(from_folder, '/')) END"
_UP = f"CASE WHEN {_DEPTH} >= 3 THEN CASE WHEN {_DEPTH} > 3 THEN array_to_string(string_split(from_folder, '/')[:{_DEPTH} - 3], '/') || '/x' ELSE 'x' END END"


def configs(spark, sf_dir):
    customer, nation = b.table(spark, sf_dir, "customer"), b.table(spark, sf_dir, "nation")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    members = lambda *cs: F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*cs)), ", "), F.lit("}"))
    member = lambda name, c: F.concat(F.lit(f'"{name}": '), c)
    listed = lambda c: F.when(F.size(c) == 1, quoted(F.get(c, F.lit(0)))).when(F.size(c) > 1, F.concat(F.lit("[3, "), F.array_join(F.transform(c, quoted), ", "), F.lit(",]")))

    def text(own, base_url, extends, paths):
        options = members(member("baseUrl", quoted(F.expr(base_url))), F.when(F.expr(own), F.lit('"paths": ' + paths)))
        return F.concat(F.lit("// a configuration\n"), members(member("extends", listed(F.expr(extends.format("array(", ")")))), member("compilerOptions", options)))

    mine = text(_OWN, _BASE_URL, _EXTENDS, '{"@a/*": ["src/*", 7, "../../../x"], /* one */ "b": "lib/b", "n": 3}')
    made = customer.select(F.expr(_DIR).alias("folder"), F.when(F.col("c_custkey") % 23 == 0, '{"compilerOptions": ').otherwise(mine).alias("text"), F.col("c_custkey").alias("k"))
    both = [made.where(w).select(F.concat("folder", F.lit(f"/{n}")).alias("path"), "text") for n, w in (("tsconfig.json", "k % 3 <> 1"), ("jsconfig.json", "k % 3 = 1 OR k % 6 = 0"))]
    base = nation.select(F.expr("concat('base', n_nationkey, '.json')").alias("path"), text(_THEIRS, _NATION_BASE, _NATION_EXTENDS, '{"c": ["c/*"]}').alias("text"))
    return both[0].unionByName(both[1]).unionByName(base)


def roots(found):
    return found.where("path LIKE '%/%'").select(F.col("path").alias("root"))


@registered(f"""{_CHAIN} SELECT root, 'paths' AS source, '@a/*' AS pattern, concat_ws(',', {_IN} || 'src/*', {_UP}) AS targets, paths_in AS declared_in FROM seen WHERE paths = 'own' AND from_folder IS NOT NULL
UNION ALL SELECT root, 'paths', 'b', {_IN} || 'lib/b', paths_in FROM seen WHERE paths = 'own' AND from_folder IS NOT NULL
UNION ALL SELECT root, 'paths', 'c', {_IN} || 'c/*', paths_in FROM seen WHERE paths = 'theirs' AND from_folder IS NOT NULL
UNION ALL SELECT root, 'baseUrl', '*', base || '/*', url_in FROM seen WHERE base IS NOT NULL""")
def alias_entries(spark, sf_dir):
    found = configs(spark, sf_dir)
    return aliases.path_entries(roots(found), found)[0].withColumn("targets", F.array_join("targets", ","))


@registered(f"""{_CHAIN} SELECT c.root, e.reason, c.path AS declared_in, e.detail FROM full_chain c JOIN edges e ON e.path = c.path WHERE e.reason IS NOT NULL
UNION ALL SELECT c.root, 'extends-cycle', c.path, e.detail FROM full_chain c JOIN edges e ON e.path = c.path WHERE e.reason IS NULL AND list_contains(c.way, e.target)
UNION ALL SELECT root, 'config-malformed', path, '' FROM full_chain WHERE NOT ok
UNION ALL SELECT root, 'target-outside-root', url_in, '*' FROM seen WHERE url IS NOT NULL AND base IS NULL
UNION ALL SELECT root, 'target-outside-root', paths_in, unnest(CASE WHEN paths = 'theirs' THEN ['c/*'] ELSE ['src/*', 'lib/b', '../../../x'] END) FROM seen WHERE paths IS NOT NULL AND from_folder IS NULL
UNION ALL SELECT root, 'target-outside-root', paths_in, '../../../x' FROM seen WHERE paths = 'own' AND from_folder IS NOT NULL AND {_UP} IS NULL""")
def alias_refusals(spark, sf_dir):
    found = configs(spark, sf_dir)
    return aliases.path_entries(roots(found), found)[1]


_FILE = "concat('a', o_custkey % 40, CASE WHEN o_orderkey % 10 = 0 THEN '/x' ELSE concat('/b', o_custkey) END, CASE WHEN o_orderkey % 3 = 0 THEN '/src/deep' ELSE '' END, '/f', o_orderkey, '.ts')"


@registered(f"""SELECT path, arg_min(config, (-length(folder), rank)) AS config FROM (
  SELECT f.path, folder, c.path AS config, CASE WHEN c.path LIKE '%tsconfig.json' THEN 1 ELSE 2 END AS rank FROM (SELECT o_custkey, {_FILE} AS path FROM orders) f JOIN ({CONFIGURED}) c ON folder = concat('a', o_custkey % 40, '/b', o_custkey) AND starts_with(f.path, folder || '/')) x GROUP BY path""")
def nearest_config(spark, sf_dir):
    return aliases.nearest(b.table(spark, sf_dir, "orders").selectExpr(f"{_FILE} AS path"), configs(spark, sf_dir))


# packages: every second customer's folder has one, as a workspace of the root where its number allows it
_PACKAGE = '{"name": "@w/NAME", MAIN "imports": {"#x": "./x.js", "#c": {"node": "./n.js", "default": {"import": {"none": 1}, "node": "./in.js"}}, "#n": {"import": null, "node": "./n.js"}, "#e": "ext", "#u": {"browser": "./b"}, "#o": "./../../../o.js", "y": "./y"}}'
_MAINS = ('"main": "./dist/index.js",', '"exports": "./e.js", "main": "./m.js",', '"exports": {".": {"browser": "./b.js", "import": "../../../../far.js"}},', '"exports": {".": {"node": {"default": "./node.js"}}},', "")


def packages(spark, sf_dir):
    customer = b.table(spark, sf_dir, "customer").where("c_custkey % 2 = 0")
    main = F.get(F.array(*[F.lit(m) for m in _MAINS]), (F.col("c_custkey") % 5).cast("int"))
    text = F.replace(F.replace(F.lit(_PACKAGE), F.lit("NAME"), F.col("c_custkey").cast("string")), F.lit("MAIN"), main)
    own = customer.select(F.concat(F.expr(_DIR), F.lit("/package.json")).alias("path"), F.when(F.col("c_custkey") % 23 == 0, "{").otherwise(text).alias("text"))
    root = b.table(spark, sf_dir, "region").where("r_regionkey = 0").select(F.lit("package.json").alias("path"), F.lit('{"workspaces": {"packages": ["a1?/b*", "./a{2,4}/*", "a6/b6", "none/*"]}}').alias("text"))
    return own.unionByName(root)


_PACKAGED = f"SELECT *, {_DIR} AS folder, {_DIR} || '/package.json' AS path FROM customer WHERE c_custkey % 2 = 0"
_SOUND = f"SELECT * FROM ({_PACKAGED}) p WHERE c_custkey % 23 <> 0"
_SPACED = f"SELECT * FROM ({_PACKAGED}) q WHERE (c_custkey % 40 BETWEEN 10 AND 19) OR c_custkey % 40 IN (2, 4) OR c_custkey = 6"
_ENTRY = "CASE c_custkey % 5 WHEN 0 THEN folder || '/dist/index.js,' WHEN 1 THEN folder || '/e.js,' WHEN 3 THEN folder || '/node.js,' ELSE '' END || folder"


@registered(f"""SELECT path AS root, 'imports' AS source, pattern, folder || target AS targets, path AS declared_in FROM ({_SOUND}) s, (VALUES ('#x', '/x.js'), ('#c', '/in.js')) v(pattern, target)
UNION ALL SELECT 'package.json', 'workspace', '@w/' || c_custkey, {_ENTRY}, path FROM ({_SPACED}) w WHERE c_custkey % 23 <> 0
UNION ALL SELECT 'package.json', 'workspace', '@w/' || c_custkey || '/*', folder || '/*', path FROM ({_SPACED}) w WHERE c_custkey % 23 <> 0
UNION ALL SELECT path, 'refused', reason, detail, path FROM ({_SOUND}) s, (VALUES ('imports-external-target', '#e'), ('imports-unsupported-conditions', '#u'), ('target-outside-root', './../../../o.js')) v(reason, detail)
UNION ALL SELECT path, 'refused', 'config-malformed', '', path FROM ({_PACKAGED}) s WHERE c_custkey % 23 = 0 UNION ALL SELECT 'package.json', 'refused', 'config-malformed', '', path FROM ({_SPACED}) s WHERE c_custkey % 23 = 0""")
def package_entries(spark, sf_dir):
    found = packages(spark, sf_dir)
    entries, refused = aliases.import_entries(found.where("path LIKE '%/%'").select(F.col("path").alias("root")), found)
    spaces, more = aliases.workspace_entries(found)
    listed = entries.unionByName(spaces).withColumn("targets", F.array_join("targets", ","))
    return listed.unionByName(refused.unionByName(more).select("root", F.lit("refused").alias("source"), F.col("reason").alias("pattern"), F.col("detail").alias("targets"), "declared_in"))
