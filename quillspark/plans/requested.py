"""Registered queries of requests, their keys, file details and report heads, with their DuckDB SQL."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..operators import requests
from . import bindings as b
from .catalog import BAD, JUDGED, VERDICT, judged, registered, verdict

MODEL, RUBRIC = "m-1", "v2"
ASKED = requests.questions(b.DIMENSIONS)
_TAIL = (',"model":"m-1","questions":' + json.dumps(ASKED, separators=(",", ":")) + "}").replace("'", "''")

# a part is a case, its line items are fragments, paths that were denied or omitted, and specifiers that were not found
_KIND = "CASE l_linenumber % 4 WHEN 0 THEN 'mock-target' WHEN 1 THEN 'test' WHEN 2 THEN 'production-seam' ELSE 'helper' END"
_FRAGMENT = {"case_id": "l_partkey", "kind": _KIND, "path": "concat('src/f', l_suppkey % 9, '.ts')", "symbol": "CASE WHEN l_orderkey % 3 = 0 THEN concat('s', l_orderkey) END", "reason": "CASE WHEN l_linenumber % 4 = 1 THEN 'test-body' ELSE 'hop-1' END", "truncated": "l_quantity > 25", "content": "concat('line \"', l_orderkey, '\"', chr(10), l_returnflag, ' é')"}
_IS_FRAGMENT, _IS_DENIED, _IS_OPEN, _IS_OMITTED = ("l_linenumber < 5", "l_linenumber = 5", "l_linenumber = 6", "l_linenumber = 7")
_MODIFIERS = {"array": "CASE WHEN p_size % 3 = 0 THEN array('skip', 'only') WHEN p_size % 3 = 1 THEN array('todo') ELSE CAST(array() AS ARRAY<STRING>) END", "text": "CASE WHEN p_size % 3 = 0 THEN '\"only\",\"skip\"' WHEN p_size % 3 = 1 THEN '\"todo\"' ELSE '' END"}


def _select(table: str, columns: dict[str, str], where: str) -> str:
    return f"SELECT {', '.join(f'{e} AS {n}' for n, e in columns.items())} FROM {table} WHERE {where}"


_JOINED = "coalesce((SELECT string_agg({0}, ',' ORDER BY {1}) FROM ({2}) x WHERE x.case_id = p_partkey), '')"
_SYMBOL = "CASE WHEN symbol IS NULL THEN '' ELSE '\"symbol\":' || to_json(symbol) || ',' END"
_FRAGMENTS = _JOINED.format(
    "'{\"kind\":\"' || kind || '\",\"path\":\"' || path || '\",' || " + _SYMBOL + " || '\"selectionReason\":\"' || reason || '\",\"truncated\":' || truncated || ',\"content\":' || to_json(content) || '}'",
    "list_position(['test', 'helper', 'production-seam', 'mock-target'], kind), path, coalesce(symbol, ''), content, reason, truncated", _select("lineitem", _FRAGMENT, _IS_FRAGMENT),
)
_DENIED = _JOINED.format("'{\"path\":\"' || path || '\",\"rule\":\"' || rule || '\"}'", "path, rule", _select("lineitem", {"case_id": "l_partkey", "path": "concat('k', l_orderkey, '.pem')", "rule": "'deny-list:*.pem'"}, _IS_DENIED))
_OPEN = _JOINED.format("'{\"specifier\":\"' || specifier || '\",\"reason\":\"' || reason || '\"}'", "specifier, reason", _select("lineitem", {"case_id": "l_partkey", "specifier": "concat('m', l_orderkey)", "reason": "'bare'"}, _IS_OPEN))
_OMITTED = _JOINED.format("'{\"path\":\"' || path || '\",' || " + _SYMBOL + " || '\"reason\":\"' || reason || '\"}'", "path, coalesce(symbol, ''), reason", _select("lineitem", {k: _FRAGMENT[k] for k in ("case_id", "path", "symbol")} | {"reason": "'hop-2'"}, _IS_OMITTED))
REQUESTS = f"""SELECT p_partkey AS case_id, '{{"state":{{"testCaseId":"' || p_partkey || '","name":' || to_json(p_name) || ',"structuralAncestry":[{{"kind":"suite","name":' || to_json(p_brand) || '}},{{"kind":"test","name":' || to_json(p_name) || '}}],"framework":"jest","repositoryRelativePath":"src/'
  || p_partkey || '.test.ts","modifiers":[' || {_MODIFIERS['text']} || '],"fragments":[' || {_FRAGMENTS} || '],"denied":[' || {_DENIED} || '],"unresolved":[' || {_OPEN} || '],"omitted":[' || {_OMITTED} || ']}}{_TAIL}' AS request FROM part"""


def built(spark, sf_dir):
    part, lines = b.table(spark, sf_dir, "part"), b.table(spark, sf_dir, "lineitem")
    ancestry = F.array(F.struct(F.lit("suite").alias("kind"), F.col("p_brand").alias("name")), F.struct(F.lit("test").alias("kind"), F.col("p_name").alias("name")))
    cases = part.select(F.col("p_partkey").alias("case_id"), F.col("p_name").alias("name"), ancestry.alias("ancestry"), F.lit("jest").alias("framework"), F.concat(F.lit("src/"), "p_partkey", F.lit(".test.ts")).alias("path"), F.expr(_MODIFIERS["array"]).alias("modifiers"))
    of = lambda where, **columns: lines.where(where).selectExpr(*[f"{e} AS {n}" for n, e in columns.items()])
    key = {"case_id": "l_partkey"}
    return requests.built_requests(
        cases, of(_IS_FRAGMENT, **_FRAGMENT), of(_IS_DENIED, **key, path="concat('k', l_orderkey, '.pem')", rule="'deny-list:*.pem'"), of(_IS_OPEN, **key, specifier="concat('m', l_orderkey)", reason="'bare'"),
        of(_IS_OMITTED, **key, path=_FRAGMENT["path"], symbol=_FRAGMENT["symbol"], reason="'hop-2'"), ASKED, MODEL,
    )


@registered(f"SELECT case_id, strlen(request)::INT AS bytes, sha256(request) AS hash FROM ({REQUESTS}) r")
def evaluation_requests(spark, sf_dir):
    return built(spark, sf_dir).select("case_id", F.octet_length("request").alias("bytes"), F.sha2("request", 256).alias("hash"))


@registered(f"""SELECT case_id, strlen(request)::INT AS bytes, sha256('{{"request":' || to_json(request) || ',"source":"' || sha256(p_name || chr(10) || p_brand) || '","rubricVersion":"v2","slot":"-"}}') AS key FROM ({REQUESTS}) r JOIN part ON p_partkey = case_id""")
def request_keys(spark, sf_dir):
    sources = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("case_id"), F.concat("p_name", F.lit("\r\n"), "p_brand").alias("text"))
    return requests.request_keys(built(spark, sf_dir), sources, RUBRIC)


_ROWS = f"SELECT v.case_id, c.path, c.name, v.verdict FROM ({VERDICT[3]}) v JOIN ({b.CASES_SQL}) c ON c.case_id = v.case_id"
_LISTED = "coalesce(string_agg({0}, ',' ORDER BY {0}) FILTER ({1}), '')"


def rows(spark, sf_dir):
    return verdict(spark, sf_dir).join(b.cases(spark, sf_dir).select("case_id", "path", "name"), "case_id")


def _details(keep: str) -> str:
    return f"SELECT path, name, verdict, dimensions, needs_review FROM ({_ROWS}) r JOIN (SELECT case_id, {_LISTED.format("dimension || '=' || coalesce(level, status)", keep)} AS dimensions, {_LISTED.format('dimension', "status = 'needs-review'")} AS needs_review FROM ({JUDGED[3]}) j GROUP BY 1) d ON d.case_id = r.case_id"


@registered(f"SELECT * FROM ({_details(f"status = 'judged' AND level IN {BAD}")}) d WHERE dimensions <> ''")
def file_details(spark, sf_dir):
    return requests.file_details(judged(spark, sf_dir), rows(spark, sf_dir))


@registered(_details("true"))
def file_details_full(spark, sf_dir):
    return requests.file_details(judged(spark, sf_dir), rows(spark, sf_dir), full=True)


@registered("""SELECT 'c' || c_custkey AS path, CASE WHEN c_custkey % 3 = 0 THEN 'vitest' ELSE 'jest' END AS framework, count(o_orderkey) AS test_cases, count(o_orderkey) FILTER (o_orderkey % 5 = 0) AS dynamic, count(o_orderkey) FILTER (o_orderkey % 7 <> 0) AS bundles
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2""")
def report_heads(spark, sf_dir):
    files = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("path"), F.when(F.col("c_custkey") % 3 == 0, "vitest").otherwise("jest").alias("framework"))
    tests = b.table(spark, sf_dir, "orders").select(F.concat(F.lit("c"), "o_custkey").alias("path"), "o_orderkey")
    return requests.report_heads(files, tests, tests.where("o_orderkey % 5 = 0"), tests.where("o_orderkey % 7 <> 0"))
