"""Registered queries of JSON values: canonical encoding and schema violations, with their DuckDB SQL.

Documents are strings and parts nested values to encode; orders stand for reports to validate, their line items for the
dimensions in them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import values
from . import bindings as b
from .catalog import registered

_PRICE = "CASE WHEN p_retailprice = floor(p_retailprice) THEN p_retailprice::BIGINT::VARCHAR ELSE p_retailprice::VARCHAR END"
_STRING = "'string:' || (length({0}) + len(regexp_extract_all({0}, '[\\x{{10000}}-\\x{{10FFFF}}]'))) || ':' || {0} || ';'"
_PART = f"""'object:key:1:2:array:5[number:' || {_PRICE} || ';number:-0;null;boolean:' || (CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END) || ';array:0[]]key:2:10:number:' || p_size || ';key:4:name:' || {_STRING.format('p_name')}
  || 'key:4:tags:array:1[object:key:0::' || {_STRING.format('p_brand')} || 'key:4:kind:object:key:1:-:' || {_STRING.format('p_type')} || ';;];'"""
_ENCODED = f"SELECT 'd' || doc_id AS id, 'object:key:1:t:' || (CASE WHEN text IS NULL THEN 'null;' ELSE {_STRING.format('text')} END) || ';' AS encoding FROM documents UNION ALL SELECT 'p' || p_partkey, {_PART} FROM part UNION ALL SELECT 'n' || p_partkey, NULL FROM part WHERE p_size % 10 = 0"


@registered(f"SELECT id, sha256(encoding) AS hash, length(encoding)::INT AS n_chars FROM ({_ENCODED}) e")
def canonical_parameters(spark, sf_dir):
    # a file of parts is small for its values, so they are dealt to tasks
    part = b.table(spark, sf_dir, "part").repartition(64, "p_partkey")
    texts = b.table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.to_json(F.struct(F.col("text").alias("t")), {"ignoreNullFields": "false"}).alias("json"))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'^\{"x":(.*)\}$', 1)
    nested = F.concat(
        F.lit('{"name":'), quoted("p_name"), F.lit(', "10" : '), "p_size", F.lit(',"2":['), "p_retailprice", F.lit(",-0,null,"), F.when(F.col("p_size") % 2 == 0, "true").otherwise("false"), F.lit(',[]],"tags":[{"":'), quoted("p_brand"), F.lit(',"kind":{"-":'), quoted("p_type"), F.lit("}}]}"),
    )
    made = part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), nested.alias("json"))
    none = part.where("p_size % 10 = 0").select(F.concat(F.lit("n"), "p_partkey").alias("id"), F.concat(F.lit('{"open":'), "p_size").alias("json"))
    return values.canonical_values(texts.unionByName(made).unionByName(none)).select("id", "hash", F.length("encoding").alias("n_chars"))


# The states of a report's case and the levels of a dimension.
STATES = ("healthy", "weak", "misleading", "needs-review")
LEVELS = ("misleading", "weak", "acceptable", "strong")
REPORT = {
    "type": "object", "required": ["id", "status", "dimensions"], "additionalProperties": False,
    "properties": {
        "id": {"type": "string"}, "status": {"type": "string", "enum": list(STATES)}, "score": {"type": ["number", "null"]},
        "dimensions": {"type": "array", "items": {"type": "object", "required": ["level"], "additionalProperties": False, "properties": {"level": {"enum": list(LEVELS)}, "n": {"type": "integer"}, "evidence-ids": {"type": "array", "items": {"type": "string"}}}}},
    },
}
# what reports hold, as text that both engines build alike
_LEVEL = "CASE WHEN l_suppkey % 9 = 0 THEN '\"poor\"' WHEN l_suppkey % 9 = 1 THEN '3' ELSE '\"weak\"' END"
_DIMENSION = f"concat('{{', CASE WHEN l_partkey % 7 = 0 THEN '\"more\":1' ELSE concat('\"level\":', {_LEVEL}) END, ',\"n\":', l_linenumber, CASE WHEN l_partkey % 5 = 0 THEN '.5' WHEN l_partkey % 5 = 1 THEN '.0' ELSE '' END, CASE WHEN l_suppkey % 4 = 0 THEN ',\"evidence-ids\":[\"a\",2,null]' ELSE '' END, '}}')"
_ITEMS = "CASE WHEN o_orderkey % 17 = 0 THEN '\"none\"' WHEN o_orderkey % 17 = 1 THEN '[7,[]]' ELSE concat('[', coalesce(items, ''), ']') END"
_BODY = f"""concat('{{', CASE WHEN o_orderkey % 7 = 0 THEN '\"id\":7' ELSE concat('\"id\":\"o', o_orderkey, '\"') END, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 11 = 1 THEN ',\"status\":\"fine\"' WHEN o_orderkey % 11 = 2 THEN ',\"status\":null' ELSE ',\"status\":\"weak\"' END,
  CASE o_custkey % 4 WHEN 0 THEN ',\"score\":null' WHEN 1 THEN ',\"score\":1.5' WHEN 2 THEN ',\"score\":\"high\"' ELSE '' END, CASE WHEN o_orderkey % 13 = 0 THEN ',\"x\":{{\"y\":1}}' ELSE '' END, CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE concat(',\"dimensions\":', {_ITEMS}) END, CASE WHEN o_orderkey % 101 = 0 THEN '' ELSE '}}' END)"""
_WHERE = "o_orderkey % 101 <> 0"
_TOP = " UNION ALL ".join(
    f"SELECT o_orderkey AS id, '{p}' AS path, '{m}' AS problem FROM orders WHERE {_WHERE} AND {w}"
    for p, m, w in (
        ("$.id", "expected type string, got number", "o_orderkey % 7 = 0"), ("$.status", "required property is missing", "o_orderkey % 11 = 0"),
        ("$.status", 'value "fine" is not one of ["healthy","weak","misleading","needs-review"]', "o_orderkey % 11 = 1"), ("$.status", "expected type string, got null", "o_orderkey % 11 = 2"),
        ("$.score", "expected type number | null, got string", "o_custkey % 4 = 2"), ("$.x", "unexpected property (additionalProperties is false)", "o_orderkey % 13 = 0"),
        ("$.dimensions", "required property is missing", "o_orderkey % 19 = 0"), ("$.dimensions", "expected type array, got string", "o_orderkey % 19 <> 0 AND o_orderkey % 17 = 0"),
        ("$.dimensions[0]", "expected type object, got number", "o_orderkey % 19 <> 0 AND o_orderkey % 17 = 1"), ("$.dimensions[1]", "expected type object, got array", "o_orderkey % 19 <> 0 AND o_orderkey % 17 = 1"),
    )
)
_ONE_OF = 'is not one of ["misleading","weak","acceptable","strong"]'
_EACH = " UNION ALL ".join(
    f"SELECT l_orderkey, '$.dimensions[' || i || ']{p}', '{m}' FROM l WHERE {w}"
    for p, m, w in (
        (".more", "unexpected property (additionalProperties is false)", "l_partkey % 7 = 0"), (".level", "required property is missing", "l_partkey % 7 = 0"), (".level", f'value "poor" {_ONE_OF}', "l_partkey % 7 <> 0 AND l_suppkey % 9 = 0"),
        (".level", f"value 3 {_ONE_OF}", "l_partkey % 7 <> 0 AND l_suppkey % 9 = 1"), (".n", "expected type integer, got number", "l_partkey % 5 = 0"), (".evidence-ids[1]", "expected type string, got number", "l_suppkey % 4 = 0"), (".evidence-ids[2]", "expected type string, got null", "l_suppkey % 4 = 0"),
    )
)


@registered(f"""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i FROM lineitem WHERE l_orderkey % 101 <> 0 AND l_orderkey % 19 <> 0 AND l_orderkey % 17 > 1 AND l_orderkey IN (SELECT o_orderkey FROM orders))
{_TOP} UNION ALL {_EACH} UNION ALL SELECT o_orderkey, '$', 'not JSON' FROM orders WHERE NOT {_WHERE}""")
def schema_violations(spark, sf_dir):
    lines = b.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "struct(l_linenumber, l_partkey, l_suppkey) AS at", f"{_DIMENSION} AS item")
    items = lines.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "item"))), lambda x: x["item"]), ",").alias("items"))
    reports = b.table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left").selectExpr("o_orderkey AS id", f"{_BODY} AS json")
    return values.schema_violations(reports, REPORT)
