"""Registered query of the benchmark corpus, with its DuckDB SQL: a part is a case, with one of several faults by its number."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..sources import corpus
from . import bindings as b
from .catalog import registered

_SOUND = {"id": "case NUMBER", "operators": ["remove-assertion"], "operatorRole": "prescriptive", "oracleKind": "assertion-mutation", "testEffect": "t", "productionEffect": "p", "expectedOutcome": "expected-to-fail", "testFile": "a.test.ts", "productionFiles": ["src/b.ts", "c.ts"]}
# (what is changed in a sound manifest, the problem that it makes)
_FAULTS = (
    ({}, None), ({"id": "case TWIN"}, None), ({"extra": 1, "also": 2}, "unknown-fields:also,extra"), ({"id": "  "}, "id"), ({"operators": []}, "operators"), ({"operators": ["x", "y"]}, "operators"), ({"operators": "remove-assertion"}, "operators"), ({"operators": [3]}, "unknown-operator"),
    ({"operators": ["rename"]}, "unknown-operator"), ({"operatorRole": None}, "operatorRole"), ({"oracleKind": "magic"}, "oracleKind"), ({"testEffect": 4}, "testEffect"), ({"productionEffect": ""}, "productionEffect"), ({"expectedOutcome": ["expected-to-fail"]}, "expectedOutcome"),
    ({"testFile": "../a.test.ts"}, "testFile"), ({"testFile": "C:\\a.ts"}, "testFile"), ({"productionFiles": []}, "productionFiles"), ({"productionFiles": ["b.ts", "/etc/x"]}, "production-file:1"), ({"productionFiles": [7]}, "production-file:0"), ({"productionFiles": ["c.ts", "gone.ts"]}, "missing:gone.ts"),
)
_TEXTS = [json.dumps(_SOUND | change) for change, _ in _FAULTS] + ["[1]", "{"]
_PROBLEMS = [p for _, p in _FAULTS] + ["not-object", "not-json"]
_N = len(_TEXTS)
_TOLD = "[" + ", ".join("NULL" if p is None else f"'{p}'" for p in _PROBLEMS) + "]"
_KIND = f"p_partkey % {_N}"
_ID = f"CASE WHEN {_KIND} IN ({_N - 2}, {_N - 1}) THEN NULL WHEN {_KIND} = 3 THEN '  ' WHEN {_KIND} = 1 THEN 'case TWIN' ELSE 'case ' || p_partkey END"
_OPERATOR = f"CASE WHEN {_KIND} IN (4, 6, 7, {_N - 2}, {_N - 1}) THEN NULL WHEN {_KIND} = 5 THEN 'x' WHEN {_KIND} = 8 THEN 'rename' ELSE 'remove-assertion' END"
_COUNT = f"CASE WHEN {_KIND} IN (0, 1, {len(_FAULTS) - 1}) THEN 3 ELSE 0 END"


@registered(f"""SELECT folder, id, operator, files::BIGINT AS files, CASE WHEN k = 1 AND folder <> min(folder) FILTER (k = 1) OVER () THEN 'repeated-id' ELSE problem END AS problem
FROM (SELECT 'corpus/n' || p_partkey AS folder, {_KIND} AS k, {_ID} AS id, {_OPERATOR} AS operator, {_COUNT} AS files, ({_TOLD})[{_KIND} + 1] AS problem FROM part) c""")
def corpus_cases(spark, sf_dir):
    part = b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("n"), F.concat(F.lit("corpus/n"), "p_partkey").alias("folder"))
    text = F.replace(F.get(F.array(*[F.lit(t) for t in _TEXTS]), (F.col("n") % _N).cast("int")), F.lit("NUMBER"), F.col("n").cast("string"))
    names = F.explode(F.array(F.struct(F.lit(corpus.MANIFEST).alias("name"), text.alias("source")), *[F.struct(F.lit(x).alias("name"), F.lit("").alias("source")) for x in ("a.test.ts", "src/b.ts", "c.ts")]))
    files = part.select("folder", names.alias("f")).select(F.concat_ws("/", "folder", "f.name").alias("path"), "f.source")
    return corpus.corpus_cases(files)
