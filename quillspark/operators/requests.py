"""Requests to an evaluator: a case's state with its evidence and the rubric's questions, in one canonical text; its key."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evidence import content_hash

# The order of fragments by kind.
KINDS = ("test", "helper", "production-seam", "mock-target")


def questions(dimensions: tuple[str, ...], wording: dict[str, str] | None = None) -> dict[str, dict]:
    """Two questions for each dimension, whether it applies and how good it is, by id in order. wording: the instructions of an id that has its own."""
    made = {}
    for d in dimensions:
        made[f"{d}.applicable"] = {"type": "noul", "instructions": f"Does {d} apply to this test?"}
        made[f"{d}.quality"] = {"type": "score", "instructions": f"How good is this test by {d}?", "criteria": ["misleading", "weak", "acceptable", "strong"]}
    for k, text in (wording or {}).items():
        made[k] = made[k] | {"instructions": text}
    return dict(sorted(made.items()))


def _listed(rows: DataFrame, order: list[Column], fields: list[str], name: str) -> DataFrame:
    """case_id, name: the rows of each case as an array of their fields, in order. A case's rows are bounded by its budget."""
    keyed = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.struct(*fields).alias("x"))
    return rows.groupBy("case_id").agg(F.transform(F.sort_array(F.collect_list(keyed)), lambda r: r["x"]).alias(name))


def built_requests(cases: DataFrame, fragments: DataFrame, denied: DataFrame, unresolved: DataFrame, omitted: DataFrame, asked: dict[str, dict], model: str) -> DataFrame:
    """case_id, request: JSON of state, model and questions, with keys in a fixed order and lists sorted, so that equal requests are equal texts.

    cases(case_id, name, ancestry, framework, path, modifiers), fragments(case_id, kind, path, symbol, reason, truncated, content), denied(case_id, path, rule), unresolved(case_id, specifier, reason), omitted(case_id, path, symbol, reason). A symbol that is null isn't written."""
    symbol = F.coalesce("symbol", F.lit(""))
    kind = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    told = fragments.withColumnRenamed("reason", "selectionReason")
    lists = {
        "fragments": _listed(told, [kind, F.col("path"), symbol, F.col("content")], ["kind", "path", "symbol", "selectionReason", "truncated", "content"], "fragments"),
        "denied": _listed(denied, [F.col("path"), F.col("rule")], ["path", "rule"], "denied"),
        "unresolved": _listed(unresolved, [F.col("specifier"), F.col("reason")], ["specifier", "reason"], "unresolved"),
        "omitted": _listed(omitted, [F.col("path"), symbol, F.col("reason")], ["path", "symbol", "reason"], "omitted"),
    }
    rows = cases
    for name, rows_of in lists.items():
        rows = rows.join(rows_of, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows_of.schema[name].dataType)))
    state = F.to_json(F.struct(
        F.col("case_id").cast("string").alias("testCaseId"), "name", F.col("ancestry").alias("structuralAncestry"), "framework", F.col("path").alias("repositoryRelativePath"), F.array_sort("modifiers").alias("modifiers"), *lists))
    tail = f',"model":{json.dumps(model)},"questions":{json.dumps(asked, separators=(",", ":"), ensure_ascii=False)}}}'
    return rows.select("case_id", F.concat(F.lit('{"state":'), state, F.lit(tail)).alias("request"))


def request_keys(requests: DataFrame, sources: DataFrame, rubric: str, slot: str = "-") -> DataFrame:
    """case_id, key, bytes of requests and sources(case_id, text): equal keys share an answer."""
    fields = F.to_json(F.struct(F.col("request"), content_hash(F.col("text")).alias("source"), F.lit(rubric).alias("rubricVersion"), F.lit(slot).alias("slot")))
    return requests.join(sources, "case_id").select("case_id", F.sha2(fields, 256).alias("key"), F.octet_length("request").alias("bytes"))


def file_details(judged: DataFrame, rows: DataFrame, full: bool = False) -> DataFrame:
    """path, name, verdict, dimensions, needs_review of rows(case_id, path, name, verdict): with full every test with all its dimensions, else those with a deficient one and no other of theirs, and what needs a review by name."""
    bad = (F.col("status") == "judged") & F.col("level").isin("misleading", "weak")
    listed = lambda keep, text: F.array_join(F.array_sort(F.collect_list(F.when(keep, text))), ",")
    shown = F.concat_ws("=", "dimension", F.coalesce("level", "status"))
    per = judged.groupBy("case_id").agg(listed(F.lit(True) if full else bad, shown).alias("dimensions"), listed(F.col("status") == "needs-review", F.col("dimension")).alias("needs_review"))
    out = rows.join(per, "case_id").select("path", "name", "verdict", "dimensions", "needs_review")
    return out if full else out.where("dimensions <> ''")


def report_heads(files: DataFrame, tests: DataFrame, dynamic: DataFrame, bundles: DataFrame) -> DataFrame:
    """path, framework, test_cases, dynamic, bundles of the discovered files(path, framework): how many of tests(path), dynamic(path) and bundles(path) each has."""
    out = files
    for name, rows in (("test_cases", tests), ("dynamic", dynamic), ("bundles", bundles)):
        out = out.join(rows.groupBy("path").agg(F.count("*").alias(name)), "path", "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return out
