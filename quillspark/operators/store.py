"""The benchmark store: cases of runs with what belongs to them, nested for readers, and taken apart again without loss.

A nested row is one case: runs have as many as there are, so they are no row of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of observations.
OBSERVATIONS = ("passed", "failed", "timed-out", "runner-error")


def fixture_hash(files: Column) -> Column:
    """A hash of a fixture's files, an array of struct(path, contents), in order of their paths, each framed by nulls."""
    framed = F.transform(F.sort_array(files), lambda f: F.concat(F.lit("path:"), f["path"], F.lit("\0"), f["contents"], F.lit("\0")))
    return F.sha2(F.array_join(framed, ""), 256)


def recorded_cases(cases: DataFrame, files: DataFrame) -> DataFrame:
    """cases(run, case_id, ..., proof_status, proof_reason) with the hash of files(run, case_id, path, contents); a reason is kept for unproven cases alone."""
    hashes = files.groupBy("run", "case_id").agg(fixture_hash(F.collect_list(F.struct("path", "contents"))).alias("fixture_hash"))
    none = F.sha2(F.lit(""), 256)
    rows = cases.join(hashes, ["run", "case_id"], "left").withColumn("fixture_hash", F.coalesce("fixture_hash", none))
    return rows.withColumn("proof_reason", F.when(F.col("proof_status") == "unproven", F.coalesce("proof_reason", F.lit(""))))


def nested_cases(cases: DataFrame, observations: DataFrame, samples: DataFrame, failures: DataFrame) -> DataFrame:
    """cases with observations (in order of id), sample and failure.

    observations(run, case_id, id, label, kind, detail, content_hash), samples(run, case_id, ...) and failures(run, case_id, kind, message): a case has any number of the first, and at most one of each other. What runner errors and failures say is their detail; a kind that isn't known is an error column, not a guess."""
    keys = ["run", "case_id"]
    known = F.col("kind").isin(*OBSERVATIONS)
    # passed and timed-out have no detail, a runner error always has one
    detail = F.when(F.col("kind") == "failed", F.col("detail")).when(F.col("kind") == "runner-error", F.coalesce("detail", F.lit("")))
    seen = observations.select(*keys, F.struct("id", "label", F.when(known, F.col("kind")).alias("kind"), detail.alias("detail"), "content_hash", F.when(~known, F.col("kind")).alias("unknown_kind")).alias("o"))
    seen = seen.groupBy(*keys).agg(F.sort_array(F.collect_list("o")).alias("observations"))
    struct = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    rows = cases.join(seen, keys, "left").join(struct(samples, "sample"), keys, "left").join(struct(failures, "failure"), keys, "left")
    none = F.array().cast(seen.schema["observations"].dataType)
    return rows.withColumn("observations", F.coalesce("observations", none))


def flat_tables(nested: DataFrame) -> dict[str, DataFrame]:
    """The tables that `nested_cases` was made of."""
    keys = ["run", "case_id"]
    seen = nested.select(*keys, F.explode("observations").alias("o")).select(*keys, "o.id", "o.label", F.coalesce("o.kind", "o.unknown_kind").alias("kind"), "o.detail", "o.content_hash")
    return {
        "cases": nested.drop("observations", "sample", "failure"), "observations": seen,
        "samples": nested.where("sample IS NOT NULL").select(*keys, "sample.*"), "failures": nested.where("failure IS NOT NULL").select(*keys, "failure.*"),
    }
