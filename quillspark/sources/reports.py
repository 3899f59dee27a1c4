"""Reports of runs in a folder: one directory a run, JSON lines in it; written, read back, listed and chosen.

A report has a head, {"head": {"testCases": n}}, and a line for each classified test. Lines that aren't JSON are kept in
a column of their own, so a broken report is counted and doesn't end a listing. A run's time is the newest of its files'
times of modification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "head struct<testCases: long>, id string, path string, status string, broken string"
# The states of a classified test.
STATES = ("healthy", "weak", "misleading", "needs-review")


def write_reports(lines: DataFrame, folder: str) -> None:
    """lines(run, line): JSON lines of each run's report."""
    lines.select("run", F.col("line").alias("value")).write.partitionBy("run").mode("append").text(f"{folder}/reports")


def report_lines(head: DataFrame, tests: DataFrame) -> DataFrame:
    """run, line of head(run, n) and tests(run, id, path, status)."""
    first = head.select(F.col("run").cast("string").alias("run"), F.to_json(F.struct(F.struct(F.col("n").alias("testCases")).alias("head"))).alias("line"))
    rest = tests.select(F.col("run").cast("string").alias("run"), F.to_json(F.struct("id", "path", "status")).alias("line"))
    return first.unionByName(rest)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """run, head, id, path, status, broken, recorded_at of every line."""
    read = spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").option("basePath", f"{folder}/reports").json(f"{folder}/reports")
    return read.select(F.col("run").cast("string").alias("run"), "head", "id", "path", "status", "broken", F.col("_metadata.file_modification_time").alias("recorded_at"))


def run_listing(lines: DataFrame) -> DataFrame:
    """run, recorded_at, n, needs_change, share, problem of every report: problem says why one can't be read. Newest first is `newest`."""
    bad = F.col("status").isin("weak", "misleading")
    counted = lines.groupBy("run").agg(
        F.max("recorded_at").alias("recorded_at"), F.count_if(F.col("status").isNotNull()).alias("n"), F.count_if(bad).alias("needs_change"), F.count_if(F.col("broken").isNotNull()).alias("lost"), F.count_if(F.col("head.testCases").isNotNull()).alias("heads"),
    )
    problem = F.when(F.col("lost") > 0, "not JSON").when(F.col("heads") == 0, "without testCases")
    sound = problem.isNull()
    share = F.when(F.col("n") == 0, 0.0).otherwise(F.col("needs_change") / F.col("n"))
    return counted.select("run", "recorded_at", F.when(sound, F.col("n")).alias("n"), F.when(sound, F.col("needs_change")).alias("needs_change"), F.when(sound, share).alias("share"), problem.alias("problem"))


def newest(listing: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of the reports that can be read, newest first, ties by run, each with the number of those that can't."""
    skipped = listing.agg(F.count_if(F.col("problem").isNotNull()).alias("skipped"))
    page = listing.where("problem IS NULL").orderBy(F.desc("recorded_at"), "run").offset(offset).limit(limit)
    return page.join(F.broadcast(skipped), how="cross")


def report_of(lines: DataFrame, run: str | None = None) -> DataFrame:
    """The lines of a run's report, or of the newest one. A run that isn't one directory's name has none, whatever it points to."""
    if run is not None:
        return lines.where(F.col("run") == run) if run not in ("", ".", "..") and not set(run) & set("/\\\0") else lines.limit(0)
    last = lines.agg(F.max_by("run", F.struct("recorded_at", "run")).alias("run"))
    return lines.join(F.broadcast(last), "run", "left_semi")
