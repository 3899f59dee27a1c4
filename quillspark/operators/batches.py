"""Batches of files to work on, of at most so many tests, by pointers from each file to the one where the next batch begins.

A batch that begins with a file ends before the first later file with which its sum would pass the bound. So every file
has a pointer to the batch border behind it, and the borders are the files that the first one reaches. Pointers are
found in buckets of the running sum and followed by doubling: no folder is folded in one row or one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

#: Running sums of one bucket, in bounds of a batch; a bucket has at most as many files as tests.
BOUNDS = 64


def running_sums(rows: DataFrame, group: str, order: list[str], value: str) -> DataFrame:
    """rows with sum, value added up along each group's order. Rows are dealt by range, summed within a task, and moved on by the sums of the tasks before, of which a group has one row each."""
    dealt = stored(rows.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    parts = dealt.groupBy(group, "_part").agg(F.sum(value).alias("s"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select(group, "_part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_carried"))
    inside = Window.partitionBy(group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return dealt.join(carried, [group, "_part"]).withColumn("sum", F.col("_carried") + F.sum(value).over(inside)).drop("_part", "_carried")


def _beside(rows: DataFrame, forward: bool) -> DataFrame:
    """rows(folder, at, kind, file): each row of kind 1 with the nearest file of kind 0 above its at (forward), or at or below it; by bucket first, then from the next bucket that has one."""
    inside = Window.partitionBy("folder", "bucket").orderBy("at", "kind")
    over = Window.partitionBy("folder").orderBy("bucket")
    # at one sum a file stands before what asks, so that it isn't above it, but at or below
    own = F.when(F.col("kind") == 0, F.struct("at", "file"))
    if forward:
        near = F.first(own, ignorenulls=True).over(inside.rowsBetween(1, Window.unboundedFollowing))
        edge, far = F.min(own), F.first("edge", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing))
    else:
        near = F.last(own, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1))
        edge, far = F.max(own), F.last("edge", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))
    edges = rows.groupBy("folder", "bucket").agg(edge.alias("edge")).select("folder", "bucket", far.alias("far"))
    asked = rows.withColumn("near", near).where("kind = 1").join(edges, ["folder", "bucket"])
    return asked.select("folder", "own", F.coalesce("near", "far").alias("beside"))


def chunks(files: DataFrame, most: int, order: list[str] | None = None) -> DataFrame:
    """folder, file, chunk of files(folder, file, n) in order: a new chunk where the sum would pass most; a larger file is alone. n is at least 1."""
    order = order or ["file"]
    placed = stored(running_sums(files, "folder", order, "n").select("folder", "file", "n", "sum"), "files")
    bucket = lambda at: F.floor(at / (most * BOUNDS)).alias("bucket")
    row = lambda at, kind, own: ["folder", at.alias("at"), F.lit(kind).alias("kind"), "file", own.alias("own"), bucket(at)]
    # a file larger than the bound is alone
    ends = F.greatest(F.col("sum"), F.col("sum") - F.col("n") + most)
    here = placed.select(*row(F.col("sum"), 0, F.lit(None).cast("string")))
    pointers = _beside(here.unionByName(placed.select(*row(ends, 1, F.col("file")))), forward=True).select("folder", F.col("own").alias("file"), F.col("beside.file").alias("next"))
    first = placed.groupBy("folder").agg(F.min_by("file", "sum").alias("file"))
    reached = stored(first.select("folder", "file", F.lit(0).cast("long").alias("chunk")), "borders")
    jump, steps = stored(pointers.where("next IS NOT NULL"), "pointers"), 1
    while jump.limit(1).count():
        on = reached.join(jump, ["folder", "file"]).select("folder", F.col("next").alias("file"), (F.col("chunk") + steps).alias("chunk"))
        more = stored(on, "borders")
        if not more.limit(1).count():
            break
        reached = reached.unionByName(more)
        twice = jump.join(jump.select("folder", F.col("file").alias("next"), F.col("next").alias("after")), ["folder", "next"]).select("folder", "file", F.col("after").alias("next"))
        jump, steps = stored(twice, "pointers"), steps * 2
    borders = placed.join(reached, ["folder", "file"]).select(*row(F.col("sum"), 0, F.lit(None).cast("string")))
    asked = placed.select(*row(F.col("sum"), 1, F.col("file")))
    held = _beside(borders.unionByName(asked), forward=False).select("folder", F.col("own").alias("file"), F.col("beside.file").alias("border"))
    return held.join(reached.select("folder", F.col("file").alias("border"), "chunk"), ["folder", "border"]).select("folder", "file", "chunk")


def worst_of(rows: DataFrame, keys: list[str], n: int = 3) -> DataFrame:
    """keys, worst: the n dimensions with most bad findings of rows(keys, dimension, bad), ties by name. A key has as many rows as there are dimensions."""
    sums = rows.groupBy(*keys, "dimension").agg(F.sum("bad").alias("bad")).where("bad > 0")
    ranked = sums.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("bad"), "dimension"))).where(F.col("r") <= n)
    listed = F.sort_array(F.collect_list(F.struct("r", "dimension", "bad")))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: F.concat_ws("=", x["dimension"], x["bad"].cast("string"))), ",").alias("worst"))


def folder_batches(tests: DataFrame, folders: DataFrame, found: DataFrame, most: int) -> DataFrame:
    """key, folder, remainder, files, tests, worst: tests(path), folders(path, folder, remainder) and found(path, dimension, bad) in batches of whole files, the largest files first. The rest of a folder that others were taken from is called other files; of several batches each is a part."""
    files = tests.groupBy("path").agg(F.count("*").alias("n")).join(folders, "path").select("folder", F.col("path").alias("file"), "n", "remainder", (-F.col("n")).alias("less"))
    files = stored(files, "batches")
    cut = files.join(chunks(files.select("folder", "file", "n", "less"), most, ["less", "file"]), ["folder", "file"])
    totals = cut.groupBy("folder", "chunk").agg(F.max("remainder").alias("remainder"), F.count("*").alias("files"), F.sum("n").alias("tests"))
    parts = cut.groupBy("folder").agg((F.max("chunk") + 1).alias("parts"))
    bad = cut.select("folder", "chunk", F.col("file").alias("path")).join(found, "path")
    label = F.concat("folder", F.when(F.col("remainder"), " (other files)").otherwise(""), F.when(F.col("parts") > 1, F.concat(F.lit(" (part "), (F.col("chunk") + 1).cast("string"), F.lit(")"))).otherwise(""))
    rows = totals.join(parts, "folder").join(worst_of(bad, ["folder", "chunk"]), ["folder", "chunk"], "left")
    return rows.select(label.alias("key"), "folder", "remainder", "files", "tests", F.coalesce("worst", F.lit("")).alias("worst"))


def file_batches(tests: DataFrame, found: DataFrame) -> DataFrame:
    """key, tests, worst: a batch for each file."""
    totals = tests.groupBy("path").agg(F.count("*").alias("tests"))
    return totals.join(worst_of(found, ["path"]), "path", "left").select(F.col("path").alias("key"), "tests", F.coalesce("worst", F.lit("")).alias("worst"))
