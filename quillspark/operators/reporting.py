"""Report questions over verdicts and judgments: files, folders, dimensions, worklists, pages, differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .judgment import is_finding, share
from .stored import stored

BUCKETS = ("misleading", "weak", "acceptable", "strong", "needs-review", "not-applicable")
# How bad a verdict is.
RANK = {"healthy": 0, "needs-review": 1, "weak": 2, "misleading": 3}


def bucket():
    return F.when(F.col("status") == "judged", F.col("level")).otherwise(F.col("status"))


def dimension_buckets(judged: DataFrame) -> DataFrame:
    """Counts of the six buckets for each dimension, and the share of deficient ones as a sum of two quotients."""
    counts = [F.count_if(bucket() == b).alias(b.replace("-", "_")) for b in BUCKETS]
    rows = judged.groupBy("dimension").agg(F.count("*").alias("n"), *counts)
    return rows.withColumn("deficient_share", share(F.col("misleading"), F.col("n")) + share(F.col("weak"), F.col("n")))


def ranked_dimensions(judged: DataFrame) -> DataFrame:
    """Dimensions with their rank, worst first. There are as many rows as dimensions."""
    order = Window.orderBy(F.desc("deficient_share"), F.desc(F.col("misleading") + F.col("weak")), "dimension")
    return dimension_buckets(judged).select("dimension", "deficient_share", F.row_number().over(order).cast("long").alias("rank"))


def file_totals(verdict: DataFrame, cases: DataFrame, key) -> DataFrame:
    per = verdict.join(cases, "case_id").groupBy(key.alias("folder")).agg(F.count("*").alias("n"), F.count_if(F.col("verdict").isin("misleading", "weak")).alias("bad"), F.count_if(F.col("verdict") == "needs-review").alias("review"))
    return per.withColumn("bad_share", share(F.col("bad"), F.col("n")))


def top_files(totals: DataFrame, n: int = 10) -> DataFrame:
    """The feature is a top list: most bad ones first, then share, then name."""
    return totals.where("bad > 0").orderBy(F.desc("bad"), F.desc("bad_share"), "folder").limit(n)


def folders_with_other(totals: DataFrame, n: int = 12) -> DataFrame:
    """The n largest folders; the others are merged. The largest are found by a limit, and broadcast as n names."""
    largest = totals.orderBy(F.desc("n"), "folder").limit(n).select("folder", F.lit(True).alias("_large"))
    named = totals.join(F.broadcast(largest), "folder", "left").withColumn("folder", F.when(F.col("_large"), F.col("folder")).otherwise("Other"))
    return named.groupBy("folder").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "review")])


def heat_cells(judged: DataFrame, cases: DataFrame, key) -> DataFrame:
    """Folder by dimension: applicable judgments and the deficient ones among them."""
    on = judged.where("applicable").join(cases.select("case_id", key.alias("folder")), "case_id")
    return on.groupBy("folder", "dimension").agg(F.count("*").alias("n"), F.count_if(bucket().isin("misleading", "weak")).alias("bad")).withColumn("bad_share", share(F.col("bad"), F.col("n")))


def drilled_cells(judged: DataFrame, placed: DataFrame, n: int = 12) -> DataFrame:
    """Heat cells of placed(case_id, folder): the n folders of most cases are rows, the others together are Other."""
    largest = placed.groupBy("folder").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "folder").limit(n).select("folder", F.lit(True).alias("_large"))
    named = placed.join(F.broadcast(largest), "folder", "left").select("case_id", F.when(F.col("_large"), F.col("folder")).otherwise("Other").alias("folder"))
    return heat_cells(judged, named, F.col("folder"))


def worst_dimensions(cells: DataFrame, n: int = 3) -> DataFrame:
    """The n worst dimensions of each folder, in order. A folder has as many rows as there are dimensions."""
    order = Window.partitionBy("folder").orderBy(F.desc("bad_share"), F.desc("bad"), "dimension")
    return cells.where("bad > 0").withColumn("r", F.row_number().over(order)).where(F.col("r") <= n).groupBy("folder").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "dimension"))), lambda x: x["dimension"]), ",").alias("worst"))


def worklist(judged: DataFrame, verdict: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that need a change, with their findings in order."""
    found = judged.where(is_finding()).groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "dimension", F.coalesce("level", "reason")))), ",").alias("findings"))
    return verdict.where(F.col("verdict").isin("misleading", "weak")).join(cases.select("case_id", "path"), "case_id").join(found, "case_id", "left").select("path", "case_id", "verdict", "findings")


def page(rows: DataFrame, order: list, first: int, size: int) -> DataFrame:
    """Rows first.. of an order, with the total and how many are left out."""
    total = rows.agg(F.count("*").alias("total"))
    part = rows.orderBy(*order).offset(first).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumn("omitted", F.col("total") - F.least(F.greatest(F.col("total") - first, F.lit(0)), F.lit(size)))


def status_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, change: added, removed, improved, regressed or same, by one full outer join."""
    rank = lambda c: F.coalesce(*[F.when(F.col(c) == k, v) for k, v in RANK.items()])
    both = before.withColumnRenamed("verdict", "b").join(after.withColumnRenamed("verdict", "a"), "case_id", "full")
    rule = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(rank("a") < rank("b"), "improved").when(rank("a") > rank("b"), "regressed").otherwise("same")
    return both.select("case_id", rule.alias("change"))


def selected(rows: DataFrame, folder: str | None = None, statuses: tuple[str, ...] = (), with_dimension: DataFrame | None = None) -> DataFrame:
    """rows(case_id, path, verdict, ...) below a folder, of some verdicts, that have a dimension: with_dimension(case_id) are those that do."""
    if folder is not None:
        rows = rows.where((F.col("path") == folder) | F.col("path").startswith(folder.rstrip("/") + "/"))
    if statuses:
        rows = rows.where(F.col("verdict").isin(*statuses))
    return rows if with_dimension is None else rows.join(with_dimension.select("case_id").distinct(), "case_id", "left_semi")


def searched(rows: DataFrame, query: str) -> DataFrame:
    """rows(case_id, name, ...) whose id is the query, or whose name holds it, whatever the case."""
    return rows.where((F.col("case_id").cast("string") == query) | F.contains(F.lower("name"), F.lit(query.lower())))


def summary(rows: DataFrame) -> DataFrame:
    """One row: how many, by verdict, and the shares that need a change or a review."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    share = lambda c: F.when(F.count("*") == 0, 0.0).otherwise(c / F.count("*"))
    return rows.agg(
        F.count("*").alias("judged"), *[count(v).alias(v.replace("-", "_")) for v in ("misleading", "weak", "needs-review", "healthy")],
        share(count("misleading") + count("weak")).alias("needs_change_share"), share(count("needs-review")).alias("needs_review_share"),
    )


def dimension_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, dimension, before, after: levels or statuses that differ, with those that only one side has."""
    state = F.coalesce("level", "status")
    x, y = (d.select("case_id", "dimension", state.alias(n)) for d, n in ((before, "before"), (after, "after")))
    return x.join(y, ["case_id", "dimension"], "full").where("NOT (before <=> after)")


def file_worklist(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """path, n, tests: needs-change tests by file, each with its misleading and weak dimensions. findings(case_id, dimension, level)."""
    listed = findings.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "dimension", "level"))), "+").alias("found"))
    bad = rows.where("verdict IN ('misleading', 'weak')").join(listed, "case_id", "left")
    line = F.concat_ws(":", "name", "verdict", F.coalesce("found", F.lit("")))
    return bad.groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "|").alias("tests"))


def review_worklist(rows: DataFrame, unsure: DataFrame) -> DataFrame:
    """path, n, tests: dimensions that need a review, with their reasons, by file. unsure(case_id, dimension, reason)."""
    line = F.concat_ws(":", "name", "dimension", F.coalesce("reason", F.lit("")))
    return rows.join(unsure, "case_id").groupBy("path").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(line)), "|").alias("tests"))


# What share of all makes a folder be opened, the least cases of a folder of its own, and segments that aren't folders of their own.
DOMINANT, GROUP_LEAST = 1 / 12, 3
GENERIC = ("src", "lib", "app", "test", "tests", "__tests__", "spec", "packages", "apps")


def drilled_folders(counts: DataFrame, dominant: float = DOMINANT, least: int = GROUP_LEAST, generic: tuple[str, ...] = GENERIC, depth: int = 32) -> DataFrame:
    """path, folder, remainder: counts(path, n) of cases by adaptive folders.

    From the root down, a folder with at least the dominant share of all cases is opened: each next folder with at least
    `least` cases, past generic segments, becomes a row, which may be opened in turn; the rest stays with the folder and
    is a remainder where others left it. At most 1 / dominant folders are open on a level, so each step is an aggregate
    over the rows that are still open, and a broadcast of that many names."""
    total = counts.agg(F.sum("n").alias("t")).first()["t"] or 0
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    # one row for each directory; levels read the level before as it was written
    known = counts.select("path", "n", dirs.alias("dirs"))
    rows = known.groupBy("dirs").agg(F.sum("n").alias("n")).select("dirs", "n", F.lit(".").alias("folder"), F.lit(0).alias("at"), F.lit(True).alias("live"))
    rows = stored(rows, "folders")
    split: list[str] = []
    for _ in range(depth):
        open_ = [r["folder"] for r in rows.where("live").groupBy("folder").agg(F.sum("n").alias("s")).where(F.col("s") >= dominant * total).select("folder").collect()]
        if not open_ or not total:
            break
        # where the next segment that isn't generic ends
        rest = F.slice("dirs", F.col("at") + 1, F.size("dirs"))
        first = F.get(F.filter(F.transform(rest, lambda x, i: F.when(~x.isin(*generic), i)), lambda i: i.isNotNull()), F.lit(0))
        below = rows.withColumn("opened", F.col("live") & F.col("folder").isin(*open_)).withColumn("to", F.when(F.col("opened"), F.col("at") + first + 1))
        below = below.withColumn("child", F.when(F.col("to").isNotNull(), F.array_join(F.slice("dirs", F.lit(1), F.col("to")), "/")))
        own = below.where("child IS NOT NULL").groupBy("child").agg(F.sum("n").alias("s"), F.min("folder").alias("parent")).where(F.col("s") >= least)
        parents = [r["parent"] for r in own.select("parent").distinct().collect()]
        if not parents:
            break
        split += parents
        moved = below.join(own.select("child", F.lit(True).alias("moved")), "child", "left")
        go = F.coalesce("moved", F.lit(False))
        rows = moved.select("dirs", "n", F.when(go, F.col("child")).otherwise(F.col("folder")).alias("folder"), F.when(go, F.col("to")).otherwise(F.col("at")).alias("at"), go.alias("live"))
        rows = stored(rows, "folders")
    remainder = F.col("folder").isin(*split) if split else F.lit(False)
    return known.join(rows, "dirs").select("path", "folder", remainder.alias("remainder"))
