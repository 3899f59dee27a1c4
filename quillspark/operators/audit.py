"""What a run of the audit counts and reports: cases and their bundles, outcomes, coverage, diagnostics, latency, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_millis

SKIPS = ("skip", "todo", "evidence-unavailable")
#: Buckets that a window of time is dealt into, and buckets whose sums are added up in one task.
TURNS, RUN = 64, 10_000


def skip_reason(modifiers: Column, has_bundle: Column) -> Column:
    """The first skip or todo modifier, else evidence-unavailable without a bundle; null for a case to evaluate."""
    first = F.get(F.filter(modifiers, lambda m: m.isin("skip", "todo")), F.lit(0))
    return F.coalesce(first, F.when(~has_bundle, "evidence-unavailable"))


def with_bundles(cases: DataFrame, bundles: DataFrame) -> DataFrame:
    """cases(case_id, modifiers, ...) with their bundle's columns, if any, and why they are skipped, if they are."""
    joined = cases.join(bundles.withColumn("_has", F.lit(True)), "case_id", "left")
    return joined.withColumn("skipped", skip_reason(F.col("modifiers"), F.coalesce("_has", F.lit(False)))).drop("_has")


def bundle_totals(fragments: DataFrame) -> DataFrame:
    """case_id, fragments, bytes, truncated, hash of fragments(case_id, path, start, text, truncated): the hash is of their canonical order."""
    row = F.struct("path", "start", F.sha2(F.col("text"), 256).alias("h"))
    listed = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.concat_ws(":", x["path"], x["start"].cast("string"), x["h"]))
    return fragments.groupBy("case_id").agg(
        F.count("*").alias("fragments"), F.sum(F.octet_length("text")).cast("long").alias("bytes"), F.count_if("truncated").alias("truncated"), F.sha2(F.array_join(listed, "\n"), 256).alias("hash")
    )


def audit_totals(files: DataFrame, cases: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """One row of counters, each from a partial aggregate of its own table."""
    a = files.agg(F.count_if(F.col("reason").isNull()).alias("files"), F.count_if(F.col("reason").isNotNull()).alias("excluded"))
    c = cases.agg(F.count("*").alias("test_cases"), F.count("hash").alias("evidence_bundles"), F.coalesce(F.sum("fragments"), F.lit(0)).alias("evidence_fragments"), F.coalesce(F.sum("truncated"), F.lit(0)).alias("evidence_truncated"))
    d = diagnostics.agg(F.count("*").alias("diagnostics"), F.count_distinct(F.when(F.col("code") == "unsupported-framework", F.col("path"))).alias("unsupported_framework_files"))
    return a.crossJoin(c).crossJoin(d)  # one row each


def outcome_totals(outcomes: DataFrame) -> DataFrame:
    """One row of outcomes(ord, state, skipped, verdict, pinned, model, tokens). Tokens are those of fresh answers alone; the model is the first that answered."""
    answered = F.col("state").isin("completed", "cached")
    count = lambda c, n: F.count_if(c).alias(n)
    state = lambda s: F.col("state") == s
    return outcomes.agg(
        count(state("completed"), "evaluated"), count(state("cached"), "cached"), count(state("not-cached"), "not_cached"), count(state("failed"), "failed"),
        *[count(state("skipped") & (F.col("skipped") == s), f"skipped_{s.replace('-', '_')}") for s in SKIPS],
        F.coalesce(F.sum(F.when(state("completed"), F.col("tokens"))), F.lit(0)).alias("input_tokens"),
        *[count(answered & (F.col("verdict") == v), v.replace("-", "_")) for v in ("misleading", "weak", "needs-review", "healthy")],
        count(answered & ~F.col("pinned"), "model_mismatches"), F.min_by(F.when(answered, F.col("model")), F.when(answered, F.col("ord"))).alias("responded_model"),
    )


def coverage(outcomes: DataFrame) -> DataFrame:
    """The funnel from found to judged."""
    judged = F.count_if(F.col("state").isin("completed", "cached"))
    return outcomes.agg(
        F.count("*").alias("discovered"), judged.alias("judged"), F.when(F.count("*") == 0, 0.0).otherwise(judged / F.count("*")).alias("judged_share"),
        F.count_if(F.col("state") == "failed").alias("not_evaluated"), F.count_if(F.col("state") == "skipped").alias("skipped"),
    )


def diagnostics_by_code(rows: DataFrame) -> DataFrame:
    """code, n, severities: severity=count in order, of rows(code, severity)."""
    per = rows.groupBy("code", "severity").agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("severity", "n"))), lambda x: F.concat_ws("=", x["severity"], x["n"].cast("string"))), ",")
    return per.groupBy("code").agg(F.sum("n").alias("n"), listed.alias("severities"))


def latency_summary(rows: DataFrame) -> DataFrame:
    """n, total, mean, least, most of rows(ms); null where nothing was measured."""
    return rows.agg(F.count("ms").alias("n"), F.sum("ms").alias("total"), F.avg("ms").alias("mean"), F.min("ms").alias("least"), F.max("ms").alias("most"))


def settled(last: DataFrame, children: DataFrame) -> DataFrame:
    """Last rows whose child rows are complete: an answer and a judgment for completed, a judgment and a key for cached, an error or a skip for the others. children(id, has_attempt, has_judgment, has_error, has_skip)."""
    has = lambda c: F.coalesce(f"has_{c}", F.lit(False))
    state = lambda s: F.col("state") == s
    complete = (state("completed") & has("attempt") & has("judgment")) | (state("cached") & has("judgment") & F.col("cache_key").isNotNull()) | (state("failed") & has("error")) | (state("skipped") & has("skip"))
    return last.join(children, "id", "left").where(complete).select(last.columns)


def report_rows(judged: DataFrame, latency: DataFrame, cache: DataFrame, bundles: DataFrame) -> DataFrame:
    """Judgments with latency, cache status (fresh where none is known) and the totals of their evidence (zeros where there is none)."""
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = judged.join(latency, "case_id", "left").join(cache, "case_id", "left").join(bundles.select("case_id", "fragments", "bytes", "truncated"), "case_id", "left")
    return rows.select(*judged.columns, "ms", F.coalesce("cache_status", F.lit("fresh")).alias("cache_status"), zero("fragments"), zero("bytes"), zero("truncated"))


def answer_problem(ids: Column, requested: Column, values: Column) -> Column:
    """Why an answer can't be used: ids that are missing or weren't asked, or a value that is no finite number; else null."""
    missing, extra = F.array_except(requested, ids), F.array_except(ids, requested)
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(F.array_sort(missing), ","))).when(F.size(extra) > 0, F.concat(F.lit("unasked:"), F.array_join(F.array_sort(extra), ","))).when(bad, "not-finite")


def evaluation_plan(cases: DataFrame, settled_ids: DataFrame, cached: DataFrame, cache_only: bool = False) -> DataFrame:
    """case_id, step: what becomes of each case, by the first that holds: skipped, reused from a run that is resumed, cached, not-cached (where only the cache may be asked), evaluate."""
    reuse = settled_ids.select("case_id", F.lit(True).alias("_done")).distinct()
    hit = cached.select("cache_key", F.lit(True).alias("_hit")).distinct()
    rows = cases.join(reuse, "case_id", "left").join(hit, "cache_key", "left")
    step = F.when(F.col("skipped").isNotNull(), "skipped").when(F.col("_done"), "reused").when(F.col("_hit"), "cached").otherwise("not-cached" if cache_only else "evaluate")
    return rows.select("case_id", step.alias("step"))


def merged_in_order(preloaded: DataFrame, dispatched: DataFrame) -> DataFrame:
    """Outcomes of a resumed run, those reused and those made, in the cases' order."""
    return preloaded.unionByName(dispatched).orderBy("ord")


def progress_marks(rows: DataFrame, total: int) -> DataFrame:
    """Rows(n), numbered from 1, that are reported: about twenty, and the last."""
    every = max(1, total // 20)
    return rows.where((F.col("n") % every == 0) | (F.col("n") == total))


def tokens_within(log: DataFrame, ms: int) -> DataFrame:
    """id, tokens: tokens (whole numbers) of all requests in the window of time that ends with each. Requests without a time are each other's window: one sum.

    A request's tokens come in at its time and go out when a window's length is over, so a window is a running sum of what came and went, and no request looks at the others of its window. Time is dealt into TURNS buckets for a window's length; what stands at a bucket's beginning is summed up over the buckets before it, so no task holds all requests."""
    rows = log.select("id", "tokens", epoch_millis(F.col("ts")).alias("at"))
    timeless, rows = rows.where("at IS NULL"), rows.where("at IS NOT NULL")
    known = F.when(F.col("tokens").isNull(), 0).otherwise(1).cast("long")
    tokens = F.coalesce(F.col("tokens").cast("long"), F.lit(0).cast("long"))
    came = rows.select("id", "at", tokens.alias("tokens"), known.alias("known"), F.lit(True).alias("own"))
    went = rows.select(F.lit(None).cast(log.schema["id"].dataType).alias("id"), (F.col("at") + ms).alias("at"), (-tokens).alias("tokens"), (-known).alias("known"), F.lit(False).alias("own"))
    both = came.unionByName(went).withColumn("bucket", F.floor(F.col("at") / max(1, ms // TURNS)))
    # what stands at the beginning of a run of buckets, then of a bucket: rows that come before all others of theirs
    sums = both.groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known")).withColumn("run", F.floor(F.col("bucket") / RUN))
    runs = sums.groupBy("run").agg(F.sum("tokens").alias("tokens"), F.sum("known").alias("known"))
    before = lambda w, *keep: [*keep, *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias(c) for c in ("tokens", "known")]]
    starts = runs.select(*before(Window.orderBy("run"), "run"), F.lit(None).cast("long").alias("bucket"))
    stands = sums.unionByName(starts).select(*before(Window.partitionBy("run").orderBy(F.col("bucket").asc_nulls_first()), "bucket")).where("bucket IS NOT NULL AND tokens IS NOT NULL")
    stands = stands.select(F.lit(None).cast(log.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("at"), "tokens", "known", F.lit(False).alias("own"), "bucket")
    running = Window.partitionBy("bucket").orderBy(F.col("at").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    summed = both.unionByName(stands).select("id", "own", F.sum("tokens").over(running).alias("spent"), F.sum("known").over(running).alias("known"))
    timed = summed.where("own").select("id", F.when(F.col("known") > 0, F.col("spent")).alias("tokens"))
    return timed.unionByName(timeless.select("id").crossJoin(timeless.agg(F.sum("tokens").alias("tokens"))))
