"""Benchmark questions: votes, confusion, rates, calibration, routing, stability, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import running_sums

#: Cases below which a rate is marked.
LEAST = 5


def votes(samples: DataFrame) -> DataFrame:
    """dimension, case_id, prescriptive, deficient: the strict plurality of the judged runs of a case; null for a tie. Booleans, so two partial counts are enough."""
    bad = F.col("level").isin("misleading", "weak")
    per = samples.where("status = 'judged'").groupBy("dimension", "case_id", "prescriptive").agg(F.count_if(bad).alias("t"), F.count_if(~bad).alias("f"))
    return per.withColumn("deficient", F.when(F.col("t") > F.col("f"), True).when(F.col("f") > F.col("t"), False))


def confusion(vote: DataFrame) -> DataFrame:
    """Truth: a descriptive case is deficient, a prescriptive one is not."""
    said, true = F.col("deficient"), ~F.col("prescriptive")
    count = lambda c, n: F.count_if(c).alias(n)
    return vote.groupBy("dimension").agg(count(said & true, "tp"), count(said & ~true, "fp"), count(~said & true, "fn"), count(~said & ~true, "tn"), count(said.isNull(), "split"))


def rate(n: Column, d: Column, name: str) -> dict[str, Column]:
    return {name: F.when(d > 0, n / d), f"{name}_kind": F.when(d == 0, "not-computable").when(d < LEAST, "below-minimum").otherwise("computed")}


def rates(matrix: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    made = rate(tp, tp + fp, "precision") | rate(tp, tp + fn, "recall") | rate(fp, fp + tn, "fpr")
    # without prescriptive cases nothing could be wrongly flagged, so precision says nothing
    lone = fp + tn == 0
    made["precision"], made["precision_kind"] = F.when(~lone, made["precision"]), F.when(lone, "not-computable").otherwise(made["precision_kind"])
    return matrix.select("dimension", *[c.alias(k) for k, c in made.items()])


def routing(samples: DataFrame) -> DataFrame:
    """Share of applicable samples of proven cases that go to review."""
    return samples.where("proven AND status <> 'not-applicable'").groupBy("dimension").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "needs-review").alias("review")).withColumn("review_share", F.col("review") / F.col("n"))


def calibration(samples: DataFrame) -> DataFrame:
    """Brier score of each case's mean deficient mass against its truth, straddles included. Rounded, as sums of doubles depend on their order."""
    per = samples.where("deficient_mass IS NOT NULL").groupBy("dimension", "case_id", "prescriptive").agg(F.avg("deficient_mass").alias("m"))
    truth = F.when(F.col("prescriptive"), 0.0).otherwise(1.0)
    return per.groupBy("dimension").agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col("m") - truth, F.lit(2))), 9).alias("brier"))


def stability(samples: DataFrame) -> DataFrame:
    """Agreeing pairs of runs of all pairs, in closed form over counts; no self-join."""
    key = F.when(F.col("status") == "judged", F.concat(F.lit("judged:"), F.col("level"))).otherwise(F.col("status"))
    per = samples.groupBy("dimension", "case_id", key.alias("k")).agg(F.count("*").alias("c"))
    case = per.groupBy("dimension", "case_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("a"))
    return case.groupBy("dimension").agg((F.sum("a") / 2).cast("long").alias("agreeing"), (F.sum(F.col("n") * (F.col("n") - 1)) / 2).cast("long").alias("pairs"))


def compare(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """case_id, outcome: both(case_id, verdict, prescriptive, proven) by one full outer join and an ordered rule."""
    b, c = (d.select("case_id", *[F.col(x).alias(f"{p}_{x}") for x in ("verdict", "prescriptive", "proven")]) for d, p in ((baseline, "b"), (candidate, "c")))
    right = lambda p: (F.col(f"{p}_verdict") == "healthy") == F.col(f"{p}_prescriptive")
    rule = (
        F.when(F.col("b_proven").isNull(), "missing-in-baseline").when(F.col("c_proven").isNull(), "missing-in-candidate")
        .when(~F.col("b_prescriptive").eqNullSafe(F.col("c_prescriptive")), "fixture-changed")
        .when(~F.col("b_proven"), "unproven-in-baseline").when(~F.col("c_proven"), "unproven-in-candidate")
        .when(F.col("b_verdict").isNull(), "not-sampled-in-baseline").when(F.col("c_verdict").isNull(), "not-sampled-in-candidate")
        .when(F.col("b_verdict") == F.col("c_verdict"), "agreement").when(right("b") & ~right("c"), "regression").otherwise("disagreement")
    )
    return b.join(c, "case_id", "full").select("case_id", rule.alias("outcome"))


def stratified(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows(dimension, ...) with their round: the first of each dimension, then the second, and so on. There are a few dimensions, so their rows are counted in ranges."""
    return running_sums(rows.withColumn("_one", F.lit(1).cast("long")), "dimension", order, "_one").withColumnRenamed("sum", "round").drop("_one")
