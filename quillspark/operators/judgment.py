"""Judgments of dimensions, verdicts of cases, and shares of verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLACK, TOLERANCE = 1e-9, 0.02


@dataclass(frozen=True)
class Policy:
    """confidence: the gate of version 1; the sides and critical: the masses of later versions."""

    version: int
    applicability: float = 0.5
    confidence: float | None = None
    acceptable: float = 0.65
    deficient: float = 0.65
    critical: float = 0.5
    cuts: tuple[float, float, float] = (1.0, 2.0, 3.0)


# The published policies.
V1 = Policy(1, confidence=0.6)
V2 = Policy(2)
V3 = Policy(3, acceptable=0.575)
STATUSES = ("misleading", "weak", "needs-review", "healthy")


def quartet_valid() -> Column:
    """p0..p3 all there, within 0 and 1, and of sum 1 but for TOLERANCE."""
    p = [F.col(f"p{k}") for k in range(4)]
    within = F.lit(True)
    for x in p:
        within = within & x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)
    return F.coalesce(within & (F.abs(p[0] + p[1] + p[2] + p[3] - 1.0) <= TOLERANCE + SLACK), F.lit(False))


def judge(answers: DataFrame, policy: Policy) -> DataFrame:
    """answers with status, level, reason, applicable, deficient_mass. A null applicability or score is a missing answer."""
    a, score = F.col("applicability"), F.col("score")
    low, high = F.col("p0") + F.col("p1"), F.col("p2") + F.col("p3")
    of = lambda status, level=None, reason=None: F.struct(F.lit(status).alias("status"), (level if isinstance(level, Column) else F.lit(level).cast("string")).alias("level"), F.lit(reason).cast("string").alias("reason"))
    rule = F.when(a.isNull(), of("needs-review", reason="missing-answer")).when(a < policy.applicability, of("not-applicable")).when(score.isNull(), of("needs-review", reason="missing-answer"))
    if policy.confidence is not None:
        level = F.when(score < policy.cuts[0], "misleading").when(score < policy.cuts[1], "weak").when(score < policy.cuts[2], "acceptable").otherwise("strong")
        rule = rule.when(F.col("confidence") < policy.confidence, of("needs-review", reason="low-confidence")).otherwise(of("judged", level))
        mass = F.lit(None).cast("double")
    else:
        bad = F.when(F.col("p0") >= policy.critical - SLACK, "misleading").otherwise("weak")
        good = F.when(score >= policy.cuts[2], "strong").otherwise("acceptable")
        rule = (
            rule.when(~quartet_valid(), of("needs-review", reason="missing-answer"))
            .when(low >= policy.deficient - SLACK, of("judged", bad))
            .when(high >= policy.acceptable - SLACK, of("judged", good))
            .otherwise(of("needs-review", reason="boundary-straddle"))
        )
        mass = F.when(quartet_valid() & (a >= policy.applicability) & score.isNotNull(), low)
    judged = answers.withColumns({"_r": rule, "deficient_mass": mass})
    return judged.withColumns({"status": F.col("_r.status"), "level": F.col("_r.level"), "reason": F.col("_r.reason"), "applicable": F.col("_r.status") != "not-applicable"}).drop("_r")


def is_finding() -> Column:
    return (F.col("status") == "needs-review") | ((F.col("status") == "judged") & F.col("level").isin("misleading", "weak"))


def verdicts(judged: DataFrame, cases: DataFrame) -> DataFrame:
    """case_id, verdict: one partial aggregate per case, then the pin by a left join."""
    was = lambda level: F.coalesce(F.bool_or((F.col("status") == "judged") & (F.col("level") == level)), F.lit(False))
    per = judged.groupBy("case_id").agg(was("misleading").alias("m"), was("weak").alias("w"), F.bool_or("applicable").alias("any"), F.bool_or(F.col("status") == "needs-review").alias("r"))
    rule = F.when(F.col("m"), "misleading").when(F.col("w"), "weak").when(~F.col("any") | F.col("r") | ~F.coalesce("pinned", F.lit(False)), "needs-review").otherwise("healthy")
    return per.join(cases.select("case_id", "pinned"), "case_id", "left").select("case_id", rule.alias("verdict"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole)


def status_breakdown(verdict: DataFrame) -> DataFrame:
    """A row for each status in fixed order, absent ones with zero."""
    fixed = verdict.sparkSession.createDataFrame([(i, s) for i, s in enumerate(STATUSES)], "position long, verdict string")
    return F.broadcast(fixed).join(verdict.groupBy("verdict").agg(F.count("*").alias("n")), "verdict", "left").select("position", "verdict", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def headline(verdict: DataFrame) -> DataFrame:
    """Shares of all verdicts that need a change or a review; 0 without verdicts."""
    n = F.count("*")
    return verdict.agg(
        n.alias("judged"), share(F.count_if(F.col("verdict").isin("misleading", "weak")), n).alias("needs_change_share"), share(F.count_if(F.col("verdict") == "needs-review"), n).alias("needs_review_share")
    )


def judge_sql(source: str, policy: Policy) -> str:
    valid = "coalesce(p0 BETWEEN 0 AND 1 AND p1 BETWEEN 0 AND 1 AND p2 BETWEEN 0 AND 1 AND p3 BETWEEN 0 AND 1 AND abs(p0 + p1 + p2 + p3 - 1) <= 0.020000001::DOUBLE, false)"
    d = lambda x: f"{x!r}::DOUBLE"
    head = f"applicability IS NULL THEN {{0}} WHEN applicability < {d(policy.applicability)} THEN {{1}} WHEN score IS NULL THEN {{0}}"
    if policy.confidence is not None:
        rows = [(f"confidence < {d(policy.confidence)}", "'needs-review'", "NULL", "'low-confidence'")]
        last = ("'judged'", "CASE WHEN score < 1 THEN 'misleading' WHEN score < 2 THEN 'weak' WHEN score < 3 THEN 'acceptable' ELSE 'strong' END", "NULL")
        mass = "NULL::DOUBLE"
    else:
        rows = [
            (f"NOT {valid}", "'needs-review'", "NULL", "'missing-answer'"),
            (f"p0 + p1 >= {d(policy.deficient)} - 1e-9::DOUBLE", "'judged'", f"CASE WHEN p0 >= {d(policy.critical)} - 1e-9::DOUBLE THEN 'misleading' ELSE 'weak' END", "NULL"),
            (f"p2 + p3 >= {d(policy.acceptable)} - 1e-9::DOUBLE", "'judged'", "CASE WHEN score >= 3 THEN 'strong' ELSE 'acceptable' END", "NULL"),
        ]
        last = ("'needs-review'", "NULL", "'boundary-straddle'")
        mass = f"CASE WHEN {valid} AND applicability >= {d(policy.applicability)} AND score IS NOT NULL THEN p0 + p1 END"
    heads = [head.format("'needs-review'", "'not-applicable'"), head.format("NULL", "NULL"), head.format("'missing-answer'", "NULL")]
    cols = ["CASE WHEN " + heads[i] + "".join(f" WHEN {r[0]} THEN {r[i + 1]}" for r in rows) + f" ELSE {last[i]} END" for i in range(3)]
    return f"SELECT *, {mass} AS deficient_mass, {cols[0]} AS status, {cols[1]} AS level, {cols[2]} AS reason, NOT coalesce(applicability < {d(policy.applicability)}, false) AS applicable FROM ({source}) src"


def verdicts_sql(judged: str, cases: str) -> str:
    return f"""SELECT p.case_id, CASE WHEN m THEN 'misleading' WHEN w THEN 'weak' WHEN NOT any_applies OR r OR NOT coalesce(c.pinned, false) THEN 'needs-review' ELSE 'healthy' END AS verdict
      FROM (SELECT case_id, coalesce(bool_or(status = 'judged' AND level = 'misleading'), false) AS m, coalesce(bool_or(status = 'judged' AND level = 'weak'), false) AS w,
        bool_or(applicable) AS any_applies, bool_or(status = 'needs-review') AS r FROM ({judged}) j GROUP BY case_id) p LEFT JOIN ({cases}) c ON p.case_id = c.case_id"""


def paired_answers(answers: DataFrame) -> DataFrame:
    """case_id, dimension, applicable, quality of answers(case_id, question, value), whose questions are <dimension>.applicable and <dimension>.quality. Other questions are left out; of repeated ones the larger value counts; a missing one is null."""
    part, kind = F.regexp_extract("question", r"^(.+)\.(applicable|quality)$", 1), F.regexp_extract("question", r"^(.+)\.(applicable|quality)$", 2)
    rows = answers.select("case_id", part.alias("dimension"), kind.alias("kind"), "value").where("dimension <> ''")
    value = lambda k: F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k)
    return rows.groupBy("case_id", "dimension").agg(value("applicable"), value("quality"))
