"""Proof of benchmark cases and their review: oracle runs, proof decisions, blind payloads, comparison with a reviewer, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of a comparison, and what a blind payload must not hold.
KINDS = ("agreement", "context-selection-error", "rubric-ambiguity", "unsupported-disagreement", "likely-model-error")
FORBIDDEN = ("verdict", "level", "score", "confidence", "probabilities", "operator", "operator_role", "expected_outcome", "proof")


def repeated_block(source: Column, block: Column, times: int) -> Column:
    """source with its one occurrence of block written so many times; null where it isn't there just once."""
    n = (F.length(source) - F.length(F.replace(source, block, F.lit("")))) / F.length(block)
    return F.when(n == 1, F.replace(source, block, F.repeat(block, F.lit(times))))


def oracle_runs(cases: DataFrame, recipes: DataFrame) -> DataFrame:
    """case_id, label, production, test: the runs that decide each case, or one row with the reason why there are none.

    cases(case_id, prescriptive, production, test), recipes(case_id, anchor, replacement, test_anchor, test_replacement): the base against its own production, the base against the mutated one, and the variant of a prescriptive case against the mutated one."""
    once = lambda text, anchor: (F.length(text) - F.length(F.replace(F.col(text), F.col(anchor), F.lit("")))) == F.length(anchor)
    rows = cases.join(recipes, "case_id", "left")
    mutated = F.replace(F.col("production"), F.col("anchor"), F.col("replacement"))
    variant = F.replace(F.col("test"), F.col("test_anchor"), F.col("test_replacement"))
    run = lambda label, p, t: F.struct(F.lit(label).alias("label"), p.alias("production"), t.alias("test"))
    two = F.array(run("baseline", F.col("production"), F.col("test")), run("base-under-mutation", mutated, F.col("test")))
    problem = F.when(F.col("anchor").isNull(), "no-mutation-declared").when(~once("production", "anchor") | (F.col("prescriptive") & ~once("test", "test_anchor")), "mutation-anchor-not-found")
    none = F.lit(None).cast("string")
    plan = F.when(problem.isNotNull(), F.array(F.struct(F.concat(F.lit("unrealizable:"), problem).alias("label"), none.alias("production"), none.alias("test")))).when(F.col("prescriptive"), F.array_append(two, run("variant-under-mutation", mutated, variant))).otherwise(two)
    return rows.select("case_id", F.explode(plan).alias("r")).select("case_id", "r.*")


def proof_decisions(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """case_id, proven, reason. cases(case_id, prescriptive, expected), observations(case_id, label, kind); the reason is the first rule that fails, without its text."""
    labels = ("baseline", "base-under-mutation", "variant-under-mutation")
    seen = observations.groupBy("case_id").agg(*[F.min(F.when(F.col("label") == x, F.col("kind"))).alias(f"k{i}") for i, x in enumerate(labels)])
    rows = cases.join(seen, "case_id", "left")
    stuck = lambda i: F.when(F.col(f"k{i}").isNull(), F.lit(f"{labels[i]}: no observation")).when(F.col(f"k{i}").isin("timed-out", "runner-error"), F.concat(F.lit(labels[i] + " "), F.col(f"k{i}")))
    got = F.when(F.col("k1") == "passed", "expected-to-keep-passing").otherwise("expected-to-fail")
    reason = F.coalesce(
        F.when(~F.col("k0").eqNullSafe(F.lit("passed")), F.lit("baseline-failed")), F.when(F.col("prescriptive") & (F.col("expected") != "expected-to-fail"), F.lit("incoherent-declaration")),
        stuck(1), F.when(got != F.col("expected"), F.lit("prediction-not-held")), F.when(F.col("prescriptive"), F.coalesce(stuck(2), F.when(F.col("k2") != "passed", F.lit("operator-did-not-hide-defect")))),
    )
    return rows.select("case_id", reason.isNull().alias("proven"), reason.alias("reason"))


def proof_tally(decisions: DataFrame) -> DataFrame:
    return decisions.agg(F.count("*").alias("n"), F.count_if("proven").alias("proven"), F.count_if(~F.col("proven")).alias("unproven"))


def proof_split(decisions: DataFrame) -> DataFrame:
    """One row: cases by proof, and the different reasons against it, sorted."""
    return decisions.agg(F.count_if("proven").alias("proven"), F.count_if(~F.col("proven")).alias("unproven"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))


def exclusions(decisions: DataFrame) -> DataFrame:
    """reason, n of the cases left out: display names end at the first colon."""
    shown = F.regexp_replace("reason", ":.*$", "")
    return decisions.where("reason IS NOT NULL").groupBy(shown.alias("reason")).agg(F.count("*").alias("n"))


def blind_payload(rows: DataFrame, shown: list[str]) -> DataFrame:
    """The columns that a reviewer may see. Refuses those that would give the judgment or the truth away."""
    leaks = sorted(set(shown) & set(FORBIDDEN))
    if leaks:
        raise ValueError(f"a blind payload must not hold {', '.join(leaks)}")
    return rows.select(*shown, F.sha2(F.to_json(F.struct(*shown)), 256).alias("payload_hash"))


def comparison_kind() -> Column:
    """Of a row with level, reviewer_level, acceptable, prescriptive, uncertainty, notes, reasoning: the first rule that holds."""
    notes, reasons = F.lower(F.coalesce("notes", F.lit(""))), F.lower(F.coalesce("reasoning", F.lit("")))
    return (
        F.when(F.col("level").isNotNull() & (F.col("level") == F.col("reviewer_level")), KINDS[0])
        .when(notes.rlike("context|missing|omitted") | reasons.rlike("missing import|missing context"), KINDS[1])
        .when((F.col("uncertainty") >= 0.5) | notes.rlike("unclear|ambiguity|interpretation") | reasons.contains("rubric wording"), KINDS[2])
        .when(F.col("acceptable") != F.col("prescriptive"), KINDS[3]).otherwise(KINDS[4])
    )


def review_comparison(assessments: DataFrame, samples: DataFrame) -> DataFrame:
    """case_id, kind: frozen assessments beside what was judged of the same case and dimension."""
    return assessments.join(samples, ["case_id", "dimension"]).select("case_id", "dimension", comparison_kind().alias("kind"))


def review_summary(compared: DataFrame) -> DataFrame:
    """kind, n: all kinds, with zeros."""
    kinds = compared.sparkSession.createDataFrame([(k,) for k in KINDS], "kind string")
    return F.broadcast(kinds).join(compared.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def review_selection(outcomes: DataFrame, kind: str, dimensions: tuple[str, ...], dimension: str | None = None, limit: int | None = None) -> DataFrame:
    """outcomes(ord, case_id, dimension, correct) that a reviewer gets, with their place: all, those that are wrong (disagreements, regressions), or stratified, which takes the first of each dimension in turn, then the second.

    A limit is pushed into each dimension as a top-k before anything is ranked."""
    rows = outcomes if dimension is None else outcomes.where(F.col("dimension") == dimension)
    if kind in ("disagreements", "regressions"):
        rows = rows.where("correct = false")
    if kind != "stratified":
        out = rows.orderBy("ord")
        return out.limit(limit) if limit else out
    place = F.array_position(F.array(*[F.lit(d) for d in dimensions]), F.col("dimension"))
    parts = rows.where(place > 0)
    if limit:
        each = [parts.where(F.col("dimension") == d).orderBy("ord").limit(limit) for d in dimensions]
        parts = each[0]
        for x in each[1:]:
            parts = parts.unionByName(x)
    ranked = parts.withColumns({"round": F.row_number().over(Window.partitionBy("dimension").orderBy("ord")), "place": place})
    out = ranked.orderBy("round", "place")
    return (out.limit(limit) if limit else out).drop("round", "place")


def version_identity(runs: DataFrame) -> DataFrame:
    """identity (none, mixed or policy/rubric) and model (one or mixed) of runs(policy, rubric, model)."""
    pair = F.concat_ws("/", "policy", "rubric")
    kinds, models = F.count_distinct(pair), F.count_distinct("model")
    return runs.agg(F.when(kinds == 0, "none").when(kinds == 1, F.min(pair)).otherwise("mixed").alias("identity"), F.when(models == 1, F.min("model")).when(models > 1, "mixed").alias("model"))


def sampled_means(samples: DataFrame, usd: float = 0.042, least: int = 5) -> DataFrame:
    """dimension, n, mean cost and latency of samples(dimension, tokens, ms), and whether there are enough."""
    n = F.count("*")
    kind = F.when(n == 0, "not-computable").when(n < least, "below-minimum").otherwise("computed")
    return samples.groupBy("dimension").agg(n.alias("n"), F.avg(F.col("tokens") * F.lit(usd) / F.lit(1e6)).alias("usd"), F.avg("ms").alias("ms"), kind.alias("kind"))


def full_metrics(dimensions: tuple[str, ...], *tables: DataFrame) -> DataFrame:
    """All dimensions in order, with the columns of each table by dimension; what has no row is null."""
    spark = tables[0].sparkSession
    out = F.broadcast(spark.createDataFrame(list(enumerate(dimensions)), "position long, dimension string"))
    for t in tables:
        out = out.join(t, "dimension", "left")
    return out
