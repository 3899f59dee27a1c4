"""What a run is resumed with: cached judgments by joins, checks before a resume, versions of runs, hints of packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import without_json_comments
from .aliases import folder, nearest

# Names of configuration files and what a test script runs.
JEST_FILES = tuple(f"jest.config.{x}" for x in ("js", "ts", "mjs", "cjs", "json"))
VITEST_FILES = tuple(f"vitest.config.{x}" for x in ("js", "ts", "mjs", "cjs", "mts", "cts"))
RUNS_JEST, RUNS_VITEST, RUNS_BUN = r"\bjest\b", r"\bvitest\b", r"\bbun\s+test\b"
DEPENDENCIES = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")


def cached_judgments(items: DataFrame, attempts: DataFrame, judgments: DataFrame) -> DataFrame:
    """cache_key, item, model, classification: of the completed items of a key that have an attempt with the pinned model and a judgment, the newest. items(id, state, cache_key), attempts(item, model, pinned), judgments(item, classification)."""
    done = items.where("state = 'completed' AND cache_key IS NOT NULL").select(F.col("id").alias("item"), "cache_key")
    rows = done.join(attempts.where("pinned"), "item").join(judgments, "item")
    return rows.groupBy("cache_key").agg(F.max(F.struct("item", "model", "classification")).alias("x")).select("cache_key", "x.*")


def resume_checks(asked: DataFrame, runs: DataFrame) -> DataFrame:
    """asked(request, run, root) -> request, outcome: the first that holds of not-found, legacy-root, root-mismatch, finished, resumed. runs(run, root, canonical, finished)."""
    known = runs.select("run", F.col("root").alias("own"), "canonical", "finished")
    rows = asked.join(known, "run", "left")
    outcome = F.when(F.col("own").isNull(), "not-found").when(~F.col("canonical"), "legacy-root").when(F.col("own") != F.col("root"), "root-mismatch").when(F.col("finished"), "finished").otherwise("resumed")
    return rows.select("request", outcome.alias("outcome"))


def version_identities(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """run, identity (none, mixed or policy/rubric) and model (null, one or mixed) of every run, by what its sampled outcomes(run, policy, rubric, model) say."""
    pair = F.when(F.col("policy").isNotNull(), F.concat_ws("/", F.col("policy").cast("string"), "rubric"))
    # one value or several shows in the least and the largest: partial sums, no distinct
    said = outcomes.groupBy("run").agg(F.min(pair).alias("lo"), F.max(pair).alias("hi"), F.min("model").alias("m"), F.max("model").alias("n"))
    rows = runs.select("run").distinct().join(said, "run", "left")
    one = lambda lo, hi: F.when(F.col(lo) == F.col(hi), F.col(lo)).when(F.col(lo) != F.col(hi), "mixed")
    return rows.select("run", F.coalesce(one("lo", "hi"), F.lit("none")).alias("identity"), one("m", "n").alias("model"))


def _text(path: str) -> Column:
    return F.to_json(F.try_variant_get("v", path, "variant"))


def framework_hints(files: DataFrame, repository: DataFrame) -> DataFrame:
    """path, hint: jest where the nearest package has evidence of it and none of another runner, else null. repository(path, text): package.json files, and by name those beside them."""
    packages = repository.where("path RLIKE '(^|/)package[.]json$'")
    found = nearest(files, packages, ("package.json",))
    read = packages.select(F.col("path").alias("config"), folder(F.col("path")).alias("folder"), F.try_parse_json(without_json_comments(F.col("text"))).alias("v")).where("v IS NOT NULL")
    script = F.when(_text("$.scripts.test").startswith('"'), F.try_variant_get("v", "$.scripts.test", "string"))
    runs = lambda p: F.coalesce(script.rlike(p), F.lit(False))
    names = F.flatten(F.array(*[F.coalesce(F.json_object_keys(_text(f"$.{k}")), F.array().cast("array<string>")) for k in DEPENDENCIES]))
    depends = F.exists(names, lambda n: (n == "vitest") | n.startswith("@vitest/"))
    base = F.element_at(F.split("path", "/"), -1)
    beside = repository.where(base.isin(*JEST_FILES, *VITEST_FILES)).groupBy(folder(F.col("path")).alias("folder")).agg(F.bool_or(base.isin(*JEST_FILES)).alias("jest"), F.bool_or(base.isin(*VITEST_FILES)).alias("vitest"))
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    own = _text("$.jest")
    signals = read.join(beside, "folder", "left").select("config", (runs(RUNS_VITEST) | runs(RUNS_BUN) | depends | no("vitest")).alias("other"), ((own.isNotNull() & (own != "null")) | runs(RUNS_JEST) | no("jest")).alias("some"))
    rows = files.select("path").distinct().join(found, "path", "left").join(signals, "config", "left")
    return rows.select("path", F.when(F.col("some") & ~F.col("other"), "jest").alias("hint"))


def selected_cases(selected: DataFrame, corpus: DataFrame) -> DataFrame:
    """selected(case_id, ...) with what the corpus says of each case; a case that the corpus lacks ends the job, as a review of part of a selection would not be one."""
    rows = selected.join(corpus.withColumn("_known", F.lit(True)), "case_id", "left")
    there = F.assert_true(F.col("_known"), F.concat(F.lit("not in the corpus: "), F.col("case_id").cast("string")))
    return rows.where(there.isNull()).drop("_known")
