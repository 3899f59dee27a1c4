"""The corpus of a benchmark: case manifests validated, and their files found in the case's own folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stored import stored

# The fields of a manifest, and what some of them may say.
FIELDS = ("id", "operators", "operatorRole", "oracleKind", "testEffect", "productionEffect", "expectedOutcome", "testFile", "productionFiles")
OPERATORS = ("remove-assertion", "weaken-expectation", "add-shared-state", "mock-owned-logic", "pin-implementation-detail", "introduce-uncontrolled-time", "assert-incidental-interaction", "obscure-failure-cause")
ROLES = ("prescriptive", "descriptive")
KINDS = ("production-mutation", "assertion-mutation", "semantics-preserving-refactor", "repeated-randomized-execution")
OUTCOMES = ("expected-to-fail", "expected-to-keep-passing")
MANIFEST = "case.json"


def safe_path(path: Column) -> Column:
    """A relative path that stays in its folder, whatever way its slashes go."""
    there = F.replace(path, F.lit("\\"), F.lit("/"))
    return (F.trim(path) != "") & ~there.startswith("/") & ~there.rlike("^[A-Za-z]:") & ~F.array_contains(F.split(there, "/"), "..")


def _raw(field: str) -> Column:
    """A field's JSON, or null where it isn't there."""
    return F.to_json(F.try_variant_get("v", f"$.{field}", "variant"))


def _string(field: str) -> Column:
    return F.when(_raw(field).startswith('"'), F.try_variant_get("v", f"$.{field}", "string"))


def _strings(field: str) -> Column:
    """The elements of an array: a string, or null for anything else."""
    return F.when(_raw(field).startswith("["), F.transform(F.from_json(_raw(field), "array<variant>"), lambda x: F.when(F.to_json(x).startswith('"'), F.try_variant_get(x, "$", "string"))))


def manifests(files: DataFrame) -> DataFrame:
    """folder, problem and the fields of every case.json of files(path, source): problem is the first that holds, null for a sound manifest.

    Texts are dealt to tasks however few files they come from. The fields are written, so that the rules read them as columns; inlined in a rule, they would be parsed anew for each."""
    text = F.to_json(F.col("v"))
    read = files.where(F.regexp_like("path", F.lit(f"(^|/){MANIFEST.replace('.', '[.]')}$")))
    read = read.select(F.regexp_replace("path", "/?[^/]*$", "").alias("folder"), "source").repartition("folder").select("folder", F.try_parse_json("source").alias("v"))
    known = F.array(*[F.lit(x) for x in FIELDS])
    parsed = read.select(
        "folder", F.col("v").isNotNull().alias("json"), text.startswith("{").alias("object"), F.array_sort(F.array_except(F.json_object_keys(text), known)).alias("unknown"),
        *[_string(f).alias(f) for f in FIELDS if f not in ("operators", "productionFiles")], *[_strings(f).alias(f) for f in ("operators", "productionFiles")],
    )
    parsed = stored(parsed, "manifests")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    full = lambda f: no(F.trim(F.col(f)) != "")
    among = lambda f, xs: no(F.col(f).isin(*xs))
    unsafe = F.array_position(F.transform("productionFiles", lambda p: no(safe_path(p))), True)
    rules = (
        ("not-json", no(F.col("json"))), ("not-object", no(F.col("object"))), ("unknown-fields", F.size("unknown") > 0), ("id", full("id")), ("operators", no(F.size("operators") == 1)), ("unknown-operator", no(F.get("operators", F.lit(0)).isin(*OPERATORS))),
        ("operatorRole", among("operatorRole", ROLES)), ("oracleKind", among("oracleKind", KINDS)), ("testEffect", full("testEffect")), ("productionEffect", full("productionEffect")), ("expectedOutcome", among("expectedOutcome", OUTCOMES)), ("testFile", no(safe_path(F.col("testFile")))),
        ("productionFiles", no(F.size("productionFiles") > 0)), ("production-file", unsafe > 0),
    )
    name = F.coalesce(*[F.when(c, F.lit(n)) for n, c in rules])
    detail = F.when(name == "unknown-fields", F.concat(F.lit(":"), F.array_join("unknown", ","))).when(name == "production-file", F.concat(F.lit(":"), (unsafe - 1).cast("string"))).otherwise("")
    return parsed.select("folder", F.concat(name, detail).alias("problem"), "id", F.get("operators", F.lit(0)).alias("operator"), *[f for f in FIELDS if f not in ("id", "operators")])


def corpus_cases(files: DataFrame) -> DataFrame:
    """folder, id, operator, files, problem of every case: how many files its manifest names, and what is wrong with the manifest, else missing:<the first file that its folder lacks>. Of cases with one id all but the first folder's are repeated."""
    known = stored(manifests(files), "cases")
    named = known.where("problem IS NULL").select("folder", F.posexplode(F.array_distinct(F.concat(F.array("testFile"), "productionFiles"))).alias("at", "file"))
    # how many paths there are is not told by the size of what they come from, so they aren't sent to the driver as a small table
    there = files.select("path", F.lit(True).alias("there")).hint("merge")
    path = F.when(F.col("folder") == "", F.col("file")).otherwise(F.concat_ws("/", "folder", "file"))
    checked = named.withColumn("path", path).join(there, "path", "left")
    per = checked.groupBy("folder").agg(F.count("*").alias("files"), F.min(F.when(F.col("there").isNull(), F.struct("at", "file"))).alias("missing"))
    first = known.where("problem IS NULL").groupBy("id").agg(F.min("folder").alias("first"))
    rows = known.join(per.hint("merge"), "folder", "left").join(first.hint("merge"), "id", "left")
    problem = F.coalesce("problem", F.when(F.col("missing").isNotNull(), F.concat(F.lit("missing:"), F.col("missing.file"))), F.when(F.col("folder") != F.col("first"), "repeated-id"))
    return rows.select("folder", "id", "operator", F.coalesce("files", F.lit(0).cast("long")).alias("files"), problem.alias("problem"))
