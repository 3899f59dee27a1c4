"""A repository as rows of (path, source): which files are tests, why others aren't, what they import, and which framework they use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import glob_pattern, normal_path

# Folders that are never scanned, what marks an end-to-end test, and the modules of frameworks.
EXCLUDED = (".git", "node_modules", "dist", "build", "vendor", "coverage", "generated")
E2E_MODULES = ("@playwright/test", "playwright", "cypress", "webdriverio", "detox")
INCLUDE = ("**/*.{test,spec}.{js,jsx,ts,tsx}",)
FRAMEWORKS = {"jest": "^(?:jest$|@jest/)", "vitest": "^(?:vitest$|@vitest/)", "bun": "^bun:test$"}
PACKAGES = {"jest": "^(?:jest|@jest/)", "vitest": "^(?:vitest|@vitest/)"}
SPECIFIER = r"""(?:\bfrom\s*|\bimport\s*\(?\s*|\brequire\s*\(\s*)["']([^"'\r\n]+)["']"""


def repository(spark: SparkSession, root: str) -> DataFrame:
    """path (below root), source: the files under a root that only Spark may be able to read. Spark gives no row for an empty file, and none is given for a name that leaves the root."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    below = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    path = F.expr(f"substring(p, locate('{base.split('://')[-1]}', p) + {len(base.split('://')[-1])})")
    return files.select(below.alias("p"), F.decode("content", "UTF-8").alias("source")).select(normal_path(path).alias("path"), "source").where("path IS NOT NULL")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_any(path: Column, globs: tuple[str, ...]) -> Column:
    """A glob that ends in /** matches its literal prefix too."""
    hits = [path.rlike(glob_pattern(g, True)) | ((path == g[:-3]) if g.endswith("/**") else F.lit(False)) for g in globs]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def excluded_folder(path: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*[F.lit(x) for x in EXCLUDED]))


def test_file(path: Column) -> Column:
    return F.lower(base_name(path)).rlike(r"(?:^|\.)(?:test|spec)\.(?:js|jsx|ts|tsx)$")


def specifiers(source: Column) -> Column:
    """What a file imports, re-exports or requires, by literal names. Comments and strings aren't told apart from code."""
    return F.regexp_extract_all(source, F.lit(SPECIFIER), F.lit(1))


def e2e_evidence(path: Column, modules: Column) -> Column:
    low = F.lower(path)
    marks = F.array(
        F.when(F.arrays_overlap(F.split(low, "/"), F.array(F.lit("e2e"), F.lit("end-to-end"))), "e2e-path-segment"),
        F.when(base_name(low).rlike(r"\.(?:e2e|cy)\.(?:js|jsx|ts|tsx)$"), "e2e-file-suffix"),
    )
    used = F.filter(modules, lambda m: m.isin(*E2E_MODULES) | m.startswith("@wdio/"))
    return F.array_distinct(F.concat(F.filter(marks, lambda m: m.isNotNull()), F.transform(used, lambda m: F.concat(F.lit("e2e-framework-import:"), m))))


def discovered(files: DataFrame, include: tuple[str, ...] = INCLUDE, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, reason (null for a test file), evidence of files(path, source), by the first rule that holds."""
    path, none = F.col("path"), F.array().cast("array<string>")
    by_path, by_import = e2e_evidence(path, none), e2e_evidence(path, specifiers(F.col("source")))
    supported = F.lower(base_name(path)).rlike(r"\.(?:js|jsx|ts|tsx)$")
    reason = (
        F.when(matches_any(path, exclude), "configured-exclude").when(excluded_folder(path), "default-exclude")
        .when(F.size(by_path) > 0, "e2e-v1").when(~supported, "unsupported-extension").when(~test_file(path) | ~matches_any(path, include), "not-test-file")
        .when(F.size(by_import) > 0, "e2e-v1")
    )
    evidence = F.when(F.col("reason") == "e2e-v1", by_import).when((F.col("reason") == "not-test-file") & test_file(path), F.array(F.lit("include-pattern"))).otherwise(none)
    return files.withColumn("reason", reason).select("path", "reason", F.array_join(evidence, ",").alias("evidence"))


def _named(patterns: dict[str, str], x: Column) -> Column:
    return F.coalesce(*[F.when(x.rlike(p), F.lit(f)) for f, p in patterns.items()])


def package_evidence(packages: DataFrame) -> DataFrame:
    """folder, framework, dependency: packages(folder, json) by the names in their dependency sections; a file that isn't JSON gives none."""
    keys = [F.coalesce(F.json_object_keys(F.get_json_object("json", f"$.{s}")), F.array().cast("array<string>")) for s in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")]
    rows = packages.select("folder", F.explode(F.array_distinct(F.concat(*keys))).alias("dependency"))
    return rows.withColumn("framework", _named(PACKAGES, F.col("dependency"))).where("framework IS NOT NULL").select("folder", "framework", "dependency")


def frameworks(files: DataFrame, package: list[str]) -> DataFrame:
    """path, framework: what a file imports decides, else the frameworks of the root's package; more than one is unknown."""
    used = F.array_distinct(F.filter(F.transform(specifiers(F.col("source")), lambda s: _named(FRAMEWORKS, s)), lambda f: f.isNotNull()))
    fallback = package[0] if len(set(package)) == 1 else "unknown"
    return files.withColumn("used", used).select("path", F.when(F.size("used") == 1, F.get("used", F.lit(0))).when(F.size("used") > 1, "unknown").otherwise(fallback).alias("framework"))


#: Comments, strings, names and single signs of a source text. Literals of regular expressions aren't told from divisions.
LEXEMES = r"""//[^\n]*|/\*[\s\S]*?(?:\*/|\z)|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"?|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'?|`[^`\\]*+(?:\\[\s\S][^`\\]*+)*+`?|[A-Za-z_$][\w$]*+|[^\s\w$]"""


def module_references(files: DataFrame) -> DataFrame:
    """path, ordinal, specifier, kind of files(path, source): what a file imports (import), passes on (export), loads (dynamic) or requires (require) by literal names, outside of comments and strings.

    A text is cut into lexemes once, and one fold over them keeps the last two lexemes and the last import or export."""
    lexemes = F.filter(F.regexp_extract_all(F.col("source"), F.lit(LEXEMES), F.lit(0)), lambda x: ~x.startswith("//") & ~x.startswith("/*"))
    out_type = "array<struct<specifier:string,kind:string>>"
    start = F.struct(F.lit("").alias("p3"), F.lit("").alias("p2"), F.lit("").alias("p1"), F.lit("").alias("word"), F.array().cast(out_type).alias("out"))

    def step(a: Column, x: Column) -> Column:
        call = (a["p1"] == "(") & (a["p3"] != ".")
        kind = F.when(a["p1"] == "from", F.when(a["word"] == "export", "export").otherwise("import")).when((a["p1"] == "import") & (a["p2"] != "."), "import").when(call & (a["p2"] == "import"), "dynamic").when(call & (a["p2"] == "require"), "require")
        literal = x.rlike("""^["'].*["']$""") & (F.length(x) > 2)
        found = F.when(literal & kind.isNotNull(), F.array_append(a["out"], F.struct(F.substr(x, F.lit(2), F.length(x) - 2).alias("specifier"), kind.alias("kind")))).otherwise(a["out"])
        # a member called import or export is no statement
        word = F.when(x.isin("import", "export") & (a["p1"] != "."), x).otherwise(a["word"])
        return F.struct(a["p2"].alias("p3"), a["p1"].alias("p2"), x.alias("p1"), word.alias("word"), found.alias("out"))

    rows = files.select("path", F.aggregate(lexemes, start, step)["out"].alias("out"))
    return rows.select("path", F.posexplode("out").alias("ordinal", "x")).select("path", "ordinal", "x.specifier", "x.kind")
