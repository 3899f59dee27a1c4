"""Alias configuration: the nearest configuration of a file, chains of extends, and the entries that map specifiers.

configs(path, text) holds the repository's tsconfig.json, jsconfig.json and package.json files and all that they extend;
comments and trailing commas are allowed. files(path) are the files to resolve for. All is joins on paths: a file meets
the configurations of its folders, a configuration those that it extends, a level of the chain at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import without_json_comments
from .stored import stored

# Names of a file's nearest configuration, in order; the conditions of a target, in order; the longest chain.
CONFIGS = ("tsconfig.json", "jsconfig.json")
CONDITIONS = ("default", "import", "node")
MAX_DEPTH = 64
#: Levels of conditions that are looked into before what is deeper is written.
LEVELS = 8
#: Tasks that what is asked of a high folder is dealt to, and package files.
PARTS = 64
REFUSALS = "root string, reason string, declared_in string, detail string"


def folder(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def contained(base: Column, target: Column) -> Column:
    """target as seen from the folder base, without dots; empty for the root itself, null outside of it and for absolute targets."""
    parts = F.filter(F.split(F.concat(base, F.lit("/"), target), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    step = lambda a, x: F.when(x != "..", F.struct(F.array_append(a["p"], x).alias("p"), a["ok"].alias("ok"))).otherwise(F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok")))
    done = F.aggregate(parts, start, step)
    return F.when(~target.startswith("/") & done["ok"], F.array_join(done["p"], "/"))


def ancestor_folders(path: Column) -> Column:
    """The folders of a path, the root (empty) last."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.reverse(F.sequence(F.lit(0), F.size(parts))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def nearest(files: DataFrame, configs: DataFrame, names: tuple[str, ...] = CONFIGS) -> DataFrame:
    """path, config: the configuration in the nearest folder above each file; of one folder the first of names."""
    base = F.element_at(F.split("path", "/"), -1)
    rank = F.array_position(F.array(*[F.lit(n) for n in names]), base)
    there = configs.where(base.isin(*names)).select(folder(F.col("path")).alias("folder"), rank.alias("rank"), F.col("path").alias("config"))
    asked = files.select("path", folder(F.col("path")).alias("own")).distinct()
    # folders climb, not files; the root and its folders are above very many, so what is asked of them is dealt into parts
    climbing = asked.select("own").distinct().select("own", F.posexplode(ancestor_folders(F.concat("own", F.when(F.col("own") != "", "/").otherwise("")))).alias("up", "folder"))
    high = ~F.col("folder").contains("/")
    climbing = climbing.withColumn("part", F.when(high, F.pmod(F.hash("own"), F.lit(PARTS))).otherwise(0))
    first = there.groupBy("folder").agg(F.min(F.struct("rank", "config")).alias("x")).select("folder", "x.config")
    first = first.withColumn("part", F.explode(F.when(high, F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))))
    found = climbing.join(first, ["folder", "part"]).groupBy("own").agg(F.min(F.struct("up", "config")).alias("x")).select("own", "x.config")
    return asked.join(found, "own").select("path", "config")


def _strings(text: Column) -> Column:
    """The strings of a JSON array, or a string alone."""
    items = F.from_json(text, "array<variant>")
    whole = F.when(text.startswith("["), items).otherwise(F.array(F.try_parse_json(text)))
    return F.transform(F.filter(whole, lambda v: F.to_json(v).startswith('"')), lambda v: F.try_variant_get(v, "$", "string"))


def settings(configs: DataFrame) -> DataFrame:
    """path, folder, ok, base_url, paths (array of pattern, targets; null if there is none), extends: what a configuration itself says."""
    parsed = F.try_parse_json(without_json_comments(F.col("text")))
    read = configs.select("path", folder(F.col("path")).alias("folder"), parsed.alias("v"))
    get = lambda p: F.to_json(F.try_variant_get("v", p, "variant"))
    base = get("$.compilerOptions.baseUrl")
    raw = F.from_json(get("$.compilerOptions.paths"), "map<string,variant>")
    listed = F.transform(F.map_entries(raw), lambda e: F.struct(e["key"].alias("pattern"), _strings(F.to_json(e["value"])).alias("targets")))
    named = F.filter(listed, lambda e: F.size(e["targets"]) > 0)
    return read.select(
        "path", "folder", F.col("v").isNotNull().alias("ok"), F.when(base.startswith('"'), F.try_variant_get("v", "$.compilerOptions.baseUrl", "string")).alias("base_url"),
        F.when(F.size(named) > 0, named).alias("paths"), F.coalesce(_strings(get("$.extends")), F.array().cast("array<string>")).alias("extends"),
    )


def chains(roots: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """roots(root) -> the configurations that each leads to by extends, as root, place, path, folder, base_url, paths, and refusals.

    place has, from the root on, minus the number of the extends taken; so the least place of a root is what counts: a
    configuration before what it extends, a later extends before an earlier one. A configuration on its own way back to
    the root is refused as a cycle."""
    # written rows are far smaller than rows in memory, so no join here is left to their size: nothing is sent whole by way of the driver
    known = stored(settings(configs), "settings").hint("merge")
    empty = F.array().cast("array<int>")
    level = roots.select("root", F.col("root").alias("path"), empty.alias("place"), F.array("root").alias("way")).join(known, "path")
    level = stored(level, "chain")
    found, refused = level, level.sparkSession.createDataFrame([], REFUSALS)
    for _ in range(MAX_DEPTH + 1):
        refused = refused.unionByName(level.where("NOT ok").select("root", F.lit("config-malformed").alias("reason"), F.col("path").alias("declared_in"), F.lit("").alias("detail")))
        asked = level.where("ok").select("root", "place", "way", F.col("path").alias("by"), "folder", F.posexplode("extends").alias("i", "detail"))
        relative = F.col("detail").rlike(r"^\.{1,2}(?:/|$)")
        target = contained(F.col("folder"), F.col("detail"))
        inside = F.array_contains(F.split(target, "/"), "node_modules")
        reason = F.when(~relative & ~F.col("detail").startswith("/"), "extends-node-modules").when(target.isNull(), "extends-outside-root").when(inside, "extends-node-modules")
        asked = asked.withColumns({"target": target, "reason": reason})
        tried = asked.where("reason IS NULL").select("*", F.posexplode(F.array("target", F.concat("target", F.lit(".json")))).alias("try", "path")).drop("folder")
        hit = tried.join(known, "path").groupBy("root", "place", "by", "i").agg(F.min_by(F.struct("way", "detail", "path", "folder", "ok", "base_url", "paths", "extends"), "try").alias("x"))
        hit = stored(hit.select("root", "place", "by", "i", "x.*"), "chain")
        keys = ["root", "place", "by", "i"]
        missing = asked.where("reason IS NULL").join(hit.select(*keys).hint("merge"), keys, "left_anti").withColumn("reason", F.lit("extends-missing"))
        cycle = hit.where(F.array_contains("way", F.col("path"))).withColumn("reason", F.lit("extends-cycle"))
        for rows in (asked.where("reason IS NOT NULL"), missing, cycle):
            refused = refused.unionByName(rows.select("root", "reason", F.col("by").alias("declared_in"), "detail"))
        level = hit.where(~F.array_contains("way", F.col("path"))).select("root", F.array_append("place", -F.col("i")).alias("place"), F.array_append("way", F.col("path")).alias("way"), "path", "folder", "ok", "base_url", "paths", "extends")
        if not level.limit(1).count():
            break
        found = found.unionByName(level.select(*found.columns))
    return found.select("root", "place", "path", "folder", "base_url", "paths"), refused


ENTRY = "root string, source string, pattern string, targets array<string>, declared_in string"


def path_entries(roots: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of paths and baseUrl of each root configuration, and refusals. The effective paths and baseUrl are taken whole from one configuration each; targets are seen from baseUrl where there is one, else from where paths stand."""
    found, refused = chains(roots, configs)
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("place", "path", "folder", c)))
    merged = found.groupBy("root").agg(first("base_url").alias("b"), first("paths").alias("p"))
    base = contained(F.col("b.folder"), F.col("b.base_url"))
    merged = merged.select("root", "b", "p", base.alias("base"))
    # a baseUrl outside of the root leaves nothing to see targets from
    seen = merged.select("root", F.when(F.col("b").isNotNull(), F.col("base")).otherwise(F.col("p.folder")).alias("from"), F.col("p.path").alias("declared_in"), F.posexplode("p.paths").alias("at", "e"))
    each = seen.select("root", "from", "declared_in", "at", "e.pattern", F.posexplode("e.targets").alias("i", "detail")).withColumn("target", contained(F.col("from"), F.col("detail")))
    whole = each.where("target IS NOT NULL").groupBy("root", "declared_in", "pattern").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "target"))), lambda x: x["target"]).alias("targets"))
    entries = whole.select("root", F.lit("paths").alias("source"), "pattern", "targets", "declared_in")
    star = F.when(F.col("base") == "", F.lit("*")).otherwise(F.concat("base", F.lit("/*")))
    own = merged.where("base IS NOT NULL").select("root", F.lit("baseUrl").alias("source"), F.lit("*").alias("pattern"), F.array(star).alias("targets"), F.col("b.path").alias("declared_in"))
    outside = lambda df, d: df.select("root", F.lit("target-outside-root").alias("reason"), "declared_in", d.alias("detail"))
    lost = merged.where("b IS NOT NULL AND base IS NULL").withColumn("declared_in", F.col("b.path"))
    refused = refused.unionByName(outside(each.where("target IS NULL"), F.col("detail"))).unionByName(outside(lost, F.lit("*")))
    return entries.unionByName(own), refused


def conditional_targets(values: DataFrame) -> DataFrame:
    """values(..., v) -> the other columns, kind, target: what a conditional export comes to. The first condition in order that leads to a string or to null counts, however deep; kind is target, blocked (null) or unsupported.

    A value is a list in which objects are replaced by what their conditions hold, in order, and what can't be a target goes; so it is its first one that counts, as soon as that is no object. LEVELS levels are looked into in a row; only values that are deeper are written for a further round."""
    null, none = F.expr("parse_json('null')"), F.array().cast("array<variant>")
    head = lambda x: F.left(F.to_json(x), F.lit(1))
    held = lambda m: F.filter(F.array(*[F.when(F.map_contains_key(m, c), F.coalesce(F.element_at(m, c), null)) for c in CONDITIONS]), lambda x: head(x).isin("{", '"', "n"))
    members = lambda x: F.flatten(F.transform(F.array(F.try_variant_get(x, "$", "map<string,variant>")), held))
    inner = lambda x: F.when(head(x) == "{", members(x)).when(head(x).isin('"', "n"), F.array(x)).otherwise(none)
    deep = lambda xs: F.coalesce(head(F.get(xs, F.lit(0))) == "{", F.lit(False))
    step = lambda xs, _: F.when(deep(xs), F.flatten(F.transform(xs, inner))).otherwise(xs)
    keep = [c for c in values.columns if c != "v"]
    rows, done = values.select(*keep, inner(F.col("v")).alias("_xs")), None
    while True:
        rows = stored(rows.withColumn("_xs", F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.col("_xs"), step)).withColumn("_deep", deep(F.col("_xs"))), "conditions")
        some = rows.where("NOT _deep")
        done = some if done is None else done.unionByName(some)
        rows = rows.where("_deep").drop("_deep")
        if not rows.limit(1).count():
            break
    first = F.get("_xs", F.lit(0))
    kind = F.when(first.isNull(), "unsupported").when(head(first) == "n", "blocked").otherwise("target")
    return done.select(*keep, kind.alias("kind"), F.try_variant_get(first, "$", "string").alias("target"))


def import_entries(packages: DataFrame, configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """packages(root), paths of package.json files -> entries of their imports that begin with #, and refusals."""
    # dealt to tasks, as few bytes of a table may stand for many texts
    read = packages.join(configs.withColumnRenamed("path", "root"), "root").repartition(PARTS, "root").select("root", F.try_parse_json(without_json_comments(F.col("text"))).alias("v"))
    # a text that is none is a row without a pattern, so texts are read once
    bad = F.array(F.struct(F.lit(None).cast("string").alias("key"), F.expr("parse_json('null')").alias("value")))
    members = F.filter(F.map_entries(F.try_variant_get("v", "$.imports", "map<string,variant>")), lambda e: e["key"].startswith("#"))
    each = read.select("root", F.explode(F.when(F.col("v").isNull(), bad).otherwise(members)).alias("e")).select("root", F.col("e.key").alias("pattern"), F.coalesce("e.value", F.expr("parse_json('null')")).alias("v"))
    known = conditional_targets(each).withColumn("to", contained(folder(F.col("root")), F.col("target")))
    reason = F.when(F.col("pattern").isNull(), "config-malformed").when(F.col("kind") == "unsupported", "imports-unsupported-conditions").when(~F.col("target").startswith("./"), "imports-external-target").when(F.col("to").isNull(), "target-outside-root")
    known = known.where("kind <> 'blocked' OR pattern IS NULL").withColumn("reason", reason)
    entries = known.where("reason IS NULL").select("root", F.lit("imports").alias("source"), "pattern", F.array("to").alias("targets"), F.col("root").alias("declared_in"))
    detail = F.when(F.col("reason") == "target-outside-root", F.col("target")).otherwise(F.coalesce("pattern", F.lit("")))
    refused = known.where("reason IS NOT NULL").select("root", "reason", F.col("root").alias("declared_in"), detail.alias("detail"))
    return entries, refused


def _glob(pattern: Column) -> Column:
    """A regular expression of a workspace pattern, a segment at a time; a segment with a wildcard takes no hidden folder and no node_modules."""
    segments = F.filter(F.split(pattern, "/"), lambda s: (s != "") & (s != "."))

    def one(s: Column) -> Column:
        bare = F.regexp_replace(s, r"[\\.+^$()|\[\]]", r"\\$0")
        wild = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"\{([^{}]*)\}", "(?:$1)"), r"\*+", "[^/]*"), r"\?(?!:)", "[^/]")
        braces = F.when(s.contains("{"), F.replace(wild, F.lit(","), F.lit("|"))).otherwise(wild)
        return F.when(s.rlike(r"[*?{]"), F.concat(F.lit(r"(?!\.|node_modules(?:/|$))"), braces)).otherwise(bare)

    return F.concat(F.lit("^"), F.array_join(F.transform(segments, one), "/"), F.lit("$"))


def workspace_entries(configs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries of the packages that the root's package.json names as workspaces: a package's name stands for its entry file, if it says one, and its folder; what is below the name for what is below the folder. The patterns of the one root file go with each package as one text, so no package is joined with all of them."""
    read = configs.where(F.col("path").endswith("package.json")).repartition(PARTS, "path").select("path", folder(F.col("path")).alias("folder"), F.try_parse_json(without_json_comments(F.col("text"))).alias("v"))
    get = lambda p: F.to_json(F.try_variant_get("v", p, "variant"))
    listed = F.coalesce(F.when(get("$.workspaces").startswith("["), get("$.workspaces")), F.when(get("$.workspaces.packages").startswith("["), get("$.workspaces.packages")))
    # as one text the patterns are compiled once, and not for each package
    globs = F.transform(_strings(listed), _glob)
    patterns = read.where("path = 'package.json'").agg(F.max(F.when(F.size(globs) > 0, globs)).alias("globs")).select(F.array_join("globs", "|").alias("globs"))
    inside = read.where("path <> 'package.json'").where(~F.array_contains(F.split("folder", "/"), "node_modules"))
    found = stored(inside.join(patterns, how="cross").where(F.regexp_like("folder", "globs")).drop("globs"), "packages")
    refused = found.where("v IS NULL").select(F.lit("package.json").alias("root"), F.lit("config-malformed").alias("reason"), F.col("path").alias("declared_in"), F.lit("").alias("detail"))
    text = lambda p: F.when(get(p).startswith('"'), F.try_variant_get("v", p, "string"))
    dot = F.element_at(F.from_json(get("$.exports"), "map<string,variant>"), ".")
    named = found.select("path", "folder", text("$.name").alias("name"), text("$.exports").alias("exports"), text("$.main").alias("main"), dot.alias("dot")).where("name IS NOT NULL")
    whole = conditional_targets(named.withColumnRenamed("dot", "v")).withColumn("entry", contained(F.col("folder"), F.coalesce("exports", "target", "main")))
    pair = F.array(F.struct(F.col("name").alias("pattern"), F.array_compact(F.array("entry", "folder")).alias("targets")), F.struct(F.concat("name", F.lit("/*")).alias("pattern"), F.array(F.concat("folder", F.lit("/*"))).alias("targets")))
    return whole.select(F.explode(pair).alias("e"), "path").select(F.lit("package.json").alias("root"), F.lit("workspace").alias("source"), "e.pattern", "e.targets", F.col("path").alias("declared_in")), refused
