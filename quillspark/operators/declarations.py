"""From the names that a snippet uses to the declarations behind them, through bindings, export lists and re-exports.

Tables, as a parser gives them:
bindings(file, local, imported, specifier, kind): kind is default, named or namespace.
uses(snippet, file, name, member): names that a snippet refers to, with the member where it is a property access.
exports(file, position, form, name, local, target): the top-level statements of a file, one row for each name. form is
default (an expression or a declaration exported as default, local its name if it has one), modified (export before a
declaration), list (export { local as name }), from (export { local as name } from target), star (export * from target;
name is null) or plain (a declaration that isn't exported); target is a file, null where it isn't in the repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stored import stored


def references(uses: DataFrame, bindings: DataFrame) -> DataFrame:
    """snippet, file, specifier, exported: distinct. A namespace counts by the members that are read, all else by its own name."""
    space = F.col("kind") == "namespace"
    exported = F.when(space, F.col("member")).when(F.col("kind") == "default", "default").otherwise(F.coalesce("imported", "local"))
    hit = uses.withColumnRenamed("name", "local").join(bindings, ["file", "local"])
    return hit.select("snippet", "file", "specifier", exported.alias("exported")).where("exported IS NOT NULL").distinct()


def explicit_exports(exports: DataFrame) -> DataFrame:
    """file, name, kind, symbol, position, target, to: the statement that a file exports a name by, if it names it.

    A declaration exported where it stands comes first, then a list that names a declaration of the file, then a
    re-export; of each kind the first. A re-export behind the file's first star is hidden by it."""
    declared = exports.where("form IN ('plain', 'modified') OR (form = 'default' AND local IS NOT NULL)").select("file", F.coalesce("local", "name").alias("local"), "position")
    declared = declared.groupBy("file", "local").agg(F.min("position").alias("declared"))
    stars = exports.where("form = 'star'").groupBy("file").agg(F.min("position").alias("star"))
    form = F.col("form")
    rows = exports.where("form IN ('default', 'modified', 'list', 'from')").join(declared, ["file", "local"], "left").join(stars, "file", "left")
    usable = form.isin("default", "modified") | ((form == "list") & F.col("declared").isNotNull()) | ((form == "from") & F.coalesce(F.col("position") < F.col("star"), F.lit(True)))
    rank = F.when(form.isin("default", "modified"), 0).when(form == "list", 1).otherwise(2)
    name = F.when(form == "default", "default").otherwise(F.col("name"))
    own = F.when(form == "list", F.col("declared")).otherwise(F.col("position"))
    # a default that has no name of its own is called default; a list's symbol is the declaration's name
    symbol = F.when(form == "default", F.coalesce("local", F.lit("default"))).when(form == "list", F.col("local")).otherwise(F.col("name"))
    found = F.struct(rank.alias("rank"), F.col("position").alias("order"), symbol.alias("symbol"), own.alias("position"), "target", F.coalesce("local", "name").alias("to"))
    kind = F.when(F.col("x.rank") == 2, "re-export").otherwise("declaration")
    return rows.where(usable).groupBy("file", name.alias("name")).agg(F.min(found).alias("x")).select("file", "name", kind.alias("kind"), "x.symbol", "x.position", "x.target", "x.to")


def exported_declarations(wanted: DataFrame, exports: DataFrame) -> DataFrame:
    """wanted(file, exported) -> kind, symbol, position: the declaration, or the re-export itself, which isn't followed; null where there is none. A star stands for every name but default that the file doesn't export before it."""
    stars = exports.where("form = 'star'").groupBy("file").agg(F.min("position").alias("star"))
    named = explicit_exports(exports).select("file", F.col("name").alias("exported"), "kind", "symbol", "position")
    rows = wanted.distinct().join(named, ["file", "exported"], "left").join(stars, "file", "left")
    star = F.col("kind").isNull() & F.col("star").isNotNull() & (F.col("exported") != "default")
    return rows.select("file", "exported", F.when(star, "re-export").otherwise(F.col("kind")).alias("kind"), F.when(star, F.col("exported")).otherwise(F.col("symbol")).alias("symbol"), F.when(star, F.col("star")).otherwise(F.col("position")).alias("position"))


def star_reach(exports: DataFrame) -> DataFrame:
    """file, reach, steps: the files that a file's first star leads to, and on by theirs; the least number of steps. Reach doubles each round and stops where nothing is new, so cycles end."""
    first = exports.where("form = 'star'").groupBy("file").agg(F.min(F.struct("position", "target")).alias("x")).select("file", F.col("x.target").alias("reach"))
    reach = stored(first.where("reach IS NOT NULL").select("file", "reach", F.lit(1).alias("steps")), "stars")
    n = reach.count()
    while n:
        on = reach.select(F.col("file").alias("reach"), F.col("reach").alias("far"), F.col("steps").alias("more"))
        further = reach.join(on, "reach").select("file", F.col("far").alias("reach"), (F.col("steps") + F.col("more")).alias("steps"))
        reach = stored(reach.unionByName(further).groupBy("file", "reach").agg(F.min("steps").alias("steps")), "stars")
        n, before = reach.count(), n
        if n == before:
            break
    return reach


def _nearest(wanted: DataFrame, named: DataFrame, stars: DataFrame) -> DataFrame:
    """wanted(id, file, name) -> id, at, name, steps: the nearest file by stars that exports the name itself."""
    here = wanted.select("id", "name", F.col("file").alias("at"), F.lit(0).alias("steps"))
    there = wanted.where("name <> 'default'").join(stars, "file").select("id", "name", F.col("reach").alias("at"), "steps")
    known = named.select(F.col("file").alias("at"), "name")
    return here.unionByName(there).join(known, ["at", "name"]).groupBy("id").agg(F.min(F.struct("steps", "at", "name")).alias("x")).select("id", "x.at", "x.name", "x.steps")


def _id(file: str, name: str) -> Column:
    return F.to_json(F.struct(F.col(file).alias("f"), F.col(name).alias("n")))


def followed_declarations(wanted: DataFrame, exports: DataFrame) -> DataFrame:
    """wanted(file, exported) -> state, found_in, symbol, position, hops: re-exports followed to the end. state is declaration, missing (no statement exports the name, or its file isn't in the repository) or cycle.

    Re-exports by name point from one (file, name) to the next that is exported by name, stars between them having been
    jumped over. The pointers are doubled, so a chain of n takes log n rounds. While a chain is open, each round ends
    some of its pointers; so what is open when a round ends none is a cycle, or leads into one."""
    named = stored(explicit_exports(exports).withColumn("id", _id("file", "name")), "exports")
    stars = star_reach(exports)
    re = named.where("kind = 're-export'")
    step = _nearest(re.where("target IS NOT NULL").select("id", F.col("target").alias("file"), F.col("to").alias("name")), named, stars)
    ends = named.where("kind = 'declaration'").select("id", F.lit("declaration").alias("state"), F.lit(None).cast("string").alias("next"), F.col("id").alias("end"), F.lit(0).alias("hops"))
    moves = re.select("id").join(step, "id", "left").select("id", F.when(F.col("at").isNull(), "missing").otherwise("open").alias("state"), _id("at", "name").alias("next"), F.lit(None).cast("string").alias("end"), F.when(F.col("at").isNull(), 0).otherwise(F.col("steps") + 1).alias("hops"))
    now = stored(ends.unionByName(moves), "pointers")
    open_ = now.where("state = 'open'").count()
    while open_:
        on = now.select(F.col("id").alias("next"), F.col("state").alias("s"), F.col("next").alias("n"), F.col("end").alias("e"), F.col("hops").cast("long").alias("h"))
        moved = now.where("state = 'open'").join(on, "next").select("id", F.col("s").alias("state"), F.col("n").alias("next"), F.col("e").alias("end"), (F.col("hops") + F.col("h")).alias("hops"))
        now = stored(now.where("state <> 'open'").withColumn("hops", F.col("hops").cast("long")).unionByName(moved), "pointers")
        open_, before = now.where("state = 'open'").count(), open_
        if open_ == before:
            break
    asked = wanted.distinct().withColumn("id", _id("file", "exported"))
    start = _nearest(asked.select("id", "file", F.col("exported").alias("name")), named, stars).select("id", _id("at", "name").alias("first"), "steps")
    ended = now.select(F.col("id").alias("first"), F.when(F.col("state") == "open", "cycle").otherwise(F.col("state")).alias("state"), "end", "hops")
    what = named.select(F.col("id").alias("end"), F.col("file").alias("found_in"), "symbol", "position")
    rows = asked.join(start, "id", "left").join(ended, "first", "left").join(what, "end", "left")
    hops = F.when(F.col("state") == "declaration", (F.col("hops") + F.col("steps")).cast("long"))
    return rows.select("file", "exported", F.coalesce("state", F.lit("missing")).alias("state"), "found_in", "symbol", "position", hops.alias("hops"))
