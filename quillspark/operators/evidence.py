"""Paths, globs, specifiers, bundles of evidence under a budget of bytes, hashes and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stored import stored

# Paths that are never read as evidence.
DENIED = (".env*", "*.pem", "*.key", "*.p12", "*.pfx", "id_rsa*", "**/secrets/**", "**/.git/**", "**/node_modules/**", "**/dist/**", "**/build/**", "**/coverage/**", "**/vendor/**", "*.min.js", "*.map", "*.d.ts")
BYTES_MOST, BYTES_LEAST, USD = 4.8, 3.0, 0.042
#: Keys that the specifiers of one beginning are dealt to.
PARTS = 16


def glob_pattern(glob: str, whole: bool = False) -> str:
    """A regular expression of a glob: **/ any folders, ** anything, * and ? within a segment, {a,b} one of them; a { without } is itself. A glob without / is for the base name, unless the whole path is asked for."""
    out, i = "", 0
    plain = lambda c: "\\" + c if c in r".+^${}()|[]\\" else c
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "{" and (end := glob.find("}", i)) >= 0:
            out, i = out + "(?:" + "|".join("".join(map(plain, x)) for x in glob[i + 1 : end].split(",")) + ")", end + 1
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, plain(c)), i + 1
    return ("^" if whole or "/" in glob else "(?:^|/)") + out + "$"


def matches_glob(path: Column, glob: str) -> Column:
    """A glob that ends in /** matches its own text before that, too."""
    hit = path.rlike(glob_pattern(glob))
    return hit | (path == glob[:-3]) if glob.endswith("/**") else hit


def denied_by(path: Column, globs: tuple[str, ...] = DENIED) -> Column:
    """deny-list:<first glob that matches>, or null."""
    return F.coalesce(*[F.when(matches_glob(path, g), F.lit(f"deny-list:{g}")) for g in globs])


def helper_role(path: Column) -> Column:
    """Test and spec files, files of test folders, and those named helper, fixture or setup may import on behalf of a test."""
    base = F.lower(F.element_at(F.split(path, "/"), -1))
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return base.rlike(r"\.(?:test|spec)\.[jt]sx?$") | F.arrays_overlap(folders, F.array(*[F.lit(x) for x in ("test", "tests", "__tests__", "__mocks__")])) | base.rlike("helper|fixture|setup")


def specifier_class(s: Column) -> Column:
    return F.when(s.isNull() | (s == ""), "dynamic").when(s.rlike(r"^\.{1,2}(?:/|$)|^/"), "relative").when(s.rlike("^(?:@/|~/|#)"), "alias").otherwise("bare")


def normal_path(path: Column) -> Column:
    """Slashes one way, no empty or dot segments, .. resolved; null for absolute paths and those that leave the root."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    start = F.struct(F.array().cast("array<string>").alias("p"), F.lit(True).alias("ok"))
    step = lambda a, x: F.when(x != "..", F.struct(F.array_append(a["p"], x).alias("p"), a["ok"].alias("ok"))).otherwise(F.struct(F.slice(a["p"], 1, F.greatest(F.size(a["p"]) - 1, F.lit(0))).alias("p"), (a["ok"] & (F.size(a["p"]) > 0)).alias("ok")))
    done = F.aggregate(parts, start, step)
    return F.when(path.rlike(r"^[/\\]|^[A-Za-z]:|\x00") | ~done["ok"] | (F.size(done["p"]) == 0), F.lit(None)).otherwise(F.array_join(done["p"], "/"))


def line_cut(text: Column, most: Column) -> Column:
    """Bytes of the longest beginning of text that ends with a line and has at most so many bytes; 0 if not even one line fits."""
    lines = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).cast("long").alias("sum"), F.lit(True).alias("go"))

    def step(a, x):
        new = a["sum"] + F.octet_length(x) + 1
        fits = a["go"] & (new <= most)
        return F.struct(F.when(fits, new).otherwise(a["sum"]).alias("sum"), fits.alias("go"))

    return F.aggregate(F.slice(lines, 1, F.size(lines) - 1), start, step)["sum"]


def cut_text(text: Column, most: int) -> Column:
    """text within a fragment's budget: whole, or to the last line that fits, or to the last whole character."""
    data = text.cast("binary")
    # a character that begins within the bytes and ends beyond them is left out
    raw = F.regexp_replace(F.make_valid_utf8(F.substring(data, 1, most).cast("string")), "\ufffd+$", "")
    bytes_ = line_cut(text, F.lit(most))
    by_line = F.decode(F.substr(data, F.lit(1), bytes_.cast("int")), "UTF-8")
    return F.when(F.octet_length(text) <= most, text).when(bytes_ > 0, by_line).otherwise(raw)


def budget_fill(fragments: DataFrame, budget: int, block: int = 1024) -> DataFrame:
    """bundle, ord, action, bytes: fragments(bundle, ord, text) are kept while the running sum fits; the first that doesn't is cut at a line's end within what is left, or left out; all later ones are left out.

    Sums of blocks of ord find the block of the first overflow, so that no task sorts a whole bundle and only one block's fragments are summed one by one."""
    sized = fragments.withColumn("n_bytes", F.octet_length("text").cast("long")).withColumn("block", F.floor(F.col("ord") / block))
    blocks = sized.groupBy("bundle", "block").agg(F.sum("n_bytes").alias("s"))
    running = F.sum("s").over(Window.partitionBy("bundle").orderBy("block"))
    over = blocks.withColumn("cum", running).where(F.col("cum") > budget).groupBy("bundle").agg(F.min(F.struct("block", (F.col("cum") - F.col("s")).alias("before"))).alias("x")).select("bundle", "x.block", "x.before")
    cum = F.col("before") + F.sum("n_bytes").over(Window.partitionBy("bundle").orderBy("ord"))
    inside = sized.join(over, ["bundle", "block"]).withColumn("cum", cum).where(F.col("cum") > budget)
    first = inside.groupBy("bundle").agg(F.min(F.struct("ord", (F.lit(budget) - F.col("cum") + F.col("n_bytes")).alias("rest"))).alias("x")).select("bundle", F.col("x.ord").alias("first"), "x.rest")
    placed = sized.join(first, "bundle", "left")
    cut = F.when(F.col("ord") == F.col("first"), line_cut(F.col("text"), F.col("rest"))).otherwise(F.lit(0))
    placed = placed.withColumn("cut", cut)
    kept = F.col("first").isNull() | (F.col("ord") < F.col("first"))
    return placed.select("bundle", "ord", F.when(kept, "keep").when(F.col("cut") > 0, "cut").otherwise("omit").alias("action"), F.when(kept, F.col("n_bytes")).otherwise(F.col("cut")).cast("long").alias("bytes"))


def first_by(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a total order, as an aggregate."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("r")).select(*keys, "r.*")


#: Targets of one row of a helper's imports.
LISTED = 1024


def two_hops(edges: DataFrame) -> DataFrame:
    """start, target, hop, importer, specifier of edges(a, b, specifier): files reached in one step, and in two by way of a helper; the least hop of each, ties by importer and specifier, never the start itself."""
    e = stored(edges.where("a <> b").distinct().groupBy("a", "b").agg(F.min("specifier").alias("specifier")), "edges")
    # files as numbers in the order of their paths: pairs of numbers are grouped without a sort of texts
    ids = stored(e.select(F.col("a").alias("file")).union(e.select("b")).distinct().orderBy("file").withColumn("id", F.monotonically_increasing_id()), "files")
    number = lambda c: ids.select(F.col("file").alias(c), F.col("id").alias(f"{c}_id"))
    e = stored(e.join(number("a"), "a").join(number("b"), "b"), "edges")
    # what a helper imports travels as lists to its importers, so a step's pairs are made behind the shuffle
    place = F.floor((F.row_number().over(Window.partitionBy("a_id").orderBy("b_id")) - 1) / LISTED)
    lists = e.withColumn("place", place).groupBy(F.col("a_id").alias("via"), "place").agg(F.collect_list("b_id").alias("targets")).drop("place")
    ways = e.where(helper_role(F.col("b"))).select(F.col("a_id").alias("start"), F.col("b_id").alias("via")).join(lists, "via").repartition("start")
    two = ways.select("start", "via", F.explode("targets").alias("target")).where("start <> target").groupBy("start", "target").agg(F.min("via").alias("via"))
    two = two.join(e.select(F.col("a_id").alias("start"), F.col("b_id").alias("target")), ["start", "target"], "left_anti")
    two = two.join(e.select(F.col("a_id").alias("via"), F.col("b_id").alias("target"), F.col("a").alias("importer"), F.col("b").alias("target_file"), "specifier"), ["via", "target"])
    two = two.join(ids.withColumnRenamed("id", "start"), "start").select(F.col("file").alias("start"), F.col("target_file").alias("target"), F.lit(2).cast("long").alias("hop"), "importer", "specifier")
    return e.select(F.col("a").alias("start"), F.col("b").alias("target"), F.lit(1).cast("long").alias("hop"), F.col("a").alias("importer"), "specifier").unionByName(two)


def target_key(path: Column) -> Column:
    """A path without its source extension and a last /index: what an import's own path looks like."""
    return F.regexp_replace(F.regexp_replace(path, r"(?i)\.(?:ts|tsx|js|jsx|mts|cts|mjs|cjs)$", ""), "/index$", "")


def resolved_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """importer, specifier, path: the file of each import; by (importer, specifier) as resolved before, else by the only file whose key is the import's. files(path, importer, specifier)."""
    exact = files.groupBy("importer", "specifier").agg(F.min("path").alias("exact"))
    keys = files.select(target_key(F.col("path")).alias("key"), "path").distinct().groupBy("key").agg(F.min("path").alias("only"), F.count("*").alias("n")).where("n = 1").drop("n")
    folder = F.regexp_replace("importer", "[^/]*$", "")
    relative = F.col("specifier").rlike(r"^\.{1,2}(?:/|$)")
    asked = imports.withColumn("key", F.when(relative, target_key(normal_path(F.concat(folder, F.col("specifier"))))))
    return asked.join(exact, ["importer", "specifier"], "left").join(keys, "key", "left").select("importer", "specifier", F.coalesce("exact", "only").alias("path"))


def mocked_targets(mocks: DataFrame, files: DataFrame) -> DataFrame:
    """importer, keys: the keys of the files that an importer mocks, sorted; a mock of no file, or of one of several, adds nothing."""
    hit = resolved_imports(mocks, files).where("path IS NOT NULL")
    return hit.groupBy("importer").agg(F.array_join(F.array_sort(F.collect_set(target_key(F.col("path")))), ",").alias("keys"))


# Extensions that stand for others when an import is looked for, and those that are added.
REWRITTEN = {"js": ("ts", "tsx"), "jsx": ("tsx",), "mjs": ("mts",), "cjs": ("cts",)}
ADDED = ("ts", "tsx", "js", "jsx", "mts", "cts", "mjs", "cjs")


def probed(asked: DataFrame, files: DataFrame) -> DataFrame:
    """base, path: the first candidate of each asked base path that exists: itself, another extension, an added one, an index file."""
    path = F.col("path")
    # the other way round: what must be asked for a file to be a candidate, and its place; a file has few such bases, a base many candidates
    rewritten = [(f".{b}", f".{a}") for a, bs in REWRITTEN.items() for b in bs]
    ends = [("", ""), *rewritten, *((f".{x}", "") for x in ADDED), *((f"/index.{x}", "") for x in ADDED)]
    of = [F.when(path.endswith(end), F.struct(F.concat(F.left(path, F.length(path) - len(end)), F.lit(by)).alias("base"), F.lit(pos).alias("pos"))) for pos, (end, by) in enumerate(ends)]
    offered = files.select("path", F.explode(F.array_compact(F.array(*of))).alias("x")).select("x.base", F.struct("x.pos", "path").alias("r"), F.lit(False).alias("asked"))
    # no join, so neither side is sent whole to every task
    both = asked.select("base", F.lit(None).cast(offered.schema["r"].dataType).alias("r"), F.lit(True).alias("asked")).unionByName(offered)
    return both.groupBy("base").agg(F.bool_or("asked").alias("asked"), F.min("r").alias("r")).where("asked AND r IS NOT NULL").select("base", "r.path")


def alias_matches(specifiers: DataFrame, patterns: DataFrame) -> DataFrame:
    """specifier, pattern: the best pattern of each. patterns(pattern, source, ord) have at most one *; an exact one comes before the longest prefix, then by order. A specifier meets patterns by its beginnings, so this is a join on equal texts, whatever the number of patterns.

    Only beginnings as long as some pattern's are made. All specifiers have the shortest ones, so these are dealt to PARTS keys, each with the patterns; the patterns of a key are looked up, so specifiers aren't sorted."""
    star = F.locate("*", F.col("pattern"))
    prefix, suffix = F.when(star > 0, F.expr("left(pattern, locate('*', pattern) - 1)")).otherwise(F.col("pattern")), F.when(star > 0, F.expr("substring(pattern, locate('*', pattern) + 1)")).otherwise(F.lit(""))
    usable = patterns.where(F.length("pattern") - F.length(F.translate("pattern", "*", "")) < 2).withColumns({"prefix": prefix, "suffix": suffix, "exact": star == 0})
    hit = F.when(F.col("exact"), F.col("specifier") == F.col("pattern")).otherwise(F.col("specifier").startswith(F.col("prefix")) & F.col("specifier").endswith(F.col("suffix")) & (F.length("specifier") >= F.length("prefix") + F.length("suffix")))
    best = F.min(F.struct("source", (~F.col("exact")).alias("loose"), (-F.length("prefix")).alias("shorter"), "ord", "pattern")).alias("r")
    # as many rows as the longest pattern has characters, at most
    lengths = usable.select(F.length("prefix").alias("n")).distinct()
    part = F.pmod(F.xxhash64("specifier"), F.lit(PARTS))
    begun = specifiers.distinct().select("specifier", F.explode(F.sequence(F.lit(0), F.length("specifier"))).alias("n")).join(F.broadcast(lengths), "n").select("specifier", F.expr("left(specifier, n)").alias("prefix"), part.alias("part"))
    dealt = usable.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    return begun.join(dealt.hint("shuffle_hash"), ["prefix", "part"]).where(hit).groupBy("specifier").agg(best).select("specifier", "r.pattern")


def token_estimate(rows: DataFrame, ceiling: int, follow_ups: int = 1) -> DataFrame:
    """Counts, bytes and requests over the ceiling of all rows(n_bytes, hit); token bounds and their price of those that aren't cache hits, with follow-ups in the most. Rounding is by row."""
    low, high = F.floor(F.col("n_bytes") / BYTES_MOST), F.ceil(F.col("n_bytes") / BYTES_LEAST)
    paid = lambda c: F.coalesce(F.sum(F.when(~F.col("hit"), c)), F.lit(0))
    sums = rows.agg(F.count("*").alias("n"), F.count_if(F.col("hit")).alias("cache_hits"), F.sum("n_bytes").alias("n_bytes"), F.count_if(high > ceiling).alias("over_ceiling"), paid(low).alias("tokens_min"), paid(high).alias("tokens_max"))
    usd = lambda c: F.round(c * F.lit(USD) / F.lit(1e6), 9)
    return sums.withColumns({"usd_min": usd(F.col("tokens_min")), "usd_max": usd(F.col("tokens_max") * (1 + follow_ups))})


def over_request_budget(state: Column, questions: Column, total_most: int = 64_000, part_most: int = 32_000) -> Column:
    """Whether a request of so many bytes of state and of each question passes a ceiling: all of it, or the state with its longest question."""
    tokens = lambda c: F.ceil(c / BYTES_LEAST)
    whole = state + F.aggregate(questions, F.lit(0).cast("long"), lambda a, x: a + x)
    return F.when(tokens(whole) > total_most, "total").when(tokens(state + F.array_max(questions)) > part_most, "state-and-question")


def content_hash(text: Column) -> Column:
    """SHA-256 of text with line feeds alone."""
    return F.sha2(F.regexp_replace(text, r"\r\n?", "\n"), 256)


def _canonical(**fields: Column) -> Column:
    """JSON with keys in the given order and explicit nulls."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()]), {"ignoreNullFields": "false"})


def case_identity(path: Column, ancestry: Column, source_hash: Column, parameter: Column) -> Column:
    """tc:v1: and a hash of canonical JSON. ancestry: array of struct(kind, name, ordinal); parameter: struct(index, valueHash) or null."""
    return F.concat(F.lit("tc:v1:"), F.sha2(_canonical(version=F.lit(1), path=normal_path(path), ancestry=ancestry, sourceHash=source_hash, parameter=parameter), 256))


def cache_key(request: Column, source: Column, rubric: str, slot: str) -> Column:
    """What two requests must share to share an answer: the request, the hash of the whole source with line feeds alone, the rubric's version and a frozen slot."""
    return F.sha2(_canonical(request=request, source=content_hash(source), rubricVersion=F.lit(rubric), slot=F.lit(slot)), 256)


def replace_once(text: Column, anchor: str, by: str) -> Column:
    """text with the one place of anchor replaced; null where it isn't there just once."""
    n = (F.length(text) - F.length(F.replace(text, F.lit(anchor), F.lit("")))) / len(anchor)
    return F.when(n == 1, F.replace(text, F.lit(anchor), F.lit(by)))


def ordinals(rows: DataFrame, scope: list[str], order: list[str]) -> DataFrame:
    """rows with their place, from 0, among the siblings of a scope."""
    return rows.withColumn("ordinal", (F.row_number().over(Window.partitionBy(*scope).orderBy(*order)) - 1).cast("long"))


def chunks(files: DataFrame, most: int) -> DataFrame:
    """folder, file, chunk: files(folder, file, n) in order, a new chunk where the sum would pass most; a larger file is alone."""
    ordered = F.sort_array(F.collect_list(F.struct("file", "n")))
    start = F.struct(F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<struct<file:string,chunk:bigint>>").alias("out"))

    def step(a, x):
        new = (a["sum"] > 0) & (a["sum"] + x["n"] > most)
        chunk = F.when(new, a["chunk"] + 1).otherwise(a["chunk"])
        return F.struct(chunk.alias("chunk"), F.when(new, x["n"]).otherwise(a["sum"] + x["n"]).alias("sum"), F.array_append(a["out"], F.struct(x["file"].alias("file"), chunk.alias("chunk"))).alias("out"))

    return files.groupBy("folder").agg(F.aggregate(ordered, start, step)["out"].alias("r")).select("folder", F.explode("r").alias("x")).select("folder", "x.file", "x.chunk")
