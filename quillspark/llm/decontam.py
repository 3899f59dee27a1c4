"""Operator 7: benchmark decontamination.

The normalised n-grams of the benchmark become a hash set of bounded size that every task holds; one pass over
each text hashes its token windows, keeps those in the set and verifies them by joining their words with the
benchmark's windows. Only hits are shuffled. A benchmark of more than MAX_SET windows is not put into a set:
all windows then go to the join, which Spark shuffles.

Defined cases: a null or empty text has no words, no hits, no items and is not contaminated; a benchmark item
without words is in no document; an item of fewer words than a window is one window; items with equal texts are
each counted; an item without an id is matched but not listed; repeated documents each get their row; an empty
benchmark finds nothing. Extra columns stay in `decontaminate`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, parts_of, positions, table, text_or_empty

N = 13
#: Windows of the benchmark that are held as a set in every task (8 bytes each and their boxes, under 50 MB).
MAX_SET = 500_000
# What lies between words, by the contract.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal_words(text: Column) -> Column:
    """Lower-cases A-Z alone; lower() does just that where all characters are ASCII."""
    low = F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return parts_of(low, GAPS)


def with_hashes(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df(w) with a column h<k> for each k of sizes: the hashes of all windows of k words. Hashes of 1, 2, 4, ... words
    are combined, so a window costs log k steps. Each step is a projection of its own: an array that is named twice
    isn't folded into the next one, where a lambda would compute it again for each element."""
    df, width, most = df.withColumn("p1", F.transform("w", lambda x: F.xxhash64(x))), 1, max(sizes, default=1)
    widths = [1]
    while width * 2 <= most:
        p = F.col(f"p{width}")
        df = df.withColumn(f"p{width * 2}", F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + width))))
        width *= 2
        widths.append(width)
    for k in sizes:
        base = max(x for x in widths if x <= k)
        p = F.col(f"p{base}")
        df = df.withColumn(f"h{k}", F.transform(p, lambda x, i: F.xxhash64(x, F.get(p, i + (k - base)))))
    return df


def benchmark_windows(bench: DataFrame, n: int = N) -> tuple[DataFrame, list[int]]:
    """One row per different window: k, window (its words), h, items (ids of the items that have it); and the k that occur."""
    items = bench.select("item_id", normal_words(text_or_empty()).alias("w")).where(F.size("w") > 0).withColumn("k", F.least(F.size("w"), F.lit(n)))
    sizes = sorted(r["k"] for r in items.select("k").distinct().collect())
    place = F.explode(positions(F.size("w") - F.col("k") + 1))
    hashed = with_hashes(items, sizes).select("item_id", "w", "k", *[f"h{k}" for k in sizes], place.alias("i"))
    h = F.coalesce(*[F.when(F.col("k") == k, F.get(f"h{k}", "i")) for k in sizes], F.lit(0).cast("long"))
    rows = hashed.select("k", F.array_join(F.slice("w", F.col("i") + 1, F.col("k")), " ").alias("window"), h.alias("h"), "item_id")
    return rows.groupBy("k", "window", "h").agg(F.collect_set("item_id").alias("items")), sizes


def hits(docs: DataFrame, bench: DataFrame, keys: list[str], n: int = N, max_set: int = MAX_SET) -> DataFrame:
    """Per row of docs, repeated rows merged: keys, n_words, n_hit, items (sorted strings)."""
    windows, sizes = benchmark_windows(bench, n)
    held = windows.select("k", "h").distinct().limit(max_set + 1).collect()
    small = len(held) <= max_set

    def found(k: int):
        places, h, w = positions(F.size("w") - (k - 1)), F.col(f"h{k}"), F.col("w")
        if small:
            allowed = [r["h"] for r in held if r["k"] == k]
            places = let(h, lambda g: F.filter(places, lambda i: F.get(g, i).isin(allowed)))
        return F.transform(places, lambda i: F.struct(F.lit(k).alias("k"), i.alias("i"), F.array_join(F.slice(w, i + 1, F.lit(k)), " ").alias("window")))

    none = F.array().cast("array<struct<k:int,i:int,window:string>>")
    scanned = with_hashes(docs.select(*keys, normal_words(text_or_empty()).alias("w")), sizes)
    one = scanned.select(*keys, F.size("w").cast("long").alias("n_words"), F.explode_outer(F.concat(none, *[found(k) for k in sizes])).alias("c"))
    one = one.select(*keys, "n_words", "c.k", "c.i", "c.window")
    known = windows.select("k", "window", "items")
    joined = one.join(F.broadcast(known) if small else known, ["k", "window"], "left")
    # a hit row carries the items of its window; equal lists are merged within a document first
    grouped = joined.groupBy(*keys, "n_words").agg(
        F.collect_set(F.when(F.col("items").isNotNull(), F.struct("i", "k"))).alias("places"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"),
    )
    start = F.struct(F.lit(0).cast("long").alias("c"), F.lit(0).alias("end"))
    covered = F.aggregate(
        F.sort_array("places"), start,
        lambda a, p: F.struct(
            (a["c"] + F.greatest(F.lit(0), p["i"] + p["k"] - F.greatest(p["i"], a["end"]))).alias("c"), F.greatest(a["end"], p["i"] + p["k"]).alias("end")
        ),
    )["c"]
    return grouped.select(*keys, "n_words", covered.alias("n_hit"), F.sort_array(F.transform("items", lambda x: x.cast("string"))).alias("items"))


CONTAMINATED = "n_hit > 0 AND 20 * n_hit >= n_words"


def keyed(docs: DataFrame) -> DataFrame:
    """A text's hash beside its id, so that rows with one id and different texts stay apart."""
    return docs.withColumn("_th", F.xxhash64(text_or_empty(), F.lit(7)))


def decontamination_report(docs: DataFrame, bench: DataFrame) -> DataFrame:
    return hits(keyed(docs.select("doc_id", "text")), bench, ["doc_id", "_th"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), F.expr(CONTAMINATED).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """docs without the contaminated ones, columns as they were."""
    bad = hits(keyed(docs.select("doc_id", "text")), bench, ["doc_id", "_th"]).where(CONTAMINATED).select(F.col("doc_id").alias("_bad"), F.col("_th").alias("_bad_th"))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty(), F.lit(7)).alias("_th"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.col("_th") == F.col("_bad_th")), "left_anti").select("_row.*")


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def report_sql(source: str) -> str:
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
    WITH d AS (SELECT doc_id, {words} AS w FROM {source}),
    b AS (SELECT item_id, {words} AS w FROM benchmark),
    bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
        SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM (
          SELECT item_id, w, least(len(w), {N}) AS k FROM b WHERE len(w) > 0) x) y),
    dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
        SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) kk WHERE len(w) >= k) x),
    h AS (SELECT dw.doc_id, dw.k, dw.i, bw.item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
    c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) q GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
        SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) q GROUP BY doc_id)
    SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(t.n_items, 0)::BIGINT AS n_items,
      sha256(coalesce(t.items, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
    FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""


QUERIES = {"op7_benchmark_decontamination": op7_benchmark_decontamination}
ORACLE = {"op7_benchmark_decontamination": report_sql("documents")}
