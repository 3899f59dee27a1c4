"""Operator 2: substring dedup by recompression.

Words are named by hashes, and rounds of recompression name runs of one symbol and then pairs of neighbours, by
hashes of what they stand for. A name depends on its content alone, so it is the same in every document and task
without a dictionary that Spark would have to join in each round. Each symbol carries the words that its place in the
parse depends on; a symbol whose words lie inside a window is there wherever the window's words occur. A window's
anchor is made of two of its symbols, least by different hashes, and of their distance. Neighbouring windows with one
anchor are an interval; intervals whose anchor is in two texts may repeat. Equal intervals are one class, which is
counted once however many documents hold it; the windows of different classes are compared by 96 bits of hashes of
all their words. A window without a symbol inside it (one word over and over) has no anchor and is always compared.
Copies of one text are represented by the first of them.

Defined cases: null and empty texts have no words; texts of fewer words than a window lose nothing; windows that
repeat only within one document stay, also between texts that share a doc_id; repeated rows don't remove each other;
a null doc_id comes after none and before none and loses nothing; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table, text_or_empty
from .wordhash import WINDOW, WINDOW2, U, chunks, hash_words, mix, spans

WORDS, LEVELS = 50, 4
FAR = 1 << 40


def recompress(words: np.ndarray, starts: np.ndarray, levels: int = LEVELS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-level symbols of many texts: names, and the first and last word that each depends on. Symbols that depend on a text's edge are left out."""
    n_texts = len(starts) - 1
    at = starts[1:] + np.arange(n_texts)  # a mark after each text
    size = len(words) + n_texts + 1
    mark = np.zeros(size, bool)
    mark[0] = True
    mark[at + 1] = True
    sym = np.zeros(size, U)
    sym[~mark] = words
    place = np.arange(size) - np.cumsum(mark)
    lo, hi = np.where(mark, -FAR, place), np.where(mark, FAR, place)
    before = lambda x, edge: np.concatenate([[edge], x[:-1]])
    after = lambda x, edge: np.concatenate([x[1:], [edge]])
    for level in range(levels):
        # runs of one symbol; that a run ends here depends on both neighbours
        head = (sym != before(sym, U(0))) | mark | before(mark, True)
        first = np.flatnonzero(head)
        length = np.diff(first, append=len(sym))
        final = first + length - 1
        name = np.where(length > 1, mix(sym[first] ^ mix(length.astype(U) + U(977 * level + 13))), sym[first])
        left, right = np.minimum(lo[first], before(lo, -FAR)[first]), np.maximum(hi[final], after(hi, FAR)[final])
        mark = mark[first]
        sym, lo, hi = name, np.where(mark, -FAR, left), np.where(mark, FAR, right)
        # pairs: a coin that the name throws makes it a left or a right one
        coin = (mix(sym + U(level + 1)) & U(1)).astype(bool)
        joins = ~coin & after(coin, False) & ~mark & ~after(mark, True)
        joined = before(joins, False)
        pair = mix(sym * U(0x9E3779B97F4A7C15) + after(sym, U(0)) * U(0xC2B2AE3D27D4EB4F) + U(level))
        name = np.where(joins, pair, sym)
        left = np.where(coin, np.minimum(lo, before(lo, -FAR)), lo)
        right = np.where(joins, after(hi, FAR), np.where(coin, hi, np.maximum(hi, after(hi, FAR))))
        keep = ~joined
        sym, lo, hi, mark = name[keep], left[keep], right[keep], mark[keep]
        lo, hi = np.where(mark, -FAR, lo), np.where(mark, FAR, hi)
    inner = (lo >= 0) & (hi < FAR)
    return sym[inner], lo[inner], hi[inner]


def least_inside(values: np.ndarray, a: np.ndarray, b: np.ndarray, has: np.ndarray) -> np.ndarray:
    """Where the least of values[a:b] is, for arrays of a and b, by a sparse table."""
    level = np.log2(np.where(has, b - a, 1)).astype(int)
    best, out = np.arange(len(values)), np.zeros(len(a), int)
    for k in range(int(level.max(initial=0)) + 1):
        if k:
            x, y = best[: -(1 << (k - 1))], best[1 << (k - 1) :]
            best = np.where(values[y] < values[x], y, x)
        here = np.flatnonzero(has & (level == k))
        x, y = best[a[here]], best[b[here] - (1 << k)]
        out[here] = np.where(values[y] < values[x], y, x)
    return out


def anchors(words: np.ndarray, starts: np.ndarray, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all windows of the texts: first word, text, anchor, and whether there is one."""
    n = np.maximum(np.diff(starts) - size + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    first = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[:-1], n)
    sym, lo, hi = recompress(words, starts)
    a, b = np.searchsorted(lo, first, "left"), np.searchsorted(hi, first + size - 1, "right")
    has = b > a
    if not has.any():
        return first, text, np.zeros(len(first), U), has
    x, y = least_inside(sym, a, b, has), least_inside(mix(sym + U(99)), a, b, has)
    return first, text, np.where(has, mix(sym[x] * U(3) + mix(sym[y]) + (lo[y] - lo[x]).astype(U)), U(0)), has


def _as_long(x: np.ndarray):
    return x.view(np.int64)


def _anchor_rows(size: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column("d1").to_numpy(zero_copy_only=False)
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for i, j in chunks(texts):
                words, starts = hash_words(texts[i:j])
                first, text, least, has = anchors(words, starts, size)
                text, least = text[has], least[has]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (least[1:] != least[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(_as_long(least[new])), pa.array(keys[i:j][text[new]])], ["anchor", "d1"])

    return run


def _interval_rows(size: int):
    """r1, r2 (hashes of an interval's words), doc_id, d1, d2, place, len (its windows), h and c (hashes of each window)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, shared = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "d1", "d2")], batch.column("anchors").to_pylist()
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            for i, j in chunks(texts):
                words, starts = hash_words(texts[i:j])
                first, text, anchor, has = anchors(words, starts, size)
                known = [np.asarray(x or [], np.int64).view(U) for x in shared[i:j]]
                own = mix(np.concatenate(known) + np.repeat(np.arange(j - i), [len(x) for x in known]).astype(U) * U(0x9E3779B97F4A7C15))
                keep = ~has | np.isin(mix(anchor + text.astype(U) * U(0x9E3779B97F4A7C15)), own)
                first, text, anchor = first[keep], text[keep], anchor[keep]
                if not len(first):
                    continue
                new = np.ones(len(first), bool)
                new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)
                at = np.flatnonzero(new)
                last = np.append(at[1:], len(first)) - 1
                other = mix(words + U(1))
                h, c = spans(words, WINDOW, first, first + size), spans(other, WINDOW2, first, first + size)
                begin, end = first[at], first[last] + size
                length, edges = last - at + 1, np.append(at, len(first)).astype(np.int32)
                arrays = [pa.array(_as_long(spans(words, WINDOW2, begin, end))), pa.array(_as_long(spans(other, WINDOW, begin, end))), *(pa.array(x[i:j][text[at]].astype(np.int64)) for x in ids)]
                arrays += [pa.array((begin - starts[text[at]]).astype(np.int32)), pa.array(length.astype(np.int32))]
                arrays += [pa.ListArray.from_arrays(edges, pa.array(_as_long(h))), pa.ListArray.from_arrays(edges, pa.array((c >> U(32)).astype(np.uint32).view(np.int32)))]
                yield pa.RecordBatch.from_arrays(arrays, ["r1", "r2", "doc_id", "d1", "d2", "place", "len", "h", "c"])

    return run


def _cleaned(size: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out: list[list] = [[], [], [], []]
            copies, found = batch.column("copy").to_pylist(), batch.column("spans")
            for k, t in enumerate(batch.column("text")):
                words = (t.as_py() or "").encode().split()
                n = len(words)
                gone = found[k].values
                if copies[k] and n >= size:
                    kept = []
                elif gone is not None and len(gone):
                    at, many = (gone.field(x).to_numpy(zero_copy_only=False) for x in range(2))
                    cover = np.cumsum(np.bincount(at, minlength=n + size + 1) - np.bincount(at + many - 1 + size, minlength=n + size + 1))[:n]
                    kept = [w for w, c in zip(words, cover) if not c]
                else:
                    kept = words
                text = b" ".join(kept)
                for col, x in zip(out, (n, n - len(kept), hashlib.sha256(text).hexdigest(), text.decode())):
                    col.append(x)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, types))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, d1, d2 (128 bits of the text), text."""
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("d1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("d2"), "text")


def repeated_spans(docs: DataFrame, size: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, d1, d2, spans): the runs of windows that start in an earlier document too, of first copies; (d1, d2, first): the first document of each text."""
    rows = keyed(docs.where("doc_id IS NOT NULL"))
    firsts = Written(rows.groupBy("d1", "d2").agg(F.min("doc_id").alias("first")), "texts").df
    found = Written(rows.select("d1", "text").mapInArrow(_anchor_rows(size), "anchor long, d1 long").distinct(), "anchors")
    shared = found.df.groupBy("anchor").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a <> b").select("anchor")
    own = found.df.join(shared, "anchor").groupBy("d1").agg(F.collect_set("anchor").alias("anchors"))
    todo = Written(firsts.join(own, "d1", "left").select(F.col("first").alias("doc_id"), "d1", "d2", "anchors"), "own-anchors")
    found.drop()
    texts = rows.join(todo.df, ["doc_id", "d1", "d2"]).select("doc_id", "d1", "d2", "text", "anchors")
    intervals = Written(texts.mapInArrow(_interval_rows(size), "r1 long, r2 long, doc_id long, d1 long, d2 long, place int, len int, h array<long>, c array<int>"), "intervals")
    todo.drop()
    # equal intervals are one class, whose windows are looked at once
    classes = Written(intervals.df.groupBy("r1", "r2").agg(F.min("doc_id").alias("d"), F.first(F.struct("h", "c")).alias("w")), "interval-classes")
    windows = classes.df.select("r1", "r2", "d", F.posexplode(F.arrays_zip("w.h", "w.c")).alias("at", "w")).select("r1", "r2", "d", "at", "w.h", "w.c")
    # written, so that the join after it has shuffles of its own, which adaptive execution splits where a passage is very common
    earlier = Written(windows.groupBy("h", "c").agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a < b").select("h", "c", "a"), "earlier")
    known = windows.join(earlier.df, ["h", "c"]).where("d > a").groupBy("r1", "r2").agg(F.collect_set("at").alias("ats"))
    marked = classes.df.select("r1", "r2", "d").join(known, ["r1", "r2"], "left")
    here = intervals.df.select("r1", "r2", "doc_id", "d1", "d2", "place", "len").join(marked, ["r1", "r2"]).where("doc_id > d OR ats IS NOT NULL")
    # in a later document all of an interval is repeated; in its first one, the windows that an earlier document has in another interval
    single = F.transform("ats", lambda x: F.struct((F.col("place") + x).alias("place"), F.lit(1).alias("len")))
    spans_here = F.when(F.col("doc_id") > F.col("d"), F.array(F.struct("place", "len"))).otherwise(single)
    places = Written(here.select("doc_id", "d1", "d2", F.explode(spans_here).alias("s")).groupBy("doc_id", "d1", "d2").agg(F.collect_list("s").alias("spans")), "places").df
    for used in (intervals, classes, earlier):
        used.drop()
    return places, firsts


def substring_dedup(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text."""
    places, firsts = repeated_spans(docs, size)
    copies = keyed(docs).drop("text").join(firsts, ["d1", "d2"]).where("doc_id > first").select("doc_id", "d1", "d2", F.lit(True).alias("copy")).distinct()
    # spans belong to the first copy of their text
    marks = places.unionByName(copies, allowMissingColumns=True)
    rows = keyed(docs).join(marks, ["doc_id", "d1", "d2"], "left").select("doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"), "spans")
    return rows.mapInArrow(_cleaned(size), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


QUERIES = {"op2_substring_dedup": op2_substring_dedup}
ORACLE: dict[str, str] = {}
