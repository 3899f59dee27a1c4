"""Operator 12: source divergence audit.

Tasks take the UTF-8 buffers of an Arrow batch one after another, mark term bytes with a lookup table, find the terms'
edges, and group the slices by xxHash64, computed for all slices at once; equal hashes are then held against each
other byte by byte. Spark adds up the counts by (lang, source, term), keeps the terms of enough documents and gives
every (lang, block of terms) the counts of its terms as a sparse matrix in row order. There each source is compared
with all others over the block: the cells of the other rows through `numpy.add.reduceat`, the terms that they lack by
prefix sums of the sorted row. Partial sums of blocks are added up again. All arithmetic is on integers.

Defined cases: null text, lang and source read as the empty string; a group without terms, or with none that is kept,
has its pairs, and a lang without kept terms has pairs of value 0; repeated rows are documents of their own; ties go
to the smaller item in byte order; a text is never cut; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Written, table
from .wordhash import chunks

#: Fixed values of the contract.
MIN_DOCS = 30
SCALE = 1_000_000_000
PLUS = 5
TOP = 50
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Cells of a sparse matrix that a task holds at a time, on average.
BLOCK_CELLS = 200_000

#: What a byte of a term becomes in lower case; 0 for bytes between terms.
TERM = np.zeros(256, np.uint8)
TERM[128:] = np.arange(128, 256)
TERM[97:123] = TERM[65:91] = np.arange(97, 123)

U = np.uint64
# The five primes of xxHash64.
P1, P2, P3, P4, P5 = (U(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
#: Slices of so many bytes and more go through the library's four lanes, one at a time.
LANES = 32


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U(by)) | (x >> U(64 - by))


def _windows(raw: np.ndarray, kind: str) -> np.ndarray:
    """The little-endian integer that begins at each byte; raw is padded by 8 bytes at least."""
    kind = np.dtype(kind)
    return np.ndarray((len(raw) - kind.itemsize + 1,), kind, raw, 0, (1,))


def slice_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """xxHash64 with seed 0 of raw[first:last], for arrays of first and last; raw is padded by 8 bytes at least."""
    import xxhash

    eight, four, size = _windows(raw, "<u8"), _windows(raw, "<u4"), last - first
    h = P5 + size.astype(U)
    left, at = size.copy(), first.copy()
    for _ in range(LANES // 8 - 1):
        some = np.flatnonzero((left >= 8) & (size < LANES))
        if not len(some):
            break
        h[some] = _turned(h[some] ^ (_turned(eight[at[some]] * P2, 31) * P1), 27) * P1 + P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero((left >= 4) & (size < LANES))
    h[some] = _turned(h[some] ^ (four[at[some]].astype(U) * P1), 23) * P2 + P3
    at[some] += 4
    left[some] -= 4
    for _ in range(3):
        some = np.flatnonzero((left >= 1) & (size < LANES))
        if not len(some):
            break
        h[some] = _turned(h[some] ^ (raw[at[some]].astype(U) * P5), 11) * P1
        at[some] += 1
        left[some] -= 1
    h = (h ^ (h >> U(33))) * P2
    h = (h ^ (h >> U(29))) * P3
    h ^= h >> U(32)
    for i in np.flatnonzero(size >= LANES):
        h[i] = xxhash.xxh64_intdigest(raw[first[i] : last[i]].tobytes())
    return h


def same_bytes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the slices of size bytes from a and from b are equal."""
    eight, equal = _windows(raw, "<u8"), np.ones(len(a), bool)
    some, done = np.arange(len(a)), 0
    while len(some):
        left = size[some] - done
        differ = eight[a[some] + done] ^ eight[b[some] + done]
        short = left < 8
        differ[short] &= (U(1) << (U(8) * left[short].astype(U))) - U(1)
        equal[some] &= differ == 0
        done += 8
        some = some[(left > 8) & (differ == 0)]
    return equal


def term_groups(texts: list[bytes], of: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """of: a number for each text. -> for each pair of number and term: the number, the term, its occurrences, its texts."""
    raw = np.frombuffer(b" ".join(texts) + b" " * 9, np.uint8)
    low = TERM[raw]
    inside = np.concatenate([[0], (low != 0).view(np.int8), [0]])
    edge = np.diff(inside)
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(first):
        return of[:0], [], first, first
    low[low == 0] = 32
    hashes, size = slice_hashes(low, first, last), last - first
    starts = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    doc = np.searchsorted(starts, first, side="right") - 1
    # of one number, texts stand in order, so the occurrences in one text stay together
    order = np.lexsort((doc, hashes, of[doc]))
    new = np.ones(len(order), bool)
    a, b = order[:-1], order[1:]
    alike = (hashes[a] == hashes[b]) & (of[doc[a]] == of[doc[b]])
    new[1:] = ~alike
    at = np.flatnonzero(alike)
    verified = (size[a[at]] == size[b[at]]) & same_bytes(low, first[a[at]], first[b[at]], np.minimum(size[a[at]], size[b[at]]))
    if not verified.all():
        return _by_bytes(low, first, last, doc, of)
    new_doc = new.copy()
    new_doc[1:] |= doc[a] != doc[b]
    group = np.flatnonzero(new)
    head = order[group]
    buffer = low.tobytes()
    terms = [buffer[i:j] for i, j in zip(first[head].tolist(), last[head].tolist())]
    return of[doc[head]], terms, np.diff(np.append(group, len(order))), np.add.reduceat(new_doc.astype(np.int64), group)


def _by_bytes(low, first, last, doc, of):
    """`term_groups` by a dictionary of the terms themselves, for slices with one hash and other bytes."""
    buffer, found = low.tobytes(), {}
    for i, j, d in zip(first.tolist(), last.tolist(), doc.tolist()):
        x = found.setdefault((int(of[d]), buffer[i:j]), [0, 0, -1])
        x[0], x[1], x[2] = x[0] + 1, x[1] + (x[2] != d), d
    return np.array([g for g, _ in found]), [t for _, t in found], np.array([x[0] for x in found.values()]), np.array([x[1] for x in found.values()])


def _count_terms(batches: Iterator) -> Iterator:
    """Batches of (lang, source, text) -> (lang, source, term, n, docs)."""
    for batch in batches:
        keys = pa.StructArray.from_arrays([batch.column(0), batch.column(1)], ["lang", "source"])
        pairs: dict[tuple, int] = {}
        of = np.array([pairs.setdefault((k["lang"], k["source"]), len(pairs)) for k in keys.to_pylist()], np.int64)
        names = list(pairs)
        langs, sources = pa.array([x for x, _ in names], pa.string()), pa.array([x for _, x in names], pa.string())
        texts = batch.column(2).cast(pa.large_binary()).to_pylist()
        for i, j in chunks(texts):
            who, terms, n, docs = term_groups(texts[i:j], of[i:j])
            yield pa.RecordBatch.from_arrays(
                [langs.take(pa.array(who)), sources.take(pa.array(who)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"]
            )


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PLUS) / total), exact for totals up to 9 * 10**15."""
    left, out = count + PLUS, np.zeros(np.broadcast(count, total).shape, np.int64)
    for _ in range(3):
        left = left * 1000
        out = out * 1000 + left // total
        left = left % total
    return out + 1


def share_column(count: Column, n: Column, v: Column) -> Column:
    """`share` for columns; n is the sum of counts, v the number of kept terms. Products that don't fit a long are divided as decimals."""
    wide, total = (count + PLUS).cast("decimal(20,0)") * F.lit(SCALE), n + PLUS * v
    exact = F.call_function("div", wide, total.cast("decimal(20,0)"))
    return F.when(count < (1 << 63) // SCALE - PLUS, F.call_function("div", (count + PLUS) * SCALE, total)).otherwise(exact) + 1


def term_counts(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, total of the terms that are in enough documents of their lang; total is n over the lang's sources, first marks one row of each term."""
    counted = docs.select("lang", "source", "text").mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long")
    cells = counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    cells = cells.withColumns({"all_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "least": F.min("source").over(term)})
    return cells.where(F.col("all_docs") >= min_docs).select("lang", "source", "term", "n", "total", (F.col("source") == F.col("least")).alias("first"))


def _block_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one (lang, block): a row without a term for each source, and the counts. -> lang, a, b, value with a < b."""
    rows = pa.Table.from_batches(list(batches))
    col = lambda c: rows.column(c).combine_chunks()
    none = col("term").is_null().to_numpy(zero_copy_only=False)
    sources = sorted(zip(col("source").filter(pa.array(none)).to_pylist(), col("n_all").filter(pa.array(none)).to_pylist()), key=lambda x: x[0].encode())
    names, total = [x for x, _ in sources], np.array([n for _, n in sources], np.int64)
    lang, v = rows.column("lang")[0].as_py(), rows.column("v")[0].as_py()
    cells = rows.filter(pa.array(~none))
    place = {x: i for i, x in enumerate(names)}
    terms = cells.column("term").combine_chunks().dictionary_encode()
    row = np.array([place[x] for x in cells.column("source").to_pylist()], np.int64)
    column, width = terms.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(terms.dictionary)
    rest = (np.zeros(len(names) - i - 1, np.int64) for i in range(len(names)))
    if v and width:
        order = np.lexsort((column, row))
        total = total + PLUS * v
        rest = divergences(row[order], column[order], share(cells.column("n").to_numpy()[order], total[row[order]]), share(np.zeros(len(names), np.int64), total), width)
    for i, values in enumerate(rest):
        n = len(values)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([names[i]] * n, pa.string()), pa.array(names[i + 1 :], pa.string()), pa.array(values)], ["lang", "a", "b", "value"])


def divergences(row: np.ndarray, column: np.ndarray, p: np.ndarray, empty: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row of a sparse matrix in row order, the sums of absolute differences from the rows behind it; a row has empty[row] where it has no cell."""
    n = len(empty)
    edges = np.searchsorted(row, np.arange(n + 1))
    for i in range(n):
        dense = np.full(width, empty[i], np.int64)
        dense[column[edges[i] : edges[i + 1]]] = p[edges[i] : edges[i + 1]]
        # as if the rows behind had no cell: the values below and above their own, by prefix sums
        ranked, behind = np.sort(dense), empty[i + 1 :]
        sums = np.concatenate([[0], np.cumsum(ranked)])
        below = np.searchsorted(ranked, behind)
        out = behind * below - sums[below] + (sums[-1] - sums[below]) - behind * (width - below)
        # then the cells that they have
        at = edges[i + 1 :]
        filled = np.flatnonzero(np.diff(at))
        if len(filled):
            own = dense[column[at[0] :]]
            change = np.abs(p[at[0] :] - own) - np.abs(empty[row[at[0] :]] - own)
            out[filled] += np.add.reduceat(change, at[filled] - at[0])
        yield out


def divergence_report(docs: DataFrame, min_docs: int = MIN_DOCS, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """lang, source, part, item, value, rank: each source's divergence from the others of its lang, and the terms that it uses more than its lang."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells = Written(term_counts(docs, min_docs), "terms").df
    langs = cells.groupBy("lang").agg(F.sum(F.col("first").cast("long")).alias("v"), F.sum("n").alias("n_lang"), F.count("*").alias("cells"))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n_all"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = Written(groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_all", "v", "n_lang", "cells")]), "groups").df

    known = cells.join(groups, ["lang", "source"])
    p, q = share_column(F.col("n"), F.col("n_all"), F.col("v")), share_column(F.col("total"), F.col("n_lang"), F.col("v"))
    own = known.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")

    blocks = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("cells") / block_cells))
    marks = groups.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "n_all", "v")
    counts = known.select("lang", F.pmod(F.xxhash64("term"), blocks).alias("block"), "source", "term", "n", "n_all", "v")
    parts = marks.unionByName(counts).groupBy("lang", "block").applyInArrow(_block_pairs, "lang string, a string, b string, value long")
    pairs = Written(parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "pairs").df
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    other = pairs.select("lang", both.alias("x"), "value").select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    top = own.withColumn("rank", rank).where(F.col("rank") <= TOP)
    return other.withColumn("rank", rank).unionByName(top)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_report(table(spark, sf_dir, "documents"))


def divergence_sql(source: str, min_docs: int = MIN_DOCS) -> str:
    p = lambda n, total: f"(1 + {SCALE} * ({n} + {PLUS})::HUGEINT // ({total} + {PLUS} * v)::HUGEINT)"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM {source}
    ), words AS (
      SELECT d, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM docs
    ), cells AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT d) AS docs FROM words GROUP BY ALL
    ), kept AS (SELECT lang, term, sum(n) AS total FROM cells GROUP BY lang, term HAVING sum(docs) >= {min_docs}
    ), langs AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM kept GROUP BY lang
    ), names AS (SELECT DISTINCT lang, source FROM docs
    ), full_cells AS (
      SELECT s.lang, s.source, k.term, k.total, coalesce(c.n, 0) AS n FROM names s JOIN kept k ON s.lang = k.lang LEFT JOIN cells c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
    ), shares AS (
      SELECT f.lang, f.source, f.term, n, {p('n', 'n_all')} AS p, {p('total', 'n_lang')} AS q
      FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS n_all FROM full_cells) f JOIN langs USING (lang)
    ), pairs AS (
      SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
      FROM names a JOIN names b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
      GROUP BY ALL
    ), terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u) r
    WHERE part = 'pair' OR rank <= {TOP}"""


QUERIES = {"op12_source_divergence": op12_source_divergence}
ORACLE = {"op12_source_divergence": divergence_sql("documents")}
