"""Operator 9: near-duplicates by SetSketch.

Each document's set of word shingles gets a SetSketch: registers that hold the truncated logarithm, in steps of
BASE, of the least of exponentially spaced values; registers of a union are the greater of both. Rows with one set
are one class, whatever their doc_id. Bands of registers gather classes that may be alike. Links to a few members
of a band are tried first and joined to components; then members of one band that are still apart are paired,
until every pair that shares a band is linked, ruled out or in one component. Two small sketches are compared inside
that join, so pairs that only share a band, or are a little below the threshold, are no rows of it: CODES of two bits
of each register have to agree often enough, and the parities of ODD counters of the sets' members differ in at most
as many places as the sets do, which rules pairs out for sure. Each trial estimates the similarity from both sketches
by maximum likelihood, leaves out what is far below the threshold (MARGIN standard errors), and confirms the others on
their full sets.

A pair at the threshold shares none of the bands with a probability of (1 - 0.8 ** 5) ** 32 = 3e-6; its codes differ
too often with less than 1e-6.

Defined cases: null and empty texts have an empty set and are linked with nothing; texts of fewer words than a
shingle are one shingle; rows with one doc_id and different texts are linked each by its own text; repeated rows
share their fate; a null doc_id is returned with its own null component and not kept; an empty table gives an empty
table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Written, table, text_or_empty
from .components import components
from .wordhash import SEED, U, chunks, hash_words, mix

SHINGLE, PERCENT = 4, 80
BANDS, ROWS = 32, 5
BASE, RATE, TOP = 1.001, 20.0, 65534
MARGIN = 6.0
#: Members of a band that the others are tried with at first: one for each choice, the same in most bands of a group.
HUBS = 16
#: Bits of the filter that keeps the texts of other documents out of a shuffle: 4 MB at any size of the corpus. A full filter lets more pass, and the join after it is exact.
FILTER_BITS, BITMAP = 1 << 25, 1 << 15
REGISTERS = BANDS * ROWS
#: Codes of two bits, one for each register, 32 to a long.
CODES = REGISTERS // 32
#: Parities of so many counters of a set's members, as longs of 64.
ODD = 8
MULTIPLIERS = SEED.integers(1, 2**64, REGISTERS, dtype=U) | U(1)
OFFSETS = SEED.integers(1, 2**64, REGISTERS, dtype=U)


def shingle_sets(texts: list[bytes], k: int = SHINGLE):
    """The sorted hashes of the different shingles of each text. A-Z are lower-cased by bytes.lower."""
    for i, j in chunks(texts):
        words, starts = hash_words([t.lower() for t in texts[i:j]])
        h = mix(words)
        whole = len(h) - k + 1
        if whole > 0:
            s = np.zeros(whole, U)
            for x in range(k):
                s = mix(s * U(0x9E3779B97F4A7C15) + h[x : x + whole])
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= k:
                yield np.unique(s[a : b - k + 1])
            elif b > a:
                one = U(b - a)
                for x in h[a:b]:
                    one = mix(np.asarray([one * U(0x9E3779B97F4A7C15) + x], U))[0]
                yield np.asarray([one], U)
            else:
                yield np.zeros(0, U)


def sketch(s: np.ndarray) -> np.ndarray:
    """Registers of a set."""
    least = np.full(REGISTERS, 2**64 - 1, U)
    for at in range(0, len(s), 512):
        least = np.minimum(least, (s[at : at + 512, None] * MULTIPLIERS + OFFSETS).min(axis=0))
    u = (least.astype(np.float64) + 0.5) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    return np.clip(np.floor(1.0 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype("<u2")


def parities(s: np.ndarray) -> bytes:
    """Whether an odd number of a set's members falls on each of 64 * ODD counters. Those of two sets differ in at most as many as the sets do."""
    return np.packbits((np.bincount((s >> U(20)).astype(np.int64) & (64 * ODD - 1), minlength=64 * ODD) & 1).astype(np.uint8)).tobytes()


def _sketches(shingle: int):
    def run(batches):
        import pyarrow as pa

        with np.errstate(over="ignore"):
            for batch in batches:
                out: list[list] = [[], [], [], [], []]
                # as bytes at once: no second copy of a batch's texts as strings
                texts = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
                for s in shingle_sets(texts, shingle):
                    d1, d2 = (s.sum(dtype=U), mix(s + U(1)).sum(dtype=U)) if len(s) else (U(0), U(0))
                    for col, x in zip(out, (len(s), int(np.int64(d1.view(np.int64))), int(np.int64(d2.view(np.int64))), sketch(s).tobytes() if len(s) else None, parities(s))):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "t1", "t2")), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())))], ["doc_id", "t1", "t2", "n", "d1", "d2", "registers", "odd"])

    return run


def _bands(batches):
    """id, n, kind, band: one row for each band of a sketch; the band's number is part of its hash."""
    import pyarrow as pa

    with np.errstate(over="ignore"):
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([np.frombuffer(x, "<u2") for x in batch.column("registers").to_pylist()]).reshape(-1, BANDS, ROWS).astype(U)
            h = np.broadcast_to(np.arange(BANDS, dtype=U) + U(1), regs.shape[:2]).copy()
            for r in range(ROWS):
                h = mix(h * U(0x9E3779B97F4A7C15) + regs[:, :, r])
            ids, n = (np.repeat(batch.column(c).to_numpy(zero_copy_only=False), BANDS) for c in ("id", "n"))
            kind = np.tile(np.arange(BANDS, dtype=np.int32) % HUBS, batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int32)), pa.array(kind), pa.array(h.ravel().view(np.int64))], ["id", "n", "kind", "band"])


SMALL = [f"c{k}" for k in range(CODES)] + [f"o{k}" for k in range(ODD)]


def _codes(batches):
    """id, c0, c1, ... (two bits of a hash of each register), o0, o1, ... (parities)."""
    import pyarrow as pa

    with np.errstate(over="ignore"):
        shifts = np.arange(32, dtype=U) * U(2)
        for batch in batches:
            if not batch.num_rows:
                continue
            regs = np.stack([np.frombuffer(x, "<u2") for x in batch.column("registers").to_pylist()]).astype(U)
            two = (mix(regs + U(77)) & U(3)).reshape(len(regs), CODES, 32) << shifts
            packed = np.bitwise_or.reduce(two, axis=2).view(np.int64)
            odd = np.stack([np.frombuffer(x, np.int64) for x in batch.column("odd").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(packed[:, k]) for k in range(CODES)), *(pa.array(odd[:, k]) for k in range(ODD))], ["id", *SMALL])


def may_link(u: str, v: str, percent: int) -> Column:
    """Whether rows with columns u and v before n and the names of SMALL may be links: codes that agree as often as at the threshold, but for MARGIN standard errors, and few enough parities that differ."""
    level = percent / 100 + (1 - percent / 100) / 4
    most = int(REGISTERS * (1 - level + MARGIN * np.sqrt(level * (1 - level) / REGISTERS)))
    apart, odd = F.lit(0), F.lit(0)
    for k in range(CODES):
        x = F.col(f"{u}c{k}").bitwiseXOR(F.col(f"{v}c{k}"))
        apart = apart + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555)))
    for k in range(ODD):
        odd = odd + F.bit_count(F.col(f"{u}o{k}").bitwiseXOR(F.col(f"{v}o{k}")))
    return (odd * (100 + percent) <= (F.col(f"{u}n") + F.col(f"{v}n")) * (100 - percent)) & (apart <= most)


def estimate(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood similarity of sketches, row by row, given the sets' sizes."""
    up, down = (ra > rb).sum(axis=1), (ra < rb).sum(axis=1)
    same = REGISTERS - up - down
    u, v = na / (na + nb), nb / (na + nb)
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 201)[None, :] * most[:, None]
    p = lambda x: -np.log(np.maximum(1 - x * (BASE - 1) / BASE, 1e-300)) / np.log(BASE)
    a, b = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    like = up[:, None] * np.log(np.maximum(a, tiny)) + down[:, None] * np.log(np.maximum(b, tiny)) + same[:, None] * np.log(np.maximum(1 - a - b, tiny))
    return grid[np.arange(len(grid)), like.argmax(axis=1)]


def _promising(percent: int):
    """Pairs whose sketches don't put them far below the threshold."""
    level = percent / 100
    floor = level - MARGIN * np.sqrt(level * (1 - level) / REGISTERS)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            na, nb = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("na", "nb"))
            ra, rb = (np.stack([np.frombuffer(x, "<u2") for x in b.column(c).to_pylist()]) for c in ("ra", "rb"))
            oa, ob = (np.stack([np.frombuffer(x, np.uint8) for x in b.column(c).to_pylist()]) for c in ("oa", "ob"))
            differ = np.unpackbits(oa ^ ob, axis=1).sum(axis=1)
            with np.errstate(all="ignore"):
                keep = (differ * (100 + percent) <= (na + nb) * (100 - percent)) & (estimate(ra, rb, na, nb) >= floor) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield b.select(["u", "v"]).filter(pa.array(keep))

    return run


def _sets(shingle: int):
    def run(batches):
        import pyarrow as pa

        with np.errstate(over="ignore"):
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([s.tobytes() for s in shingle_sets(b.column("text").fill_null("").cast(pa.binary()).to_pylist(), shingle)], pa.binary())], ["id", "s"])

    return run


def _linked(percent: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keep = []
            for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist()):
                x, y = np.frombuffer(x, U), np.frombuffer(y, U)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield b.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def maybe_in(df: DataFrame, need: DataFrame) -> DataFrame:
    """The rows of df(id, ...) whose id may be in need(id): a filter of one hash and FILTER_BITS bits, held by every task."""
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    maps = need.select(bit.alias("b")).groupBy(F.expr(f"b div {BITMAP}").alias("map")).agg(F.bitmap_construct_agg(F.col("b") % BITMAP).alias("bits"))
    placed = df.withColumn("_b", bit).withColumn("map", F.expr(f"_b div {BITMAP}")).join(F.broadcast(maps), "map")
    byte = F.conv(F.hex(F.substr("bits", F.expr(f"cast((_b % {BITMAP}) div 8 + 1 as int)"), F.lit(1))), 16, 10).cast("int")
    return placed.where(byte.bitwiseAND(F.expr("shiftleft(1, cast(_b % 8 as int))")) != 0).select(df.columns)


class Trials:
    """Tries pairs of classes: sketches first, then full sets, which are read from one text of each class that comes up."""

    def __init__(self, docs: DataFrame, reps: DataFrame, percent: int, shingle: int):
        self.docs, self.reps, self.percent, self.shingle = docs, reps, percent, shingle

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs(u, v) that are links."""
        side = lambda id, x: self.reps.select(F.col("id").alias(id), F.col("n").alias(f"n{x}"), F.col("registers").alias(f"r{x}"), F.col("odd").alias(f"o{x}"))
        full = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v").select("u", "v", "na", "nb", "ra", "rb", "oa", "ob")
        good = Written(full.mapInArrow(_promising(self.percent), "u long, v long"), "pairs")
        need = good.df.select(F.explode(F.array("u", "v")).alias("class")).distinct()
        need = Written(need.join(self.reps.select(F.col("id").alias("class"), "doc_id", "t1", "t2"), "class").withColumn("id", F.xxhash64("doc_id", "t1", "t2")), "needed")
        rows = texts_of(self.docs).withColumn("id", F.xxhash64("doc_id", "t1", "t2"))
        found = maybe_in(rows, need.df).drop("id").join(need.df.drop("id"), ["doc_id", "t1", "t2"])  # a semi-join would be pushed below the filter
        # repeated rows have equal sets, so any of them will do
        sets = Written(found.select(F.col("class").alias("id"), "text").mapInArrow(_sets(self.shingle), "id long, s binary").dropDuplicates(["id"]), "sets")
        a, b = sets.df.select(F.col("id").alias("u"), F.col("s").alias("sa")), sets.df.select(F.col("id").alias("v"), F.col("s").alias("sb"))
        out = Written(good.df.join(a, "u").join(b, "v").select("u", "v", "sa", "sb").mapInArrow(_linked(self.percent), "u long, v long"), "links").df
        for used in (good, need, sets):
            used.drop()
        return out


def texts_of(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (128 bits of the text), text."""
    return docs.select("doc_id", F.xxhash64(text_or_empty()).alias("t1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("t2"), "text")


def grouped(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, t1, t2, n_shingles, component_id, kept of each row of docs."""
    rows = Written(texts_of(docs).mapInArrow(_sketches(shingle), "doc_id long, t1 long, t2 long, n long, d1 long, d2 long, registers binary, odd binary"), "sketches").df
    full = rows.where("n > 0 AND doc_id IS NOT NULL")
    # a class is a set; its number is given once, when the table is written, and its first row stands for it
    least = full.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc_id", "t1", "t2")).alias("r"), F.first(F.struct("registers", "odd")).alias("k"))
    reps = Written(least.select(F.monotonically_increasing_id().alias("id"), "n", "d1", "d2", "r.doc_id", "r.t1", "r.t2", "k.registers", "k.odd"), "reps").df
    bands = Written(reps.select("id", "n", "registers").mapInArrow(_bands, "id long, n int, kind int, band long"), "bands")
    # bands of one member link nothing
    shared = bands.df.groupBy("band").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b")
    members = Written(bands.df.join(shared.select("band"), "band"), "members").df
    bands.drop()
    trials = Trials(docs, reps, percent, shingle)
    close = f"100 * least(nu, nv) >= {percent} * greatest(nu, nv)"
    # a band's hub is tried with its other members
    hubs = members.groupBy("band").agg(F.min(F.struct(F.xxhash64("id", "kind").alias("k"), "id", "n")).alias("h")).select("band", F.col("h.id").alias("hub"), F.col("h.n").alias("nv"))
    pairs = members.withColumnRenamed("n", "nu").join(hubs, "band").where("id <> hub").where(close).select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
    links = trials.links(Written(pairs, "hub-pairs").df)
    parts = Written(components(links), "parts").df
    # the exact rest: pairs of one band that are still in different components
    one = Written(members.join(parts.withColumnRenamed("node", "id"), "id", "left").select("id", "n", "band", F.coalesce("component", "id").alias("c")), "labelled").df
    mixed = one.groupBy("band").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("band")
    codes = reps.select("id", "registers", "odd").mapInArrow(_codes, "id long, " + ", ".join(f"{c} long" for c in SMALL))
    left = Written(one.join(mixed, "band").join(codes, "id"), "apart").df
    x, y = (left.select("band", F.col("id").alias(i), F.col("c").alias(f"of{i}"), *[F.col(c).alias(f"{i}{c}") for c in ("n", *SMALL)]) for i in ("u", "v"))
    sizes = f"100 * least(un, vn) >= {percent} * greatest(un, vn)"
    rest = x.join(y, (x["band"] == y["band"]) & (F.col("u") < F.col("v")) & (F.col("ofu") != F.col("ofv")) & F.expr(sizes) & may_link("u", "v", percent)).select("u", "v").distinct()
    parts = Written(components(links.unionByName(trials.links(Written(rest, "rest-pairs").df))), "parts").df
    linked = reps.join(parts, reps["id"] == parts["node"], "left").select("id", "n", "d1", "d2", "doc_id", F.coalesce("component", "id").alias("component"))
    first = linked.groupBy("component").agg(F.min("doc_id").alias("first"))
    named = linked.join(first, "component").select("n", "d1", "d2", "first")
    out = rows.select("doc_id", "t1", "t2", "n", "d1", "d2").join(named, ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    return grouped(docs, percent, shingle).drop("t1", "t2")


def drop_near_copies(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """docs without those that aren't the first of their component; rows without a doc_id stay."""
    gone = grouped(docs, percent, shingle).where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_gone"), "t1", "t2").distinct()
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(text_or_empty()).alias("_t1"), F.xxhash64(text_or_empty(), F.lit(1)).alias("_t2"))
    return rows.join(gone, (F.col("_id") == F.col("_gone")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left_anti").select("_row.*")


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op9_minhash_near_dedup": op9_minhash_near_dedup}
ORACLE: dict[str, str] = {}
