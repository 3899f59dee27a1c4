"""Operator 3: token ids in a binary block file with Elias-Fano document boundaries.

File format: a folder of Parquet files, so that any store that Spark writes will hold it and a lost task leaves no
half file. One row is a block of about `block` tokens of consecutive documents in ascending doc_id order:
part, block (the order of blocks), doc_ids, n_tokens, ids (little-endian, 2 bytes an id where the vocabulary
allows it, else 4), width, ends_low / ends_high / low_bits (Elias-Fano code of the documents' end offsets within
the block) and samples (the place of every 256th one-bit, for select). Offsets cost about 2 + log2(tokens / document)
bits a document; an absolute offset is the block's base, a running sum over blocks, plus a select.

Defined cases: a null or empty text is its end id alone; repeated rows are all written, equal ids ordered by text;
null doc_ids come first; an empty table gives no blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import VOCABULARY, encoder, text_batches, tokenizer

END, BLOCK, SAMPLE = 0, 1 << 20, 256
BLOCKS = "part int, block int, doc_ids array<long>, n_tokens long, width int, ids binary, low_bits int, ends_low binary, ends_high binary, samples binary"


def elias_fano(ends: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """low_bits, low, high, samples of a non-decreasing sequence."""
    n, u = len(ends), int(ends[-1])
    low_bits = max(0, (u // n).bit_length() - 1)
    shifts = np.arange(low_bits)
    low = ((ends[:, None] >> shifts) & 1).astype(np.uint8).ravel()
    ones = (ends >> low_bits) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1, np.uint8)
    high[ones] = 1
    pack = lambda bits: np.packbits(bits, bitorder="little").tobytes()
    return low_bits, pack(low), pack(high), ones[::SAMPLE].astype("<u4").tobytes()


class Boundaries:
    """Reads an Elias-Fano code; ends() gives all, select(i) one without decoding the others."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self.samples = np.frombuffer(samples, "<u4")

    def _low(self, first: int, count: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(count, np.int64)
        a, b = first * self.low_bits, (first + count) * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : (b + 7) // 8], bitorder="little")[a % 8 :][: b - a]
        return bits.reshape(count, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))

    def ends(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        return ((ones - np.arange(self.n)) << self.low_bits) | self._low(0, self.n)

    def select(self, i: int) -> int:
        at, need = int(self.samples[i // SAMPLE]), i % SAMPLE
        bits = np.unpackbits(self.high[at // 8 :], count=None, bitorder="little") if need else None
        one = at if not need else at - at % 8 + int(np.flatnonzero(bits)[np.count_nonzero(bits[: at % 8]) + need])
        return ((one - i) << self.low_bits) | int(self._low(i, 1)[0])


def blocks(docs: DataFrame, end: int = END, vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """The rows of the file. Text is what is shuffled: it is smaller than its ids."""

    def encode(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        width = 2 if tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else 4
        last = np.asarray([end], "<u4").tobytes()
        ids: list = []
        kept: list[bytes] = []
        n = 0

        def flush():
            nonlocal ids, kept, n, number
            ends = np.cumsum([len(x) // 4 for x in kept])
            all_ids = np.frombuffer(b"".join(kept), "<u4").astype(f"<u{width}").tobytes()
            low_bits, low, high, samples = elias_fano(ends)
            row = [[part], [number], [ids], [int(ends[-1])], [width], [all_ids], [low_bits], [low], [high], [samples]]
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            ids, kept, n, number = [], [], 0, number + 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], [x.split()[0] for x in BLOCKS.split(", ")])

        for (docs_ids,), texts in text_batches(batches, ["doc_id"]):
            for doc, raw in zip(docs_ids.to_pylist(), known.encode(texts)):
                ids.append(doc)
                kept.append(raw + last)
                n += len(raw) // 4 + 1
                if n >= block:
                    yield flush()
        if kept:
            yield flush()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(encode, BLOCKS)


def bases(file: DataFrame) -> DataFrame:
    """part, block, base: the tokens of all blocks before. The window without a key is over parts, of which there are as many as tasks."""
    sizes = file.select("part", "block", "n_tokens")
    by_part = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = by_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("part_base"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sizes.withColumn("within", within).join(before, "part").select("part", "block", (F.col("part_base") + F.col("within")).alias("base"))


def documents_of(file: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a file."""

    def decode(batches):
        import pyarrow as pa

        for batch in batches:
            for b in batch.to_pylist():
                ends = Boundaries(len(b["doc_ids"]), b["low_bits"], b["ends_low"], b["ends_high"], b["samples"]).ends()
                starts = np.concatenate([[0], ends[:-1]])
                ids = np.frombuffer(b["ids"], f"<u{b['width']}").astype("<u4")
                crc = [zlib.crc32(ids[s:e].tobytes()) for s, e in zip(starts, ends)]
                k = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([b["part"]] * k, pa.int32()), pa.array([b["block"]] * k, pa.int32()), pa.array(b["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
                )

    rows = file.mapInArrow(decode, "part int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    return rows.join(bases(file), ["part", "block"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def write_tokens(docs: DataFrame, path: str, **options) -> None:
    blocks(docs, **options).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    return documents_of(spark.read.parquet(path))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of(written(blocks(table(spark, sf_dir, "documents")), "token-file"))


QUERIES = {"op3_token_file": op3_token_file}
ORACLE: dict[str, str] = {}
