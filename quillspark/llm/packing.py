"""Operator 1: best-fit packing into sequences of at most `size` tokens.

Only the histogram of piece lengths, of at most `size` counts, is planned on the driver. A configuration linear
program over it (which fillings of a sequence, how often, so that every length is covered at the least number of
sequences) is solved by multiplicative weights: a length's weight falls as more of its pieces are placed, and a
knapsack dynamic program over the sequence's capacity prices fillings for the weights, the best one through each
length. The steps of a round are rounded down to whole sequences; the next round solves the residual histogram in the
same way, until no filling is full. Weights over the value of the best filling are a feasible dual, so each round also
gives a lower bound. Best fit, longest first, places the few pieces that are left. The plan is a table of runs: places
r .. r + n of a length go to these sequences at this offset; it has at most a few entries for each filling and so
doesn't grow with the corpus. Spark ranks the pieces of each length, salted by their number so that a frequent length
is ranked in many tasks, and joins each rank with its run.

Defined cases: a null or empty text is its end id alone; a text of more than `size` tokens is cut into pieces of
`size`, the first one shorter; repeated rows are packed each for itself; an empty table gives no sequences.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .tokens import VOCABULARY, encoder, text_batches

SIZE, END = 1024, 2
#: Most rounds of the multiplicative weights; how fast a length that is placed loses weight; how much more a long piece weighs than its share of a sequence (each is tried, the plan of fewer sequences is used).
ROUNDS, RATE, BIAS = 200, 1.0, (0.1, 1.0)
#: Pieces of a length that are ranked together.
RANKED = 1 << 20
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece of each document, from one pass of the tokenizer."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        known, last = encoder(vocabulary), np.asarray([end], dtype="<u4").tobytes()
        for (ids,), texts in text_batches(batches, ["doc_id"]):
            rows: list[list] = [[], [], [], [], []]
            for doc, raw in zip(ids.to_pylist(), known.encode(texts)):
                raw += last
                n = len(raw) // 4
                edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    for col, x in zip(rows, (doc, k, a, b - a, zlib.crc32(raw[4 * a : 4 * b]))):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, PIECES)


def knapsack(weights, size: int):
    """For each capacity the most weight, with as many of a length as fit, and the length that is taken there (0: none)."""
    import numpy as np

    best, take = np.zeros(size + 1), np.zeros(size + 1, dtype=int)
    lengths = np.flatnonzero(weights > 0)
    for c in range(1, size + 1):
        best[c] = best[c - 1]
        fit = lengths[: np.searchsorted(lengths, c, side="right")]
        if len(fit):
            value = best[c - fit] + weights[fit]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], take[c] = value[k], fit[k]
    return best, take


def through(length: int, take, size: int) -> tuple:
    """The best filling that holds the length: (length, how often), longest first."""
    filling, room = {length: 1}, size - length
    while room > 0:
        x = int(take[room])
        if x:
            filling[x] = filling.get(x, 0) + 1
        room -= x or 1
    return tuple(sorted(filling.items(), reverse=True))


def configuration_lp(counts: dict[int, int], size: int, rounds: int = ROUNDS, bias: float = BIAS[0]) -> dict[tuple, int]:
    """Full fillings and how often to use each, together within the histogram. See `lower_bound` for the dual."""
    import numpy as np

    demand = {k: v for k, v in counts.items() if v > 0}
    left, used = dict(demand), {}
    for _ in range(rounds):
        have = np.array(sorted(left), dtype=int)
        placed = np.array([1 - left[int(k)] / demand[int(k)] for k in have])
        w = np.zeros(size + 1)
        w[have] = have / size * (1 + bias * have / size) * np.exp(-RATE * placed)
        _, take = knapsack(w, size)
        before = len(used), sum(used.values())
        for x in map(int, have[::-1]):
            filling = through(x, take, size)
            if sum(k * n for k, n in filling) == size and (step := min(left[k] // n for k, n in filling)):
                used[filling] = used.get(filling, 0) + step
                for k, n in filling:
                    left[k] -= n * step
        left = {k: v for k, v in left.items() if v}
        if not left or before == (len(used), sum(used.values())):
            break
    return used


def lower_bound(counts: dict[int, int], size: int, rounds: int = 20) -> float:
    """The most that the duals of some rounds show to be needed: weights over the value of the best filling. Lengths that the bound leans on too much lose weight."""
    import numpy as np

    have = np.array(sorted(k for k, v in counts.items() if v > 0), dtype=int)
    if not len(have):
        return 0.0
    demand = np.array([counts[int(k)] for k in have], float)
    served, bound = np.zeros(len(have)), 0.0
    for t in range(1, rounds + 1):
        w = np.zeros(size + 1)
        w[have] = have / size * np.exp(-RATE * served / t)
        best, take = knapsack(w, size)
        bound = max(bound, float(demand @ w[have] / best[size]))
        filling = dict(through(int(have[(w[have] + best[size - have]).argmax()]), take, size))
        served += np.array([filling.get(int(k), 0) for k in have]) / demand
    return bound


def rounded(counts: dict[int, int], fillings: dict[tuple, int], size: int) -> list[tuple[tuple, int]]:
    """(filling, times) that hold counts exactly: the fillings, and best fit, longest first, on what is left of the histogram."""
    left = {k: v for k, v in counts.items() if v > 0}
    plan: dict[tuple, int] = {}
    for key, times in fillings.items():
        plan[key] = times
        for x, n in key:
            left[x] -= n * times
    # the rest: bins of one content are counted together, so the work follows the histogram and not the pieces
    import bisect

    bins: dict[int, dict[tuple, int]] = {}
    rooms: list[int] = []

    def put(content: tuple, times: int) -> None:
        room = size - sum(x * n for x, n in content)
        if room not in bins:
            bins[room] = {}
            bisect.insort(rooms, room)
        bins[room][content] = bins[room].get(content, 0) + times

    for x in sorted((k for k, v in left.items() if v > 0), reverse=True):
        n = left[x]
        while n > 0:
            at = bisect.bisect_left(rooms, x)
            if at == len(rooms):
                per = min(n, size // x)
                put(((x, per),), times := n // per)
                n -= per * times
                continue
            room = rooms[at]
            content, there = next(iter(bins[room].items()))
            per = min(n, room // x)
            times = min(there, n // per)
            if there == times:
                del bins[room][content]
            else:
                bins[room][content] -= times
            if not bins[room]:
                del bins[room]
                rooms.remove(room)
            put((*content, (x, per)), times)
            n -= per * times
    for group in bins.values():
        for content, times in group.items():
            plan[content] = plan.get(content, 0) + times
    return list(plan.items())


def runs(plan: list[tuple[tuple, int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first place, end place, first sequence, pieces of the length in a sequence, first offset)."""
    out, place, sequence = [], {}, 0
    for content, times in plan:
        offset = 0
        for x, n in content:
            at = place.get(x, 0)
            out.append((x, at, at + n * times, sequence, n, offset))
            place[x] = at + n * times
            offset += x * n
        sequence += times
    return out


def planned(counts: dict[int, int], size: int) -> list[tuple[tuple, int]]:
    """The rounded plan of fewest sequences among those of BIAS."""
    return min((rounded(counts, configuration_lp(counts, size, bias=b), size) for b in BIAS), key=lambda p: sum(n for _, n in p))


def packed(cut: DataFrame, size: int = SIZE, ranked: int = RANKED) -> DataFrame:
    """cut (a written table of pieces) with sequence_id and offset."""
    import bisect

    spark = cut.sparkSession
    lengths = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most size rows
    salts = F.broadcast(spark.createDataFrame([(k, -(-n // ranked)) for k, n in sorted(lengths.items())], "length long, salts long"))
    salted = cut.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    per = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).collect()  # a row for each length and each RANKED pieces
    by: dict[int, list] = {}
    for x, *run in runs(planned(lengths, size)):
        by.setdefault(x, []).append(tuple(run))
    known, at = [], {}
    for x, salt, n in sorted((r["length"], r["salt"], r["n"]) for r in per):
        first = at.get(x, 0)
        at[x] = first + n
        ends = [run[1] for run in by[x]]
        known.append((x, salt, first, by[x][bisect.bisect_right(ends, first) : bisect.bisect_left(ends, first + n) + 1]))
    run = "struct<first:long,stop:long,sequence:long,each:long,at:long>"
    known = F.broadcast(spark.createDataFrame(known, f"length long, salt int, base long, runs array<{run}>"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    placed = salted.withColumn("local", rank).join(known, ["length", "salt"]).withColumn("place", F.col("base") + F.col("local"))
    hit = F.get(F.filter("runs", lambda r: (r["first"] <= F.col("place")) & (F.col("place") < r["stop"])), F.lit(0))
    within = F.col("place") - F.col("run.first")
    return placed.withColumn("run", hit).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("run.sequence") + F.floor(within / F.col("run.each"))).cast("long").alias("sequence_id"),
        (F.col("run.at") + F.pmod(within, F.col("run.each")) * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, size: int = SIZE, end: int = END, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of docs with their sequence and place."""
    return packed(written(pieces(docs, size, end, vocabulary), "pieces"), size)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": op1_best_fit_packing}
ORACLE: dict[str, str] = {}
