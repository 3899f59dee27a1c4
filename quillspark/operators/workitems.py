"""The append-only log of work items: last states, cache hits, resume, retention. Aggregates, not windows, so that a hot key is combined before it is shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import epoch_millis

TERMINAL = ("completed", "cached", "failed")


def last_states(log: DataFrame) -> DataFrame:
    """identity, id, state, value: the last row of each identity, terminal or not."""
    row = F.max(F.struct("id", "state", "value")).alias("r")
    return log.groupBy("identity").agg(row).select("identity", "r.id", "r.state", "r.value")


def terminal(log: DataFrame) -> DataFrame:
    return last_states(log).where(F.col("state").isin(*TERMINAL))


def outstanding(log: DataFrame) -> DataFrame:
    """Identities whose last row isn't terminal: what a resumed run still has to do."""
    return log.select("identity").distinct().join(terminal(log).select("identity"), "identity", "left_anti")


def cache_entries(log: DataFrame) -> DataFrame:
    """cache_key, source_id, value: the newest completed row of each key; cached rows are no source."""
    return log.where("state = 'completed' AND cache_key IS NOT NULL").groupBy("cache_key").agg(F.max(F.struct("id", "value")).alias("r")).select("cache_key", F.col("r.id").alias("source_id"), "r.value")


def cache_hits(requests: DataFrame, log: DataFrame) -> DataFrame:
    """All keys are looked up by one join."""
    return requests.select(F.col("id"), "cache_key").join(cache_entries(log), "cache_key")


def state_totals(log: DataFrame) -> DataFrame:
    count = lambda s: F.count_if(F.col("state") == s).alias(s)
    return last_states(log).agg(F.count("*").alias("items"), *[count(s) for s in ("pending", "running", "completed", "cached", "failed")])


def retained(runs: DataFrame, keep: int = 5) -> DataFrame:
    """Runs with whether they stay: the newest keep by time, then id descending. The runs of a store are few; the top ones are found by a limit, not by ranking all."""
    newest = runs.orderBy(F.desc("recorded"), F.desc("run")).limit(keep).select("run", F.lit(True).alias("kept"))
    return runs.join(F.broadcast(newest), "run", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def append_log(rows: DataFrame, path: str) -> None:
    """Adds rows to the log; runs are folders, so that a run is read alone."""
    rows.write.mode("append").partitionBy("run_id").parquet(path)


def requests_within(log: DataFrame, seconds: int) -> DataFrame:
    """id, n: rows of the same identity in the window of time that ends with each row. Time is dealt into buckets of the window's length; a row only needs its own bucket and the one before, so a busy identity is spread over tasks. Rows without a time are each other's window."""
    ms = seconds * 1000
    rows = log.select("id", "identity", epoch_millis(F.col("ts")).alias("at")).withColumn("bucket", F.floor(F.col("at") / ms))
    both = rows.withColumn("own", F.lit(True)).unionByName(rows.where("bucket IS NOT NULL").withColumns({"bucket": F.col("bucket") + 1, "own": F.lit(False)}))
    frame = Window.partitionBy("identity", "bucket").orderBy("at").rangeBetween(-(ms - 1), 0)
    return both.withColumn("n", F.count("*").over(frame)).where("own").select("id", "identity", "n")


def throttle_limits(signals: DataFrame, ceiling: int = 8, restore: int = 5) -> DataFrame:
    """key, limit, streak: the concurrency that a key's signals, in order, lead to. signals(key, ord, signal): throttled halves the limit, restore clean ones in a row below the ceiling add one."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "signal"))), lambda x: x["signal"])
    state = lambda limit, streak: F.struct(limit.cast("int").alias("limit"), streak.cast("int").alias("streak"))
    zero = F.lit(0)

    def step(a, s):
        restored = a["streak"] + 1 >= restore
        clean = F.when(a["limit"] >= ceiling, state(a["limit"], zero)).when(restored, state(a["limit"] + 1, zero)).otherwise(state(a["limit"], a["streak"] + 1))
        return F.when(s == "throttled", state(F.greatest(F.lit(1), F.floor(a["limit"] / 2)), zero)).when(s == "clean", clean).otherwise(a)

    rows = signals.groupBy("key").agg(ordered.alias("s")).select("key", F.aggregate("s", state(F.lit(ceiling), zero), step).alias("r"))
    return rows.select("key", F.col("r.limit").cast("long").alias("limit"), F.col("r.streak").cast("long").alias("streak"))
