"""The throttle as a stream: the concurrency of each key, kept as state over its signals, and duplicate events left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupStateTimeout

CEILING, RESTORE = 8, 5


def next_state(limit: int, streak: int, signal: str, ceiling: int = CEILING, restore: int = RESTORE) -> tuple[int, int]:
    """Throttled halves the limit; so many clean ones in a row below the ceiling add one; anything else changes nothing."""
    if signal == "throttled":
        return max(1, limit // 2), 0
    if signal != "clean":
        return limit, streak
    if limit >= ceiling:
        return limit, 0
    return (limit + 1, 0) if streak + 1 >= restore else (limit, streak + 1)


def throttle_stream(signals: DataFrame, ceiling: int = CEILING, restore: int = RESTORE) -> DataFrame:
    """key, limit, streak after each batch of signals(key, ord, signal). Within a batch signals are taken in order of ord; a key's state is two numbers."""

    def fold(key, frames, state):
        import pandas as pd

        limit, streak = state.get if state.exists else (ceiling, 0)
        rows = pd.concat(list(frames)).sort_values("ord", kind="stable")
        for signal in rows["signal"]:
            limit, streak = next_state(int(limit), int(streak), signal, ceiling, restore)
        state.update((limit, streak))
        yield pd.DataFrame([(key[0], limit, streak)], columns=["key", "limit", "streak"])

    schema = "key string, limit long, streak long"
    return signals.groupBy("key").applyInPandasWithState(fold, schema, "limit long, streak long", "update", GroupStateTimeout.NoTimeout)


def first_events(events: DataFrame, keys: list[str], at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Events without repetitions of their keys; state is kept as long as an event may be late."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)
