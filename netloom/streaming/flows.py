"""Streaming twins: minute buckets with late data, and first-of-cooldown per key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def minute_buckets(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events per minute; rows later than ``late`` behind the newest are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")


def _emit(times: list[int], last: int | None, cooldown: int) -> tuple[list[int], int | None]:
    out = []
    for t in sorted(times):
        if last is None or t - last >= cooldown:
            out.append(t)
            last = t
    return out, last


def throttle_stream(events: DataFrame, cooldown: int, late: str = "10 minutes") -> DataFrame:
    """events: key string, t bigint (seconds, 0 or more: a stream's first watermark is at 0, and what
    is not past it counts as late, so event times are shifted by one). The rows that no emitted row precedes by less than
    cooldown. What is later than ``late`` behind the newest goes; times before the last that was
    emitted count as within its cooldown. A key's state is dropped once its cooldown is over for all
    that may still come."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        out, last = _emit([t for p in parts for t in p["t"].tolist()], last, cooldown)
        if last is not None:
            state.update((last,))
            state.setTimeoutTimestamp(max((last + cooldown + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]] * len(out), "t": out})

    timed = events.select("key", "t", F.timestamp_seconds(F.col("t") + 1).alias("at")).withWatermark("at", late)
    return timed.groupBy("key").applyInPandasWithState(run, "key string, t bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def throttle_batch(events: DataFrame, cooldown: int) -> DataFrame:
    """The same over a table. Rows stream through in order of key and time, so a task never holds a key as a whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, last = None, None
        for f in frames:
            out = []
            for k, t in zip(f["key"], f["t"]):
                if k != key or last is None or t - last >= cooldown:
                    out.append((k, t))
                    key, last = k, t
            yield pd.DataFrame(out, columns=["key", "t"])

    return events.select("key", "t").repartition("key").sortWithinPartitions("key", "t").mapInPandas(run, "key string, t bigint")
