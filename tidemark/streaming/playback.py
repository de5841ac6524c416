"""Structured Streaming over timed events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def density_stream(events: DataFrame, at: str = "ts", window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Counts per event-time window; state older than the watermark is dropped."""
    counted = events.withWatermark(at, late).groupBy(F.window(at, window)).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "n")


def coverage_stream(events: DataFrame, by: str = "user_id", at: str = "t_ms", longest: int = 1500) -> DataFrame:
    """Time credited between consecutive reports of a key; a jump, or a step back, starts a new session.

    State per key is three numbers, whatever the stream's length.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, credited, sessions = state.get if state.exists else (None, 0, 0)
        for frame in frames:
            for t in sorted(frame[at].tolist()):
                if last is not None and 0 <= t - last <= longest:
                    credited += t - last
                else:
                    sessions += 1
                last = t
        state.update((last, credited, sessions))
        yield pd.DataFrame([(key[0], credited, sessions)], columns=[by, "credited_ms", "sessions"])

    kind = events.schema[by].dataType.simpleString()
    return events.select(by, at).groupBy(by).applyInPandasWithState(step, f"{by} {kind}, credited_ms bigint, sessions bigint", "last bigint, credited bigint, sessions bigint", "update", GroupStateTimeout.NoTimeout)
