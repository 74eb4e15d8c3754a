"""Streams of events: windows, sessions and late data (an extension beyond batch tracks)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def windowed(events: DataFrame, ts: str, keys: list[str], length: str, slide: str | None = None, late: str | None = None, value: str = "value") -> DataFrame:
    """keys, start, n, total per tumbling or sliding window; works on a stream (with a watermark) and on a table."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.window(ts, length, slide or length).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(*keys, F.col("w.start").alias("start"), "n", "total")


def sessions(events: DataFrame, ts: str, keys: list[str], gap: str, late: str | None = None) -> DataFrame:
    """keys, start, end, n per run of events with gaps under ``gap``."""
    source = events.withWatermark(ts, late) if late else events
    return source.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_sightings(events: DataFrame, ident: str, ts: str, late: str) -> DataFrame:
    """Each ident once, for repeats that arrive within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([ident])


RUNNING = T.StructType([T.StructField("n", T.LongType()), T.StructField("largest", T.DoubleType())])


def running_largest(events: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, largest after each batch of a key: state kept per key between batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = dict(events.dtypes)[key]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, largest = state.get if state.exists else (0, None)
        for frame in frames:
            values = frame[value].dropna()
            n += len(frame)
            if len(values):
                largest = float(values.max()) if largest is None else max(largest, float(values.max()))
        state.update((n, largest))
        yield pd.DataFrame({key: [k[0]], "n": [n], "largest": [largest]})

    return events.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, n long, largest double", RUNNING, "update", GroupStateTimeout.NoTimeout)
