"""Windowed aggregates and alerts that run alike on batch and streaming DataFrames of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WATERMARK = "1 day"


def _late(events: DataFrame, delay: str = WATERMARK) -> DataFrame:
    return events.withWatermark("ts", delay) if events.isStreaming else events


def tumbling(events: DataFrame, length: str = "1 day") -> DataFrame:
    """Counts and correct counts by window and event type."""
    return _late(events).groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("correct"))


def sliding(events: DataFrame, length: str = "7 days", slide: str = "1 day") -> DataFrame:
    return _late(events).groupBy(F.window("ts", length, slide)).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("value") > 50).cast("int")), 6).alias("accuracy"))


def first_seen(events: DataFrame, keys: tuple[str, ...] = ("user_id", "event_type")) -> DataFrame:
    """One row a key; on a stream, within the watermark."""
    if events.isStreaming:
        return _late(events).dropDuplicatesWithinWatermark(list(keys))
    return events.dropDuplicates(list(keys))


def daily_alerts(events: DataFrame, least: float = 90.0) -> DataFrame:
    e = _late(events).filter(F.col("value") > least)
    return e.groupBy("user_id", F.window("ts", "1 day")).agg(F.min("ts").alias("first_ts"), F.count(F.lit(1)).alias("n")).select("user_id", F.to_date("window.start").alias("day"), "first_ts", "n")


def rate_limited_alerts(events: DataFrame, least: float = 90.0, hours: int = 24) -> DataFrame:
    """Streaming only: an alert per user at most every ``hours`` of event time, kept as keyed state."""

    def step(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for r in rows.itertuples():
            if last is None or r.ts >= pd.Timestamp(last) + pd.Timedelta(hours=hours):
                out.append((key[0], r.ts, r.value))
                last = r.ts.isoformat()
        if last is not None:
            state.update((str(last),))
        yield pd.DataFrame(out, columns=["user_id", "ts", "value"])

    hot = events.filter(F.col("value") > least)
    return hot.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, ts timestamp, value double", "last string", "append", "NoTimeout")
