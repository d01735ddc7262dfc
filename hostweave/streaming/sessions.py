"""Campaigns of a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions_of(events: DataFrame, gap: int, watermark: int | None = None) -> DataFrame:
    """(start, end, events) of bursts separated by more than `gap` seconds, for batch and streaming tables alike.

    time is integer seconds. A window of `gap` seconds merges events that are exactly that far apart, as the batch rule
    does. On a stream, results come once the watermark (by default the gap) has passed a burst's end.
    """
    rows = events.withColumn("ts", F.timestamp_seconds("time"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", f"{watermark or gap} seconds")
    # a stream's session windows need a key beside the window; all events have the same one
    out = rows.withColumn("_all", F.col("time") * 0).groupBy("_all", F.session_window("ts", f"{gap} seconds")).agg(F.count("*").alias("events"), F.min("time").alias("start"), F.max("time").alias("end"))
    return out.select("start", "end", "events")
