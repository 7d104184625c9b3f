"""Streams of records and of request events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_counts(events: DataFrame, window: str = "60 seconds", slide: str = "30 seconds", delay: str | None = None) -> DataFrame:
    """Events of each kind in sliding windows; with a delay, late events beyond it are left out and state is dropped.

    Works on tables and on streams alike: ts, event_type.
    """
    rows = events.withWatermark("ts", delay) if delay else events
    out = rows.groupBy(F.window("ts", window, slide).alias("w"), "event_type").agg(F.count("*").alias("requests"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "requests")


def first_records(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Records of a stream whose key was not seen within the delay; state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append(stream: DataFrame, path: str, checkpoint: str, partitions: tuple[str, ...] = ("provider", "query_id")):
    """Appends what is new and stops: a run that is started again goes on where the last one ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partitions).trigger(availableNow=True).start()
