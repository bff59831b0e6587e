"""Structured Streaming: popularity and deduplicated edges from an unbounded event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_events(stream: DataFrame, watermark: str = "1 hour", time: str = "ts", key: str = "event_id") -> DataFrame:
    """Events without those that repeat a key within the watermark; state is dropped as the watermark passes."""
    return stream.withWatermark(time, watermark).dropDuplicatesWithinWatermark([key])


def windowed_popularity(stream: DataFrame, window: str = "1 day", watermark: str | None = "1 hour", time: str = "ts", item: str = "event_type") -> DataFrame:
    """(start, end, item_id, owners, events) per tumbling window; late rows up to the watermark count. None for a stream that has one."""
    if watermark:
        stream = stream.withWatermark(time, watermark)
    counts = stream.groupBy(F.window(time, window), F.col(item).alias("item_id")).agg(F.approx_count_distinct("user_id", 0.01).alias("owners"), F.count("*").alias("events"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "item_id", "owners", "events")


def running_edges(stream: DataFrame, item: str = "event_type", value: str = "value") -> DataFrame:
    """Fieldwise maxima per (user_id, item_id) so far, for update mode: the streaming form of canonical edges."""
    return stream.groupBy("user_id", F.col(item).alias("item_id")).agg(F.max(value).alias("playtime_forever"), F.count("*").alias("rows"))


def write(df: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Start a query that writes Parquet parts once all available rows are read."""
    return df.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
