"""Time windows over events; the same function serves a table and, behind a watermark, a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str, watermark: str | None = None) -> DataFrame:
    """starts, event_type, events, total of windows of fixed width."""
    own = events.withWatermark("ts", watermark) if watermark else events
    out = own.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).cast("bigint").alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("w.start").alias("starts"), "event_type", "events", "total")


def sessions(events: DataFrame, gap: str, watermark: str | None = None) -> DataFrame:
    """user_id, starts, events of runs of a user's events without a pause of the given length."""
    own = events.withWatermark("ts", watermark) if watermark else events
    out = own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).cast("bigint").alias("events"))
    return out.select("user_id", F.col("w.start").alias("starts"), "events")


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Events as they arrive as Parquet files in a folder; each file is read once."""
    return spark.readStream.schema(schema).parquet(path)
