"""Event streams: windows with watermarks, and first-seen filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream over Parquet files as they come."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; rows later than ``late`` are dropped."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return ts.groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by user that end after ``gap`` without an event."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """The first of repeated rows within the watermark."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
