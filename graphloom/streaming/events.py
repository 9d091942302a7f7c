"""Event streams: windowed counts with late data, and running learned weights, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """A stream of the event files in a folder."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total): tumbling hours; rows later than the watermark are dropped by a stream."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("window.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, n): sessions that end when a user is silent for gap."""
    out = events.withWatermark("ts", gap).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), "n")


def running_weights(events: DataFrame, failed: str = "error") -> DataFrame:
    """(key, accept): by event user, the share of events that aren't errors; as a stream, updated with every batch."""
    return events.groupBy(F.col("user_id").alias("key")).agg(F.round(F.avg((F.col("event_type") != failed).cast("double")), 6).alias("accept"))
