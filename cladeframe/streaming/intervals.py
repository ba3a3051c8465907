"""Interval statistics of an event stream, as tumbling windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """A stream of the event files of a folder; times without a zone are taken as UTC."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    out = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def interval_statistics(events: DataFrame, *, length: str = "1 day", late: str = "1 day") -> DataFrame:
    """Attempts and gain of each event type in each interval; with a stream, intervals are final once the
    watermark has passed them, and later events are left out."""
    value = F.round(F.col("value") * 100).cast("long")
    d = events.withWatermark("ts", late) if events.isStreaming else events
    out = d.groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("attempts"), F.sum(value).alias("gain"))
    return out.select("event_type", F.col("window.start").alias("start"), "attempts", "gain")


def sessions(events: DataFrame, *, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    """Sessions of users that end after a gap, by number of events."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    out = d.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("events"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
