"""Streaming forms of the event aggregates (extensions: late data, windows, sessions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a stream of Parquet files; the clock as a timestamp, which watermarks need.

    The last letter is written as a pattern, for a stream takes a plain path to be a folder and ``folder`` may be one file.
    """
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(f"{folder[:-1]}[{folder[-1]}]").withColumn("ts", F.col("ts").cast("timestamp"))


def by_window(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window and kind; rows later than ``late`` don't change closed windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("w.start", "user_id", "n")


def by_sliding_window(events: DataFrame, width: str = "1 hour", step: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts by overlapping event-time windows and kind; a row is in every window that covers it."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")
