"""Streaming over events: an extension, with windows, watermarks and deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, sf_dir: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Events as files of a folder arrive."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value by type in windows of a width; state is bounded by the watermark."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")


def once(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Each event_id once; on a stream within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
