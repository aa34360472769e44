"""Streaming extras, beyond relational parity: counts over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of Parquet files that arrive in ``folder``."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per window and type; state older than the watermark is dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", width), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("begins"), "event_type", "n")
