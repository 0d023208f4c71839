"""Gauge readings as a stream: range checks, watermark, windowed statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def readings(spark: SparkSession, folder: str, schema) -> DataFrame:
    """A stream of event files."""
    return spark.readStream.schema(schema).parquet(folder)


def window_levels(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and extremes of plausible values (0 to 20) by type and window; later readings are left out."""
    ok = events.where(F.col("value").between(0, 20)).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = ok.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "mean", "low", "high")
