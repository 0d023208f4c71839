"""The catalogue of depressions and the tables around it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def of_type(depressions: DataFrame, sink_type: int) -> DataFrame:
    return depressions.where(F.col("sink_type") == sink_type)


def override_types(depressions: DataFrame, overrides: DataFrame) -> DataFrame:
    """depressions (sink_id, sink_type, ...) with the types that an analyst gives (record, newtype)."""
    o = overrides.select(F.col("record").alias("sink_id"), "newtype")
    return depressions.join(o, "sink_id", "left").withColumn("sink_type", F.coalesce("newtype", "sink_type")).drop("newtype")


def replace_processed(base: DataFrame, processed: DataFrame, key: str, value: str) -> DataFrame:
    """base, with the processed value wherever there is one for the key."""
    p = processed.select(key, F.col(value).alias("_p"))
    return base.join(p, key, "left").withColumn(value, F.coalesce("_p", value)).drop("_p")


def same_grid(metadata: DataFrame) -> DataFrame:
    """Groups of rasters (grp, nrows, ncols, x0, y0, dx, dy) and whether all of a group lie on one grid."""
    shape = F.struct("nrows", "ncols", "x0", "y0", "dx", "dy")
    return metadata.groupBy("grp").agg((F.min(shape) == F.max(shape)).alias("aligned"), F.count("*").alias("n"))
