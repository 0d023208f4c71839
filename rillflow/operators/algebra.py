"""Local map algebra: expressions on the values of one cell, and overlays of aligned rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Occurrence that land and water classes stand for, in percent.
CLASS_OCCURRENCE = {1: 0, 2: 30, 3: 30, 4: 10, 5: 10}


def class_occurrence(code: Column) -> Column:
    """Occurrence of a water class; 0 where there is no class."""
    out = F.lit(0)
    for k, v in CLASS_OCCURRENCE.items():
        out = F.when(code == k, v).otherwise(out)
    return out


def observed_occurrence(value: Column) -> Column:
    """Observed occurrence to 70 %, cut to whole numbers; above 100 it is not an observation and counts as 0.

    Seven tenths are taken exactly: 90 gives 63, where a product with the binary 0.7 would be cut to 62.
    """
    return F.floor(F.when(value > 100, 0).otherwise(value) * 7 / 10).cast("int")


def combined_occurrence(code: Column, value: Column) -> Column:
    """Sum of both, only where the class gives any."""
    known = class_occurrence(code)
    return F.when(known > 0, known + observed_occurrence(value))


def burn(h: Column, occurrence: Column, ocean: Column) -> Column:
    """Heights lowered by water occurrence (a little raised where it is rare); the ocean has no height."""
    return F.when(ocean, F.lit(None)).when(occurrence.isNotNull() & (occurrence != 0), h - (0.06 * occurrence - 3)).otherwise(h)


def without(value: Column, nodata: float) -> Column:
    return F.nullif(value, F.lit(nodata))


def overlay(base: DataFrame, patch: DataFrame, value: str = "h") -> DataFrame:
    """base with the patch's values where it has any."""
    p = patch.where(F.col(value).isNotNull()).select("r", "c", F.col(value).alias("_p"))
    return base.join(p, ["r", "c"], "left").withColumn(value, F.coalesce("_p", value)).drop("_p")


def mosaic(rasters: list[DataFrame], value: str = "h") -> DataFrame:
    """Cells of all rasters; where several have a value, that of the last one in the list."""
    each = [x.where(F.col(value).isNotNull()).select("r", "c", value, F.lit(i).alias("priority")) for i, x in enumerate(rasters)]
    return reduce(DataFrame.unionByName, each).groupBy("r", "c").agg(F.max_by(value, "priority").alias(value))


def fuse(first: DataFrame, second: DataFrame, residual: DataFrame) -> DataFrame:
    """first where it has a height, else second plus the smoothed residual between both."""
    s = second.select("r", "c", F.col("h").alias("h2"))
    e = residual.select("r", "c", F.col("h").alias("e"))
    return s.join(first, ["r", "c"], "left").join(e, ["r", "c"], "left").select("r", "c", F.coalesce("h", F.col("h2") + F.coalesce("e", F.lit(0.0))).alias("h"))


def inside(polygon: list[tuple[float, float]], x: Column, y: Column) -> Column:
    """Even-odd test of a point against a polygon's ring."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(polygon, [*polygon[1:], polygon[0]]):
        if y1 != y2:
            hit = ((y >= min(y1, y2)) & (y < max(y1, y2))) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hit.cast("int")
    return crossings % 2 == 1
