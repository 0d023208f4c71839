"""Rasters as relations: a cell is (r, c, value); a D8 direction is an edge to one of eight neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Neighbours clockwise from east: (row step, column step). Neighbour k has the direction code 2 ** k.
STEPS = ((0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1))
#: Distance to neighbour k in cells.
FACTORS = tuple(math.sqrt(2.0) if dr and dc else 1.0 for dr, dc in STEPS)


def cells_from_arrays(table: DataFrame, row: str, values: str) -> DataFrame:
    """One array for each raster row, as cells (r, c, h); null values (nodata) stay null."""
    return table.select(F.col(row).alias("r"), F.posexplode(values).alias("c", "h")).select("r", "c", F.col("h").cast("double").alias("h"))


def arrays_from_cells(cells: DataFrame, value: str = "h") -> DataFrame:
    """The inverse: one array for each row, in column order."""
    return cells.groupBy("r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", value))), lambda x: x[value]).alias("values"))


def cell_id(ncols: int, r: str | Column = "r", c: str | Column = "c") -> Column:
    r, c = (F.col(x) if isinstance(x, str) else x for x in (r, c))
    return r.cast("long") * ncols + c


def with_tile(cells: DataFrame, edge: int) -> DataFrame:
    return cells.withColumn("tile_r", F.floor(F.col("r") / edge).cast("int")).withColumn("tile_c", F.floor(F.col("c") / edge).cast("int"))


def neighbours(cells: DataFrame, *values: str) -> DataFrame:
    """Each cell (r, c, values...) with every value's eight neighbours as {value}_0 .. {value}_7; null outside.

    Every cell is sent to those that see it and values are combined by (r, c). Cells next to each other mostly lie in the
    same partition, so the map-side combine turns the nine copies back into about one row per cell before the shuffle.
    """
    seen = [F.struct(F.lit(8).alias("k"), F.lit(0).alias("dr"), F.lit(0).alias("dc"))]
    seen += [F.struct(F.lit(k).alias("k"), F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for k, (dr, dc) in enumerate(STEPS)]
    sent = cells.select("r", "c", *values, F.explode(F.array(*seen)).alias("o")).select((F.col("r") - F.col("o.dr")).alias("r"), (F.col("c") - F.col("o.dc")).alias("c"), F.col("o.k").alias("k"), *values)
    at = lambda v, k: F.max(F.when(F.col("k") == k, F.col(v)))
    out = sent.groupBy("r", "c").agg(F.max(F.col("k") == 8).alias("own"), *(at(v, 8).alias(v) for v in values), *(at(v, k).alias(f"{v}_{k}") for v in values for k in range(8)))
    return out.where("own").drop("own")


def row_step(code: Column | str) -> Column:
    """Row step of a direction code; null for none."""
    return _step(code, 0)


def column_step(code: Column | str) -> Column:
    return _step(code, 1)


def _step(code: Column | str, i: int) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = F.lit(None).cast("int")
    for k, step in enumerate(STEPS):
        out = F.when(code == 1 << k, step[i]).otherwise(out)
    return out


def pyramid(cells: DataFrame, factor: int) -> DataFrame:
    """Preview at a lower resolution: the mean of factor by factor cells."""
    return cells.groupBy(F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("c") / factor).alias("c")).agg(F.round(F.avg("h"), 6).alias("h"), F.count("h").alias("n"))


def window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of a rectangle (bounds included), counted from its corner."""
    return cells.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).withColumn("r", F.col("r") - r0).withColumn("c", F.col("c") - c0)
