"""Rasters on other grids: snapping, and resampling driven by the cells of the target."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grid:
    """Square cells in rows from a north-western corner."""

    west: float
    north: float
    size: float
    rows: int
    cols: int

    def centre(self, r: Column, c: Column) -> tuple[Column, Column]:
        return self.west + (c + 0.5) * self.size, self.north - (r + 0.5) * self.size

    def place(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of a point, in cells from the corner, not rounded."""
        return (self.north - y) / self.size, (x - self.west) / self.size

    def aligned(self) -> Grid:
        """This grid snapped to whole multiples of its cell size, outwards."""
        west, north = math.floor(self.west / self.size), math.ceil(self.north / self.size)
        east, south = math.ceil((self.west + self.cols * self.size) / self.size - 1e-9), math.floor((self.north - self.rows * self.size) / self.size + 1e-9)
        return Grid(west * self.size, north * self.size, self.size, north - south, east - west)


Mapping = Callable[[Column, Column], tuple[Column, Column]]


def _targets(cells: DataFrame, target: Grid, mapping: Mapping | None) -> DataFrame:
    """Cells of the target with the point of the source (x, y) that their centres come from."""
    ids = cells.sparkSession.range(target.rows * target.cols)
    at = ids.select(F.floor(F.col("id") / target.cols).alias("r"), (F.col("id") % target.cols).alias("c"))
    x, y = target.centre(F.col("r"), F.col("c"))
    x, y = mapping(x, y) if mapping else (x, y)
    return at.select("r", "c", x.alias("x"), y.alias("y"))


def warp_nearest(cells: DataFrame, source: Grid, target: Grid, mapping: Mapping | None = None) -> DataFrame:
    """r, c, h of all target cells that fall into the source: the value of the source cell (r, c, h) that their centre lies in.

    mapping leads from a point of the target to one of the source. One equi-join; cells outside are left out before it.
    """
    y, x = source.place(F.col("x"), F.col("y"))
    t = _targets(cells, target, mapping).select("r", "c", F.floor(y).alias("sr"), F.floor(x).alias("sc"))
    t = t.where(F.col("sr").between(0, source.rows - 1) & F.col("sc").between(0, source.cols - 1))
    return t.join(cells.select(F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), "h"), ["sr", "sc"]).select("r", "c", "h")


def warp_bilinear(cells: DataFrame, source: Grid, target: Grid, mapping: Mapping | None = None) -> DataFrame:
    """r, c, h of target cells whose centre falls into the source: the mean of the four source cells around it, weighted by
    nearness; weights of cells that are missing or null go to the others, and a cell with none of them is left out.
    """
    y, x = source.place(F.col("x"), F.col("y"))
    t = _targets(cells, target, mapping).select("r", "c", y.alias("y"), x.alias("x")).where((F.col("y") >= 0) & (F.col("y") < source.rows) & (F.col("x") >= 0) & (F.col("x") < source.cols))
    t = t.select("r", "c", F.floor(F.col("y") - 0.5).alias("r0"), F.floor(F.col("x") - 0.5).alias("c0"), (F.col("y") - 0.5).alias("y"), (F.col("x") - 0.5).alias("x"))
    fy, fx = F.col("y") - F.col("r0"), F.col("x") - F.col("c0")
    four = F.array(*(F.struct((F.col("r0") + i).alias("sr"), (F.col("c0") + j).alias("sc"), ((fy if i else 1 - fy) * (fx if j else 1 - fx)).alias("w")) for i in (0, 1) for j in (0, 1)))
    t = t.select("r", "c", F.explode(four).alias("o")).select("r", "c", "o.*").where("w > 0")
    s = cells.where("h is not null").select(F.col("r").cast("long").alias("sr"), F.col("c").cast("long").alias("sc"), "h")
    return t.join(s, ["sr", "sc"]).groupBy("r", "c").agg((F.sum(F.col("h") * F.col("w")) / F.sum("w")).alias("h"))
