"""Aggregates over labelled cells: extents, geometry and class of depressions, water bodies, basin scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .focal import boundary_ring

#: Square metres of a cell; limits of an endorheic depression: square kilometres, cubic kilometres, metres.
CELL_M2, LEAST_AREA, LEAST_VOLUME, LEAST_DEPTH = 900.0, 50.0, 0.5, 10.0


def extents(labels: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Per label: cells, extent, and whether it touches each side of the raster."""
    touch = lambda x: F.max(x)
    return labels.groupBy("label").agg(
        F.count("*").alias("n"), F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.min("c").alias("min_c"), F.max("c").alias("max_c"),
        touch(F.col("r") == 0).alias("touch_u"), touch(F.col("r") == nrows - 1).alias("touch_d"), touch(F.col("c") == 0).alias("touch_l"), touch(F.col("c") == ncols - 1).alias("touch_r"),
    )


def crops(labels: DataFrame) -> DataFrame:
    """Masks of labels (label, r, c) over their bounding boxes: label, r, c, inside (1 or 0)."""
    box = labels.groupBy("label").agg(F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    cells = box.select("label", F.explode(F.sequence("r0", "r1")).alias("r"), "c0", "c1").select("label", "r", F.explode(F.sequence("c0", "c1")).alias("c"))
    return cells.join(labels.select("label", "r", "c", F.lit(1).alias("inside")), ["label", "r", "c"], "left").withColumn("inside", F.coalesce("inside", F.lit(0)))


def lowest_cells(labels: DataFrame) -> DataFrame:
    """The lowest cell of each label, the first in scan order of equal ones."""
    best = labels.groupBy("label").agg(F.min(F.struct("h", "r", "c")).alias("m"))
    return best.select("label", F.col("m.r").alias("low_r"), F.col("m.c").alias("low_c"), F.col("m.h").alias("low_h"))


def depression_class(area: Column, volume: Column, depth: Column) -> Column:
    """1 flat, 2 endorheic, 3 exorheic; null without an outlet."""
    return F.when(volume.isNull(), F.lit(None)).when(volume == 0, 1).when((area > LEAST_AREA) & (volume > LEAST_VOLUME) & (depth > LEAST_DEPTH), 2).otherwise(3)


def geometry(cells: DataFrame) -> DataFrame:
    """Depressions of cells (r, c, label, h; label null outside): outlet, lowest cell, area, depth, volume and class.

    The outlet is the lowest cell of the ring around a depression, the first in scan order of equal ones.
    """
    ring = boundary_ring(cells).groupBy("label").agg(F.min(F.struct("h", "r", "c")).alias("o"))
    own = cells.where("label is not null").join(ring, "label", "left")
    below = F.when(F.col("h") <= F.col("o.h"), ((F.col("o.h") - F.col("h")) * CELL_M2).cast("decimal(28,6)"))
    g = own.groupBy("label").agg(F.count("*").alias("n"), F.min(F.struct("h", "r", "c")).alias("m"), F.first("o").alias("o"), F.sum(below).alias("m3"))
    area, depth, volume = F.col("n") * CELL_M2 / 1e6, F.col("o.h") - F.col("m.h"), F.when(F.col("o").isNotNull(), F.coalesce(F.col("m3").cast("double"), F.lit(0.0)) / 1e9)
    return g.select("label", "n", F.col("o.r").alias("out_r"), F.col("o.c").alias("out_c"), F.col("m.r").alias("low_r"), F.col("m.c").alias("low_c"), area.alias("area_km2"), depth.alias("depth_m"), volume.alias("volume_km3"), depression_class(area, volume, depth).alias("sink_type"))


def water_bodies(labels: DataFrame, occurrence: DataFrame, least_mean: float, least_cells: int) -> DataFrame:
    """Labels (label, r, c) whose mean occurrence and number of cells are large enough."""
    g = labels.join(occurrence, ["r", "c"]).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("occ"), 6).alias("mean_occ"))
    return g.where((F.col("mean_occ") >= least_mean) & (F.col("n") >= least_cells))


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells of two basins sets (basin, r, c): intersection, union and their ratio, per basin."""
    x = a.select("basin", "r", "c", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(b.select("basin", "r", "c", F.lit(0).alias("a"), F.lit(1).alias("b")))
    both = x.groupBy("basin", "r", "c").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.groupBy("basin").agg(F.sum(F.col("a") * F.col("b")).alias("both"), F.count("*").alias("either")).withColumn("csi", F.round(F.col("both") / F.col("either"), 6))


def outlet_scan(ring: DataFrame) -> DataFrame:
    """The outlet of each depression, as a scan of its ring finds it: label, r, c, h.

    ring is label, seq, r, c, h, dir, to_label: cells beside a depression in the order of the scan, with their direction (0 or
    null: none) and the label of the cell that it leads to. A cell that is no lower than the outlet so far is passed over; one
    without a direction ends the scan and is the outlet; one that flows into the depression is passed over; any other
    becomes the outlet. The outlet so far is a running minimum, so the scan is a window and no loop. Null heights are passed over.
    """
    ends, leaves = F.coalesce(F.col("dir"), F.lit(0)) == 0, ~F.col("to_label").eqNullSafe(F.col("label"))
    before = Window.partitionBy("label").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.min(F.when(~ends & leaves, F.col("h"))).over(before)
    seen = ring.where("h is not null").withColumn("stop", ends & (F.col("h") < F.coalesce(so_far, F.lit(float("inf"))))).withColumn("ends", ends).withColumn("leaves", leaves)
    cell = F.struct("h", "seq", "r", "c")
    found = seen.groupBy("label").agg(F.min_by(cell, F.when(F.col("stop"), F.col("seq"))).alias("stop"), F.min(F.when(~F.col("ends") & F.col("leaves"), cell)).alias("low"))
    o = F.coalesce("stop", "low")
    return found.select("label", o["r"].alias("r"), o["c"].alias("c"), o["h"].alias("h")).where("r is not null")
