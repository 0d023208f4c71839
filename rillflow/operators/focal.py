"""Neighbourhood operators on cells, all from one exchange of neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import FACTORS, STEPS, cell_id, neighbours


def _each(name: str) -> list[Column]:
    return [F.col(f"{name}_{k}") for k in range(8)]


def _first(best: Column, values: list[Column], results: list) -> Column:
    """The result of the first value that equals best."""
    out = F.lit(None)
    for v, result in reversed(list(zip(values, results))):
        out = F.when(v == best, result).otherwise(out)
    return out


def _code(k: Column) -> Column:
    """Direction code of neighbour k."""
    return F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), k + 1)


def d8(cells: DataFrame) -> DataFrame:
    """Steepest descent: r, c, h, dir. Level neighbours count, the first of equally steep ones wins, 0 is a terminal."""
    n = neighbours(cells, "h").where("h is not null")
    slopes = [F.when(v <= F.col("h"), (F.col("h") - v) / f) for v, f in zip(_each("h"), FACTORS)]
    n = n.select("r", "c", "h", *(s.alias(f"s{k}") for k, s in enumerate(slopes)))
    s = [F.col(f"s{k}") for k in range(8)]
    return n.select("r", "c", "h", F.coalesce(_first(F.greatest(*s), s, [1 << k for k in range(8)]), F.lit(0)).cast("short").alias("dir"))


def gentlest_rise(cells: DataFrame) -> DataFrame:
    """Reverse D8: the direction of the least rise among neighbours that are not lower; null if there is none."""
    n = neighbours(cells, "h").where("h is not null")
    rises = [F.when(v >= F.col("h"), (v - F.col("h")) / f) for v, f in zip(_each("h"), FACTORS)]
    n = n.select("r", "c", "h", *(s.alias(f"s{k}") for k, s in enumerate(rises)))
    s = [F.col(f"s{k}") for k in range(8)]
    return n.select("r", "c", _first(F.least(*s), s, [1 << k for k in range(8)]).cast("int").alias("dir"))


def flow_edges(directions: DataFrame, ncols: int) -> DataFrame:
    """Directions (r, c, dir) as edges (id, next_id); next_id is null at terminals."""
    from .grid import column_step, row_step

    to = cell_id(ncols, F.col("r") + row_step("dir"), F.col("c") + column_step("dir"))
    return directions.select(cell_id(ncols).alias("id"), F.when(F.col("dir") > 0, to).alias("next_id"))


def boundary_flag(cells: DataFrame) -> DataFrame:
    """Whether a cell touches the outside: any neighbour out of the raster or without a value."""
    n = neighbours(cells, "h").where("h is not null")
    missing = F.lit(False)
    for v in _each("h"):
        missing = missing | v.isNull()
    return n.select("r", "c", missing.alias("boundary"))


def boundary_ring(labels: DataFrame) -> DataFrame:
    """Cells (r, c, label, h) next to a labelled region but outside of it: label, r, c, h."""
    n = neighbours(labels, "label", "h").where("h is not null")
    others = F.filter(F.array_distinct(F.array(*_each("label"))), lambda x: x.isNotNull() & (F.col("label").isNull() | (x != F.col("label"))))
    return n.select(F.explode(others).alias("label"), "r", "c", "h")


def mask_edge(mask: DataFrame) -> DataFrame:
    """Cells of a mask (r, c) with fewer than four neighbours in it along rows and columns."""
    n = neighbours(mask.select("r", "c", F.lit(1).alias("m")), "m")
    inner = sum((F.coalesce(F.col(f"m_{k}"), F.lit(0)) for k, (dr, dc) in enumerate(STEPS) if not (dr and dc)), F.lit(0))
    return n.where(inner < 4).select("r", "c")


def raise_to_window(cells: DataFrame) -> DataFrame:
    """Interior cells raised to the largest value around them."""
    n = neighbours(cells, "h").where("h is not null")
    full = F.lit(True)
    for v in _each("h"):
        full = full & v.isNotNull()
    return n.select("r", "c", F.when(full, F.greatest("h", *_each("h"))).otherwise(F.col("h")).alias("h"))


def gaussian(cells: DataFrame, sigma: float = 5.0, truncate: float = 4.0) -> DataFrame:
    """Gaussian filter of a full raster, one axis after the other, mirrored at the border; null counts as 0.

    Each pass sends a value to the cells in reach and sums by cell; sums within a row (or column) combine on the map side.
    """
    reach = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-reach, reach + 1)]
    weights = [w / sum(raw) for w in raw]
    size = cells.agg(F.max("r").alias("_nr"), F.max("c").alias("_nc"))
    taps = F.array(*(F.struct(F.lit(i - reach).alias("d"), F.lit(w).alias("w")) for i, w in enumerate(weights)))

    def one(df: DataFrame, axis: str, last: str) -> DataFrame:
        # Mirroring repeats with twice the length; a cell may be reached from both sides.
        n = F.col(last) + 1
        sent = df.crossJoin(F.broadcast(size)).select("r", "c", "h", last, F.explode(taps).alias("t"))
        images = F.array(F.col(axis) - F.col("t.d"), -F.col(axis) - 1 - F.col("t.d"), 2 * n - 1 - F.col(axis) - F.col("t.d"))
        sent = sent.withColumn("at", F.explode(images)).where(F.col("at").between(0, F.col(last)))
        other = "c" if axis == "r" else "r"
        return sent.groupBy(F.col("at").alias(axis), other).agg(F.sum(F.col("h") * F.col("t.w")).alias("h")).select("r", "c", "h")

    return one(one(cells.select("r", "c", F.coalesce("h", F.lit(0.0)).alias("h")), "r", "_nr"), "c", "_nc")


def steepest_exit(labels: DataFrame) -> DataFrame:
    """For each region (r, c, label, h): the member and direction of the steepest way out to a cell outside of it."""
    n = neighbours(labels, "label", "h").where("label is not null")
    ways = F.array(*(F.when(~F.col(f"label_{k}").eqNullSafe(F.col("label")) & F.col(f"h_{k}").isNotNull(), F.struct(((F.col("h") - F.col(f"h_{k}")) / FACTORS[k]).alias("slope"), (-F.col("r")).alias("nr"), (-F.col("c")).alias("nc"), F.lit(-k).alias("nk"))) for k in range(8)))
    best = n.select("label", F.array_max(ways).alias("w")).groupBy("label").agg(F.max("w").alias("w")).where("w is not null")
    return best.select("label", (-F.col("w.nr")).alias("r"), (-F.col("w.nc")).alias("c"), _code(-F.col("w.nk")).alias("dir"), "w.slope")


def pit_exits(basins: DataFrame) -> DataFrame:
    """Where basins (r, c, label, f) are left over their filled surface: label, r, c, dir.

    Of the cells with a neighbour outside, the lowest by f (then first in scan order), towards its first such neighbour.
    Cells without a label are outside; a basin that has nothing around it is left out.
    """
    n = neighbours(basins.select("r", "c", "label", "f"), "label", "f").where("label is not null and f is not null")
    out = F.array_compact(F.array(*(F.when(F.col(f"f_{k}").isNotNull() & ~F.col(f"label_{k}").eqNullSafe(F.col("label")), F.lit(k)) for k in range(8))))
    best = n.withColumn("k", F.get(out, F.lit(0))).where("k is not null").groupBy("label").agg(F.min(F.struct("f", "r", "c", "k")).alias("m"))
    return best.select("label", F.col("m.r").alias("r"), F.col("m.c").alias("c"), _code(F.col("m.k")).alias("dir"))


def lowest_resolved(cells: DataFrame) -> DataFrame:
    """For cells without a direction (r, c, h, dir): towards the lowest neighbour that has one, the last of equal ones."""
    n = neighbours(cells, "h", "dir").where("dir is null and h is not null")
    ways = F.array(*(F.when(F.col(f"dir_{k}").isNotNull(), F.struct(F.col(f"h_{k}").alias("h"), F.lit(-k).alias("nk"))) for k in range(8)))
    return n.select("r", "c", F.array_min(ways).alias("w")).select("r", "c", F.when(F.col("w").isNotNull(), _code(-F.col("w.nk"))).alias("dir"))


def resample_nearest(cells: DataFrame, factor: int) -> DataFrame:
    """Every factor-th cell, from the middle of its block."""
    half = factor // 2
    return cells.where((F.col("r") % factor == half) & (F.col("c") % factor == half)).select(((F.col("r") - half) / factor).cast("int").alias("r"), ((F.col("c") - half) / factor).cast("int").alias("c"), "h")


def preview_size(nrows: int, ncols: int, most: int = 1024) -> tuple[int, int]:
    """Rows and columns of a preview whose longer side has at most so many cells; small rasters are enlarged."""
    scale = min(most / ncols, most / nrows)
    return max(1, int(nrows * scale)), max(1, int(ncols * scale))


def preview(cells: DataFrame, nrows: int, ncols: int, rows: int, cols: int) -> DataFrame:
    """A raster of nrows by ncols cells (r, c, h) as one of rows by cols: r, c, h.

    Bilinear: a cell's weight falls linearly with the distance of its centre from the new cell's, to 0 at the width of a
    new cell (of an old one, where the raster is enlarged). Null cells have no weight; a new cell without any is left out.
    Each old cell is sent to the few new cells that see it, and sums combine before the exchange, so that no more than the
    preview of each partition is shuffled.
    """

    def weights(axis: str, n: int, out: int) -> Column:
        step = n / out
        reach, at = max(step, 1.0), F.col(axis) + 0.5
        first, last = F.ceil((at - reach) / step - 0.5), F.floor((at + reach) / step - 0.5)
        near = F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit(out - 1)))
        near = F.transform(near, lambda i: F.struct(i.alias("i"), (1 - F.abs(at - (i + 0.5) * step) / reach).alias("w")))
        return F.filter(near, lambda x: x["w"] > 0)

    sent = cells.where("h is not null").select("h", "c", F.explode(weights("r", nrows, rows)).alias("y")).select("h", "y", F.explode(weights("c", ncols, cols)).alias("x"))
    w = F.col("y.w") * F.col("x.w")
    sums = sent.groupBy(F.col("y.i").alias("r"), F.col("x.i").alias("c")).agg(F.sum(w * F.col("h")).alias("s"), F.sum(w).alias("w"))
    return sums.select("r", "c", (F.col("s") / F.col("w")).alias("h"))


def resample_bilinear(cells: DataFrame, up: int) -> DataFrame:
    """A grid up times as fine, between cell corners: weighted means of the four cells around."""
    n = neighbours(cells, "h").where("h is not null")
    e, se, s = (F.coalesce(F.col(f"h_{k}"), F.col("h")) for k in (0, 1, 2))
    se = F.coalesce(F.col("h_1"), F.col("h_0"), F.col("h_2"), F.col("h"))
    fine = n.select("r", "c", "h", e.alias("e"), s.alias("s"), se.alias("se"), F.explode(F.sequence(F.lit(0), F.lit(up * up - 1))).alias("i"))
    y, x = F.floor(F.col("i") / up) / up, (F.col("i") % up) / up
    h = (F.col("h") * (1 - x) + F.col("e") * x) * (1 - y) + (F.col("s") * (1 - x) + F.col("se") * x) * y
    return fine.select((F.col("r") * up + F.floor(F.col("i") / up)).alias("r"), (F.col("c") * up + F.col("i") % up).alias("c"), h.alias("h"))
