"""Regions of a raster as outlines, dissolved groups and points, and the water at dams made level."""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .flow import accumulate, cycle_regions
from .grid import STEPS, neighbours


def outlines(regions: DataFrame, ncols: int) -> DataFrame:
    """Rings around regions (label, r, c): label, ring, step, x, y; x and y are corners of cells, from 0.

    The inside is on the right hand (rows grow downwards), so a ring's signed area is positive around a region and negative
    around a hole. Cells that only touch at a corner get rings of their own. A ring is a cycle of edges, found by pointer
    doubling; step 0 is its edge of the smallest number.
    """
    n = neighbours(regions, "label")
    sides = []
    # Side d of a cell (top, right, bottom, left) leads from one corner to the next, clockwise.
    for d, (k, r, c) in enumerate(((6, 0, 0), (0, 0, 1), (2, 1, 1), (4, 1, 0))):
        open_ = ~F.col(f"label_{k}").eqNullSafe(F.col("label"))
        sides.append(F.when(open_, F.struct(F.lit(d).alias("d"), (F.col("c") + c).cast("long").alias("x"), (F.col("r") + r).cast("long").alias("y"))))
    return _traced(n.select("label", F.explode(F.array_compact(F.array(*sides))).alias("e")).select("label", "e.*"), ncols)


def _traced(e: DataFrame, ncols: int) -> DataFrame:
    """Rings of edges (label, d, x, y) of unit length: label, ring, step, x, y, d."""
    edge = lambda d, x, y: (y * (ncols + 1) + x) * 4 + d
    # Two regions may share an edge, in opposite directions: the number tells them apart.
    e = materialize(e.withColumn("id", edge(F.col("d"), F.col("x"), F.col("y"))), "outline")
    dx, dy = F.when(F.col("d") == 0, 1).when(F.col("d") == 2, -1).otherwise(0), F.when(F.col("d") == 1, 1).when(F.col("d") == 3, -1).otherwise(0)
    to = e.select("label", "id", "d", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    ahead = e.select("label", "x", "y", F.col("d").alias("nd"), F.col("id").alias("nid"))
    # To the right first, then straight on, then to the left.
    turn = F.pmod(F.col("d") + 1 - F.col("nd"), F.lit(4))
    flow = materialize(to.join(ahead, ["label", "x", "y"]).groupBy("id").agg(F.min_by("nid", turn).alias("next_id")), "outline")
    ring = materialize(cycle_regions(flow).withColumnRenamed("label", "ring"), "outline")
    open_ring = flow.join(ring, "id").select("id", F.when(F.col("next_id") != F.col("ring"), F.col("next_id")).alias("next_id"))
    return e.join(ring, "id").join(accumulate(open_ring), "id").select("label", "ring", F.col("acc").alias("step"), "x", "y", "d")


def signed_area(x: str = "x", y: str = "y", d: str = "d") -> Column:
    """Sum it over the edges of a ring for the area inside, in cells: only edges along columns count."""
    return F.when(F.col(d) == 1, F.col(x)).when(F.col(d) == 3, -F.col(x)).otherwise(0)


def dissolve_outlines(edges: DataFrame, groups: DataFrame, ncols: int) -> DataFrame:
    """Rings around the union of polygons: label, ring, step, x, y, d, the label being the group's.

    edges is label, d, x, y as of outlines, groups is label, group. Polygons of a group may share edges but not overlap; an
    edge that two of them share goes in both directions and cancels. Labels without a group are left out.
    """
    back = F.col("d") > 1
    # The same place for both directions: its left or upper end, and whether it runs along a row.
    x, y = F.col("x") - F.when(F.col("d") == 2, 1).otherwise(0), F.col("y") - F.when(F.col("d") == 3, 1).otherwise(0)
    own = edges.join(groups.select("label", "group"), "label").select("group", x.alias("px"), y.alias("py"), (F.col("d") % 2).alias("o"), F.when(back, -1).otherwise(1).alias("way"))
    left = own.groupBy("group", "px", "py", "o").agg(F.sum("way").alias("way")).where("way != 0")
    d = (F.col("o") + F.when(F.col("way") < 0, 2).otherwise(0)).cast("int")
    x, y = F.col("px") + F.when(d == 2, 1).otherwise(0), F.col("py") + F.when(d == 3, 1).otherwise(0)
    return _traced(left.select(F.col("group").alias("label"), d.alias("d"), x.alias("x"), y.alias("y")), ncols)


def shells(rings: DataFrame) -> DataFrame:
    """Polygons of rings (label, ring, x, y, d): label, ring, shell, area, first_x, first_y.

    Rings of positive area are shells, their own. A hole belongs to the smallest shell of its label around it: the one that a
    line to the right from the cell below its first upper edge crosses an odd number of times. That line meets only edges
    of its own row, which is what they are joined by. first is the cell below the first upper edge, for shells their first cell in scan order.
    """
    own = materialize(rings.groupBy("label", "ring").agg(F.sum(signed_area()).alias("area"), F.min(F.when(F.col("d") == 0, F.struct("y", "x"))).alias("m")), "shells")
    own = own.select("label", "ring", "area", F.col("m.x").alias("first_x"), F.col("m.y").alias("first_y"))
    row = F.col("y") - F.when(F.col("d") == 3, 1).otherwise(0)
    sides = rings.where("d = 1 or d = 3").join(own.where("area > 0").select("label", "ring", F.col("area").alias("around")), ["label", "ring"]).select("label", F.col("ring").alias("shell"), "around", row.alias("first_y"), "x")
    met = own.where("area < 0").join(sides, ["label", "first_y"]).where(F.col("x") > F.col("first_x"))
    inside = met.groupBy("label", "ring", "shell", "around").agg(F.count("*").alias("n")).where("n % 2 = 1")
    held = inside.groupBy("label", "ring").agg(F.min_by("shell", F.struct("around", "shell")).alias("shell"))
    return own.join(held, ["label", "ring"], "left").select("label", "ring", F.coalesce("shell", F.when(F.col("area") > 0, F.col("ring"))).alias("shell"), "area", "first_x", "first_y")


def dissolve(cells: DataFrame, group: str, cell_km2: float) -> DataFrame:
    """Cells (group, id) as one region a group: distinct cells and their area."""
    return cells.select(group, "id").distinct().groupBy(group).agg(F.count("*").alias("cells"), F.round(F.count("*") * cell_km2, 9).alias("area_km2"))


def points(cells: DataFrame, west: float, north: float, size: float) -> DataFrame:
    """Cells (r, c) as points at their centres: r, c, lon, lat."""
    return cells.withColumn("lon", F.round((F.col("c") + 0.5) * size + west, 9)).withColumn("lat", F.round(F.lit(north) - (F.col("r") + 0.5) * size, 9))


def point_raster(cells: DataFrame, pts: DataFrame, west: float, north: float, size: float) -> DataFrame:
    """The number of points (lon, lat) in each cell (r, c): r, c, points."""
    at = pts.groupBy(F.floor((F.lit(north) - F.col("lat")) / size).alias("r"), F.floor((F.col("lon") - west) / size).alias("c")).agg(F.count("*").alias("points"))
    return cells.select("r", "c").join(at, ["r", "c"], "left").select("r", "c", F.coalesce("points", F.lit(0)).alias("points"))


def _dams_of_tile(tile: tuple, dams: pd.DataFrame, cells: pd.DataFrame, reach: int, edge: int) -> pd.DataFrame:
    """What the dams (n, r, c) around a tile do to its own water, in their order, by kind.

    0: the lowest height h that dam n finds as given; 1: dam n finds what dam p has left; 2: the last dam n at cell (p, c).
    """
    # The water (r, c, h) as a grid with a free cell around the windows of the dams.
    high = edge + 4 * reach + 2
    r0, c0 = tile[0] * edge - 2 * reach - 1, tile[1] * edge - 2 * reach - 1
    h, last = np.full(high * high, np.nan), np.zeros(high * high, np.int64)
    h[(cells["r"].to_numpy() - r0) * high + cells["c"].to_numpy() - c0] = cells["h"]
    wet = ~np.isnan(h).reshape(high, high)
    own = np.zeros((high, high), bool)
    own[2 * reach + 1 : 2 * reach + 1 + edge, 2 * reach + 1 : 2 * reach + 1 + edge] = True
    own, side = own.ravel(), 2 * reach + 3
    off, low, found = [dr * side + dc for dr, dc in STEPS], [], []
    dams = dams.sort_values("n")
    for n, r, c in zip(dams["n"].tolist(), (dams["r"] - r0 - reach).tolist(), (dams["c"] - c0 - reach).tolist()):
        window = np.zeros((side, side), bool)
        window[1:-1, 1:-1] = wet[r : r + side - 2, c : c + side - 2]
        at = (reach + 1) * side + reach + 2
        if window.flat[at]:
            left, body = bytearray(window.tobytes()), [at]
            left[at] = 0
            for x in body:
                for k in off:
                    if left[x + k]:
                        left[x + k] = 0
                        body.append(x + k)
            y, x = np.divmod(np.array(body), side)
        else:
            y, x = np.nonzero(window)
        place = (y + r - 1) * high + x + c - 1
        place = place[own[place]]
        if len(place):
            was = last[place]
            given = place[was == 0]
            if len(given):
                low.append((n, h[given].min()))
            found.extend((n, p) for p in np.unique(was[was > 0]).tolist())
            last[place] = n
    at = np.flatnonzero(last)
    none = np.full(len(at), np.nan)
    frames = [
        pd.DataFrame({"kind": 0, "n": [n for n, _ in low], "p": 0, "c": 0, "h": [v for _, v in low]}),
        pd.DataFrame({"kind": 1, "n": [n for n, _ in found], "p": [p for _, p in found], "c": 0, "h": np.nan}),
        pd.DataFrame({"kind": 2, "n": last[at], "p": at // high + r0, "c": at % high + c0, "h": none}),
    ]
    return pd.concat([f for f in frames if len(f)] or frames[:1], ignore_index=True)


def _levels_of_dams(batches):
    """The level that each dam leaves, of rows (kind, n, p, h) in the order of n: the least of what it finds."""
    name, level = array("q"), array("d")
    for t in batches:
        # The last dam may go on from the batch before.
        begun = max(len(name) - 1, 0)
        for kind, n, p, h in zip(t["kind"].tolist(), t["n"].tolist(), t["p"].tolist(), t["h"].tolist()):
            if not name or name[-1] != n:
                name.append(n)
                level.append(math.inf)
            found = level[bisect_left(name, p)] if kind else h
            if found < level[-1]:
                level[-1] = found
        yield pd.DataFrame({"n": name[begun:], "level": level[begun:]})


def flatten_dams(cells: DataFrame, water: DataFrame, dams: DataFrame, reach: int = 20, edge: int = 256) -> DataFrame:
    """Heights (r, c, h) with the water (r, c) at each dam (dam, r, c) made level at its lowest cell, dams in their order.

    A dam levels the water of its window of 2 * reach + 1 cells a side that holds the cell east of it (all of it, if none
    does), and sees what dams before it have changed. Which cells it changes does not depend on heights, so a tile finds
    for itself which dam was last at each cell before another one. A dam then leaves the least of the heights that it finds
    as given and of the levels that the dams found before it have left. This pass over dams in their order is sequential
    and one task's; it holds two numbers a dam, and reads at most one row a dam, tile and dam before it. A group is a tile
    with the cells of 2 * reach around it and the dams of reach around it. Null heights and places, and dams without water
    in their window, change nothing; dams of one number come by their places.
    """
    d = dams.select("dam", F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c")).dropna()
    d = d.select(F.row_number().over(Window.orderBy("dam", "r", "c")).cast("long").alias("n"), "r", "c")
    tiles = lambda x, wide: F.explode(F.sequence(F.floor((F.col(x) - wide) / edge), F.floor((F.col(x) + wide) / edge)))
    near = materialize(d.withColumn("tr", tiles("r", reach)).withColumn("tc", tiles("c", reach)), "dams")
    wet = cells.where("h is not null and not isnan(h)").select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("h").cast("double").alias("h"))
    wet = wet.join(water.select("r", "c").distinct(), ["r", "c"], "left_semi").withColumn("tr", tiles("r", 2 * reach)).withColumn("tc", tiles("c", 2 * reach))
    wet = wet.join(near.select("tr", "tc").distinct(), ["tr", "tc"], "left_semi")
    done = near.groupBy("tr", "tc").cogroup(wet.groupBy("tr", "tc")).applyInPandas(lambda k, a, b: _dams_of_tile(k, a, b, reach, edge), "kind int, n long, p long, c long, h double")
    done = materialize(done, "dams")
    found = done.where("kind < 2").select("kind", "n", "p", "h").repartition(1).sortWithinPartitions("n", "kind")
    level = found.mapInPandas(_levels_of_dams, "n long, level double").groupBy("n").agg(F.min("level").alias("new"))
    new = done.where("kind = 2").select("n", F.col("p").alias("r"), "c").join(level, "n").select("r", "c", "new")
    return cells.select("r", "c", "h").join(new, ["r", "c"], "left").select("r", "c", F.coalesce("new", "h").alias("h"))
