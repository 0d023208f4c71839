"""Filling and re-routing: work that is sequential inside one depression or tile, and independent between them."""

from __future__ import annotations

import heapq
import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import label_mask, labelled, spanning_parts
from .flood import EDGE, INFINITY, around, filled_levels, flood_directions, route_floods, with_rims  # noqa: F401
from .flow import break_cycles, cycle_regions, terminal_labels
from .focal import boundary_ring, d8, flow_edges
from .grid import STEPS, cell_id, neighbours
from .zonal import water_bodies


def level_directions(cells: set[tuple[int, int]], start: tuple[int, int]) -> dict[tuple[int, int], int]:
    """Direction codes along a breadth-first tree from start."""
    seen, todo, out = {start}, deque([start]), {}
    while todo:
        cell = todo.popleft()
        for k, n in around(cell):
            if n in cells and n not in seen:
                seen.add(n)
                out[n] = 1 << (k + 4) % 8
                todo.append(n)
    return out


def _route_level(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
    cells = list(zip(g["r"].tolist(), g["c"].tolist()))
    start = (int(g["start_r"].iloc[0]), int(g["start_c"].iloc[0]))
    found, keep = level_directions({*cells}, start), dict(zip(cells, g["dir"].tolist()))
    return pd.DataFrame({"label": key[0], "r": g["r"], "c": g["c"], "dir": [keep[x] if x == start else found.get(x, -1) for x in cells]})


def route_depressions(cells: DataFrame, flat: bool = False) -> DataFrame:
    """Directions inside each depression: cells is label, r, c, h, dir, start_r, start_c; returns label, r, c, dir.

    The start cell (an outlet, or the lowest cell of an endorheic depression) keeps its direction; cells that it does not
    reach get -1. Floods run by tile (route_floods), whatever a depression's size; with flat, a depression is one group.
    """
    if not flat:
        return route_floods(cells)
    rows = cells.select("label", "r", "c", F.col("h").cast("double").alias("h"), F.coalesce(F.col("dir").cast("int"), F.lit(0)).alias("dir"), "start_r", "start_c")
    return rows.groupBy("label").applyInPandas(_route_level, "label long, r int, c int, dir int")


def _fill_tile(t: pd.DataFrame, rise: float, edge: int) -> pd.DataFrame:
    """Lower bound water levels of one tile's cells to max(h, least level around + rise), by a flood from what is known."""
    r, c, own = t["r"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64), t["own"].to_numpy().astype(bool)
    r0, c0, wide = int(t["tr"].iloc[0]) * edge - 2, int(t["tc"].iloc[0]) * edge - 2, edge + 4
    at, size = (r - r0) * wide + c - c0, wide * wide
    ground, level, mine = np.full(size, np.nan), np.full(size, INFINITY), np.zeros(size, bool)
    ground[at], level[at], mine[at] = t["h"].to_numpy(float), t["f"].to_numpy(float), own
    known = at[level[at] < INFINITY]
    steps, news = [dr * wide + dc for dr, dc in STEPS], np.zeros(size, bool)
    for k in steps:
        news[known] |= mine[known + k] & (np.maximum(ground[known + k], level[known] + rise) < level[known + k])
    heap = [(f, x) for f, x in zip(level[news].tolist(), np.flatnonzero(news).tolist())]
    heapq.heapify(heap)
    g, f_, free = ground.tolist(), level.tolist(), bytearray(mine.tobytes())
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        f, x = pop(heap)
        if f > f_[x]:
            continue
        f += rise
        for k in steps:
            n = x + k
            if free[n]:
                to = g[n]
                if to < f:
                    to = f
                if to < f_[n]:
                    f_[n] = to
                    push(heap, (to, n))
    now, here = np.array(f_), at[own]
    return pd.DataFrame({"r": r[own], "c": c[own], "h": ground[here], "f": now[here], "new": now[here] < level[here]})


def fill(cells: DataFrame, edge: int | None = None, rise: float = 0.0, start: str | None = None) -> DataFrame:
    """Filled heights: r, c, h, f, f being the least over paths to the border (or a null cell) of the highest cell on it.

    With a rise, each step away from the border adds it to the level, so that no flat is left. With start, a boolean
    column, water leaves at the cells where it is true instead of the border; cells cut off from them have f = infinity.

    Without a rise the levels come from the spill graph (filled_levels). With one, tiles are flooded each by itself from the
    levels known around them, until no level changes: the number of rounds is that of tiles along the longest spill path,
    and tiles without news rest. A tile and the ring around it are one task.
    """
    if not rise and not start:
        return filled_levels(cells, edge or EDGE)
    edge = edge or EDGE
    if start:
        n, rim = cells.where("h is not null"), F.coalesce(F.col(start), F.lit(False))
    else:
        n, rim = neighbours(cells.select("r", "c", "h"), "h").where("h is not null"), F.lit(False)
        for k in range(8):
            rim = rim | F.col(f"h_{k}").isNull()
    state = materialize(n.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("h").cast("double").alias("h"), F.when(rim, F.col("h").cast("double")).otherwise(F.lit(INFINITY)).alias("f"), F.lit(True).alias("new")), "fill")
    # What is not a number comes out of a task as null.
    sure = [F.coalesce(k, F.lit(math.nan)).alias(k) for k in ("h", "f")]
    while True:
        sent = with_rims(state, edge, "h", "f", "new")
        active = materialize(sent.where("new").select("tr", "tc").distinct(), "fill")
        done = sent.join(active, ["tr", "tc"], "left_semi").groupBy("tr", "tc").applyInPandas(lambda t: _fill_tile(t, rise, edge), "r long, c long, h double, f double, new boolean")
        tiled = state.withColumn("tr", F.floor(F.col("r") / edge)).withColumn("tc", F.floor(F.col("c") / edge))
        rest = tiled.join(active, ["tr", "tc"], "left_anti").select("r", "c", "h", "f", F.lit(False).alias("new"))
        state = materialize(rest.unionByName(done.select("r", "c", *sure, "new")), "fill")
        if state.where("new").isEmpty():
            return state.select("r", "c", "h", "f")


def sinks(filled: DataFrame, ncols: int, max_depth: float | None = None) -> DataFrame:
    """Depressions of a filled surface (r, c, h, f): r, c, label, depth, level; the components of cells under water.

    With max_depth, those that are deeper anywhere are left out: they stay unfilled.
    """
    found = labelled(filled.where("f > h").select("r", "c", "h", "f"), ncols).select("r", "c", "label", (F.col("f") - F.col("h")).alias("depth"), F.col("f").alias("level"))
    if max_depth is None:
        return found
    found = materialize(found, "sinks")
    return found.join(found.groupBy("label").agg(F.max("depth").alias("most")).where(F.col("most") <= max_depth).select("label"), "label", "left_semi").select("r", "c", "label", "depth", "level")


def fill_shallow(cells: DataFrame, ncols: int, max_depth: float, edge: int | None = None) -> DataFrame:
    """r, c, h, f as fill, but depressions deeper than max_depth keep their ground."""
    filled = materialize(fill(cells, edge), "shallow")
    wet = materialize(labelled(filled.where("f > h"), ncols), "shallow")
    deep = wet.groupBy("label").agg(F.max(F.col("f") - F.col("h")).alias("most"))
    kept = wet.join(deep, "label").select("r", "c", "h", F.when(F.col("most") <= max_depth, F.col("f")).otherwise(F.col("h")).alias("f"))
    return filled.where("not f > h").select("r", "c", "h", F.col("h").alias("f")).unionByName(kept)


def correct_depressions(cells: DataFrame, geometry: DataFrame) -> DataFrame:
    """Directions r, c, dir of a raster (r, c, h, dir, label; label null outside), depressions re-routed by their class.

    geometry holds label, out_r, out_c, sink_type. Class 1 is routed level by level from its outlet, the others by the
    flood; the outlet, a cell outside of the depression, keeps its direction. A depression without an outlet stays.
    """
    c = cells.select("label", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "h", F.col("dir").cast("int").alias("dir"))
    g = materialize(geometry.where("out_r is not null").select("label", F.col("out_r").cast("int").alias("start_r"), F.col("out_c").cast("int").alias("start_c"), "sink_type"), "class")
    out = c.drop("label").join(g.select("label", "start_r", "start_c", "sink_type", F.col("start_r").alias("r"), F.col("start_c").alias("c")), ["r", "c"])
    own = materialize(c.join(g, "label").unionByName(out), "class")
    routed = route_depressions(own.where("sink_type = 1"), True).unionByName(route_depressions(own.where("sink_type != 1")))
    return c.join(routed.withColumnRenamed("dir", "new"), ["label", "r", "c"], "left").select("r", "c", F.when(F.col("new") >= 0, F.col("new")).otherwise(F.col("dir")).alias("dir"))


def route_endorheic(cells: DataFrame, occurrence: DataFrame, ncols: int, least_mean: float = 50, least_cells: int = 1111, rise: float = 1e-5) -> DataFrame:
    """Directions label, r, c, dir inside endorheic depressions (label, r, c, h, dir) that do not touch each other.

    Of a depression in several pieces, the one that reaches all sides of the depression's box is routed (spanning_parts);
    the other cells get a null direction.

    A depression with one water body at most (components of the occurrence, r, c, occ, that are large enough) is flooded
    from its lowest cell. With more, the basins that a body touches are flooded together from their lowest cell, the body
    of the largest label winning shared cells; what no body touches drains over its lowest passes into what is routed so,
    on a surface filled from there. Lowest cells become terminals (0).
    """
    given = materialize(cells.select("label", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "h", cell_id(ncols).alias("id"), "dir"), "endo")
    own = materialize(given.join(spanning_parts(given, ncols), ["label", "r", "c"], "left_semi"), "endo")
    inside = flow_edges(own, ncols)
    inside = inside.join(own.select(F.col("id").alias("next_id"), F.lit(True).alias("in")), "next_id", "left").select("id", F.when(F.col("in"), F.col("next_id")).alias("next_id"))
    # Level cells may point to each other: such basins end at their lowest cell.
    basin = materialize(terminal_labels(break_cycles(materialize(inside, "endo"), own.select("id", "h"))).withColumnRenamed("label", "basin"), "endo")
    wet = own.join(occurrence.where("occ is not null"), ["r", "c"], "left_semi").select("label", "r", "c", "id")
    body = materialize(wet.join(label_mask(wet, ncols).withColumnRenamed("label", "body"), "id"), "endo")
    kept = water_bodies(body.select(F.col("body").alias("label"), "r", "c"), occurrence, least_mean, least_cells).select(F.col("label").alias("body"))
    kept = materialize(body.join(kept, "body", "left_semi"), "endo")
    many = materialize(kept.groupBy("label").agg(F.count_distinct("body").alias("k")).where("k > 1").select("label"), "endo")
    touched = kept.join(many, "label", "left_semi").join(basin, "id").select("body", "basin").distinct()
    whole = own.join(many, "label", "left_anti").select(F.col("label").alias("part"), "label", "r", "c", "h")
    parts = own.join(basin, "id").join(touched, "basin").select(F.col("body").alias("part"), "label", "r", "c", "h")
    # A body's number may equal that of a one-body depression: they are never of one depression, so the pair is the group.
    group = materialize(whole.unionByName(parts).withColumn("group", F.xxhash64("label", "part")), "endo")
    low = group.groupBy("group").agg(F.min(F.struct("h", "r", "c")).alias("m")).select("group", F.col("m.r").alias("start_r"), F.col("m.c").alias("start_c"))
    routed = route_depressions(group.join(low, "group").select(F.col("group").alias("label"), "r", "c", "h", F.lit(0).alias("dir"), "start_r", "start_c")).withColumnRenamed("label", "group")
    won = routed.join(group.select("group", "label", "part", "r", "c"), ["group", "r", "c"]).where("dir >= 0").groupBy("label", "r", "c").agg(F.max_by("dir", "part").alias("new"))
    first = materialize(own.join(won, ["label", "r", "c"], "left").select("label", "r", "c", "h", "id", "new"), "endo")
    rest = first.join(many, "label", "left_semi")
    open_ = rest.where("new is null")
    every = given.select("label", "r", "c")
    if open_.isEmpty():
        return every.join(first.select("label", "r", "c", F.col("new").alias("dir")), ["label", "r", "c"], "left")
    near = neighbours(first.select("r", "c", F.when(F.col("new").isNotNull(), F.col("h")).alias("g")), "g")
    exits = F.array(*(F.when(F.col(f"g_{k}").isNotNull(), F.struct(F.col(f"g_{k}").alias("g"), F.lit(-k).alias("nk"))) for k in range(8)))
    way = near.select("r", "c", F.array_min(exits).alias("way"))
    gate = open_.join(way, ["r", "c"], "left").select("label", "r", "c", "h", "way", F.col("way").isNotNull().alias("start"))
    gate = materialize(gate, "endo")
    level = materialize(fill(gate.select("r", "c", "h", "start"), rise=rise, start="start"), "endo")
    down = d8(level.select("r", "c", F.col("f").alias("h"))).select("r", "c", F.col("dir").cast("int").alias("down"))
    code = F.element_at(F.array(*(F.lit(1 << k) for k in range(8))), -F.col("way.nk") + 1)
    later = gate.join(down, ["r", "c"]).select("label", "r", "c", F.when(F.col("start"), code).otherwise(F.col("down")).alias("later"))
    routed = first.join(later, ["label", "r", "c"], "left").select("label", "r", "c", F.coalesce("new", "later", F.lit(0)).alias("dir"))
    return every.join(routed, ["label", "r", "c"], "left")


def reroute_cycles(cells: DataFrame, ncols: int, most: int = 50) -> DataFrame:
    """Directions r, c, dir of a raster (r, c, h, dir) in which cells that end in a cycle flow out of their region instead.

    All cells above a cycle are one region; it is flooded from the lowest cell beside it (the first in scan order of equal
    ones). Regions that then flow into each other are joined in the next round, so there are fewer each time. A region
    without a cell beside it ends at its lowest cell.
    """
    state = materialize(cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "h", F.col("dir").cast("int").alias("dir")), "reroute")
    for _ in range(most):
        found = materialize(cycle_regions(materialize(flow_edges(state, ncols), "reroute")), "reroute")
        if found.isEmpty():
            return state.select("r", "c", "dir")
        labelled = materialize(state.withColumn("id", cell_id(ncols)).join(found, "id", "left"), "reroute")
        ring = boundary_ring(labelled).groupBy("label").agg(F.min(F.struct("h", "r", "c")).alias("o"))
        low = labelled.where("label is not null").groupBy("label").agg(F.min(F.struct("h", "r", "c")).alias("m"))
        root = materialize(low.join(ring, "label", "left").select("label", F.coalesce("o", "m").alias("s")).select("label", F.col("s.r").alias("start_r"), F.col("s.c").alias("start_c")), "reroute")
        own = labelled.where("label is not null").select("label", "r", "c", "h", F.lit(0).alias("dir"))
        beside = labelled.join(root.select(F.col("label").alias("to"), F.col("start_r").alias("r"), F.col("start_c").alias("c")), ["r", "c"]).where("not label <=> to").select(F.col("to").alias("label"), "r", "c", "h", "dir")
        new = route_depressions(own.unionByName(beside).join(root, "label")).withColumnRenamed("dir", "new")
        state = materialize(labelled.join(new, ["label", "r", "c"], "left").select("r", "c", "h", F.when(F.col("new") >= 0, F.col("new")).otherwise(F.col("dir")).alias("dir")), "reroute")
    raise ValueError("cycles are left after the last round")


def turn_counterflows(directions: DataFrame, ncols: int) -> DataFrame:
    """r, c, dir: of two cells that point to each other, the first in scan order turns.

    It turns to its first neighbour (east, then clockwise) with a direction that is not the opposite of its own; where
    there is none it stays.
    """
    n = neighbours(directions.select("r", "c", F.col("dir").cast("int").alias("dir")), "dir")
    opposite = lambda d: F.when(d >= 16, (d / 16).cast("int")).otherwise(d * 16)
    meets, turn = F.lit(False), F.col("dir")
    for k in reversed(range(8)):
        faces = (F.col("dir") == 1 << k) & (F.col(f"dir_{k}") == 1 << (k + 4) % 8)
        # Neighbours 0 to 3 come later in scan order.
        meets = meets | (faces if k < 4 else F.lit(False))
        turn = F.when(F.col(f"dir_{k}").isNotNull() & (F.col(f"dir_{k}") != opposite(F.col("dir"))), 1 << k).otherwise(turn)
    return n.select("r", "c", F.when(F.coalesce(meets, F.lit(False)), turn).otherwise(F.col("dir")).alias("dir"))


def refill_regions(cells: DataFrame, region: DataFrame, rise: float = 1e-5) -> DataFrame:
    """r, c, dir of a raster (r, c, h, dir) with the cells of each region (label, r, c) re-directed over its filled crop.

    A crop is the region's box and a cell more on each side; it is filled by itself, from its own border, so water leaves a
    region wherever the ground around lets it. Crops may overlap, regions must not. For the filling, crops are laid one
    below the other, with a free row between, as one raster.
    """
    region = materialize(region.select("label", "r", "c"), "refill")
    box = region.groupBy("label").agg((F.min("r") - 1).alias("r0"), (F.max("r") + 1).alias("r1"), (F.min("c") - 1).alias("c0"), (F.max("c") + 1).alias("c1"))
    box = materialize(box, "refill")
    high = box.agg(F.max(F.col("r1") - F.col("r0")).alias("high")).first()["high"]
    if high is None:
        return cells.select("r", "c", F.col("dir").cast("int").alias("dir"))
    crop = box.withColumn("r", F.explode(F.sequence("r0", "r1"))).withColumn("c", F.explode(F.sequence("c0", "c1")))
    at = (F.col("label") * (high + 2) + F.col("r") - F.col("r0")).alias("at")
    crop = materialize(crop.join(cells.select("r", "c", "h"), ["r", "c"]).select("label", at, "r", "c", "h"), "refill")
    # Crops lie far apart, so small tiles leave less of their grids empty.
    level = materialize(fill(crop.select(F.col("at").alias("r"), "c", "h"), 64, rise).select("r", "c", F.col("f").alias("h")), "refill")
    new = d8(level).select(F.col("r").alias("at"), "c", F.col("dir").cast("int").alias("new"))
    new = crop.join(new, ["at", "c"]).join(region, ["label", "r", "c"]).select("r", "c", "new")
    return cells.join(new, ["r", "c"], "left").select("r", "c", F.coalesce("new", F.col("dir").cast("int")).alias("dir"))
