"""The flow graph: every cell points to one other at most (id, next_id); next_id is null at terminals.

Walks are done by pointer doubling: after k rounds a pointer has followed 2 ** k edges, so the longest path sets the number
of rounds, logarithmically. Each round writes its state, which bounds the lineage.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .components import label_mask
from .grid import cell_id, column_step, row_step, with_tile


def _rounds(flow: DataFrame) -> int:
    return max(1, math.ceil(math.log2(max(flow.count(), 2)))) + 1


def accumulate(flow: DataFrame, weight: str | None = None) -> DataFrame:
    """id, acc: the cells (or the weight) upstream of each cell, itself excluded. A cycle raises an error."""
    own = F.col(weight) if weight else F.lit(1).cast("long")
    state = materialize(flow.select("id", F.col("next_id").alias("p"), own.alias("s")), "acc")
    for _ in range(_rounds(flow)):
        if state.where("p is not null").isEmpty():
            out = state.select("id", "s")
            return out.join(flow.select("id", own.alias("w")), "id").select("id", (F.col("s") - F.col("w")).alias("acc")) if weight else out.select("id", (F.col("s") - 1).alias("acc"))
        add = state.where("p is not null").groupBy(F.col("p").alias("id")).agg(F.sum("s").alias("more"))
        jump = state.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        moved = state.join(add, "id", "left").select("id", "p", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s"))
        state = materialize(moved.join(jump, "p", "left").select("id", F.col("pp").alias("p"), "s"), "acc")
    raise ValueError("the flow graph has a cycle")


def terminal_labels(flow: DataFrame, outlets: DataFrame | None = None) -> DataFrame:
    """id, label: the terminal that each cell reaches; with outlets (id), the first outlet or terminal on the way.

    Cells that reach a cycle have a null label.
    """
    if outlets is not None:
        flow = flow.join(outlets.select("id", F.lit(True).alias("stop")), "id", "left").select("id", F.when(F.col("stop").isNull(), F.col("next_id")).alias("next_id"))
    state = materialize(flow.select("id", F.coalesce("next_id", "id").alias("label"), F.col("next_id").isNull().alias("done")), "labels")
    for _ in range(_rounds(flow)):
        if state.where("not done").isEmpty():
            break
        up = state.select(F.col("id").alias("label"), F.col("label").alias("up"), F.col("done").alias("ends"))
        state = materialize(state.join(up, "label").select("id", F.col("up").alias("label"), "ends").withColumnRenamed("ends", "done"), "labels")
    return state.select("id", F.when(F.col("done"), F.col("label")).alias("label"))


def initial_basins(directions: DataFrame, ncols: int) -> DataFrame:
    """r, c, label of a raster of directions (r, c, dir): the terminals that touch are one, labelled by their smallest id, and
    a cell has the label of the terminals that it flows to.

    Cells that leave the raster, or flow into a null direction or a cycle, have a null label; null directions have no row.
    """
    own = materialize(directions.where("dir is not null").select(cell_id(ncols).alias("id"), F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), F.col("dir").cast("int").alias("dir")), "initial")
    to = own.where("dir > 0").select("id", (F.col("r") + row_step("dir")).alias("r"), (F.col("c") + column_step("dir")).alias("c"))
    inside = to.join(own.select("r", "c", F.col("id").alias("next_id")), ["r", "c"]).select("id", "next_id")
    ends = terminal_labels(materialize(own.select("id").join(inside, "id", "left"), "initial"))
    touching = materialize(label_mask(own.where("dir = 0"), ncols).select(F.col("id").alias("label"), F.col("label").alias("basin")), "initial")
    found = ends.join(touching, "label", "left").select("id", "basin")
    return own.join(found, "id").select("r", "c", F.col("basin").alias("label"))


def cycle_cells(flow: DataFrame) -> DataFrame:
    """id, on_cycle of all cells that never reach a terminal: those in a cycle, and those above one."""
    state = materialize(flow.select("id", F.col("next_id").alias("p")).where("p is not null"), "cycle")
    for _ in range(_rounds(flow)):
        if state.isEmpty():
            break
        jump = state.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        state = materialize(state.join(jump, "p").select("id", F.col("pp").alias("p")), "cycle")
    on = state.select(F.col("p").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    return state.select("id").join(on, "id", "left").select("id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def cycle_regions(flow: DataFrame) -> DataFrame:
    """id, label of all cells that never reach a terminal; label is the smallest id of the cycle that they end in."""
    bad = materialize(cycle_cells(flow).select("id"), "cycle")
    state = materialize(flow.join(bad, "id").select("id", F.col("next_id").alias("p"), F.col("next_id").alias("least")), "cycle")
    for _ in range(_rounds(bad)):
        # After enough rounds p lies on the cycle, and least is the smallest id passed; only that of cycle cells is used.
        jump = state.select(F.col("id").alias("p"), F.col("p").alias("pp"), F.col("least").alias("other"))
        state = materialize(state.join(jump, "p").select("id", F.col("pp").alias("p"), F.least("least", "other").alias("least")), "cycle")
    return state.select("id", "p").join(state.select(F.col("id").alias("p"), F.col("least").alias("label")), "p").select("id", "label")


def break_cycles(flow: DataFrame, h: DataFrame) -> DataFrame:
    """flow in which every cycle ends at its lowest cell (then smallest id); h: id, h. The result has no cycle.

    Cycles are told apart by the smallest id on them, found by doubling over cycle cells alone.
    """
    bad = materialize(cycle_cells(flow).where("on_cycle").select("id"), "cycle")
    if bad.isEmpty():
        return flow
    ring = flow.join(bad, "id").select("id", F.col("next_id").alias("p"), F.col("id").alias("least"))
    state = materialize(ring, "cycle")
    for _ in range(_rounds(bad)):
        jump = state.select(F.col("id").alias("p"), F.col("p").alias("pp"), F.col("least").alias("other"))
        state = materialize(state.join(jump, "p").select("id", F.col("pp").alias("p"), F.least("least", "other").alias("least")), "cycle")
    ends = state.join(h, "id", "left").groupBy("least").agg(F.min_by("id", F.struct(F.coalesce("h", F.lit(float("inf"))), "id")).alias("id"))
    return flow.join(ends.select("id", F.lit(True).alias("cut")), "id", "left").select("id", F.when(F.col("cut").isNull(), F.col("next_id")).alias("next_id"))


def counterflow_pairs(flow: DataFrame) -> DataFrame:
    """Pairs of cells that point to each other: a < b."""
    pair = flow.where("next_id is not null").select(F.least("id", "next_id").alias("a"), F.greatest("id", "next_id").alias("b"), (F.col("id") < F.col("next_id")).alias("up"))
    return pair.groupBy("a", "b").agg(F.max("up").alias("x"), F.min("up").alias("y")).where("x and not y").select("a", "b")


def upstream(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """Transitive closure against the flow: edges (up_id, down_id), seeds (id) to (seed, id), the seed itself excluded.

    Where every id has one way down and none leads back, the seeds below each other are found by doubling and all else is
    labelled with the first seed on its way, in logarithmic rounds. Other edges are walked from the seeds: only pairs that
    were new in the last round are joined with the edges, each round is written once, and the rounds are the longest path.
    """
    edges = materialize(edges.select("up_id", "down_id").where("up_id != down_id").distinct(), "closure")
    front = materialize(seeds.select(F.col("id").alias("seed"), "id").distinct(), "closure")
    if edges.groupBy("up_id").count().where("count > 1").isEmpty():
        closed = _closed_forest(edges, front)
        if closed is not None:
            return closed
    fronts: list[DataFrame] = []
    while True:
        more = front.join(edges.select(F.col("down_id").alias("id"), F.col("up_id").alias("up")), "id").select("seed", F.col("up").alias("id")).where("seed != id").distinct()
        for f in fronts:
            more = more.join(f, ["seed", "id"], "left_anti")
        front = materialize(more, "closure")
        if front.isEmpty():
            break
        fronts.append(front)
        if len(fronts) == 8:
            fronts = [materialize(reduce(DataFrame.unionByName, fronts), "closure")]
    return reduce(DataFrame.unionByName, fronts) if fronts else front


def _closed_forest(edges: DataFrame, seeds: DataFrame) -> DataFrame | None:
    """upstream where every id has one way down; None if a way leads back."""
    ids = edges.select(F.col("up_id").alias("id"), F.col("down_id").alias("next_id"))
    ends = ids.select(F.col("next_id").alias("id")).distinct().join(ids, "id", "left_anti").withColumn("next_id", F.lit(None).cast(ids.schema["id"].dataType))
    flow = materialize(ids.unionByName(ends), "closure")
    if not cycle_cells(flow).isEmpty():
        return None
    own = seeds.select("id")
    first = materialize(terminal_labels(flow, own).join(own.select(F.col("id").alias("label")), "label", "left_semi"), "closure")
    # The next seed below each seed, and from there all seeds below it.
    jump = materialize(own.join(flow.where("next_id is not null"), "id").join(first.select(F.col("id").alias("next_id"), "label"), "next_id").select("id", F.col("label").alias("to")), "closure")
    pairs = jump
    while not jump.isEmpty():
        further = jump.join(pairs.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to"))
        pairs = materialize(pairs.unionByName(further), "closure")
        jump = materialize(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "closure")
    holds = pairs.select(F.col("to").alias("seed"), F.col("id").alias("label")).unionByName(own.select(F.col("id").alias("seed"), F.col("id").alias("label")))
    return holds.join(first, "label").select("seed", "id").where("seed != id")


def basins_at(flow: DataFrame, outlets: DataFrame) -> DataFrame:
    """outlet, id: all cells above each outlet (id) and the outlet itself; basins of outlets below others hold theirs.

    Cells are labelled with the first outlet on their way, in logarithmic rounds; which outlets lie below which is a
    closure over the outlets alone.
    """
    outlets = materialize(outlets.select("id").distinct(), "basins")
    first = materialize(terminal_labels(flow, outlets).join(outlets.select(F.col("id").alias("label")), "label", "left_semi"), "basins")
    below = confluence(flow, first, outlets).select(F.col("up_basin").alias("up_id"), F.col("down_basin").alias("down_id"))
    holds = upstream(below, outlets).unionByName(outlets.select(F.col("id").alias("seed"), "id"))
    return holds.select(F.col("seed").alias("outlet"), F.col("id").alias("label")).join(first, "label").select("outlet", "id")


def confluence(flow: DataFrame, labels: DataFrame, outlets: DataFrame) -> DataFrame:
    """Basins next to each other along the flow: up_basin drains into down_basin."""
    return outlets.join(flow, "id").where("next_id is not null").join(labels.select(F.col("id").alias("next_id"), F.col("label").alias("down_basin")), "next_id").select(F.col("id").alias("up_basin"), "down_basin")


def strahler(flow: DataFrame) -> DataFrame:
    """id, order: 1 at headwaters; below, the largest order above, one more where that occurs twice. 0 on cycles.

    A cell has more than order k where, at it or above it, two cells of order k or more meet. So each order is one count of
    the cells that flow into a cell and one accumulation along the flow, over what the order before has left: as many
    passes as there are orders, each logarithmic in the longest path.
    """
    ring = materialize(cycle_cells(flow).where("on_cycle").select("id"), "order")
    whole = flow.join(ring, "id", "left_anti")
    if not ring.isEmpty():
        whole = whole.join(ring.select(F.col("id").alias("next_id"), F.lit(True).alias("cut")), "next_id", "left").select("id", F.when(F.col("cut").isNull(), F.col("next_id")).alias("next_id"))
    left = materialize(whole.select("id", "next_id"), "order")
    passed = [left.select("id", F.lit(1).alias("order"))]
    while True:
        meet = left.where("next_id is not null").groupBy(F.col("next_id").alias("id")).agg((F.count("*") > 1).cast("long").alias("w")).where("w > 0")
        seeds = materialize(left.join(meet, "id", "left").select("id", "next_id", F.coalesce("w", F.lit(0).cast("long")).alias("w")), "order")
        if seeds.where("w > 0").isEmpty():
            break
        above = accumulate(seeds, "w")
        left = materialize(seeds.join(above, "id").where("acc + w > 0").select("id", "next_id"), "order")
        passed.append(left.select("id", F.lit(len(passed) + 1).alias("order")))
    out = ring.select("id", F.lit(0).alias("order"))
    for p in passed:
        out = out.unionByName(p)
    return out.groupBy("id").agg(F.max("order").alias("order"))


def stream_links(flow: DataFrame, orders: DataFrame) -> DataFrame:
    """Cells of each river link: link is the cell where it starts (a headwater or just below a confluence), step from 0."""
    above = flow.join(orders.select("id"), "id", "left_semi").where("next_id is not null").groupBy(F.col("next_id").alias("id")).agg(F.count("*").alias("n"))
    cells = flow.join(orders, "id").join(above, "id", "left").withColumn("start", F.coalesce("n", F.lit(0)) != 1)
    back = cells.where("next_id is not null").select(F.col("next_id").alias("id"), F.col("id").alias("prev"))
    state = cells.where("not start").join(back, "id").select("id", F.col("prev").alias("p"), F.lit(1).alias("step"))
    state = materialize(state.unionByName(cells.where("start").select("id", F.lit(None).cast("long").alias("p"), F.lit(0).alias("step"))), "links")
    label = materialize(state.select("id", F.coalesce("p", "id").alias("p"), "step", F.col("p").isNull().alias("done")), "links")
    for _ in range(_rounds(flow)):
        if label.where("not done").isEmpty():
            break
        up = label.select(F.col("id").alias("p"), F.col("p").alias("pp"), F.col("step").alias("more"), F.col("done").alias("ends"))
        label = materialize(label.join(up, "p").select("id", F.when(F.col("done"), F.col("p")).otherwise(F.col("pp")).alias("p"), (F.col("step") + F.when(F.col("done"), 0).otherwise(F.col("more"))).alias("step"), (F.col("done") | F.col("ends")).alias("done")), "links")
    return label.select("id", F.col("p").alias("link"), "step")


def link_basins(flow: DataFrame, streams: DataFrame) -> DataFrame:
    """id, link: the end of the first stream link on each cell's way; streams (id, next_id) are the cells of links.

    A link ends before a confluence, at a terminal, and where the streams end. Cells without one below are left out.
    """
    into = streams.where("next_id is not null").groupBy(F.col("next_id").alias("id")).agg(F.count("*").alias("n"))
    below = streams.select("id").join(into, "id", "left").select(F.col("id").alias("next_id"), F.coalesce("n", F.lit(0)).alias("n"))
    ends = materialize(streams.join(below, "next_id", "left").where("next_id is null or n is null or n > 1").select("id"), "links")
    return terminal_labels(flow, ends).join(ends.select(F.col("id").alias("label")), "label", "left_semi").select("id", F.col("label").alias("link"))


def river_lines(flow: DataFrame, orders: DataFrame) -> DataFrame:
    """Rivers as lines: line, order, step, id, own; orders (id, order) names the river cells.

    A line is all cells of one order one after the other. Two of an order that meet make a larger one, so a cell has one
    neighbour of its order above and one below at most, and the line, named by its first cell, does not depend on where
    one begins. After its own cells comes the one beyond, where the line flows into another or leaves the rivers (own is
    false). Cells on cycles that keep their order have no first cell and are left out.
    """
    known = materialize(flow.join(orders.select("id", "order"), "id"), "lines")
    below = orders.select(F.col("id").alias("next_id"), F.col("order").alias("below"))
    ahead = materialize(known.join(below, "next_id", "left").select("id", "order", "next_id", F.coalesce(F.col("below") == F.col("order"), F.lit(False)).alias("goes_on")), "lines")
    back = ahead.where("goes_on").select(F.col("next_id").alias("id"), F.col("id").alias("prev"))
    chain = materialize(ahead.select("id").join(back, "id", "left").select("id", F.col("prev").alias("next_id")), "lines")
    first = materialize(terminal_labels(chain).where("label is not null").withColumnRenamed("label", "line"), "lines")
    step = accumulate(ahead.join(first, "id", "left_semi").select("id", F.when(F.col("goes_on"), F.col("next_id")).alias("next_id")))
    own = materialize(ahead.join(first, "id").join(step.withColumnRenamed("acc", "step"), "id"), "lines")
    beyond = own.where("not goes_on and next_id is not null").select("line", "order", (F.col("step") + 1).alias("step"), F.col("next_id").alias("id"), F.lit(False).alias("own"))
    return own.select("line", "order", "step", "id", F.lit(True).alias("own")).unionByName(beyond)


def line_strings(lines: DataFrame, ncols: int, west: float, north: float, size: float) -> DataFrame:
    """river_lines as one row each: line, order, cells, points (centres x, y in order, the one beyond at the end); two at least."""
    x, y = west + (F.col("id") % ncols + 0.5) * size, north - (F.floor(F.col("id") / ncols) + 0.5) * size
    placed = lines.select("line", "order", "own", F.struct("step", x.alias("x"), y.alias("y")).alias("p"))
    points = F.transform(F.sort_array(F.collect_list("p")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return placed.groupBy("line", "order").agg(F.count_if("own").alias("cells"), points.alias("points")).where(F.size("points") > 1)


def reverse_cycles(flow: DataFrame, near: DataFrame) -> DataFrame:
    """flow (id, next_id) in which every cycle leaves its basin, by turning round as few cells as can be; near is id, k, to:
    the neighbours of cells, in order.

    All that ends in a cycle is a basin. A basin is left at the cell with the fewest steps to its cycle (then the smallest
    id, then the first neighbour) that has a neighbour in another one, and the way from there to the cycle is turned round.
    A basin must not be left for one that flows into it: basins that choose each other in a ring wait but for one of them,
    and choose again among those outside of what flows into them. So there are at most half as many in each round. A basin
    without a way out ends at the first cell of its cycle.
    """
    region = materialize(cycle_regions(flow).withColumnRenamed("label", "basin"), "reverse")
    if region.isEmpty():
        return flow
    ring = materialize(cycle_cells(flow).where("on_cycle").select("id"), "reverse")
    own = flow.join(region, "id")
    tree = materialize(own.join(ring.withColumn("on", F.lit(True)), "id", "left").select("id", "basin", F.when(F.col("on").isNull(), F.col("next_id")).alias("next_id")), "reverse")
    # Steps to the cycle, by doubling.
    state = materialize(tree.select("id", F.col("next_id").alias("p"), F.col("next_id").isNotNull().cast("long").alias("steps")), "reverse")
    for _ in range(_rounds(tree)):
        if state.where("p is not null").isEmpty():
            break
        jump = state.select(F.col("id").alias("p"), F.col("p").alias("pp"), F.col("steps").alias("more"))
        state = materialize(state.join(jump, "p", "left").select("id", F.col("pp").alias("p"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps")), "reverse")
    steps = state.select("id", "steps")
    # Ways out of basins; what ends in no cycle is basin -1.
    there = flow.select(F.col("id").alias("to")).join(region.select(F.col("id").alias("to"), F.col("basin").alias("other")), "to", "left").select("to", F.coalesce("other", F.lit(-1).cast("long")).alias("other"))
    ways = materialize(near.join(region, "id").join(steps, "id").join(there, "to").where("basin != other").select("basin", "other", F.struct("steps", "id", "k", "to").alias("way")), "reverse")
    ways = materialize(ways.groupBy("basin", "other").agg(F.min("way").alias("way")), "reverse")
    basins = region.select("basin").distinct()
    # What each basin flows into so far, in the end: itself, if it waits.
    end = materialize(basins.select("basin", F.col("basin").alias("end")).unionByName(flow.sparkSession.range(1).select(F.lit(-1).cast("long").alias("basin"), F.lit(-1).cast("long").alias("end"))), "reverse")
    chosen = []
    while True:
        wait = end.where("basin = end and basin >= 0").select("basin")
        to = end.select(F.col("basin").alias("other"), F.col("end").alias("into"))
        best = materialize(ways.join(wait, "basin", "left_semi").join(to, "other").where("into != basin").groupBy("basin").agg(F.min(F.struct("way", "into")).alias("m")), "reverse")
        if best.isEmpty():
            break
        goes = wait.join(best, "basin", "left").select(F.col("basin").alias("id"), F.col("m.into").alias("next_id"))
        goes = materialize(goes.unionByName(flow.sparkSession.range(1).select(F.lit(-1).cast("long").alias("id"), F.lit(None).cast("long").alias("next_id"))), "reverse")
        kept = materialize(break_cycles(goes, goes.select("id", F.lit(0.0).alias("h"))), "reverse")
        chosen.append(materialize(kept.where("next_id is not null").select(F.col("id").alias("basin")).join(best, "basin").select("basin", "m.way"), "reverse"))
        ends = terminal_labels(kept).select(F.col("id").alias("end"), F.col("label").alias("new"))
        end = materialize(end.join(ends, "end").select("basin", F.col("new").alias("end")), "reverse")
    out = materialize(reduce(DataFrame.unionByName, chosen).select("basin", F.col("way.id").alias("id"), F.col("way.to").alias("to"), F.col("way.steps").alias("steps")) if chosen else basins.select("basin", F.col("basin").alias("id"), F.lit(None).cast("long").alias("to"), F.lit(0).cast("long").alias("steps")).limit(0), "reverse")
    stays = basins.join(out, "basin", "left_anti").select(F.col("basin").alias("id"), F.lit(None).cast("long").alias("to"))
    # The way from the exit to the cycle: cells at 1, 2, 4 .. steps more in each round.
    path = out.select("id", F.lit(0).cast("long").alias("at"), F.col("id").alias("exit"), "steps")
    jump = materialize(tree.where("next_id is not null").select("id", F.col("next_id").alias("to")), "reverse")
    reach = 1
    while not path.where(F.col("steps") >= reach).isEmpty():
        further = path.where(F.col("at") + reach <= F.col("steps")).join(jump, "id").select(F.col("to").alias("id"), (F.col("at") + reach).alias("at"), "exit", "steps")
        path = materialize(path.unionByName(further), "reverse")
        jump = materialize(jump.join(jump.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "reverse")
        reach *= 2
    turned = path.join(path.select("exit", (F.col("at") + 1).alias("at"), F.col("id").alias("to")), ["exit", "at"]).select("id", "to")
    new = out.select("id", "to").unionByName(turned).unionByName(stays).withColumn("changed", F.lit(True))
    return flow.join(new, "id", "left").select("id", F.when(F.col("changed"), F.col("to")).otherwise(F.col("next_id")).alias("next_id"))


def river_mouths(flow: DataFrame, streams: DataFrame, valid: DataFrame) -> DataFrame:
    """Stream cells whose downstream cell has no value."""
    return streams.join(flow, "id").where("next_id is not null").join(valid.select(F.col("id").alias("next_id")), "next_id", "left_anti").select("id", "next_id")


def snap_outlets(flow: DataFrame, acc: DataFrame, stations: DataFrame, error: float = 0.2, steps: int = 200) -> DataFrame:
    """Stations (station, id, cells) moved downstream until the cells above fit: station, id, step; id -1 where none does.

    A walk stops when the accumulation is within the error of the wanted cells, and fails once it exceeds them, the flow
    ends or steps are used up. Accumulation grows along the flow, so a walk passes over all cells that are still too small:
    jumps of 2 ** k cells, longest first, take it to the last of them, and one step more to where it stops.
    """
    here = materialize(flow.join(acc, "id").select("id", "next_id", "acc"), "snap")
    jumps = [materialize(here.where("next_id is not null").select("id", F.col("next_id").alias("to")), "snap")]
    while 2 ** len(jumps) <= steps:
        last = jumps[-1]
        jumps.append(materialize(last.join(last.select(F.col("id").alias("to"), F.col("to").alias("far")), "to").select("id", F.col("far").alias("to")), "snap"))
    off = F.abs(F.col("acc") - F.col("cells")) / F.col("cells")
    small = (off > error) & (F.col("acc") <= F.col("cells"))
    walk = stations.join(here.select("id", "acc"), "id").select("station", "id", "cells", F.lit(0).alias("step"), "acc")
    for k in reversed(range(len(jumps))):
        there = jumps[k].join(here.select(F.col("id").alias("to"), F.col("acc").alias("acc_to")), "to")
        go = small & (F.col("step") + 2**k <= steps) & (F.abs(F.col("acc_to") - F.col("cells")) / F.col("cells") > error) & (F.col("acc_to") <= F.col("cells"))
        go = F.coalesce(go, F.lit(False))
        moved = walk.join(there, "id", "left")
        walk = materialize(moved.select("station", F.when(go, F.col("to")).otherwise(F.col("id")).alias("id"), "cells", (F.col("step") + F.when(go, 2**k).otherwise(0)).alias("step"), F.when(go, F.col("acc_to")).otherwise(F.col("acc")).alias("acc")), "snap")
    there = jumps[0].join(here.select(F.col("id").alias("to"), F.col("acc").alias("acc_to")), "to")
    go = small & F.col("to").isNotNull() & (F.col("step") < steps)
    end = walk.join(there, "id", "left").select("station", F.when(go, F.col("to")).otherwise(F.col("id")).alias("id"), "cells", (F.col("step") + F.when(go, 1).otherwise(0)).alias("step"), F.when(go, F.col("acc_to")).otherwise(F.col("acc")).alias("acc"))
    return end.select("station", F.when(off <= error, F.col("id")).otherwise(F.lit(-1).cast("long")).alias("id"), "step")


def snap_to_streams(flow: DataFrame, acc: DataFrame, streams: DataFrame, stations: DataFrame, error: float = 0.2, tries: int = 11) -> DataFrame:
    """The other rule: to the first stream cell below, then up along streams: station, id, fits.

    Stream cells above a tried cell go on a stack in direction order and the last one is tried next, until the cells above
    one (itself included) are within the error, the stack is empty or the tries are used up; id is the last cell tried. A
    station without a stream below tries the terminal that it reaches; one that reaches a cycle is left out.
    """
    at = materialize(terminal_labels(flow, streams).where("label is not null"), "snap")
    size = acc.select("id", (F.col("acc") + 1).alias("size"))
    ups = flow.where("next_id is not null").join(streams.select("id"), "id", "left_semi").groupBy(F.col("next_id").alias("id")).agg(F.collect_list("id").alias("ups"))
    around = materialize(size.join(ups, "id", "left"), "snap")
    walk = stations.join(at, "id").select("station", "cells", F.col("label").alias("id"), F.lit(None).cast("array<long>").alias("stack"), F.lit(False).alias("done"), F.lit(False).alias("fits"))
    walk = materialize(walk.withColumn("stack", F.array(F.col("id"))), "snap")
    for _ in range(tries):
        if walk.where("not done").isEmpty():
            break
        now = walk.withColumn("id", F.when(F.col("done"), F.col("id")).otherwise(F.element_at("stack", -1))).join(around, "id", "left")
        fits = F.col("fits") | (~F.col("done") & (F.abs(F.col("size") - F.col("cells")) / F.col("cells") <= error))
        rest = F.slice("stack", 1, F.size("stack") - 1)
        stack = F.when(F.col("done"), F.col("stack")).otherwise(F.concat(rest, F.transform(F.array_sort(F.transform(F.coalesce("ups", F.array().cast("array<long>")), lambda u: F.struct(_turn(u - F.col("id")).alias("k"), u.alias("u")))), lambda x: x["u"])))
        walk = materialize(now.select("station", "cells", "id", stack.alias("stack"), fits.alias("fits"), F.col("done").alias("was")).select("station", "cells", "id", "stack", (F.col("was") | F.col("fits") | (F.size("stack") == 0)).alias("done"), "fits"), "snap")
    return walk.select("station", "id", "fits")


def _turn(step: Column) -> Column:
    """A sort key of neighbours by the difference of ids: east, south-east, south .. north-east, at any raster width."""
    turn = F.when(step == 1, 0).when(step > 1, 1).when(step == -1, 2).otherwise(3)
    return F.struct(turn.alias("turn"), F.when(step > 1, -step).when(step < -1, step).otherwise(0).alias("at"))


def _tile_accumulation(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
    """Inside one tile: cells upstream within the tile, and the cell where each path leaves it."""
    ids, nxt, extra = t["id"].tolist(), t["next_id"].tolist(), t["extra"].tolist()
    index = {x: i for i, x in enumerate(ids)}
    to = [index.get(int(x), -1) if x == x and x is not None else -1 for x in nxt]
    waits = [0] * len(ids)
    for j in to:
        if j >= 0:
            waits[j] += 1
    total, order = [1 + e for e in extra], [i for i, w in enumerate(waits) if not w]
    for i in order:
        if to[i] >= 0:
            total[to[i]] += total[i]
            waits[to[i]] -= 1
            if not waits[to[i]]:
                order.append(to[i])
    if len(order) < len(ids):
        raise ValueError("the flow graph has a cycle")
    exits = [0] * len(ids)
    for i in reversed(order):
        exits[i] = i if to[i] < 0 else exits[to[i]]
    return pd.DataFrame({"id": ids, "exit": [ids[e] for e in exits], "total": total})


def accumulate_tiled(flow: DataFrame, ncols: int, edge: int) -> DataFrame:
    """As accumulate, in two levels: inside tiles, then over the graph of tile crossings, then inside tiles again.

    Only cells where flow enters or leaves a tile take part in the doubling: about 4 / edge of all.
    """
    cells = with_tile(flow.withColumn("r", F.floor(F.col("id") / ncols)).withColumn("c", F.col("id") % ncols), edge)
    cells = cells.select("id", "next_id", "tile_r", "tile_c")
    run = lambda df: df.groupBy("tile_r", "tile_c").applyInPandas(_tile_accumulation, "id long, exit long, total long")
    local = materialize(run(cells.withColumn("extra", F.lit(0).cast("long"))), "tile")
    there = cells.select(F.col("id").alias("next_id"), F.col("tile_r").alias("tr"), F.col("tile_c").alias("tc"))
    crossing = cells.where("next_id is not null").join(there, "next_id").where("tile_r != tr or tile_c != tc").select("id", "next_id")
    out = crossing.join(local.select("id", "total"), "id")
    # An entry passes on what enters it to the cell where its path leaves the tile, and so to the next entry.
    entries = materialize(out.groupBy(F.col("next_id").alias("id")).agg(F.sum("total").alias("w")), "tile")
    leave = entries.join(local.select("id", "exit"), "id").join(crossing.select(F.col("id").alias("exit"), F.col("next_id").alias("to")), "exit", "left")
    graph = materialize(leave.select("id", F.col("to").alias("next_id"), "w"), "tile")
    above = accumulate(graph, "w")
    extra = graph.select("id", "w").join(above, "id").select("id", (F.col("w") + F.col("acc")).alias("extra"))
    final = run(cells.join(extra, "id", "left").withColumn("extra", F.coalesce("extra", F.lit(0).cast("long"))))
    return final.select("id", (F.col("total") - 1).alias("acc"))
