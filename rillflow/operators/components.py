"""Connected components of masks, runs along raster edges, and what grows from them."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, FractionalType, LongType, StructField, StructType

from ..storage import materialize
from .grid import STEPS, cell_id, neighbours

#: Cells along a tile's side, and edges between parts of tiles up to which one task joins them.
EDGE, EDGES = 256, 1_000_000


def adjacency(mask: DataFrame, ncols: int, eight: bool = True) -> DataFrame:
    """Edges (a, b), a < b, between neighbouring cells of a mask (r, c)."""
    n = neighbours(mask.select("r", "c", cell_id(ncols).alias("id")), "id")
    near = F.array(*(F.col(f"id_{k}") for k, (dr, dc) in enumerate(STEPS) if eight or not (dr and dc)))
    return n.select(F.col("id").alias("a"), F.explode(near).alias("b")).where("a < b")


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label: the smallest id that edges (a, b) reach. Labels hook onto smaller ones and jump along themselves."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")), "edges")
    labels = materialize(vertices.select("id", F.col("id").alias("label")), "labels")
    while True:
        far = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("far"))
        hooked = labels.join(far, "id", "left").select("id", F.col("label").alias("old"), F.least("label", "far").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("label").alias("up"))
        new = materialize(hooked.join(jump, "next").select("id", F.least("next", "up").alias("label"), "old"), "labels")
        labels = new.select("id", "label")
        if new.where("label != old").isEmpty():
            return labels


def _merged(up: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of each place's component: up names places by themselves, a and b are joined."""
    while True:
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            return up
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while ((further := up[up]) != up).any():
            up = further


def _label_tile(t: pd.DataFrame, value: str | None, ncols: int, eight: bool, edge: int) -> pd.DataFrame:
    """The cells of a tile with their part: the smallest id that they reach inside the tile."""
    r, c = t["r"].to_numpy().astype(np.int64), t["c"].to_numpy().astype(np.int64)
    r0, c0, wide = r[0] // edge * edge, c[0] // edge * edge, edge + 2
    at = (r - r0 + 1) * wide + c - c0 + 1
    here = np.full(wide * wide, -1)
    # Equal values have equal numbers, not a number being one of them.
    here[at] = 0 if value is None else pd.factorize(t[value])[0] + 1
    joined = []
    for dr, dc in STEPS[:4]:
        if eight or not (dr and dc):
            joined.append((on := at[here[at] == here[at + dr * wide + dc]], on + dr * wide + dc))
    up = _merged(np.arange(wide * wide), *(np.concatenate(x) for x in zip(*joined)))
    root = up[at]
    return t.drop(columns=["tr", "tc"]).assign(part=(r0 + root // wide - 1) * ncols + c0 + root % wide - 1)


def _label_parts(batches) -> Iterator[pd.DataFrame]:
    """id, label of all edges (a, b) together."""
    pairs = np.concatenate([np.empty((0, 2), np.int64), *(t[["a", "b"]].to_numpy() for t in batches)])
    names, at = np.unique(pairs, return_inverse=True)
    at = at.reshape(-1, 2)
    yield pd.DataFrame({"id": names, "label": names[_merged(np.arange(len(names)), at[:, 0], at[:, 1])]})


def labelled(own: DataFrame, ncols: int, value: str | None = None, eight: bool = True, edge: int = EDGE, most: int = EDGES) -> DataFrame:
    """own (r, c, any others and, if named, a value, none of them null) with id and label: the smallest id of the component of equal values.

    A tile finds its own parts; those of tiles side by side are joined by a graph that has no more vertices than the tiles'
    rims have cells: in one task for so many edges at most, by rounds of joins beyond.
    """
    tiled = own.withColumn("tr", F.floor(F.col("r") / edge)).withColumn("tc", F.floor(F.col("c") / edge))
    schema = StructType([*own.schema.fields, StructField("part", LongType())])
    parts = tiled.groupBy("tr", "tc").applyInPandas(lambda t: _label_tile(t, value, ncols, eight, edge), schema)
    # What is not a number comes out of a task as null.
    parts = parts.select(*(F.coalesce(f.name, F.lit(math.nan).cast(f.dataType)).alias(f.name) if isinstance(f.dataType, FractionalType) and not isinstance(f.dataType, DecimalType) else f.name for f in schema))
    parts = materialize(parts, "parts")
    rim = [F.pmod(F.col(k), F.lit(edge)).isin(0, edge - 1) for k in ("r", "c")]
    n = neighbours(parts.where(rim[0] | rim[1]), *([value] if value else []), "part")
    same = [F.when(F.col(f"{value}_{k}") == F.col(value) if value else F.lit(True), F.col(f"part_{k}")) for k, (dr, dc) in enumerate(STEPS) if eight or not (dr and dc)]
    edges = n.select(F.col("part").alias("a"), F.explode(F.array_compact(F.array(*same))).alias("b")).where("a < b").distinct()
    edges = materialize(edges, "parts")
    if edges.count() <= most:
        far = edges.repartition(1).mapInPandas(_label_parts, "id long, label long")
    else:
        far = components(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), edges)
    out = parts.join(far.withColumnRenamed("id", "part"), "part", "left")
    return out.select(*own.columns, cell_id(ncols).alias("id"), F.coalesce("label", "part").alias("label"))


def label_mask(mask: DataFrame, ncols: int, eight: bool = True, edge: int = EDGE, most: int = EDGES) -> DataFrame:
    """Components of a mask (r, c): id, label."""
    return labelled(mask.select("r", "c"), ncols, None, eight, edge, most).select("id", "label")


def label_equal(cells: DataFrame, value: str, ncols: int, edge: int = EDGE, most: int = EDGES) -> DataFrame:
    """Components of neighbouring cells (r, c, value) with the same value: r, c, value, label. Null values have none."""
    own = cells.where(F.col(value).isNotNull()).select("r", "c", value)
    return labelled(own, ncols, value, True, edge, most).select("r", "c", value, "label")


def spanning_parts(regions: DataFrame, ncols: int) -> DataFrame:
    """The cells of regions (r, c, label) in that connected part which reaches all four sides of its region's box: r, c, label.

    A region has one such part at most, since a way from left to right meets each one from top to bottom. A region without
    one, as several small pieces apart, is left out; so are cells without a label.
    """
    own = regions.select("r", "c", F.col("label").alias("region"))
    parts = materialize(label_equal(own, "region", ncols), "parts")
    sides = [F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1")]
    box = materialize(parts.groupBy("region", "label").agg(*sides), "boxes")
    whole = box.groupBy("region").agg(F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.min("c0").alias("c0"), F.max("c1").alias("c1"))
    spans = box.join(whole, ["region", "r0", "r1", "c0", "c1"]).select("region", "label")
    return parts.join(spans, ["region", "label"], "left_semi").select("r", "c", F.col("region").alias("label"))


def edge_runs(cells: DataFrame, condition, least: int) -> DataFrame:
    """Runs of at least so many cells along each raster edge that meet a condition: edge, first, last, n."""
    size = cells.agg(F.max("r").alias("nr"), F.max("c").alias("nc"))
    c = cells.crossJoin(F.broadcast(size)).where("r = 0 or c = 0 or r = nr or c = nc")
    sides = F.array(*(F.when(cond, F.struct(F.lit(name).alias("edge"), F.col(at).alias("at"))) for cond, name, at in ((F.col("r") == 0, "top", "c"), (F.col("r") == F.col("nr"), "bottom", "c"), (F.col("c") == 0, "left", "r"), (F.col("c") == F.col("nc"), "right", "r"))))
    on = c.withColumn("e", F.explode(F.array_compact(sides))).where(condition).select("e.edge", "e.at")
    runs = on.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy("edge").orderBy("at")))
    return runs.groupBy("edge", "run").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def ocean(cells: DataFrame, ncols: int, condition, least: int) -> DataFrame:
    """Cells (id) that meet a condition and connect, by rows and columns, to a long run of it along a raster edge."""
    mask = cells.where(condition)
    labels = label_mask(mask, ncols, eight=False)
    size = cells.agg(F.max("r").alias("nr"), F.max("c").alias("nc"))
    runs = edge_runs(cells, condition, least)
    on = mask.crossJoin(F.broadcast(size))
    at = F.when(F.col("edge").isin("top", "bottom"), F.col("c")).otherwise(F.col("r"))
    side = ((F.col("edge") == "top") & (F.col("r") == 0)) | ((F.col("edge") == "bottom") & (F.col("r") == F.col("nr"))) | ((F.col("edge") == "left") & (F.col("c") == 0)) | ((F.col("edge") == "right") & (F.col("c") == F.col("nc")))
    seeds = on.where("r = 0 or c = 0 or r = nr or c = nc").join(F.broadcast(runs), side & at.between(F.col("first"), F.col("last"))).select(cell_id(ncols).alias("id")).distinct()
    return labels.join(labels.join(seeds, "id").select("label").distinct(), "label", "left_semi").select("id")
