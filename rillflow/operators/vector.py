"""Points, extents and distances."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

EARTH_M = 6371008.8


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def zone_area(lat: Column, cell: float) -> Column:
    """Square metres of a cell of so many degrees whose lower edge is at a latitude, on a sphere."""
    return (EARTH_M**2) * math.radians(cell) * (F.sin(F.radians(lat + cell)) - F.sin(F.radians(lat)))


def nearest(points: DataFrame, sites: DataFrame, first: float, longest: float) -> DataFrame:
    """The nearest site (site, x, y) of each point (point, x, y): point, site, d2 (squared distance), ties to the smaller site.

    Buckets as wide as the search radius make it an equi-join: a point meets the sites of its own bucket and the eight
    around it. Points with nothing within the radius try again at twice the radius; longest bounds all distances.
    """
    radius, left, found = first, points.select("point", "x", "y"), []
    around = F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long"))
    while True:
        bx, by = F.floor(F.col("x") / radius), F.floor(F.col("y") / radius)
        s = sites.select("site", F.col("x").alias("sx"), F.col("y").alias("sy")).withColumn("bx", F.floor(F.col("sx") / radius)).withColumn("by", F.floor(F.col("sy") / radius))
        p = left.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumn("bx", bx + F.col("i")).withColumn("by", by + F.col("j"))
        d2 = (F.col("x") - F.col("sx")) * (F.col("x") - F.col("sx")) + (F.col("y") - F.col("sy")) * (F.col("y") - F.col("sy"))
        near = p.join(s, ["bx", "by"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius)
        near = materialize(near.groupBy("point").agg(F.min(F.struct("d2", "site")).alias("m")).select("point", "m.site", "m.d2"), "near")
        found.append(near)
        left = materialize(left.join(near, "point", "left_anti"), "near")
        if radius >= longest or left.isEmpty():
            break
        radius *= 2
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def nearest_lines(points: DataFrame, segments: DataFrame, width: float) -> DataFrame:
    """The nearest line of each point (point, x, y), at any distance: point, line, d2, x, y; ties to the smaller line.

    segments is line, x0, y0, x1, y1, a line being any number of them; a segment may be a point. x and y are the place on the
    line that is nearest (of a line's several, the smallest). Points of equal numbers are one if their places are, null places take no part.
    Points of one place are looked for once, and of equal segments only that of the smallest line.

    Segments are owned by the squares of side width that the middles of their pieces lie in, and squares by those twice as
    wide, up to one that holds all. From there each point goes down the squares, and keeps those that may hold what is
    nearer than something in another surely is; only in the smallest squares are segments met. The rounds are logarithmic in
    the extent. width should leave few segments in a square.
    """
    s = segments.select("line", *(F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1"))).dropna()
    s = s.groupBy("x0", "y0", "x1", "y1").agg(F.min("line").alias("line"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pieces = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / width), F.lit(1)).cast("long")
    s = s.withColumn("k", pieces).withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    t = (F.col("i") - 0.5) / F.col("k")
    s = materialize(s.withColumn("bx", F.floor((F.col("x0") + t * dx) / width)).withColumn("by", F.floor((F.col("y0") + t * dy) / width)).drop("i", "k"), "nearest")
    e = s.agg(*(f(k).alias(f"{n}{k}") for n, f in (("lo", F.min), ("hi", F.max)) for k in ("bx", "by"))).first()
    p = points.select("point", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"]).distinct()
    if e["lobx"] is None:
        return p.select("point", F.lit(None).cast(s.schema["line"].dataType).alias("line"), *(F.lit(0.0).alias(k) for k in ("d2", "x", "y"))).limit(0)
    top = max(e["hibx"] - e["lobx"], e["hiby"] - e["loby"]).bit_length()
    # Squares count from the corner of all; the square of a level is found by dropping bits.
    s = s.withColumn("bx", F.col("bx") - e["lobx"]).withColumn("by", F.col("by") - e["loby"])
    squares = materialize(s.select("bx", "by").distinct(), "nearest")
    places = p.select("x", "y").distinct()
    held = places.withColumn("bx", F.lit(0).cast("long")).withColumn("by", F.lit(0).cast("long"))
    for level in range(top - 1, -1, -1):
        side = width * (1 << level)
        own = squares.select(F.shiftright("bx", level).alias("cx"), F.shiftright("by", level).alias("cy")).distinct()
        own = own.select("cx", "cy", F.shiftright("cx", 1).alias("bx"), F.shiftright("cy", 1).alias("by"))
        w, n = F.col("cx") * side + e["lobx"] * width, F.col("cy") * side + e["loby"] * width
        out = lambda x, lo: F.greatest(lo - x, x - lo - side, F.lit(0.0))
        far = lambda x, lo: F.greatest(F.abs(x - lo), F.abs(x - lo - side))
        near, most = (F.sqrt(g(F.col("x"), w) * g(F.col("x"), w) + g(F.col("y"), n) * g(F.col("y"), n)) for g in (out, far))
        met = held.join(own, ["bx", "by"]).select("x", "y", "cx", "cy", near.alias("near"), most.alias("most"))
        # A piece reaches half its length beyond the square of its middle; rounding is given a little more.
        sure = F.min("most").over(Window.partitionBy("x", "y"))
        met = met.withColumn("sure", sure).where(F.col("near") <= F.col("sure") * (1 + 1e-9) + width * 0.5000001)
        held = materialize(met.select("x", "y", F.col("cx").alias("bx"), F.col("cy").alias("by")), "nearest")
    g2 = dx * dx + dy * dy
    t = F.when(g2 == 0, 0.0).otherwise(F.least(F.greatest(((F.col("x") - F.col("x0")) * dx + (F.col("y") - F.col("y0")) * dy) / g2, F.lit(0.0)), F.lit(1.0)))
    found = held.join(s, ["bx", "by"]).select("x", "y", "line", (F.col("x0") + t * dx).alias("px"), (F.col("y0") + t * dy).alias("py"))
    d2 = (F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))
    best = found.groupBy("x", "y").agg(F.min(F.struct(d2.alias("d2"), "line", "px", "py")).alias("m"))
    return p.join(best, ["x", "y"]).select("point", "m.line", "m.d2", F.col("m.px").alias("x"), F.col("m.py").alias("y"))


def _drop_contained(batches, most: int = 4096):
    """Extents in the order of bucket and falling area without those that lie in one of the bucket's first ones."""
    at, held = None, np.empty((0, 4))
    for t in batches:
        # One holds another if none of its four is larger.
        box, keep = t[["x0", "x1", "y0", "y1"]].to_numpy() * (1, -1, 1, -1), np.ones(len(t), bool)
        key = list(zip(t["bx"].tolist(), t["by"].tolist()))
        cuts = [0, *(i for i in range(1, len(key)) if key[i] != key[i - 1]), len(key)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b and key[a] != at:
                at, held = key[a], np.empty((0, 4))
            for i in range(a, b, 256):
                rows = np.arange(i, min(i + 256, b))
                rows = rows[~(held[None] <= box[rows, None]).all(2).any(1)]
                inside = (box[rows][None] <= box[rows][:, None]).all(2)
                np.fill_diagonal(inside, False)
                rows = rows[~inside.any(1)]
                held = np.concatenate([held, box[rows]])[:most]
                keep[i : min(i + 256, b)] = False
                keep[rows] = True
        yield t[keep]


def not_contained(extents: DataFrame, bucket: float) -> DataFrame:
    """Extents (id, x0, x1, y0, y1) that lie in no larger one; of equal ones the smaller id stays. An id is that of one extent.

    Equal extents are one from the start. Of the others of a bucket (by their corners), a task keeps some of the largest and
    drops what lies in these. What is left is sent to the buckets that it covers, wider ones for larger extents; a small
    one looks for larger ones in the bucket of its corner, of each width. Extents with a null hold none and lie in none.
    """
    corners = ("x0", "x1", "y0", "y1")
    known = F.lit(True)
    for k in ("id", *corners):
        known = known & F.col(k).isNotNull()
    one = extents.where(known).groupBy("id", *corners).agg(F.count("*").alias("n")).groupBy(*corners).agg(F.min(F.struct("id", "n")).alias("m"))
    at = lambda k, wide: F.floor(F.col(k) / wide)
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    one = one.select("m.id", "m.n", *corners, at("x0", bucket).alias("bx"), at("y0", bucket).alias("by"), F.greatest(F.ceil(F.log2(side / bucket)), F.lit(0)).cast("int").alias("level"))
    one = materialize(one.fillna(0, "level"), "extents")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    dealt = one.repartitionByRange("bx", "by", "x0", "y0").sortWithinPartitions("bx", "by", area.desc())
    left = materialize(dealt.mapInPandas(_drop_contained, one.schema), "extents").drop("bx", "by")
    levels = sorted(r["level"] for r in left.select("level").distinct().collect())
    wide = F.pow(F.lit(2.0), F.col("level")) * bucket
    big = left.select(*(F.col(k).alias(f"b{k}") for k in corners), "level", F.explode(F.sequence(at("x0", wide), at("x1", wide))).alias("bx"), at("y0", wide).alias("lo"), at("y1", wide).alias("hi"))
    big = big.withColumn("by", F.explode(F.sequence("lo", "hi"))).drop("lo", "hi")
    small = left.withColumn("level", F.explode(F.array(*(F.lit(k) for k in levels)).cast("array<int>"))).withColumn("bx", at("x0", wide)).withColumn("by", at("y0", wide))
    inside = (F.col("bx0") <= F.col("x0")) & (F.col("bx1") >= F.col("x1")) & (F.col("by0") <= F.col("y0")) & (F.col("by1") >= F.col("y1"))
    same = (F.col("bx0") == F.col("x0")) & (F.col("bx1") == F.col("x1")) & (F.col("by0") == F.col("y0")) & (F.col("by1") == F.col("y1"))
    gone = small.join(big, ["level", "bx", "by"]).where(inside & ~same).select("id").distinct()
    out = left.join(gone, "id", "left_anti").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return out.select("id", *corners).unionByName(extents.where(~known).select("id", *corners))


def lines(cells: DataFrame, group: str, order: str) -> DataFrame:
    """Cells (group, order, x, y) as one line for each group: its points in order, at least two."""
    points = F.transform(F.sort_array(F.collect_list(F.struct(order, "x", "y"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return cells.groupBy(group).agg(points.alias("points")).where(F.size("points") > 1)
