"""Areas of polygons of two layers over each other.

A polygon is the signed sum of the strips below its edges, so the area that two polygons share is the signed sum, over pairs
of edges, of the area below both: an integral of the lower of two lines over the columns that they have in common. No
polygon is cut or gathered; rings may be of any shape and have holes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _below_both(p: Column, q: Column, e: list[Column], f: list[Column]) -> Column:
    """The integral from p to q of the lower of two edges, each given as its heights at p and q."""
    dp, dq = e[0] - f[0], e[1] - f[1]
    t = dp / (dp - dq)
    low_p, low_q = F.least(e[0], f[0]), F.least(e[1], f[1])
    cross = e[0] + t * (e[1] - e[0])
    return (q - p) / 2 * F.when(dp * dq >= 0, low_p + low_q).otherwise((low_p + cross) * t + (cross + low_q) * (1 - t))


def _polygons(edges: DataFrame) -> DataFrame:
    """Boxes and signed areas: poly, x0, x1, y0, y1, area (positive for rings that go clockwise, y up)."""
    lo, hi = lambda k: F.min(F.least(f"{k}0", f"{k}1")), lambda k: F.max(F.greatest(f"{k}0", f"{k}1"))
    area = F.sum((F.col("x1") - F.col("x0")) * (F.col("y0") + F.col("y1")) / 2)
    return edges.groupBy("poly").agg(lo("x").alias("bx0"), hi("x").alias("bx1"), lo("y").alias("by0"), hi("y").alias("by1"), area.alias("area"))


def overlay_areas(left: DataFrame, right: DataFrame, bucket: float, strip: float) -> DataFrame:
    """Shared areas of polygons of two layers: a, b, area_a, area_b, shared, csi (shared by united), for pairs that share any.

    A layer is edges poly, x0, y0, x1, y1 of closed rings, in either sense, holes in the other sense than their shell. Pairs
    whose boxes meet are found by squares of side bucket; of the squares that both cover, one owns the pair. Edges of a pair
    meet by strips of columns, likewise with one owner, so that only edges above each other do.
    """
    left, right = (materialize(x.select("poly", *(F.col(k).cast("double").alias(k) for k in ("x0", "y0", "x1", "y1"))).where("poly is not null"), "overlay") for x in (left, right))
    boxes = [materialize(_polygons(x).where("area != 0"), "overlay") for x in (left, right)]

    def covered(b: DataFrame, name: str) -> DataFrame:
        at = lambda k: F.floor(F.col(k) / bucket)
        b = b.withColumn("i", F.explode(F.sequence(at("bx0"), at("bx1")))).withColumn("j", F.explode(F.sequence(at("by0"), at("by1"))))
        return b.select("i", "j", *(F.col(k).alias(f"{name}_{k}") for k in b.columns if k not in ("i", "j")))

    pair = covered(boxes[0], "a").join(covered(boxes[1], "b"), ["i", "j"])
    least = {k: F.greatest(f"a_{k}0", f"b_{k}0") for k in ("bx", "by")}
    meet = (least["bx"] < F.least("a_bx1", "b_bx1")) & (least["by"] < F.least("a_by1", "b_by1"))
    owner = (F.col("i") == F.floor(least["bx"] / bucket)) & (F.col("j") == F.floor(least["by"] / bucket))
    pair = pair.where(meet & owner).select(F.col("a_poly").alias("a"), F.col("b_poly").alias("b"), F.col("a_area").alias("area_a"), F.col("b_area").alias("area_b"), F.least("a_by0", "b_by0").alias("floor"), least["bx"].alias("from"), F.least("a_bx1", "b_bx1").alias("to"))
    pair = materialize(pair, "overlay")

    def stripped(edges: DataFrame, side: str) -> DataFrame:
        e = pair.select("a", "b", "from", "to").join(edges.where("x0 != x1").withColumnRenamed("poly", side), side)
        lo, hi = F.greatest(F.least("x0", "x1"), "from"), F.least(F.greatest("x0", "x1"), "to")
        e = e.withColumn("lo", lo).withColumn("hi", hi).where("lo < hi")
        e = e.withColumn("strip", F.explode(F.sequence(F.floor(F.col("lo") / strip), F.floor(F.col("hi") / strip))))
        at = lambda x: F.col("y0") + (F.col(x) - F.col("x0")) / (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
        return e.select("a", "b", "strip", *(F.col(k).alias(f"{side}{k}") for k in ("lo", "hi")), at("lo").alias(f"{side}u"), at("hi").alias(f"{side}v"), F.signum(F.col("x1") - F.col("x0")).alias(f"{side}s"))

    both = stripped(left, "a").withColumnsRenamed({k: f"e{k[1:]}" for k in ("alo", "ahi", "au", "av", "as")})
    both = both.join(stripped(right, "b").withColumnsRenamed({k: f"f{k[1:]}" for k in ("blo", "bhi", "bu", "bv", "bs")}), ["a", "b", "strip"])
    both = both.withColumn("p", F.greatest("elo", "flo")).withColumn("q", F.least("ehi", "fhi")).where((F.col("p") < F.col("q")) & (F.floor(F.col("p") / strip) == F.col("strip")))
    at = lambda k, x: F.col(f"{k}u") + (F.col(x) - F.col(f"{k}lo")) / (F.col(f"{k}hi") - F.col(f"{k}lo")) * (F.col(f"{k}v") - F.col(f"{k}u"))
    sums = both.join(pair.select("a", "b", "floor"), ["a", "b"]).select("a", "b", (F.col("es") * F.col("fs") * (_below_both(F.col("p"), F.col("q"), [at("e", "p"), at("e", "q")], [at("f", "p"), at("f", "q")]) - F.col("floor") * (F.col("q") - F.col("p")))).alias("s"))
    sums = sums.groupBy("a", "b").agg(F.sum("s").alias("s"))
    out = pair.join(sums, ["a", "b"]).withColumn("shared", F.col("s") * F.signum("area_a") * F.signum("area_b"))
    out = out.select("a", "b", F.abs("area_a").alias("area_a"), F.abs("area_b").alias("area_b"), "shared")
    # What rounding leaves of edges that only touch is no area.
    return out.where(F.col("shared") > 1e-9 * F.least("area_a", "area_b")).withColumn("csi", F.col("shared") / (F.col("area_a") + F.col("area_b") - F.col("shared")))
