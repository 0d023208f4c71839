"""Queries over regions as outlines, groups and points."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flow as fl
from ..operators import outline
from ..storage import materialize
from .inputs import DEM, DOWN, FLOW, WIDE, dem, flow, ncols, query, table, water
from .terrain import _LAB, _labelled


@query(f"WITH {_LAB}, own AS (SELECT label, count(*) AS area FROM lab WHERE label IS NOT NULL GROUP BY label), inner_ AS (SELECT label, count(*) AS n FROM pair WHERE label = nlabel AND k % 2 = 0 GROUP BY label) SELECT own.label, CAST(area * 4 - coalesce(n, 0) AS BIGINT) AS edges, CAST(area AS BIGINT) AS area FROM own LEFT JOIN inner_ USING (label)")
def region_outlines(spark, d):
    """Length of the outlines of each depression, and the area that they enclose (holes taken off)."""
    rings = outline.outlines(_labelled(spark, d).where("label is not null").select("label", "r", "c"), ncols(spark, d))
    return rings.groupBy("label").agg(F.count("*").alias("edges"), F.sum(outline.signed_area()).alias("area"))


@query(f"WITH {DOWN}, b AS (SELECT down.id, pos // ({WIDE} * 100) AS band FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL) SELECT band, count(*) AS cells, round(count(*) * 0.0009, 9) AS area_km2 FROM b GROUP BY band")
def dissolved_basins(spark, d):
    """Basins joined by the hundred rows in which they end."""
    n = ncols(spark, d)
    return outline.dissolve(fl.terminal_labels(flow(spark, d)).withColumn("band", F.floor(F.col("label") / (n * 100))), "band", 0.0009)


_WEST, _NORTH, _SIZE = 70.0, 50.0, 0.01


def _ends(spark, d):
    n = ncols(spark, d)
    t = flow(spark, d).where("next_id is null").select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))
    return outline.points(t, _WEST, _NORTH, _SIZE)


@query(f"WITH {FLOW} SELECT id // {WIDE} AS r, id % {WIDE} AS c, round((id % {WIDE} + 0.5::DOUBLE) * 0.01::DOUBLE + 70, 9) AS lon, round(50 - (id // {WIDE} + 0.5::DOUBLE) * 0.01::DOUBLE, 9) AS lat FROM flow WHERE next_id IS NULL")
def terminal_points(spark, d):
    return _ends(spark, d)


@query(f"WITH {FLOW} SELECT id // {WIDE} AS r, id % {WIDE} AS c, CAST(next_id IS NULL AS BIGINT) AS points FROM flow")
def terminal_raster(spark, d):
    return outline.point_raster(dem(spark, d), _ends(spark, d), _WEST, _NORTH, _SIZE)


@query()
def dam_flattening(spark, d):
    """Low ground at dams (suppliers at cells) made level."""
    n = ncols(spark, d)
    all_ = dem(spark, d).count()
    at = F.col("s_suppkey") * 37 % all_
    dams = table(spark, d, "supplier").select(F.col("s_suppkey").alias("dam"), F.floor(at / n).alias("r"), (at % n).alias("c"))
    return outline.flatten_dams(dem(spark, d), water(spark, d), dams)


_UNION = f"{DEM}, lc AS MATERIALIZED (SELECT r, c, r * {WIDE} + c AS id, r // 100 AS grp FROM dem WHERE h > -0.1), le AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM lc a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dr, dc), lc b WHERE b.r = a.r + dr AND b.c = a.c + dc AND b.grp = a.grp), uc AS MATERIALIZED (WITH RECURSIVE l(id, label) USING KEY (id) AS (SELECT id, id FROM lc UNION SELECT le.b, min(l.label) FROM l JOIN le ON le.a = l.id LEFT JOIN recurring.l o ON o.id = le.b WHERE o.label IS NULL OR l.label < o.label GROUP BY le.b) SELECT * FROM l)"


@query(f"WITH {_UNION}, f AS (SELECT id, min(label) AS label FROM uc GROUP BY id) SELECT lc.grp, f.label AS first, count(*) AS area FROM f JOIN lc USING (id) GROUP BY ALL")
def dissolved_outlines(spark, d):
    """Polygons of high ground by blocks of cells, united over bands of blocks by their edges: each shell without its holes."""
    n = ncols(spark, d)
    block = F.floor(F.col("r") / 10) * 10 + F.floor(F.col("c") / 16)
    high = materialize(dem(spark, d).where("h > -0.1").select(block.alias("label"), "r", "c"), "union")
    groups = high.select("label", F.floor(F.col("label") / 100).alias("group")).distinct()
    rings = materialize(outline.dissolve_outlines(outline.outlines(high, n), groups, n), "union")
    parts = outline.shells(rings)
    net = parts.groupBy("label", "shell").agg(F.sum("area").alias("area"), F.max(F.when(F.col("ring") == F.col("shell"), F.col("first_y") * n + F.col("first_x"))).alias("first"))
    return net.select(F.col("label").alias("grp"), "first", F.col("area").cast("long").alias("area"))
