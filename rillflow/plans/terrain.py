"""Queries over the raster and its flow graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import algebra, components, flood, focal, grid, route, vector, zonal
from ..operators import flow as fl
from ..storage import materialize
from .inputs import ACC, D8, DEM, DIRS, DOWN, FLOW, NEAR, WATER, WIDE, dem, flow, ncols, nrows, query, table, water

#: A stream has at least so many cells above it.
STREAM = 8


@query(f"WITH {DEM} SELECT r, c, h FROM dem")
def grid_scan(spark, d):
    return dem(spark, d)


@query("SELECT vec_id AS r, [CAST(x AS DOUBLE) for x in embedding] AS h_row, len(embedding) AS n FROM embeddings".replace("[CAST(x AS DOUBLE) for x in embedding] AS h_row", "round(list_sum([CAST(x AS DOUBLE) for x in embedding]), 4) AS total"))
def grid_rows(spark, d):
    """Cells back to arrays, one for each row."""
    rows = grid.arrays_from_cells(dem(spark, d))
    return rows.select("r", F.round(F.aggregate("values", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("values").alias("n"))


@query(f"WITH {DEM} SELECT count(*) AS n, max(r) + 1 AS nrows, max(c) + 1 AS ncols, min(h) AS lowest, max(h) AS highest, count(*) FILTER (h IS NULL) AS nodata FROM dem")
def raster_metadata(spark, d):
    return dem(spark, d).agg(F.count("*").alias("n"), (F.max("r") + 1).alias("nrows"), (F.max("c") + 1).alias("ncols"), F.min("h").alias("lowest"), F.max("h").alias("highest"), F.count_if(F.col("h").isNull()).alias("nodata"))


@query(f"WITH {DEM} SELECT r // 8 AS r, c // 8 AS c, round(avg(h), 6) AS h, count(h) AS n FROM dem GROUP BY ALL")
def grid_pyramid(spark, d):
    return grid.pyramid(dem(spark, d), 8)


_AXIS = "(SELECT x, i, 1 - abs(x + 0.5::DOUBLE - (i + 0.5::DOUBLE) * q) / greatest(q, 1) AS w FROM (SELECT *, {n}::DOUBLE / {o} AS q, unnest(range({n})) AS x FROM size) s, (SELECT unnest(range({o})) AS i FROM size) t WHERE w > 0)"
_PREVIEW = f"WITH {DEM}, size AS MATERIALIZED (SELECT nr, nc, greatest(1, CAST(floor(nr * s) AS BIGINT)) AS onr, greatest(1, CAST(floor(nc * s) AS BIGINT)) AS onc FROM (SELECT nr, nc, least(256::DOUBLE / nr, 256::DOUBLE / nc) AS s FROM (SELECT max(r) + 1 AS nr, max(c) + 1 AS nc FROM dem))), wr AS MATERIALIZED {_AXIS.format(n='nr', o='onr')}, wc AS MATERIALIZED {_AXIS.format(n='nc', o='onc')}, across AS MATERIALIZED (SELECT dem.r, wc.i AS c, sum(wc.w * h) AS s, sum(wc.w) AS w FROM dem JOIN wc ON wc.x = dem.c WHERE h IS NOT NULL GROUP BY ALL)"


@query(f"{_PREVIEW} SELECT wr.i AS r, a.c, round(sum(wr.w * a.s) / sum(wr.w * a.w), 6) AS h FROM across a JOIN wr ON wr.x = a.r GROUP BY ALL")
def bilinear_preview(spark, d):
    """The whole raster at 256 cells a side at most."""
    rows, cols = nrows(spark, d), ncols(spark, d)
    return focal.preview(dem(spark, d), rows, cols, *focal.preview_size(rows, cols, 256)).select("r", "c", F.round("h", 6).alias("h"))


@query(f"WITH {DEM} SELECT r - 100 AS r, c - 20 AS c, h FROM dem WHERE r BETWEEN 100 AND 140 AND c BETWEEN 20 AND 40")
def window_crop(spark, d):
    return grid.window(dem(spark, d), 100, 140, 20, 40)


_OCC = "CAST(floor(least(100, abs(h) * 200)) AS INT)"


def _occurrence(spark, d):
    return water(spark, d).select("r", "c", "h", F.floor(F.least(F.lit(100), F.abs("h") * 200)).cast("int").alias("occ"))


@query(f"WITH {DEM}, x AS (SELECT r, c, (r + c) % 6 AS osm, {_OCC} + (c % 2) * 120 AS seen FROM dem), y AS (SELECT r, c, CASE osm WHEN 2 THEN 30 WHEN 3 THEN 30 WHEN 4 THEN 10 WHEN 5 THEN 10 ELSE 0 END AS k, CAST(floor((CASE WHEN seen > 100 THEN 0 ELSE seen END) * 0.7) AS INT) AS g FROM x) SELECT r, c, CASE WHEN k > 0 THEN k + g END AS occ FROM y")
def reclassify_occurrence(spark, d):
    seen = F.floor(F.least(F.lit(100), F.abs("h") * 200)).cast("int") + (F.col("c") % 2) * 120
    return dem(spark, d).select("r", "c", algebra.combined_occurrence((F.col("r") + F.col("c")) % 6, seen).cast("int").alias("occ"))


@query(f"WITH {DEM} SELECT r, c, CASE WHEN h < -0.12 AND r % 10 = 0 THEN 100 WHEN h < -0.12 THEN {_OCC} END AS occ FROM dem")
def lake_override(spark, d):
    lake = F.col("r") % 10 == 0
    return dem(spark, d).join(_occurrence(spark, d).select("r", "c", "occ"), ["r", "c"], "left").select("r", "c", F.when(lake & F.col("occ").isNotNull(), 100).otherwise(F.col("occ")).alias("occ"))


@query(f"WITH {DEM}, x AS (SELECT r, c, h, CASE WHEN h < -0.12 THEN {_OCC} END AS occ, (r + c) % 97 = 0 AS ocean FROM dem) SELECT r, c, CASE WHEN ocean THEN NULL WHEN occ <> 0 THEN round(h - (CAST(0.06 AS DOUBLE) * occ - 3), 9) ELSE round(h, 9) END AS h FROM x")
def burn_dem(spark, d):
    occ = _occurrence(spark, d).select("r", "c", "occ")
    out = dem(spark, d).join(occ, ["r", "c"], "left")
    return out.select("r", "c", F.round(algebra.burn(F.col("h"), F.col("occ"), (F.col("r") + F.col("c")) % 97 == 0), 9).alias("h"))


@query(f"WITH {DEM} SELECT r, c, nullif(floor(h * 10), 0) AS v FROM dem")
def nodata_to_null(spark, d):
    return dem(spark, d).select("r", "c", algebra.without(F.floor(F.col("h") * 10).cast("double"), 0.0).alias("v"))


@query(f"WITH {DEM} SELECT r, c, CAST(NOT (r % 100 < 10 AND c BETWEEN 20 AND 30) AS INT) AS valid FROM dem")
def valid_mask(spark, d):
    h = F.when(~((F.col("r") % 100 < 10) & F.col("c").between(20, 30)), F.col("h"))
    return dem(spark, d).select("r", "c", h.isNotNull().cast("int").alias("valid"))


@query(f"WITH {DEM}, b AS (SELECT r + 3 AS r, c + 2 AS c, -h AS h FROM dem) SELECT a.r, a.c, round(a.h - b.h, 9) AS diff FROM dem a JOIN b USING (r, c)")
def dem_difference(spark, d):
    b = dem(spark, d).select((F.col("r") + 3).alias("r"), (F.col("c") + 2).alias("c"), (-F.col("h")).alias("h2"))
    return dem(spark, d).join(b, ["r", "c"]).select("r", "c", F.round(F.col("h") - F.col("h2"), 9).alias("diff"))


@query(f"WITH {DEM}, b AS (SELECT r + 3 AS r, c + 2 AS c, -h AS h FROM dem) SELECT coalesce(a.r, b.r) AS r, coalesce(a.c, b.c) AS c, coalesce(b.h, a.h) AS h FROM dem a FULL JOIN b USING (r, c)")
def mosaic_priority(spark, d):
    a = dem(spark, d)
    return algebra.mosaic([a, a.select((F.col("r") + 3).cast("long").alias("r"), (F.col("c") + 2).cast("int").alias("c"), (-F.col("h")).alias("h"))])


@query(f"WITH {DEM} SELECT a.r, a.c, coalesce(p.h, a.h) AS h FROM dem a LEFT JOIN (SELECT r + 50 AS r, c + 10 AS c, h FROM dem WHERE r < 20 AND c < 20 AND h > 0) p USING (r, c)")
def patch_overlay(spark, d):
    patch = dem(spark, d).where("r < 20 and c < 20 and h > 0").select((F.col("r") + 50).alias("r"), (F.col("c") + 10).alias("c"), "h")
    return algebra.overlay(dem(spark, d), patch)


@query(f"WITH {DEM} SELECT a.r, a.c, a.h FROM dem a ANTI JOIN (SELECT r, c FROM dem WHERE h < -0.12) w USING (r, c)")
def difference_cells(spark, d):
    return dem(spark, d).join(water(spark, d).select("r", "c"), ["r", "c"], "left_anti")


@query(f"WITH {DEM} SELECT r, c, h FROM dem WHERE c + 0.5 > 10 AND r + 0.5 >= 10 AND r + 0.5 < 110 AND c + 0.5 < 10 + (r + 0.5 - 10) * 0.4")
def clip_polygon(spark, d):
    """Cells whose centre lies in a triangle."""
    return dem(spark, d).where(algebra.inside([(10.0, 10.0), (10.0, 110.0), (50.0, 110.0)], F.col("c") + 0.5, F.col("r") + 0.5))


@query(f"WITH {DEM} SELECT (r - 2) // 4 AS r, (c - 2) // 4 AS c, h FROM dem WHERE r % 4 = 2 AND c % 4 = 2")
def resample_nearest(spark, d):
    return focal.resample_nearest(dem(spark, d), 4)


@query(f"WITH {DEM}, n AS (SELECT a.r, a.c, a.h, coalesce(e.h, a.h) AS e, coalesce(s.h, a.h) AS s, coalesce(x.h, e.h, s.h, a.h) AS x FROM dem a LEFT JOIN dem e ON e.r = a.r AND e.c = a.c + 1 LEFT JOIN dem s ON s.r = a.r + 1 AND s.c = a.c LEFT JOIN dem x ON x.r = a.r + 1 AND x.c = a.c + 1), t AS (SELECT *, unnest([0, 1, 2, 3]) AS i FROM n) SELECT r * 2 + i // 2 AS r, c * 2 + i % 2 AS c, round((h * (1 - i % 2 * 0.5::DOUBLE) + e * (i % 2 * 0.5::DOUBLE)) * (1 - i // 2 * 0.5::DOUBLE) + (s * (1 - i % 2 * 0.5::DOUBLE) + x * (i % 2 * 0.5::DOUBLE)) * (i // 2 * 0.5::DOUBLE), 6) AS h FROM t")
def resample_bilinear(spark, d):
    return focal.resample_bilinear(dem(spark, d), 2).select("r", "c", F.round("h", 6).alias("h"))


def _gauss_sql(sigma: float = 2.0) -> str:
    reach = int(4 * sigma + 0.5)
    w = f"w AS (SELECT d, exp(-0.5::DOUBLE * (d / {sigma}::DOUBLE) * (d / {sigma}::DOUBLE)) AS g FROM (SELECT unnest(range(-{reach}, {reach + 1})) AS d)), k AS (SELECT d, g / (SELECT sum(g) FROM w) AS g FROM w)"
    fold = lambda x, n: f"CASE WHEN {x} < 0 THEN -1 - ({x}) WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"
    return f"WITH {DEM}, {w}, one AS (SELECT a.r, a.c, sum(b.h * g) AS h FROM dem a, k, dem b WHERE b.c = a.c AND b.r = {fold('a.r + d', '(SELECT max(r) + 1 FROM dem)')} GROUP BY ALL) SELECT a.r, a.c, round(sum(b.h * g), 5) AS h FROM one a, k, one b WHERE b.r = a.r AND b.c = {fold('a.c + d', WIDE)} GROUP BY ALL"


@query(_gauss_sql())
def gaussian_smooth(spark, d):
    return focal.gaussian(dem(spark, d), 2.0).select("r", "c", F.round("h", 5).alias("h"))


@query(f"WITH {DEM}, fab AS (SELECT r, c, CASE WHEN r % 3 > 0 THEN h END AS h FROM dem) SELECT r, c, round(coalesce(fab.h, dem.h + 0.5 * dem.h), 9) AS h FROM dem JOIN fab USING (r, c)")
def dem_fusion(spark, d):
    a = dem(spark, d)
    return algebra.fuse(a.withColumn("h", F.when(F.col("r") % 3 > 0, F.col("h"))), a, a.withColumn("h", F.col("h") * 0.5)).withColumn("h", F.round("h", 9))


@query(f"WITH {DIRS} SELECT r, c, h, dir FROM dirs")
def d8_direction(spark, d):
    return focal.d8(dem(spark, d))


@query(f"WITH {NEAR} SELECT dem.r, dem.c, CAST(x.dir AS INT) AS dir FROM dem LEFT JOIN (SELECT r, c, 1 << k AS dir FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY (nh - h) / f, k) AS i FROM near WHERE nh >= h) WHERE i = 1) x USING (r, c)")
def reverse_d8(spark, d):
    return focal.gentlest_rise(dem(spark, d))


@query(f"WITH {NEAR} SELECT r, c, sum(nh)::DECIMAL(18,6) AS around, count(*) AS n FROM (SELECT r, c, CAST(nh AS DECIMAL(18,6)) AS nh FROM near) GROUP BY ALL".replace("sum(nh)::DECIMAL(18,6)", "CAST(sum(nh) AS DOUBLE)"))
def upstream_neighbours(spark, d):
    n = grid.neighbours(dem(spark, d), "h")
    values = F.array_compact(F.array(*(F.col(f"h_{k}").cast("decimal(18,6)") for k in range(8))))
    return n.select("r", "c", F.aggregate(values, F.lit(0).cast("decimal(28,6)"), lambda a, x: (a + x).cast("decimal(28,6)")).cast("double").alias("around"), F.size(values).cast("long").alias("n"))


_HOLE = "holed AS MATERIALIZED (SELECT r, c, CASE WHEN NOT (r % 100 < 10 AND c BETWEEN 20 AND 30) THEN h END AS h FROM dem)"


def _holed(spark, d):
    return dem(spark, d).withColumn("h", F.when(~((F.col("r") % 100 < 10) & F.col("c").between(20, 30)), F.col("h")))


@query(f"WITH {DEM}, {_HOLE}, {D8} SELECT a.r, a.c, count(b.h) < 8 AS boundary FROM holed a, d8 LEFT JOIN holed b ON b.r = a.r + dr AND b.c = a.c + dc WHERE a.h IS NOT NULL GROUP BY a.r, a.c".replace("FROM holed a, d8 LEFT JOIN", "FROM (SELECT * FROM holed, d8) a LEFT JOIN"))
def boundary_flag(spark, d):
    return focal.boundary_flag(_holed(spark, d))


@query(f"WITH {DEM}, {_HOLE}, {D8}, m AS (SELECT r, c FROM holed WHERE h IS NOT NULL) SELECT a.r, a.c FROM (SELECT * FROM m, d8 WHERE k % 2 = 0) a LEFT JOIN m b ON b.r = a.r + dr AND b.c = a.c + dc GROUP BY a.r, a.c HAVING count(b.r) < 4")
def mask_edge(spark, d):
    return focal.mask_edge(_holed(spark, d).where("h is not null"))


@query(f"WITH {NEAR} SELECT r, c, CASE WHEN count(*) = 8 THEN greatest(any_value(h), max(nh)) ELSE any_value(h) END AS h FROM near GROUP BY r, c")
def raise_to_window(spark, d):
    return focal.raise_to_window(dem(spark, d))


def _labelled(spark, d):
    labels = components.label_mask(water(spark, d), ncols(spark, d))
    return dem(spark, d).withColumn("id", grid.cell_id(ncols(spark, d))).join(labels, "id", "left").select("r", "c", "label", "h")


@query(f"WITH {WATER} SELECT id, label FROM comp")
def components8(spark, d):
    return components.label_mask(water(spark, d), ncols(spark, d))


_LAB = f"{WATER}, lab AS MATERIALIZED (SELECT r, c, h, label FROM dem LEFT JOIN comp ON id = r * {WIDE} + c), pair AS MATERIALIZED (SELECT a.*, k, f, b.label AS nlabel, b.h AS nh FROM (SELECT *, r + dr AS nr, c + dc AS nc FROM lab, d8) a JOIN lab b ON b.r = a.nr AND b.c = a.nc), ring AS MATERIALIZED (SELECT DISTINCT nlabel AS label, r, c, h FROM pair WHERE nlabel IS NOT NULL AND nlabel IS DISTINCT FROM label)"


@query(f"WITH {_LAB} SELECT label, r, c, h FROM ring")
def boundary_ring(spark, d):
    return focal.boundary_ring(_labelled(spark, d))


@query(f"WITH {WATER}, x AS (SELECT label, id // {WIDE} AS r, id % {WIDE} AS c FROM comp) SELECT label, count(*) AS n, min(r) AS min_r, max(r) AS max_r, min(c) AS min_c, max(c) AS max_c, bool_or(r = 0) AS touch_u, bool_or(r = (SELECT max(vec_id) FROM embeddings)) AS touch_d, bool_or(c = 0) AS touch_l, bool_or(c = {WIDE} - 1) AS touch_r FROM x GROUP BY label")
def depression_extent(spark, d):
    return zonal.extents(_labelled(spark, d).where("label is not null"), nrows(spark, d), ncols(spark, d))


@query(f"WITH {WATER}, x AS (SELECT label, id // {WIDE} AS r, id % {WIDE} AS c FROM comp) SELECT label FROM x GROUP BY label HAVING bool_or(r = 0 OR c = 0 OR c = {WIDE} - 1 OR r = (SELECT max(vec_id) FROM embeddings))")
def rejected_depressions(spark, d):
    return zonal.extents(_labelled(spark, d).where("label is not null"), nrows(spark, d), ncols(spark, d)).where("touch_u or touch_d or touch_l or touch_r").select("label")


@query(f"WITH {_LAB} SELECT label, r AS low_r, c AS low_c, h AS low_h FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, r, c) AS i FROM lab WHERE label IS NOT NULL) WHERE i = 1")
def lowest_cells(spark, d):
    return zonal.lowest_cells(_labelled(spark, d).where("label is not null"))


_GEO = f"{_LAB}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h, r, c) AS i FROM ring) WHERE i = 1), geo AS (SELECT lab.label, count(*) AS n, any_value(o.r) AS out_r, any_value(o.c) AS out_c, any_value(o.h) AS oh, min(lab.h) AS lh, round(count(*) * 900.0 / 1e6, 9) AS area_km2, CAST(sum(CASE WHEN lab.h <= o.h THEN CAST((o.h - lab.h) * 900.0 AS DECIMAL(28,6)) END) AS DOUBLE) / 1e9 AS volume_km3 FROM lab JOIN o USING (label) GROUP BY lab.label)"


@query(f"WITH {_GEO} SELECT label, n, out_r, out_c, area_km2, round(oh - lh, 6) AS depth_m, round(volume_km3, 12) AS volume_km3, CASE WHEN volume_km3 = 0 THEN 1 WHEN area_km2 > 50 AND volume_km3 > 0.5 AND oh - lh > 10 THEN 2 ELSE 3 END AS sink_type FROM geo")
def depression_geometry(spark, d):
    g = zonal.geometry(_labelled(spark, d))
    return g.select("label", "n", "out_r", "out_c", F.round("area_km2", 9).alias("area_km2"), F.round("depth_m", 6).alias("depth_m"), F.round("volume_km3", 12).alias("volume_km3"), "sink_type")


@query(f"WITH {WATER}, occ AS (SELECT r * {WIDE} + c AS id, {_OCC} AS occ FROM dem WHERE h < -0.12) SELECT label, count(*) AS n, round(avg(occ), 6) AS mean_occ FROM comp JOIN occ USING (id) GROUP BY label HAVING avg(occ) >= 30 AND count(*) >= 4")
def water_body_filter(spark, d):
    return zonal.water_bodies(_labelled(spark, d).where("label is not null").select("label", "r", "c"), _occurrence(spark, d), 30, 4)


@query(f"WITH {DEM}, e AS (SELECT r, c, unnest([CASE WHEN r = 0 THEN 'top' END, CASE WHEN r = (SELECT max(r) FROM dem) THEN 'bottom' END, CASE WHEN c = 0 THEN 'left' END, CASE WHEN c = {WIDE} - 1 THEN 'right' END]) AS edge FROM dem WHERE h > -0.05), x AS (SELECT edge, CASE WHEN edge IN ('top', 'bottom') THEN c ELSE r END AS pos FROM e WHERE edge IS NOT NULL), y AS (SELECT *, pos - row_number() OVER (PARTITION BY edge ORDER BY pos) AS g FROM x) SELECT edge, min(pos) AS first, max(pos) AS last, count(*) AS n FROM y GROUP BY edge, g HAVING count(*) >= 5")
def edge_runs(spark, d):
    return components.edge_runs(dem(spark, d), F.col("h") > -0.05, 5)


@query(f"WITH {DEM}, fld AS (WITH RECURSIVE w AS (SELECT r, c FROM (SELECT *, count(*) OVER (PARTITION BY edge, g) AS n FROM (SELECT *, pos - row_number() OVER (PARTITION BY edge ORDER BY pos) AS g FROM (SELECT r, c, edge, CASE WHEN edge IN ('top', 'bottom') THEN c ELSE r END AS pos FROM (SELECT r, c, unnest([CASE WHEN r = 0 THEN 'top' END, CASE WHEN r = (SELECT max(r) FROM dem) THEN 'bottom' END, CASE WHEN c = 0 THEN 'left' END, CASE WHEN c = {WIDE} - 1 THEN 'right' END]) AS edge FROM dem WHERE h < -0.02) WHERE edge IS NOT NULL))) WHERE n >= 4 UNION SELECT dem.r, dem.c FROM w, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) s(dr, dc), dem WHERE dem.r = w.r + dr AND dem.c = w.c + dc AND h < -0.02) SELECT DISTINCT r, c FROM w) SELECT r * {WIDE} + c AS id FROM fld")
def ocean_fill(spark, d):
    return components.ocean(dem(spark, d), ncols(spark, d), F.col("h") < -0.02, 4)


@query(f"WITH {FLOW} SELECT id FROM flow WHERE next_id IS NULL")
def terminals(spark, d):
    return flow(spark, d).where("next_id is null").select("id")


@query(f"WITH {ACC} SELECT id, acc FROM acc")
def flow_accumulation(spark, d):
    return fl.accumulate(flow(spark, d))


@query(f"WITH {ACC} SELECT id, acc FROM acc")
def flow_accumulation_tiled(spark, d):
    return fl.accumulate_tiled(flow(spark, d), ncols(spark, d), 16)


@query(f"WITH {ACC} SELECT id FROM acc WHERE acc >= {STREAM}")
def stream_mask(spark, d):
    return fl.accumulate(flow(spark, d)).where(F.col("acc") >= STREAM).select("id")


@query(f"WITH {DOWN} SELECT id, pos AS label FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL".replace("SELECT id, pos", "SELECT down.id AS id, pos"))
def basin_labels(spark, d):
    return fl.terminal_labels(flow(spark, d))


_INITIAL = f"WITH {DIRS}, fd AS MATERIALIZED (SELECT r, c, r * {WIDE} + c AS id, CASE WHEN h >= -0.12 THEN nr * {WIDE} + nc END AS next_id FROM dirs WHERE h < -0.02 OR h >= -0.01), ends AS MATERIALIZED (SELECT id FROM fd WHERE next_id IS NULL), te AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM near JOIN ends a ON a.id = near.r * {WIDE} + near.c JOIN ends b ON b.id = near.nr * {WIDE} + near.nc), rc AS (WITH RECURSIVE w AS (SELECT id, id AS pos FROM ends UNION SELECT w.id, b FROM w JOIN te ON te.a = w.pos) SELECT * FROM w), cp AS MATERIALIZED (SELECT id, min(pos) AS label FROM rc GROUP BY id), dn AS MATERIALIZED (WITH RECURSIVE w AS (SELECT id, id AS pos FROM fd UNION ALL SELECT w.id, t.id FROM w JOIN fd f ON f.id = w.pos JOIN fd t ON t.id = f.next_id) SELECT * FROM w)"


@query(f"{_INITIAL} SELECT fd.r, fd.c, x.label FROM fd LEFT JOIN (SELECT dn.id, cp.label FROM dn JOIN cp ON cp.id = dn.pos) x USING (id)")
def initial_basins(spark, d):
    """Basins of connected terminals: low ground takes what flows to it; a band of heights has no direction."""
    dirs = focal.d8(dem(spark, d)).where("h < -0.02 or h >= -0.01").select("r", "c", F.when(F.col("h") < -0.12, 0).otherwise(F.col("dir")).alias("dir"))
    return fl.initial_basins(dirs, ncols(spark, d))


@query(f"WITH {DOWN}, t AS (SELECT down.id, pos, step FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL OR pos % 29 = 0) SELECT id, arg_min(pos, step) AS label FROM t GROUP BY id")
def incremental_basins(spark, d):
    f = flow(spark, d)
    return fl.terminal_labels(f, f.where("id % 29 = 0").select("id"))


@query(f"WITH {DOWN}, t AS (SELECT down.id, pos, step FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL OR pos % 29 = 0), b AS (SELECT id, arg_min(pos, step) AS label FROM t GROUP BY id) SELECT f.id AS up_basin, b.label AS down_basin FROM flow f JOIN b ON b.id = f.next_id WHERE f.id % 29 = 0")
def basin_confluence(spark, d):
    f = flow(spark, d)
    outlets = f.where("id % 29 = 0").select("id")
    return fl.confluence(f, materialize(fl.terminal_labels(f, outlets), "labels"), outlets)


@query(f"WITH {DOWN} SELECT pos AS label, count(*) AS cells FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL GROUP BY pos")
def basin_sizes(spark, d):
    return fl.terminal_labels(flow(spark, d)).groupBy("label").agg(F.count("*").alias("cells"))


_RISE = f"{NEAR}, up AS (SELECT r, c, nr, nc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY (nh - h) / f, k) AS i FROM near WHERE nh >= h) WHERE i = 1), rise AS MATERIALIZED (SELECT dem.r * {WIDE} + dem.c AS id, nr * {WIDE} + nc AS next_id FROM dem LEFT JOIN up USING (r, c))"


def _flawed(spark, d):
    """Mixed directions, with counter-flows: every third row follows the gentlest rise instead of the descent."""
    n = ncols(spark, d)
    down, up = flow(spark, d), focal.flow_edges(focal.gentlest_rise(dem(spark, d)), n).select("id", F.col("next_id").alias("up"))
    return materialize(down.join(up, "id").select("id", F.when(F.floor(F.col("id") / n) % 3 == 0, F.col("up")).otherwise(F.col("next_id")).alias("next_id")), "flawed")


_FLAWED = f"{FLOW}, up AS (SELECT r, c, nr, nc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY (nh - h) / f, k) AS i FROM near WHERE nh >= h) WHERE i = 1), flawed AS MATERIALIZED (SELECT flow.id, CASE WHEN (flow.id // {WIDE}) % 3 = 0 THEN up.nr * {WIDE} + up.nc ELSE flow.next_id END AS next_id FROM flow LEFT JOIN up ON flow.id = up.r * {WIDE} + up.c)"


@query(f"WITH {_FLAWED} SELECT a.id AS a, b.id AS b FROM flawed a JOIN flawed b ON a.next_id = b.id AND b.next_id = a.id AND a.id < b.id")
def counterflow_pairs(spark, d):
    return fl.counterflow_pairs(_flawed(spark, d))


@query(f"WITH {_FLAWED}, walk AS MATERIALIZED (WITH RECURSIVE w AS (SELECT id, id AS pos FROM flawed UNION SELECT w.id, next_id FROM w JOIN flawed f ON f.id = w.pos WHERE next_id IS NOT NULL) SELECT * FROM w), ends AS (SELECT DISTINCT walk.id FROM walk JOIN flawed f ON f.id = walk.pos WHERE f.next_id IS NULL), bad AS (SELECT id FROM flawed ANTI JOIN ends USING (id)), back AS (SELECT DISTINCT w.id FROM walk w JOIN flawed f ON f.id = w.pos AND f.next_id = w.id) SELECT bad.id, back.id IS NOT NULL AS on_cycle FROM bad LEFT JOIN back USING (id)")
def cycle_cells(spark, d):
    return fl.cycle_cells(_flawed(spark, d))


@query(f"WITH {_FLAWED} SELECT CAST(0 AS BIGINT) AS cycles, CAST(0 AS BIGINT) AS pairs, count(*) AS cells FROM flawed")
def cycle_repair(spark, d):
    """Invariants of repaired directions: no cell in or above a cycle, no counter-flow, no cell lost."""
    n = ncols(spark, d)
    fixed = materialize(fl.break_cycles(_flawed(spark, d), dem(spark, d).select(grid.cell_id(n).alias("id"), "h")), "fixed")
    cycles = fl.cycle_cells(fixed).agg(F.count("*").alias("cycles"))
    return cycles.crossJoin(fl.counterflow_pairs(fixed).agg(F.count("*").alias("pairs"))).crossJoin(fixed.agg(F.count("*").alias("cells")))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS up_id, c_custkey // 2 AS down_id FROM customer), w AS (SELECT up_id AS id, down_id AS seed FROM e UNION SELECT w.id, e.down_id FROM w JOIN e ON e.up_id = w.seed) SELECT seed, id FROM w WHERE seed <> id")
def upstream_closure(spark, d):
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("up_id"), F.floor(F.col("c_custkey") / 2).alias("down_id"))
    return fl.upstream(e, e.select(F.col("down_id").alias("id")).union(e.select("up_id")).distinct())


@query(f"WITH {FLOW}, v AS (SELECT r * {WIDE} + c AS id FROM dem WHERE NOT (r % 100 < 10 AND c BETWEEN 20 AND 30)) SELECT f.id, f.next_id FROM flow f JOIN v USING (id) WHERE f.next_id IS NOT NULL AND f.next_id NOT IN (SELECT id FROM v)")
def river_mouths(spark, d):
    valid = _holed(spark, d).where("h is not null").select(grid.cell_id(ncols(spark, d)).alias("id"))
    return fl.river_mouths(flow(spark, d), valid, valid)


@query(f'WITH {DOWN}, so AS (WITH RECURSIVE w AS (SELECT 1 AS k, id FROM flow UNION SELECT m.k + 1, down.pos FROM (SELECT w.k, f.next_id AS x FROM w JOIN flow f ON f.id = w.id WHERE f.next_id IS NOT NULL GROUP BY w.k, f.next_id HAVING count(*) > 1) m JOIN down ON down.id = m.x) SELECT * FROM w) SELECT id, max(k) AS "order" FROM so GROUP BY id')
def strahler_order(spark, d):
    return fl.strahler(flow(spark, d))


@query(f"WITH {ACC}, st AS (SELECT id FROM acc WHERE acc >= {STREAM}), up AS (SELECT f.next_id AS id, count(*) AS n FROM flow f JOIN st ON st.id = f.id WHERE f.next_id IS NOT NULL GROUP BY 1), starts AS (SELECT st.id FROM st LEFT JOIN up USING (id) WHERE coalesce(n, 0) <> 1), t AS (SELECT d.pos AS id, d.id AS link, d.step FROM down d JOIN starts ON starts.id = d.id) SELECT id, arg_min(link, step) AS link, min(step) AS step FROM t JOIN st USING (id) GROUP BY id")
def river_links(spark, d):
    f = flow(spark, d)
    streams = fl.accumulate(f).where(F.col("acc") >= STREAM).select("id")
    s = materialize(f.join(streams, "id"), "streams")
    return fl.stream_links(s, s.select("id").withColumn("order", F.lit(1)))


_STATION = f"s AS (SELECT s_suppkey AS station, (s_suppkey * 37) % (SELECT count(*) FROM dem) AS id, abs(s_acctbal) / 1000 + 1 AS cells FROM supplier)"


@query(f"WITH {ACC}, {_STATION}, w AS (SELECT s.station, s.cells, d.pos, d.step, a.acc, f.next_id, abs(a.acc - s.cells) / s.cells <= 0.2 AS ok FROM s JOIN down d ON d.id = s.id JOIN acc a ON a.id = d.pos JOIN flow f ON f.id = d.pos), x AS (SELECT *, row_number() OVER (PARTITION BY station ORDER BY step) AS i FROM w WHERE ok OR acc > cells OR next_id IS NULL OR step >= 200) SELECT station, CASE WHEN ok THEN pos ELSE -1 END AS id, step FROM x WHERE i = 1")
def outlet_snap(spark, d):
    f = flow(spark, d)
    n = dem(spark, d).count()
    stations = table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 37 % n).alias("id"), (F.abs("s_acctbal") / 1000 + 1).alias("cells"))
    return fl.snap_outlets(f, materialize(fl.accumulate(f), "acc"), stations)


@query(f"WITH {ACC}, st AS MATERIALIZED (SELECT id FROM acc WHERE acc >= {STREAM}), w AS MATERIALIZED (SELECT r * {WIDE} + c AS id FROM dem WHERE h < -0.05), k AS (SELECT f.id, f.next_id FROM flow f JOIN st USING (id) JOIN w USING (id)), into_ AS (SELECT DISTINCT f.next_id AS id FROM flow f JOIN st USING (id) WHERE f.id NOT IN (SELECT id FROM w) AND f.next_id IS NOT NULL) SELECT k.id, CASE WHEN k.next_id IN (SELECT id FROM w) AND k.id IN (SELECT id FROM into_) THEN 2 WHEN k.next_id IS NOT NULL AND k.next_id NOT IN (SELECT id FROM w) THEN 1 ELSE 0 END AS kind FROM k")
def key_points(spark, d):
    """Stream cells of low ground: 2 where a stream enters and stays, 1 where it leaves, else 0."""
    f, n = flow(spark, d), ncols(spark, d)
    streams = fl.accumulate(f).where(F.col("acc") >= STREAM).select("id")
    s = materialize(f.join(streams, "id"), "streams")
    low = dem(spark, d).where("h < -0.05").select(grid.cell_id(n).alias("id"))
    entered = s.where("next_id is not null").join(low, "id", "left_anti").select(F.col("next_id").alias("id")).distinct().withColumn("entered", F.lit(True))
    stays = low.select(F.col("id").alias("next_id"), F.lit(True).alias("stays"))
    k = s.join(low, "id").join(entered, "id", "left").join(stays, "next_id", "left")
    return k.select("id", F.when(F.col("stays") & F.col("entered"), 2).when(F.col("next_id").isNotNull() & F.col("stays").isNull(), 1).otherwise(0).alias("kind"))


@query(f"WITH {_LAB} SELECT label, r, c, CAST(1 << k AS INT) AS dir FROM (SELECT label, r, c, k, row_number() OVER (PARTITION BY label ORDER BY (h - nh) / f DESC, r, c, k) AS i FROM pair WHERE label IS NOT NULL AND nlabel IS DISTINCT FROM label) WHERE i = 1")
def steepest_exit(spark, d):
    return focal.steepest_exit(_labelled(spark, d)).select("label", "r", "c", "dir")


@query(f"WITH {NEAR}, t AS (SELECT r, c, h, (r * 7 + c * 3) % 5 = 0 AS open FROM dem), x AS (SELECT n.r, n.c, 1 << n.k AS dir, row_number() OVER (PARTITION BY n.r, n.c ORDER BY n.nh, n.k DESC) AS i FROM near n WHERE (n.r * 7 + n.c * 3) % 5 = 0 AND (n.nr * 7 + n.nc * 3) % 5 <> 0) SELECT t.r, t.c, CAST(x.dir AS INT) AS dir FROM t LEFT JOIN x ON x.r = t.r AND x.c = t.c AND x.i = 1 WHERE t.open")
def lowest_resolved(spark, d):
    return focal.lowest_resolved(dem(spark, d).withColumn("dir", F.when((F.col("r") * 7 + F.col("c") * 3) % 5 != 0, 1)))


@query(f"WITH RECURSIVE {DEM}, {D8}, n AS MATERIALIZED (SELECT a.r, a.c, b.r AS nr, b.c AS nc FROM dem a, d8, dem b WHERE b.r = a.r + dr AND b.c = a.c + dc), g AS (SELECT CAST(count(*) AS BIGINT) AS cells FROM dem) SELECT cells, CAST(0 AS BIGINT) AS below, CAST(0 AS BIGINT) AS pits, CAST(0 AS BIGINT) AS moved FROM g")
def fill_levels(spark, d):
    """Invariants of filled heights: none below the ground, no pit inside, the border as it was."""
    f = materialize(route.fill(dem(spark, d)), "filled")
    n = grid.neighbours(f.select("r", "c", "h", "f"), "f", "h")
    inner, lower = F.lit(True), F.lit(False)
    for k in range(8):
        inner, lower = inner & F.col(f"f_{k}").isNotNull(), lower | F.coalesce(F.col(f"f_{k}") <= F.col("f"), F.lit(False))
    # A pit stands above the ground's own level without a neighbour at or below it; at ground level it is none.
    pit = inner & ~lower
    return n.agg(F.count("*").alias("cells"), F.count_if(F.col("f") < F.col("h")).alias("below"), F.count_if(pit).alias("pits"), F.count_if(~inner & (F.col("f") != F.col("h"))).alias("moved"))


def _routed(spark, d, flat: bool):
    lab = materialize(_labelled(spark, d).where("label is not null"), "lab")
    low = zonal.lowest_cells(lab).select("label", F.col("low_r").cast("int").alias("start_r"), F.col("low_c").cast("int").alias("start_c"))
    cells = lab.join(low, "label").select("label", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "h", F.lit(0).alias("dir"), "start_r", "start_c")
    n = ncols(spark, d)
    out = materialize(route.route_depressions(cells, flat), "routed")
    edges = focal.flow_edges(out, n)
    ends = materialize(fl.terminal_labels(edges), "ends").where("label is not null").groupBy(F.col("label").alias("end")).agg(F.count("*").alias("reached"))
    start = low.select("label", grid.cell_id(n, "start_r", "start_c").alias("end"))
    totals = out.groupBy("label").agg(F.count("*").alias("cells"), F.count_if(F.col("dir") < 0).alias("unrouted"))
    return totals.join(start, "label").join(ends, "end").select("label", "cells", "unrouted", "reached")


_ROUTED = f"WITH {WATER} SELECT label, count(*) AS cells, CAST(0 AS BIGINT) AS unrouted, count(*) AS reached FROM comp GROUP BY label"

_RISE = f"{_LAB}, low AS (SELECT label, arg_min(r * {WIDE} + c, (h, r, c)) AS id, min(h) AS h FROM lab WHERE label IS NOT NULL GROUP BY label), le AS MATERIALIZED (SELECT r * {WIDE} + c AS a, (r + dr) * {WIDE} + c + dc AS b, nh FROM (SELECT pair.*, d8.dr, d8.dc FROM pair JOIN d8 USING (k)) WHERE label = nlabel), rise AS MATERIALIZED (WITH RECURSIVE l(id, f) USING KEY (id) AS (SELECT id, h FROM low UNION SELECT le.b, min(greatest(l.f, le.nh)) FROM l JOIN le ON le.a = l.id LEFT JOIN recurring.l o ON o.id = le.b WHERE o.f IS NULL OR greatest(l.f, le.nh) < o.f GROUP BY le.b) SELECT * FROM l)"


@query(f"WITH {_RISE} SELECT label, r, c, f AS level, true AS arrives FROM lab JOIN rise ON rise.id = r * {WIDE} + c WHERE label IS NOT NULL")
def pf_d8_route(spark, d):
    """Depressions flooded from their lowest cells: the level of the water at each cell, and whether its way ends there."""
    lab = materialize(_labelled(spark, d).where("label is not null"), "lab")
    low = zonal.lowest_cells(lab).select("label", F.col("low_r").cast("int").alias("start_r"), F.col("low_c").cast("int").alias("start_c"))
    return _flooded(materialize(lab.join(low, "label").select("label", "r", "c", "h", F.lit(0).alias("dir"), "start_r", "start_c"), "flood"), ncols(spark, d))


def _flooded(cells, n: int):
    """Levels of floods, and whether the directions of each cell lead to its start."""
    spill = flood.Spill(cells)
    ends = fl.terminal_labels(focal.flow_edges(materialize(spill.directions(), "routed"), n)).select("id", F.col("label").alias("end"))
    start = cells.select("label", grid.cell_id(n, "start_r", "start_c").alias("start")).distinct()
    return spill.levels().withColumn("id", grid.cell_id(n)).join(ends, "id").join(start, "label").select("label", "r", "c", "level", F.coalesce(F.col("end") == F.col("start"), F.lit(False)).alias("arrives"))


@query(_ROUTED)
def flat_route(spark, d):
    return _routed(spark, d, True)


@query(f"WITH {DEM}, a AS (SELECT r // 50 AS basin, r, c FROM dem WHERE h < 0.05), b AS (SELECT r // 50 AS basin, r, c FROM dem WHERE h > -0.05), j AS (SELECT coalesce(a.basin, b.basin) AS basin, a.r IS NOT NULL AND b.r IS NOT NULL AS x FROM a FULL JOIN b ON a.r = b.r AND a.c = b.c) SELECT basin, count(*) FILTER (x) AS both, count(*) AS either, round(count(*) FILTER (x) / count(*), 6) AS csi FROM j GROUP BY basin")
def overlap_csi(spark, d):
    basin = F.floor(F.col("r") / 50).alias("basin")
    c = dem(spark, d)
    return zonal.overlap(c.where("h < 0.05").select(basin, "r", "c"), c.where("h > -0.05").select(basin, "r", "c"))


@query(f"WITH {DEM} SELECT r // 100 AS band, CAST(sum(CAST(floor(6371008.8::DOUBLE * 6371008.8::DOUBLE * radians(0.1::DOUBLE) * (sin(radians(r * 0.1::DOUBLE - 60 + 0.1::DOUBLE)) - sin(radians(r * 0.1::DOUBLE - 60))) / 1000000) AS BIGINT)) AS BIGINT) AS km2 FROM dem GROUP BY 1")
def geodesic_area(spark, d):
    """Area of bands of rows, each cell a tenth of a degree, on a sphere."""
    cell = F.floor(vector.zone_area(F.col("r") * 0.1 - 60, 0.1) / 1000000).cast("long")
    return dem(spark, d).groupBy(F.floor(F.col("r") / 100).alias("band")).agg(F.sum(cell).alias("km2"))


@query(f"WITH {DOWN}, b AS MATERIALIZED (SELECT down.id AS id, pos AS label FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL) SELECT id, label FROM b WHERE label IN (SELECT b.label FROM b JOIN dem ON b.id = r * {WIDE} + c WHERE h < -0.25)")
def touched_basins(spark, d):
    """Basins that a water body touches, as cells."""
    labels = materialize(fl.terminal_labels(flow(spark, d)), "labels")
    wet = dem(spark, d).where("h < -0.25").select(grid.cell_id(ncols(spark, d)).alias("id"))
    return labels.join(labels.join(wet, "id", "left_semi").select("label").distinct(), "label", "left_semi").select("id", "label")


@query(f"WITH {WATER}, x AS MATERIALIZED (SELECT label, id // {WIDE} AS r, id % {WIDE} AS c FROM comp), e AS (SELECT label, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM x GROUP BY label), g AS (SELECT label, r, unnest(range(c0, c1 + 1)) AS c FROM (SELECT *, unnest(range(r0, r1 + 1)) AS r FROM e)) SELECT g.label, g.r, g.c, CAST(x.label IS NOT NULL AS INT) AS inside FROM g LEFT JOIN x ON x.label = g.label AND x.r = g.r AND x.c = g.c")
def label_crops(spark, d):
    """Each depression as a mask, 1 inside and 0 outside, of its bounding box."""
    n = ncols(spark, d)
    own = components.label_mask(water(spark, d), n).select("label", F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))
    return zonal.crops(materialize(own, "lab"))


@query(f"WITH {WATER} SELECT DISTINCT label, CAST(floor(h * 100) AS BIGINT) AS level FROM dem JOIN comp ON id = r * {WIDE} + c")
def water_levels(spark, d):
    """The different levels of each depression, in hundredths."""
    return _labelled(spark, d).where("label is not null").select("label", F.floor(F.col("h") * 100).alias("level")).distinct()
