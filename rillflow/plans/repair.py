"""Queries that repair directions, fill depressions, and score basins at snapped outlets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, focal, grid, route, zonal
from ..operators import flow as fl
from ..storage import materialize
from .inputs import ACC, DOWN, NEAR, WIDE, dem, flow, ncols, nrows, query, table
from .terrain import _FLAWED, _LAB, _STATION, STREAM, _flawed, _flooded, _labelled, _occurrence

_LAST = "(SELECT max(vec_id) FROM embeddings)"


def _filled_sql(rise: str) -> str:
    """Levels by relaxation from the border, until none falls."""
    to = f"greatest(n.nh, f.f + {rise}::DOUBLE)"
    return f"{NEAR}, filled AS MATERIALIZED (WITH RECURSIVE fl(r, c, f) USING KEY (r, c) AS (SELECT r, c, h FROM dem WHERE r = 0 OR c = 0 OR r = {_LAST} OR c = {WIDE} - 1 UNION SELECT n.nr, n.nc, min({to}) FROM fl f JOIN near n ON n.r = f.r AND n.c = f.c LEFT JOIN recurring.fl o ON o.r = n.nr AND o.c = n.nc WHERE o.f IS NULL OR {to} < o.f GROUP BY n.nr, n.nc) SELECT * FROM fl)"


_FILLED = _filled_sql("0")


@query(f"WITH {_FILLED} SELECT r, c, dem.h, f FROM dem JOIN filled USING (r, c)")
def filled_surface(spark, d):
    return route.fill(dem(spark, d))


@query(f"WITH {_filled_sql('0.001')} SELECT r, c, round(f, 9) AS f FROM filled")
def filled_rising(spark, d):
    """Filled without flats: each step away from the border adds to the level."""
    return route.fill(dem(spark, d), rise=0.001).select("r", "c", F.round("f", 9).alias("f"))


_SINK = f"{_FILLED}, wet AS MATERIALIZED (SELECT r, c, r * {WIDE} + c AS id, dem.h, f FROM dem JOIN filled USING (r, c) WHERE f > dem.h), we AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM (SELECT wet.*, r + dr AS nr, c + dc AS nc FROM wet, d8) a JOIN wet b ON b.r = a.nr AND b.c = a.nc), sk AS MATERIALIZED (SELECT id, min(label) AS label FROM (WITH RECURSIVE l(id, label) USING KEY (id) AS (SELECT id, id FROM wet UNION SELECT we.b, min(l.label) FROM l JOIN we ON we.a = l.id LEFT JOIN recurring.l o ON o.id = we.b WHERE o.label IS NULL OR l.label < o.label GROUP BY we.b) SELECT * FROM l) GROUP BY id)"


@query(f"WITH {_SINK} SELECT r, c, label, round(f - h, 9) AS depth FROM wet JOIN sk USING (id)")
def sink_cells(spark, d):
    """Depressions of the raw surface: the components of cells that filling raises."""
    return route.sinks(materialize(route.fill(dem(spark, d)), "filled"), ncols(spark, d)).select("r", "c", "label", F.round("depth", 9).alias("depth"))


@query(f"WITH {_SINK}, ok AS (SELECT label FROM wet JOIN sk USING (id) GROUP BY label HAVING max(f - h) <= 0.1) SELECT r, c, dem.h, CASE WHEN label IN (SELECT label FROM ok) THEN filled.f ELSE dem.h END AS f FROM dem JOIN filled USING (r, c) LEFT JOIN (SELECT wet.r, wet.c, label FROM wet JOIN sk USING (id)) USING (r, c)")
def filled_shallow(spark, d):
    return route.fill_shallow(dem(spark, d), ncols(spark, d), 0.1)


_FD = f"{_FLAWED}, code AS MATERIALIZED (SELECT flawed.id // {WIDE} AS r, flawed.id % {WIDE} AS c, k, CASE WHEN next_id IS NULL THEN 0 ELSE 1 << k END AS dir, next_id FROM flawed LEFT JOIN d8 ON next_id = flawed.id + dr * {WIDE} + dc)"


def _flawed_directions(spark, d):
    """The mixed directions as r, c, h, dir."""
    n = ncols(spark, d)
    f = _flawed(spark, d).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"), (F.col("next_id") - F.col("id")).alias("step"))
    code = F.lit(0)
    for k, (dr, dc) in enumerate(grid.STEPS):
        code = F.when(F.col("step") == dr * n + dc, 1 << k).otherwise(code)
    return materialize(dem(spark, d).join(f, ["r", "c"]).select("r", "c", "h", code.alias("dir")), "flawed")


@query(f"WITH {_FD}, first AS (SELECT a.r, a.c, a.k FROM code a JOIN code b ON a.next_id = b.r * {WIDE} + b.c AND b.next_id = a.r * {WIDE} + a.c WHERE a.next_id > a.r * {WIDE} + a.c), turn AS (SELECT f.r, f.c, min(s.k) AS k FROM first f, d8 s, code b WHERE b.r = f.r + s.dr AND b.c = f.c + s.dc AND b.dir <> 1 << ((f.k + 4) % 8) GROUP BY f.r, f.c) SELECT code.r, code.c, CAST(CASE WHEN turn.k IS NULL THEN code.dir ELSE 1 << turn.k END AS INT) AS dir FROM code LEFT JOIN turn ON turn.r = code.r AND turn.c = code.c")
def counterflow_turn(spark, d):
    return route.turn_counterflows(_flawed_directions(spark, d), ncols(spark, d))


_FWALK = f"{_FLAWED}, walk AS MATERIALIZED (WITH RECURSIVE w AS (SELECT id, id AS pos FROM flawed UNION SELECT w.id, next_id FROM w JOIN flawed f ON f.id = w.pos WHERE next_id IS NOT NULL) SELECT * FROM w), pairs AS (SELECT a.id AS a FROM flawed a JOIN flawed b ON a.next_id = b.id AND b.next_id = a.id AND a.id < b.id)"


def _counterflow_cells(spark, d):
    f = _flawed(spark, d)
    pairs = materialize(fl.counterflow_pairs(f), "pairs")
    ends = fl.terminal_labels(f, pairs.select(F.explode(F.array("a", "b")).alias("id")))
    both = pairs.select("a", F.explode(F.array("a", "b")).alias("label"))
    n = ncols(spark, d)
    return ends.join(both, "label").select(F.col("a").alias("label"), F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))


@query(f"WITH {_FWALK} SELECT a AS label, count(*) AS n, min(id // {WIDE}) - 1 AS r0, max(id // {WIDE}) + 1 AS r1, min(id % {WIDE}) - 1 AS c0, max(id % {WIDE}) + 1 AS c1 FROM walk JOIN pairs ON pos = a GROUP BY a")
def counterflow_regions(spark, d):
    """What flows into each counter-flow, and its box with a cell more on each side."""
    return _counterflow_cells(spark, d).groupBy("label").agg(F.count("*").alias("n"), (F.min("r") - 1).alias("r0"), (F.max("r") + 1).alias("r1"), (F.min("c") - 1).alias("c0"), (F.max("c") + 1).alias("c1"))


_CROPS = f"{_FWALK}, reg AS MATERIALIZED (SELECT a AS label, id // {WIDE} AS r, id % {WIDE} AS c FROM walk JOIN pairs ON pos = a), box AS (SELECT label, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1 FROM reg GROUP BY label), crop AS MATERIALIZED (SELECT label, r, c, h, r = r0 OR r = r1 OR c = c0 OR c = c1 OR r = 0 OR c = 0 OR r = {_LAST} OR c = {WIDE} - 1 AS rim FROM box JOIN dem ON r BETWEEN r0 AND r1 AND c BETWEEN c0 AND c1), ce AS MATERIALIZED (SELECT a.label, a.r, a.c, n.k, n.f, n.nr, n.nc, n.nh FROM crop a JOIN near n ON n.r = a.r AND n.c = a.c JOIN crop b ON b.label = a.label AND b.r = n.nr AND b.c = n.nc), lev AS MATERIALIZED (WITH RECURSIVE fl(label, r, c, f) USING KEY (label, r, c) AS (SELECT label, r, c, h FROM crop WHERE rim UNION SELECT n.label, n.nr, n.nc, min(greatest(n.nh, f.f + 1e-5::DOUBLE)) FROM fl f JOIN ce n ON n.label = f.label AND n.r = f.r AND n.c = f.c LEFT JOIN recurring.fl o ON o.label = n.label AND o.r = n.nr AND o.c = n.nc WHERE o.f IS NULL OR greatest(n.nh, f.f + 1e-5::DOUBLE) < o.f GROUP BY n.label, n.nr, n.nc) SELECT * FROM fl), way AS (SELECT a.r, a.c, ce.k, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.f - b.f) / ce.f DESC, ce.k) AS i FROM lev a JOIN reg USING (label, r, c) JOIN ce ON ce.label = a.label AND ce.r = a.r AND ce.c = a.c JOIN lev b ON b.label = a.label AND b.r = ce.nr AND b.c = ce.nc WHERE b.f <= a.f)"


@query(f"WITH {_FD.replace(_FLAWED, _CROPS)} SELECT code.r, code.c, CAST(CASE WHEN reg.label IS NULL THEN code.dir ELSE coalesce(1 << way.k, 0) END AS INT) AS dir FROM code LEFT JOIN reg ON reg.r = code.r AND reg.c = code.c LEFT JOIN way ON way.r = code.r AND way.c = code.c AND way.i = 1")
def counterflow_refill(spark, d):
    """Regions of counter-flows re-directed over their filled crops."""
    return route.refill_regions(_flawed_directions(spark, d), _counterflow_cells(spark, d))


@query()
def cycle_reroute(spark, d):
    """Directions in which whatever ended in a cycle leaves its region at the lowest cell beside it."""
    return route.reroute_cycles(_flawed_directions(spark, d), ncols(spark, d))


_EQ = f"{NEAR}, val AS MATERIALIZED (SELECT r, c, r * {WIDE} + c AS id, CAST(floor(h * 10) AS INT) AS v FROM dem), ve AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM near JOIN val a ON a.r = near.r AND a.c = near.c JOIN val b ON b.r = nr AND b.c = nc WHERE a.v = b.v), eq AS MATERIALIZED (SELECT id, min(label) AS label FROM (WITH RECURSIVE l(id, label) USING KEY (id) AS (SELECT id, id FROM val UNION SELECT ve.b, min(l.label) FROM l JOIN ve ON ve.a = l.id LEFT JOIN recurring.l o ON o.id = ve.b WHERE o.label IS NULL OR l.label < o.label GROUP BY ve.b) SELECT * FROM l) GROUP BY id)"


@query(f"WITH {_EQ} SELECT label, any_value(v) AS v, count(*) AS n, min(r) - 1 AS r0, max(r) + 1 AS r1, min(c) - 1 AS c0, max(c) + 1 AS c1 FROM val JOIN eq USING (id) GROUP BY label")
def equal_regions(spark, d):
    """Components of equal value, and their boxes with a cell more on each side."""
    v = dem(spark, d).select("r", "c", F.floor(F.col("h") * 10).cast("int").alias("v"))
    own = components.label_equal(v, "v", ncols(spark, d))
    return own.groupBy("label").agg(F.min("v").alias("v"), F.count("*").alias("n"), (F.min("r") - 1).alias("r0"), (F.max("r") + 1).alias("r1"), (F.min("c") - 1).alias("c0"), (F.max("c") + 1).alias("c1"))


def _stations(spark, d):
    n = dem(spark, d).count()
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("station"), (F.col("s_suppkey") * 37 % n).alias("id"), (F.abs("s_acctbal") / 1000 + 1).alias("cells"))


_CLIMB = f"{ACC}, {_STATION}, st AS (SELECT id FROM acc WHERE acc >= {STREAM}), ups AS MATERIALIZED (SELECT f.next_id AS id, list(f.id ORDER BY d8.k) AS ups FROM flow f JOIN st USING (id) JOIN d8 ON f.id = f.next_id + dr * {WIDE} + dc GROUP BY f.next_id), landed AS (SELECT s.station, s.cells, arg_min(d.pos, d.step) AS id FROM s JOIN down d ON d.id = s.id JOIN flow f ON f.id = d.pos WHERE f.next_id IS NULL OR d.pos IN (SELECT id FROM st) GROUP BY s.station, s.cells), climb AS MATERIALIZED (WITH RECURSIVE w AS (SELECT station, cells, id, 1 AS i, CAST([] AS BIGINT[]) AS stack, abs((acc + 1) - cells) / cells <= 0.2 AS fits FROM landed JOIN acc USING (id) UNION ALL SELECT w.station, w.cells, list_last(x.stack), i + 1, x.stack[:-2], abs((acc.acc + 1) - w.cells) / w.cells <= 0.2 FROM (SELECT w.*, list_concat(w.stack, coalesce(ups.ups, [])) AS more FROM w LEFT JOIN ups USING (id) WHERE NOT fits AND i < 11) w, LATERAL (SELECT w.more AS stack) x JOIN acc ON acc.id = list_last(x.stack) WHERE len(x.stack) > 0) SELECT station, arg_max(id, i) AS id, arg_max(fits, i) AS fits FROM w GROUP BY station)"
_CLIMB = _CLIMB.replace("list_last(x.stack), i + 1, x.stack[:-2]", "list_last(w.more), i + 1, w.more[:-2]").replace(" w, LATERAL (SELECT w.more AS stack) x JOIN acc ON acc.id = list_last(x.stack) WHERE len(x.stack) > 0)", " w JOIN acc ON acc.id = list_last(w.more))")


def _climbed(spark, d):
    f = flow(spark, d)
    acc = materialize(fl.accumulate(f), "acc")
    return f, acc, fl.snap_to_streams(f, acc, acc.where(F.col("acc") >= STREAM).select("id"), _stations(spark, d))


@query(f"WITH {_CLIMB} SELECT station, id, fits FROM climb")
def outlet_climb(spark, d):
    """Stations moved down to a stream and up along it until the cells above fit."""
    return _climbed(spark, d)[2]


@query(f"WITH {_CLIMB}, o AS (SELECT DISTINCT id FROM climb) SELECT o.id AS outlet, down.id FROM down JOIN o ON o.id = down.pos")
def outlet_basins(spark, d):
    f, _, at = _climbed(spark, d)
    return fl.basins_at(f, at)


@query(f"WITH {_CLIMB}, b AS (SELECT station, down.id FROM climb JOIN down ON down.pos = climb.id), w AS (SELECT station, down.id FROM s JOIN down ON down.pos = s.id), j AS (SELECT coalesce(b.station, w.station) AS station, b.id IS NOT NULL AS x, w.id IS NOT NULL AS y FROM b FULL JOIN w ON b.station = w.station AND b.id = w.id) SELECT station, count(*) FILTER (x) AS cells, round(count(*) FILTER (x) * 0.0009, 9) AS area_km2, round((count(*) FILTER (x) - any_value(s.cells)) / any_value(s.cells), 6) AS re, round(count(*) FILTER (x AND y) / count(*), 6) AS csi FROM j JOIN s USING (station) GROUP BY station")
def basin_scores(spark, d):
    """Scorecard of the basins found: cells, area, relative error, and overlap with the basin at the station itself."""
    f, _, at = _climbed(spark, d)
    at, st = materialize(at, "climb"), _stations(spark, d)
    found = fl.basins_at(f, at).join(at.select("station", F.col("id").alias("outlet")), "outlet").select(F.col("station").alias("basin"), F.col("id").alias("r"), F.lit(0).alias("c"))
    wanted = fl.basins_at(f, st).join(st.select("station", F.col("id").alias("outlet")), "outlet").select(F.col("station").alias("basin"), F.col("id").alias("r"), F.lit(0).alias("c"))
    size = found.groupBy("basin").agg(F.count("*").alias("cells"))
    score = zonal.overlap(found, wanted).join(size, "basin").withColumnRenamed("basin", "station").join(st.select("station", F.col("cells").alias("want")), "station")
    return score.select("station", "cells", F.round(F.col("cells") * 0.0009, 9).alias("area_km2"), F.round((F.col("cells") - F.col("want")) / F.col("want"), 6).alias("re"), "csi")


def _started(spark, d):
    lab = materialize(_labelled(spark, d).where("label is not null"), "lab")
    low = zonal.lowest_cells(lab).select("label", F.col("low_r").cast("int").alias("start_r"), F.col("low_c").cast("int").alias("start_c"))
    return lab.join(low, "label").select("label", F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "h", F.lit(0).alias("dir"), "start_r", "start_c")


_BFS = f"{_LAB}, low AS (SELECT label, arg_min(r * {WIDE} + c, (h, r, c)) AS id FROM lab WHERE label IS NOT NULL GROUP BY label), le AS MATERIALIZED (SELECT r * {WIDE} + c AS a, (r + dr) * {WIDE} + c + dc AS b, k FROM pair WHERE label = nlabel), tree AS MATERIALIZED (WITH RECURSIVE t(id, path, k) USING KEY (id) AS (SELECT id, '', -1 FROM low UNION SELECT b, min(t.path || le.k), arg_min(le.k, t.path || le.k) FROM t JOIN le ON le.a = t.id LEFT JOIN recurring.t o ON o.id = le.b WHERE o.id IS NULL GROUP BY b) SELECT * FROM t)"


@query(f"WITH {_BFS} SELECT label, r, c, CAST(CASE WHEN k < 0 THEN 0 ELSE 1 << ((k + 4) % 8) END AS INT) AS dir FROM lab JOIN tree ON tree.id = r * {WIDE} + c WHERE label IS NOT NULL")
def flat_directions(spark, d):
    """Directions of depressions routed level by level from their lowest cell."""
    return route.route_depressions(_started(spark, d), True)


@query()
def flood_directions(spark, d):
    """Directions of depressions routed by the flood from their lowest cell."""
    return route.route_depressions(_started(spark, d))


_SPILT = f"{NEAR}, start AS (SELECT r, c, h FROM dem WHERE r = 0 OR c = 0 OR r = {_LAST} OR c = {WIDE} - 1 ORDER BY h, r, c LIMIT 1), rise AS MATERIALIZED (WITH RECURSIVE fl(r, c, f) USING KEY (r, c) AS (SELECT r, c, h FROM start UNION SELECT n.nr, n.nc, min(greatest(n.nh, f.f)) FROM fl f JOIN near n ON n.r = f.r AND n.c = f.c LEFT JOIN recurring.fl o ON o.r = n.nr AND o.c = n.nc WHERE o.f IS NULL OR greatest(n.nh, f.f) < o.f GROUP BY n.nr, n.nc) SELECT * FROM fl)"


@query(f"WITH {_SPILT} SELECT r, c, f AS level, true AS arrives FROM rise")
def region_flood(spark, d):
    """The whole raster as one region, flooded from the lowest cell of its border: levels, and whether each cell's way ends there."""
    cells, n, last = materialize(dem(spark, d), "region"), ncols(spark, d), nrows(spark, d) - 1
    rim = cells.where((F.col("r") == 0) | (F.col("c") == 0) | (F.col("r") == last) | (F.col("c") == n - 1))
    start = rim.agg(F.min(F.struct("h", "r", "c")).alias("s")).select(F.col("s.r").alias("start_r"), F.col("s.c").alias("start_c"))
    region = cells.crossJoin(F.broadcast(start)).select(F.lit(0).alias("label"), "r", "c", "h", F.lit(0).alias("dir"), "start_r", "start_c")
    return _flooded(materialize(region, "region"), n).drop("label")


@query()
def exorheic_correction(spark, d):
    """Depressions re-routed from their outlets, those of even labels as flats."""
    lab = materialize(_labelled(spark, d), "lab")
    g = zonal.geometry(lab).withColumn("sink_type", F.when(F.col("label") % 2 == 0, 1).otherwise(F.col("sink_type")))
    return route.correct_depressions(focal.d8(dem(spark, d)).join(lab.select("r", "c", "label"), ["r", "c"]), g)


_PARTS = f"WITH {NEAR}, m AS MATERIALIZED (SELECT r, c, r * {WIDE} + c AS id, r // 25 * 100 + c // 16 AS label FROM dem WHERE h < 0.02), e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM near JOIN m a ON a.r = near.r AND a.c = near.c JOIN m b ON b.r = near.nr AND b.c = near.nc WHERE a.label = b.label), w AS (WITH RECURSIVE w AS (SELECT id, id AS pos FROM m UNION SELECT w.id, b FROM w JOIN e ON e.a = w.pos) SELECT * FROM w), p AS MATERIALIZED (SELECT m.*, part FROM m JOIN (SELECT id, min(pos) AS part FROM w GROUP BY id) USING (id)), x AS (SELECT *, min(r) OVER s AS r0, max(r) OVER s AS r1, min(c) OVER s AS c0, max(c) OVER s AS c1, min(r) OVER l AS lr0, max(r) OVER l AS lr1, min(c) OVER l AS lc0, max(c) OVER l AS lc1 FROM p WINDOW s AS (PARTITION BY label, part), l AS (PARTITION BY label))"


@query(f"{_PARTS} SELECT label, r, c FROM x WHERE r0 = lr0 AND r1 = lr1 AND c0 = lc0 AND c1 = lc1")
def spanning_parts(spark, d):
    """Low ground of each tile that hangs together from side to side of its box."""
    low = dem(spark, d).where("h < 0.02").select("r", "c", (F.floor(F.col("r") / 25) * 100 + F.floor(F.col("c") / 16)).alias("label"))
    return components.spanning_parts(low, ncols(spark, d)).select("label", "r", "c")


@query()
def endorheic_routing(spark, d):
    """Connected low ground routed inside itself, towards its water bodies where it has several."""
    n = ncols(spark, d)
    low = dem(spark, d).where("h < 0.02")
    lab = components.label_mask(low, n)
    cells = focal.d8(low).withColumn("id", grid.cell_id(n)).join(lab, "id").select("label", "r", "c", "h", F.col("dir").cast("int").alias("dir"))
    return route.route_endorheic(cells, _occurrence(spark, d).select("r", "c", "occ"), n, 20, 4)


_ORDERED = f'{DOWN}, so AS (WITH RECURSIVE w AS (SELECT 1 AS k, id FROM flow UNION SELECT m.k + 1, down.pos FROM (SELECT w.k, f.next_id AS x FROM w JOIN flow f ON f.id = w.id WHERE f.next_id IS NOT NULL GROUP BY w.k, f.next_id HAVING count(*) > 1) m JOIN down ON down.id = m.x) SELECT * FROM w), od AS MATERIALIZED (SELECT id, max(k) AS o FROM so GROUP BY id HAVING max(k) > 1)'
_LINED = f"{_ORDERED}, goes AS MATERIALIZED (SELECT f.id, f.next_id, a.o, coalesce(b.o = a.o, false) AS goes_on FROM flow f JOIN od a ON a.id = f.id LEFT JOIN od b ON b.id = f.next_id), ln AS (WITH RECURSIVE w AS (SELECT id AS line, o, id, 0 AS step, true AS own FROM goes WHERE id NOT IN (SELECT next_id FROM goes WHERE goes_on) UNION ALL SELECT w.line, w.o, g.next_id, w.step + 1, g.goes_on FROM w JOIN goes g ON g.id = w.id WHERE w.own AND g.next_id IS NOT NULL) SELECT * FROM w)"


@query(f'WITH {_LINED} SELECT line, CAST(o AS INT) AS "order", i - 1 AS step, round(20 + (id % {WIDE} + 0.5) * 0.25, 6) AS x, round(50 - (id // {WIDE} + 0.5) * 0.25, 6) AS y FROM (SELECT *, row_number() OVER (PARTITION BY line ORDER BY step) AS i, count(*) OVER (PARTITION BY line) AS n FROM ln) WHERE n > 1')
def river_lines(spark, d):
    """Rivers of the second order and more as lines with coordinates, each to the cell beyond its end."""
    f, n = flow(spark, d), ncols(spark, d)
    lines = fl.river_lines(f, materialize(fl.strahler(f).where(F.col("order") > 1), "orders"))
    found = fl.line_strings(lines, n, 20.0, 50.0, 0.25)
    return found.select("line", "order", F.posexplode("points").alias("step", "p")).select("line", "order", F.col("step").cast("long").alias("step"), F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


@query(f"WITH {ACC}, st AS (SELECT id FROM acc WHERE acc >= {STREAM}), up AS (SELECT f.next_id AS id, count(*) AS n FROM flow f JOIN st USING (id) WHERE f.next_id IS NOT NULL GROUP BY 1), ends AS MATERIALIZED (SELECT f.id FROM flow f JOIN st USING (id) LEFT JOIN up ON up.id = f.next_id WHERE f.next_id IS NULL OR up.n > 1 OR f.next_id NOT IN (SELECT id FROM st)), d AS (SELECT down.id, down.pos, down.step FROM down JOIN ends ON ends.id = down.pos) SELECT id, arg_min(pos, step) AS link FROM d GROUP BY id")
def link_basins(spark, d):
    """Basins of all stream links: each cell with the first end of a link on its way."""
    f = flow(spark, d)
    acc = materialize(fl.accumulate(f), "acc")
    streams = materialize(f.join(acc.where(F.col("acc") >= STREAM).select("id"), "id", "left_semi"), "streams")
    return fl.link_basins(f, streams).select("id", "link")


_RINGS = f"{_LAB}, bd AS MATERIALIZED (SELECT dem.r, dem.c, dirs.dir, dirs.nr, dirs.nc FROM dem JOIN ({{}}) dirs USING (r, c)), rg AS (SELECT ring.label, row_number() OVER (PARTITION BY ring.label ORDER BY ring.r, ring.c) AS seq, ring.r, ring.c, ring.h, bd.dir, lab.label AS to_label FROM ring JOIN bd ON bd.r = ring.r AND bd.c = ring.c LEFT JOIN lab ON lab.r = bd.nr AND lab.c = bd.nc)"
_D8_ALONE = "SELECT dem.r, dem.c, coalesce(1 << k, 0) AS dir, nr, nc FROM dem LEFT JOIN (SELECT r, c, k, nr, nc, row_number() OVER (PARTITION BY r, c ORDER BY (h - nh) / f DESC, k) AS i FROM near WHERE nh <= h) b ON b.r = dem.r AND b.c = dem.c AND b.i = 1"


@query(f"WITH {_RINGS.format(_D8_ALONE)}, l AS (SELECT label, list({{'h': h, 'r': r, 'c': c, 'dir': dir, 'inside': coalesce(to_label = label, false), 'done': false}} ORDER BY seq) AS ring FROM rg GROUP BY label), o AS (SELECT label, list_reduce(list_prepend({{'h': CAST('inf' AS DOUBLE), 'r': -1, 'c': -1, 'dir': 0, 'inside': false, 'done': false}}, ring), lambda o, x: CASE WHEN o.done OR x.h >= o.h THEN o WHEN x.dir = 0 THEN {{'h': x.h, 'r': x.r, 'c': x.c, 'dir': x.dir, 'inside': x.inside, 'done': true}} WHEN x.inside THEN o ELSE x END) AS o FROM l) SELECT label, o.r AS r, o.c AS c, o.h AS h FROM o WHERE o.r >= 0")
def outlet_scan(spark, d):
    """Outlets of depressions as a scan of the ring finds them, the first cell without a direction ending it."""
    lab = materialize(_labelled(spark, d), "lab")
    dirs = focal.d8(dem(spark, d)).select("r", "c", F.col("dir").cast("int").alias("dir"))
    to = materialize(dirs.select("r", "c", "dir", (F.col("r") + grid.row_step("dir")).alias("tr"), (F.col("c") + grid.column_step("dir")).alias("tc")), "ring")
    ring = focal.boundary_ring(lab).join(to, ["r", "c"]).join(lab.select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("label").alias("to_label")), ["tr", "tc"], "left")
    return zonal.outlet_scan(ring.withColumn("seq", F.struct("r", "c")))


@query(f"WITH {_FWALK}, done AS (SELECT DISTINCT w.id FROM walk w JOIN flawed f ON f.id = w.pos WHERE f.next_id IS NULL) SELECT id, true AS arrives, true AS as_before FROM done UNION ALL SELECT id, true, NULL FROM flawed ANTI JOIN done USING (id)")
def cycle_reversal(spark, d):
    """Cycles led out of their basins by turning round the way from the nearest exit: whether each cell arrives at a terminal,
    and whether what did so before is as it was."""
    f, n = _flawed(spark, d), ncols(spark, d)
    near = grid.neighbours(dem(spark, d).select("r", "c", grid.cell_id(n).alias("id")), "id")
    near = near.select("id", F.posexplode(F.array(*(F.col(f"id_{k}") for k in range(8)))).alias("k", "to")).where("to is not null")
    fixed = materialize(fl.reverse_cycles(f, near), "fixed")
    bad = materialize(fl.cycle_cells(f).select("id"), "bad")
    ends = fl.terminal_labels(fixed).select("id", F.col("label").isNotNull().alias("arrives"))
    same = f.join(bad, "id", "left_anti").join(fixed.withColumnRenamed("next_id", "now"), "id").select("id", F.col("now").eqNullSafe(F.col("next_id")).alias("as_before"))
    return ends.join(same, "id", "left")


@query(f"WITH {DOWN}, {_FILLED.replace(NEAR + ', ', '')}, bs AS MATERIALIZED (SELECT down.id, down.pos AS label FROM down JOIN flow f ON f.id = down.pos WHERE f.next_id IS NULL), nb AS MATERIALIZED (SELECT r * {WIDE} + c AS id, nr * {WIDE} + nc AS nid, k FROM near), fd AS MATERIALIZED (SELECT r * {WIDE} + c AS id, r, c, f FROM filled), lk AS MATERIALIZED (SELECT nb.id, a.label, min(nb.k) AS k FROM nb JOIN bs a ON a.id = nb.id JOIN bs b ON b.id = nb.nid WHERE a.label <> b.label GROUP BY ALL), x AS (SELECT lk.label, fd.r, fd.c, fd.f, lk.k FROM lk JOIN fd USING (id)) SELECT label, r, c, CAST(1 << k AS INT) AS dir FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY f, r, c) AS i FROM x) WHERE i = 1")
def pit_exits(spark, d):
    """Where the basin of each pit is left over the filled surface."""
    n = ncols(spark, d)
    basins = fl.terminal_labels(flow(spark, d)).select(F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"), "label")
    f = route.fill(dem(spark, d)).select("r", "c", "f")
    return focal.pit_exits(materialize(basins.join(f, ["r", "c"]), "pits")).withColumn("dir", F.col("dir").cast("int"))


@query(f"WITH {_ORDERED} SELECT dem.r, string_agg(CAST(coalesce(od.o, 0) AS VARCHAR), ',' ORDER BY dem.c) AS orders FROM dem LEFT JOIN od ON od.id = dem.r * {WIDE} + dem.c GROUP BY dem.r")
def order_raster(spark, d):
    """Orders of the second and more as rows of a raster, 0 elsewhere."""
    n = ncols(spark, d)
    orders = fl.strahler(flow(spark, d)).where(F.col("order") > 1)
    cells = dem(spark, d).withColumn("id", grid.cell_id(n)).join(orders, "id", "left").select("r", "c", F.coalesce("order", F.lit(0)).alias("o"))
    return grid.arrays_from_cells(cells, "o").select("r", F.array_join(F.col("values").cast("array<string>"), ",").alias("orders"))
