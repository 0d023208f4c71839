"""Queries over lines, polygons, the ellipsoid and other grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import components, outline
from ..operators.ellipsoid import GRS80, WGS84, Albers, cell_area, distance
from ..operators.overlay import overlay_areas
from ..operators.vector import nearest_lines
from ..operators.warp import Grid, warp_bilinear, warp_nearest
from ..storage import materialize
from .inputs import DEM, WATER, WIDE, dem, ncols, nrows, query, table, water
from .tables import _ST, _stations

_LINES = "ln AS (SELECT s_suppkey AS line, CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE) AS x0, CAST((s_suppkey * 31) % 140 - 60 AS DOUBLE) AS y0, CAST((s_suppkey * 97) % 360 - 180 AS DOUBLE) AS x1, CAST((s_suppkey * 71) % 140 - 60 AS DOUBLE) AS y1 FROM supplier)"


@query(f"WITH {_ST}, {_LINES}, a AS (SELECT id AS point, line, x0, y0, x1 - x0 AS dx, y1 - y0 AS dy, CAST(lon AS DOUBLE) AS x, CAST(lat AS DOUBLE) AS y FROM st, ln), t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE least(greatest(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM a), d AS (SELECT point, line, (x - (x0 + t * dx)) * (x - (x0 + t * dx)) + (y - (y0 + t * dy)) * (y - (y0 + t * dy)) AS d2 FROM t) SELECT point, arg_min(line, (d2, line)) AS line, round(min(d2), 9) AS d2 FROM d GROUP BY point")
def nearest_line(spark, d):
    """The nearest of many long lines for each station, however far."""
    points = _stations(spark, d).select(F.col("id").alias("point"), F.col("lon").alias("x"), F.col("lat").alias("y"))
    at = lambda a, m, b: (F.col("s_suppkey") * a % m - b).cast("double")
    lines = table(spark, d, "supplier").select(F.col("s_suppkey").alias("line"), at(53, 360, 180).alias("x0"), at(31, 140, 60).alias("y0"), at(97, 360, 180).alias("x1"), at(71, 140, 60).alias("y1"))
    return nearest_lines(points, lines, 8.0).select("point", "line", F.round("d2", 9).alias("d2"))


def _vincenty_sql(pairs: str) -> str:
    """Rows id, metres of pairs (id, lon1, lat1, lon2, lat2), a row for each step of the iteration."""
    a, b, f = WGS84.a, WGS84.b, WGS84.f
    angles = "sqrt((c2 * sin(lam)) ** 2 + (c1 * s2 - s1 * c2 * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2 * cos(lam) AS cs"
    more = "SELECT *, 1 - sa * sa AS c2a FROM (SELECT *, atan2(ss, cs) AS sigma, CASE WHEN ss = 0 THEN 0 ELSE c1 * c2 * sin(lam) / ss END AS sa FROM (SELECT *, " + angles + " FROM {})) z"
    mid = "SELECT *, CASE WHEN c2a = 0 THEN 0 ELSE cs - 2 * s1 * s2 / c2a END AS m FROM (" + more + ") y"
    turn = f"SELECT *, {f!r}::DOUBLE / 16 * c2a * (4 + {f!r}::DOUBLE * (4 - 3 * c2a)) AS c FROM (" + mid + ") x"
    ends = f"SELECT id, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2, l, l AS lam, CAST('inf' AS DOUBLE) AS was, 0 AS i FROM (SELECT id, atan((1 - {f!r}::DOUBLE) * tan(radians(lat1))) AS u1, atan((1 - {f!r}::DOUBLE) * tan(radians(lat2))) AS u2, radians(lon2 - lon1) AS l FROM ({pairs}))"
    step = f"SELECT id, s1, c1, s2, c2, l, l + (1 - c) * {f!r}::DOUBLE * sa * (sigma + c * ss * (m + c * cs * (2 * m * m - 1))), lam, i + 1 FROM (" + turn.format("v") + ") w WHERE abs(lam - was) > 1e-12 AND i < 200"
    last = "SELECT id, arg_max(s1, i) AS s1, arg_max(c1, i) AS c1, arg_max(s2, i) AS s2, arg_max(c2, i) AS c2, arg_max(lam, i) AS lam, arg_max(was, i) AS was FROM it GROUP BY id"
    w = f"c2a * ({a!r}::DOUBLE ** 2 - {b!r}::DOUBLE ** 2) / {b!r}::DOUBLE ** 2"
    big, small = "1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))", "w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))"
    less = "small * ss * (m + small / 4 * (cs * (2 * m * m - 1) - small / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3)))"
    return f"it AS (WITH RECURSIVE v AS ({ends} UNION ALL {step}) SELECT * FROM v), fin AS (SELECT *, {big} AS big, {small} AS small FROM (SELECT *, {w} AS w FROM ({mid.format('(' + last + ')')}))) SELECT id, abs(lam - was) <= 1e-12 AND abs(lam) <= pi() AS converged, CASE WHEN abs(lam - was) <= 1e-12 AND abs(lam) <= pi() THEN round({b!r}::DOUBLE * big * (sigma - ({less})), 3) END AS metres FROM fin"


_PAIRS = "SELECT id, CAST(lon AS DOUBLE) AS lon1, CAST(lat AS DOUBLE) AS lat1, CAST((id * 7) % 360 - 180 AS DOUBLE) AS lon2, CAST((id * 11) % 170 - 85 AS DOUBLE) AS lat2 FROM st"


@query(f"WITH {_ST}, {_vincenty_sql(_PAIRS)}")
def ellipsoid_distance(spark, d):
    """Metres along geodesics between stations and places all over the globe."""
    s = _stations(spark, d)
    at = lambda k, m, b: (F.col("id") * k % m - b).cast("double")
    found = distance(F.col("lon").cast("double"), F.col("lat").cast("double"), at(7, 360, 180), at(11, 170, 85))
    return s.select("id", found.alias("s")).select("id", "s.converged", F.round("s.metres", 3).alias("metres"))


def _zone_sql(lat: str) -> str:
    e = WGS84.e2**0.5
    return f"({WGS84.b!r}::DOUBLE ** 2 / 2 * (sin(radians({lat})) / (1 - {WGS84.e2!r}::DOUBLE * sin(radians({lat})) ** 2) + ln((1 + {e!r}::DOUBLE * sin(radians({lat}))) / (1 - {e!r}::DOUBLE * sin(radians({lat})))) / (2 * {e!r}::DOUBLE)))"


@query(f"WITH {WATER}, x AS (SELECT label, id // {WIDE} AS r, count(*) AS n FROM comp GROUP BY ALL) SELECT label, round(sum(n * radians(0.1::DOUBLE) * ({_zone_sql('60 - (r + 1) * 0.1::DOUBLE + 0.1::DOUBLE')} - {_zone_sql('60 - (r + 1) * 0.1::DOUBLE')})) / 1e6, 6) AS km2 FROM x GROUP BY label")
def ellipsoid_area(spark, d):
    """Areas of water bodies on the ellipsoid, cells being a tenth of a degree."""
    n = ncols(spark, d)
    own = components.label_mask(water(spark, d), n).select("label", F.floor(F.col("id") / n).alias("r"))
    rows = own.groupBy("label", "r").agg(F.count("*").alias("n"))
    return rows.groupBy("label").agg(F.round(F.sum(F.col("n") * cell_area(60 - (F.col("r") + 1) * 0.1, 0.1, 0.1)) / 1e6, 6).alias("km2"))


#: The raster's cells of a twentieth of a degree, and a grid of 5 km in an equal-area projection around it.
_ALBERS, _DEGREES, _METRES, _ACROSS = Albers(), 0.05, 5000.0, 80


def _albers_sql() -> str:
    n, c, rho0 = _ALBERS.constants
    e2, a = GRS80.e2, GRS80.a
    series = f"beta + {e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040!r}::DOUBLE * sin(2 * beta) + {23 * e2**2 / 360 + 251 * e2**3 / 3780!r}::DOUBLE * sin(4 * beta) + {761 * e2**3 / 45360!r}::DOUBLE * sin(6 * beta)"
    cells = f"SELECT i // {_ACROSS} AS r, i % {_ACROSS} AS c, -420000 + (i % {_ACROSS} + 0.5::DOUBLE) * 5000 AS x, 1920000 - (i // {_ACROSS} + 0.5::DOUBLE) * 5000 AS y FROM (SELECT unnest(range((SELECT (max(vec_id) + 1) * 6 // 5 FROM embeddings) * {_ACROSS})) AS i)"
    polar = f"SELECT *, x * x + ({rho0!r}::DOUBLE - y) * ({rho0!r}::DOUBLE - y) AS rho2, degrees(atan2(x, {rho0!r}::DOUBLE - y)) / {n!r}::DOUBLE - 96 AS lon FROM ({cells})"
    beta = f"SELECT *, asin(({c!r}::DOUBLE - rho2 * {n * n!r}::DOUBLE / {a**2!r}::DOUBLE) / {n!r}::DOUBLE / {_ALBERS._q(90)!r}::DOUBLE) AS beta FROM ({polar})"
    return f"tgt AS MATERIALIZED (SELECT r, c, (40 - degrees({series})) / {_DEGREES}::DOUBLE AS fy, (lon + 100) / {_DEGREES}::DOUBLE AS fx FROM ({beta}))"


def _grids(spark, d) -> tuple[Grid, Grid]:
    rows = nrows(spark, d)
    return Grid(-100.0, 40.0, _DEGREES, rows, ncols(spark, d)), Grid(-420000.0, 1920000.0, _METRES, rows * 6 // 5, _ACROSS)


@query(f"WITH {DEM}, {_albers_sql()} SELECT tgt.r, tgt.c, dem.h FROM tgt JOIN dem ON dem.r = CAST(floor(fy) AS BIGINT) AND dem.c = CAST(floor(fx) AS BIGINT)")
def albers_nearest(spark, d):
    """The raster, in degrees, on a grid in metres: nearest cells."""
    return warp_nearest(dem(spark, d), *_grids(spark, d), _ALBERS.inverse)


@query(f"WITH {DEM}, {_albers_sql()}, w AS (SELECT r, c, CAST(floor(fy - 0.5) AS BIGINT) AS r0, CAST(floor(fx - 0.5) AS BIGINT) AS c0, fy - 0.5 - floor(fy - 0.5) AS y, fx - 0.5 - floor(fx - 0.5) AS x FROM tgt WHERE fy >= 0 AND fx >= 0 AND fy < (SELECT max(r) + 1 FROM dem) AND fx < {WIDE}), q AS (SELECT w.r, w.c, dem.h, CASE i WHEN 1 THEN y ELSE 1 - y END * CASE j WHEN 1 THEN x ELSE 1 - x END AS g FROM w, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(i, j), dem WHERE dem.r = r0 + i AND dem.c = c0 + j AND dem.h IS NOT NULL) SELECT r, c, round(sum(h * g) / sum(g), 5) AS h FROM q WHERE g > 0 GROUP BY ALL")
def albers_bilinear(spark, d):
    """The same, with means of the four cells around."""
    return warp_bilinear(dem(spark, d), *_grids(spark, d), _ALBERS.inverse).select("r", "c", F.round("h", 5).alias("h"))


@query(f"WITH {DEM}, g AS (SELECT floor(20.1::DOUBLE / 0.25) AS w, ceil(50.07::DOUBLE / 0.25) AS n, ceil((20.1::DOUBLE + {WIDE} * 0.25::DOUBLE) / 0.25 - 1e-9) AS e, floor((50.07::DOUBLE - (SELECT max(r) + 1 FROM dem) * 0.25::DOUBLE) / 0.25 + 1e-9) AS s), t AS (SELECT unnest(range(CAST(n - s AS BIGINT))) AS r, w, n, e FROM g), u AS (SELECT r, unnest(range(CAST(e - w AS BIGINT))) AS c, w * 0.25::DOUBLE AS west, n * 0.25::DOUBLE AS north FROM t) SELECT u.r, u.c, dem.h FROM u JOIN dem ON dem.r = CAST(floor((50.07::DOUBLE - (north - (u.r + 0.5) * 0.25)) / 0.25) AS BIGINT) AND dem.c = CAST(floor((west + (u.c + 0.5) * 0.25 - 20.1::DOUBLE) / 0.25) AS BIGINT)")
def grid_snap(spark, d):
    """The raster on the grid of whole multiples of its cell size."""
    source = Grid(20.1, 50.07, 0.25, nrows(spark, d), ncols(spark, d))
    return warp_nearest(dem(spark, d), source, source.aligned())


@query(f"WITH {WATER}, x AS (SELECT label, id // {WIDE} AS r, id % {WIDE} AS c FROM comp), n AS (SELECT label, count(*) AS n FROM x GROUP BY label) SELECT label AS a, (r // 20) * 1000 + c // 20 AS b, CAST(any_value(n) AS DOUBLE) AS area_a, 400::DOUBLE AS area_b, CAST(count(*) AS DOUBLE) AS shared, round(count(*) / (any_value(n) + 400 - count(*)), 6) AS csi FROM x JOIN n USING (label) GROUP BY 1, 2")
def polygon_overlay(spark, d):
    """Outlines of water bodies over squares of 20 cells: shared areas, from edges alone."""
    n = ncols(spark, d)
    own = components.label_mask(water(spark, d), n).select("label", F.floor(F.col("id") / n).alias("r"), (F.col("id") % n).alias("c"))
    e = outline.outlines(materialize(own, "overlay"), n)
    dx, dy = F.when(F.col("d") == 0, 1).when(F.col("d") == 2, -1).otherwise(0), F.when(F.col("d") == 1, 1).when(F.col("d") == 3, -1).otherwise(0)
    left = e.select(F.col("label").alias("poly"), F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + dx).alias("x1"), (F.col("y") + dy).alias("y1"))
    squares = dem(spark, d).select(F.floor(F.col("r") / 20).alias("i"), F.floor(F.col("c") / 20).alias("j")).distinct()
    corner = lambda a, b: F.struct(((F.col("j") + a) * 20).alias("x"), ((F.col("i") + b) * 20).alias("y"))
    ring = [corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)]
    sides = F.array(*(F.struct(p.alias("p"), q.alias("q")) for p, q in zip(ring, [*ring[1:], ring[0]])))
    right = squares.select((F.col("i") * 1000 + F.col("j")).alias("poly"), F.explode(sides).alias("e")).select("poly", F.col("e.p.x").alias("x0"), F.col("e.p.y").alias("y0"), F.col("e.q.x").alias("x1"), F.col("e.q.y").alias("y1"))
    return overlay_areas(left, right, 32.0, 8.0).select("a", "b", "area_a", "area_b", F.round("shared", 6).alias("shared"), F.round("csi", 6).alias("csi"))
