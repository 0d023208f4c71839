"""Lines, ellipsoid, projection, grids and overlays against brute force and published values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import vector
from rillflow.operators.ellipsoid import GRS80, Albers, Ellipsoid, cell_area, distance, edge_area, region_area
from rillflow.operators.overlay import overlay_areas
from rillflow.operators.vector import nearest_lines
from rillflow.operators.warp import Grid, warp_bilinear, warp_nearest


def gap(x, y, x0, y0, x1, y1):
    dx, dy = x1 - x0, y1 - y0
    t = 0.0 if dx == dy == 0 else min(max(((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
    px, py = x0 + t * dx, y0 + t * dy
    return (x - px) * (x - px) + (y - py) * (y - py)


@pytest.mark.parametrize("width", [1.5, 40.0])
def test_nearest_lines_at_any_distance(spark, width):
    rng = random.Random(3)
    lines = [(i % 17, *(rng.uniform(-20, 20) for _ in range(2))) for i in range(40)]
    lines = [(k, x, y, x + rng.choice((0, 0.2, 3, 25)), y + rng.choice((0, -1, 8))) for k, x, y in lines] + [(99, 500.0, 500.0, 500.0, 500.0), (98, 500.0, 500.0, 500.0, 500.0), (1, None, 0.0, 0.0, 0.0)]
    points = [(i, rng.uniform(-25, 25), rng.uniform(-25, 25)) for i in range(60)] + [(900, 1e5, -3e4), (901, 499.0, 502.0), (902, -20.0, 20.0), (903, None, 1.0)]
    got = nearest_lines(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(lines, "line long, x0 double, y0 double, x1 double, y1 double"), width)
    want = {p: min((gap(x, y, *s[1:]), s[0]) for s in lines if s[1] is not None) for p, x, y in points if x is not None}
    assert {r["point"]: (r["d2"], r["line"]) for r in got.collect()} == want
    assert nearest_lines(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame([], "line long, x0 double, y0 double, x1 double, y1 double"), width).count() == 0


def test_equal_points_and_segments_are_looked_for_once(spark, monkeypatch):
    rng = random.Random(5)
    places = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(4)]
    ways = [tuple(rng.uniform(-9, 9) for _ in range(4)) for _ in range(3)]
    points, lines = [(i, *places[i % 4]) for i in range(400)], [(i, *ways[i % 3]) for i in range(5, 305)]
    kept, real = [], vector.materialize
    monkeypatch.setattr(vector, "materialize", lambda df, label: (kept.append(real(df, label)), kept[-1])[1])
    got = nearest_lines(spark.createDataFrame(points, "point long, x double, y double"), spark.createDataFrame(lines, "line long, x0 double, y0 double, x1 double, y1 double"), 4.0)
    assert {r["point"]: (r["d2"], r["line"]) for r in got.collect()} == {p: min((gap(x, y, *s[1:]), s[0]) for s in lines) for p, x, y in points}
    assert max(df.count() for df in kept) < 100


def test_published_lines(spark):
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    flinders, buninyong = (dms(144, 25, 29.52440), dms(-37, 57, 3.72030)), (dms(143, 55, 35.38390), dms(-37, 39, 10.15610))
    jfk, lhr = (-73.8, 40.6), (-0.5, 51.6)
    rows = [(1, *flinders, *buninyong), (2, *jfk, *lhr), (3, 5.0, 5.0, 5.0, 5.0), (4, 0.0, 0.0, 179.9, 0.1), (5, 0.0, 0.0, 1.0, 0.0), (6, 0.0, -90.0, 0.0, 90.0), (7, None, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double")
    at = [F.col(k) for k in "abcd"]
    got = {r["id"]: (r["w"], r["g"]) for r in df.select("id", distance(*at).alias("w"), distance(*at, GRS80).alias("g")).collect()}
    assert round(got[1][1]["metres"], 3) == 54972.271
    assert round(got[2][0]["metres"], 3) == 5551759.400
    assert got[3][0]["metres"] == 0 and got[3][0]["converged"]
    assert got[4][0]["metres"] is None and not got[4][0]["converged"]
    assert round(got[5][0]["metres"], 3) == round(6378137.0 * math.pi / 180, 3)
    assert round(got[6][0]["metres"], 3) == 20003931.459
    assert got[7][0]["metres"] is None


def test_areas_of_zones(spark):
    one = spark.range(1)
    # The whole ellipsoid, and a sphere of nearly no flattening.
    whole = one.select(cell_area(F.lit(-90.0), 180.0, 360.0).alias("x")).first()["x"]
    assert abs(whole - 510065621724088.44) < 1
    ball = one.select(cell_area(F.lit(10.0), 5.0, 7.0, Ellipsoid(1000.0, 1e-9)).alias("x")).first()["x"]
    assert abs(ball / (1e6 * math.radians(7) * (math.sin(math.radians(15)) - math.sin(math.radians(10)))) - 1) < 1e-7
    ring = [(0.0, 10.0), (3.0, 10.0), (3.0, 8.0), (1.0, 8.0), (1.0, 6.0), (0.0, 6.0)]
    edges = spark.createDataFrame([(*a, *b) for a, b in zip(ring, [*ring[1:], ring[0]])], "a double, b double, c double, d double")
    got = edges.agg(F.sum(edge_area(*(F.col(k) for k in "abcd"))).alias("x")).first()["x"]
    cells = spark.createDataFrame([(1, r) for r in range(4) for c in range(3) if r < 2 or c < 1], "g int, r int")
    want = region_area(cells, "g", 10.0, 1.0).first()["m2"]
    assert abs(got - want) < 1e-3 * 1e3 and abs(got / want - 1) < 1e-12


def test_albers(spark):
    # The worked example of the published formulas, on the ellipsoid of 1866.
    clarke = Ellipsoid(6378206.4, 1 - math.sqrt(1 - 0.00676866))
    x, y = Albers(on=clarke).forward(F.lit(-75.0), F.lit(35.0))
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert abs(r["x"] - 1885472.7) < 0.1 and abs(r["y"] - 1535925.0) < 0.1
    p = Albers()
    df = spark.createDataFrame([(-120.0, 48.0), (-96.0, 23.0), (-70.0, 30.0), (-96.0, 60.0)], "lon double, lat double")
    x, y = p.forward(F.col("lon"), F.col("lat"))
    back = df.select("lon", "lat", x.alias("x"), y.alias("y"))
    lon, lat = p.inverse(F.col("x"), F.col("y"))
    for r in back.select("lon", "lat", lon.alias("lon2"), lat.alias("lat2")).collect():
        assert abs(r["lon"] - r["lon2"]) < 1e-9 and abs(r["lat"] - r["lat2"]) < 1e-7


def test_grids(spark):
    rng = random.Random(2)
    h = {(r, c): rng.random() for r in range(9) for c in range(7) if (r, c) != (4, 4)}
    cells = spark.createDataFrame([(*x, v) for x, v in h.items()], "r int, c int, h double")
    source = Grid(0.3, 9.7, 1.0, 9, 7)
    snapped = source.aligned()
    assert snapped == Grid(0.0, 10.0, 1.0, 10, 8) == snapped.aligned()
    got = {(r["r"], r["c"]): r["h"] for r in warp_nearest(cells, source, snapped).collect()}
    want = {}
    for r in range(10):
        for c in range(8):
            at = (math.floor((9.7 - (10 - (r + 0.5))) / 1.0), math.floor((c + 0.5 - 0.3) / 1.0))
            if at in h:
                want[r, c] = h[at]
    assert got == want
    fine = Grid(0.3, 9.7, 0.4, 23, 18)
    got = {(r["r"], r["c"]): r["h"] for r in warp_bilinear(cells, source, fine).collect()}
    for r in range(23):
        for c in range(18):
            y, x = (r + 0.5) * 0.4, (c + 0.5) * 0.4
            if not (y < 9 and x < 7):
                assert (r, c) not in got
                continue
            y, x = y - 0.5, x - 0.5
            r0, c0 = math.floor(y), math.floor(x)
            w = {(r0 + i, c0 + j): (y - r0 if i else 1 - y + r0) * (x - c0 if j else 1 - x + c0) for i in (0, 1) for j in (0, 1)}
            w = {k: v for k, v in w.items() if k in h and v > 0}
            assert abs(got[r, c] - sum(h[k] * v for k, v in w.items()) / sum(w.values())) < 1e-9


def clipped(a, b):
    """Area of the part of polygon a inside the convex polygon b (counter-clockwise), half-plane by half-plane."""
    for (x0, y0), (x1, y1) in zip(b, [*b[1:], b[0]]):
        side = lambda p: (x1 - x0) * (p[1] - y0) - (y1 - y0) * (p[0] - x0)  # noqa: B023, E731
        out = []
        for p, q in zip(a, [*a[1:], *a[:1]]):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        a = out
    return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, [*a[1:], *a[:1]]))) / 2


def convex(rng, x, y, size):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 7)))
    return [(x + size * math.cos(t), y + size * math.sin(t)) for t in turns]


def edge_frame(spark, polygons):
    rows = [(k, *map(float, (*p, *q))) for k, rings in polygons.items() for ring in rings for p, q in zip(ring, [*ring[1:], ring[0]])]
    return spark.createDataFrame(rows, "poly long, x0 double, y0 double, x1 double, y1 double")


def test_overlay_of_slanted_polygons(spark):
    rng = random.Random(4)
    a = {i: convex(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(1, 6)) for i in range(8)}
    b = {i: convex(rng, rng.uniform(-9, 9), rng.uniform(-9, 9), rng.uniform(1, 6)) for i in range(7)}
    want = {(i, j): clipped(p, q) for i, p in a.items() for j, q in b.items()}
    turned = {i: [p[::-1] if i % 2 else p] for i, p in a.items()}
    for bucket, strip in ((2.5, 0.7), (50.0, 50.0)):
        got = {(r["a"], r["b"]): r for r in overlay_areas(edge_frame(spark, turned), edge_frame(spark, {k: [p] for k, p in b.items()}), bucket, strip).collect()}
        assert got.keys() == {k for k, v in want.items() if v > 1e-6}
        assert all(abs(r["shared"] - want[k]) < 1e-9 for k, r in got.items())


def test_overlay_with_a_hole_and_a_bay(spark):
    shell, hole = [(0, 0), (0, 10), (10, 10), (10, 0)], [(3, 3), (7, 3), (7, 7), (3, 7)]
    bay = [(0, 0), (4, 0), (4, 8), (6, 8), (6, 0), (12, 0), (12, 12), (0, 12)]
    r = overlay_areas(edge_frame(spark, {1: [shell, hole]}), edge_frame(spark, {5: [bay], 6: [[(4, 4), (6, 4), (6, 6), (4, 6)]], 7: [[(20, 20), (21, 20), (21, 21)]]}), 4.0, 1.5).collect()
    assert [(x["a"], x["b"], x["area_a"], x["area_b"]) for x in r] == [(1, 5, 84.0, 128.0)]
    # Of the shell without its hole, the bay takes columns 4 to 6 up to 8, of which the hole had rows 3 to 7.
    assert abs(r[0]["shared"] - (84 - (2 * 8 - 2 * 4))) < 1e-9
