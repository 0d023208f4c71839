"""Operators against small brute-force versions and against invariants."""

import math
import random

import pytest
from pyspark.sql import functions as F

from rillflow.operators import algebra, components, flood, flow, focal, grid, route, vector
from rillflow.sources import tiles

NO = 0
MASK = [[0, 0, 0, 1, 1, 1], [0, 1, 1, 1, 1, 0], [0, 1, 1, 0, 0, 0], [1, 1, 0, 0, 0, 0], [0, 1, 0, 0, 0, 0]]
DEM = [[14, 62, 59, 2, 3, 4], [88, 5, 4, 4, 5, 31], [6, 5, 5, 6, 6, 74], [5, 5, 6, 7, 22, 49], [4, 5, 6, 22, 19, 27]]


def ends_at(directions, start):
    """Whether every cell with a direction gets to start without coming back to a cell."""
    for cell in directions:
        seen = set()
        while cell != start:
            if cell in seen or cell not in directions:
                return False
            seen.add(cell)
            k = directions[cell].bit_length() - 1
            cell = (cell[0] + grid.STEPS[k][0], cell[1] + grid.STEPS[k][1])
    return True


def test_flood_on_a_toy_grid():
    h = {(r, c): DEM[r][c] for r in range(5) for c in range(6) if MASK[r][c]}
    out = route.flood_directions(h, (4, 1))
    assert set(out) == set(h) - {(4, 1)} and ends_at(out, (4, 1))


@pytest.mark.parametrize("seed", range(5))
def test_floods_are_trees(seed):
    rng = random.Random(seed)
    h = {(r, c): rng.randint(0, 4) for r in range(9) for c in range(9)}
    start = (rng.randrange(9), rng.randrange(9))
    for out in (route.flood_directions(h, start), route.level_directions({*h}, start)):
        assert set(out) == set(h) - {start} and ends_at(out, start)


def cells(spark, values):
    return spark.createDataFrame([(r, c, float(v)) for r, row in enumerate(values) for c, v in enumerate(row)], "r int, c int, h double")


def random_grid(seed, rows=23, cols=19, levels=50):
    rng = random.Random(seed)
    return [[rng.randint(0, levels) for _ in range(cols)] for _ in range(rows)]


def brute_fill(v):
    import heapq

    rows, cols = len(v), len(v[0])
    heap = [(v[r][c], r, c) for r in range(rows) for c in range(cols) if r in (0, rows - 1) or c in (0, cols - 1)]
    out = {(r, c): x for x, r, c in heap}
    heapq.heapify(heap)
    while heap:
        f, r, c = heapq.heappop(heap)
        for dr, dc in grid.STEPS:
            n = (r + dr, c + dc)
            if 0 <= n[0] < rows and 0 <= n[1] < cols and n not in out:
                out[n] = max(f, v[n[0]][n[1]])
                heapq.heappush(heap, (out[n], *n))
    return out


@pytest.mark.parametrize("edge", [5, 64])
def test_fill_equals_one_flood(spark, edge):
    v = random_grid(1)
    assert {(r["r"], r["c"]): r["f"] for r in route.fill(cells(spark, v), edge).collect()} == brute_fill(v)


@pytest.mark.parametrize("edge", [4, 7])
def test_tiles_do_not_change_accumulation(spark, edge):
    f = focal.flow_edges(focal.d8(cells(spark, random_grid(2, levels=10**6))), 19).cache()
    one = {tuple(r) for r in flow.accumulate(f).collect()}
    assert one == {tuple(r) for r in flow.accumulate_tiled(f, 19, edge).collect()}
    ends = f.where("next_id is null").join(flow.accumulate(f), "id").agg(F.sum(F.col("acc") + 1)).first()[0]
    assert ends == 23 * 19


def chain(spark, n=3000):
    return spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("next_id"))


def test_long_chains(spark):
    f = chain(spark)
    assert flow.accumulate(f).where("id = 0").first()["acc"] == 2999
    assert flow.terminal_labels(f).select("label").distinct().count() == 1


def test_cycles(spark):
    f = chain(spark, 100).union(spark.createDataFrame([(200, 201), (201, 202), (202, 200), (203, 200), (300, 301), (301, 300)], "id long, next_id long"))
    bad = {tuple(r) for r in flow.cycle_cells(f).collect()}
    assert bad == {(200, True), (201, True), (202, True), (203, False), (300, True), (301, True)}
    assert [tuple(r) for r in flow.counterflow_pairs(f).collect()] == [(300, 301)]
    h = f.select("id", (-F.col("id")).cast("double").alias("h"))
    fixed = flow.break_cycles(f, h)
    assert flow.cycle_cells(fixed).count() == 0
    assert {r["id"] for r in fixed.where("next_id is null").collect()} == {0, 202, 301}
    with pytest.raises(ValueError):
        flow.accumulate(f)


def test_strahler(spark):
    #   5 6 7 8      two pairs of headwaters meet twice; 9 joins below without raising the order
    edges = [(5, 3), (6, 3), (7, 4), (8, 4), (3, 2), (4, 2), (9, 1), (2, 1), (1, None)]
    f = spark.createDataFrame(edges, "id long, next_id long")
    assert dict(map(tuple, flow.strahler(f).collect())) == {5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 3: 2, 4: 2, 2: 3, 1: 3}
    links = {r["id"]: (r["link"], r["step"]) for r in flow.stream_links(f, flow.strahler(f)).collect()}
    assert links[1] == (1, 0) and links[2] == (2, 0) and links[9] == (9, 0)


def test_strahler_never_falls_downstream(spark):
    f = focal.flow_edges(focal.d8(cells(spark, random_grid(3, levels=10**6))), 19).cache()
    o = flow.strahler(f).cache()
    down = f.join(o, "id").join(o.select(F.col("id").alias("next_id"), F.col("order").alias("below")), "next_id")
    assert o.where("order < 1").count() == 0 and down.where("below < order").count() == 0


def test_components(spark):
    mask = spark.createDataFrame([(r, c) for r in range(5) for c in range(6) if MASK[r][c]], "r int, c int")
    assert components.label_mask(mask, 6).select("label").distinct().count() == 1
    assert components.label_mask(mask, 6, eight=False).count() == 12


def test_nearest_and_containment(spark):
    rng = random.Random(4)
    p = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(60)]
    s = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(7)]
    got = {r["point"]: r["site"] for r in vector.nearest(spark.createDataFrame(p, "point long, x double, y double"), spark.createDataFrame(s, "site long, x double, y double"), 2.0, 256.0).collect()}
    assert got == {i: min(s, key=lambda q: ((x - q[1]) ** 2 + (y - q[2]) ** 2, q[0]))[0] for i, x, y in p}


def test_tiles_round_trip(spark, tmp_path):
    c = cells(spark, random_grid(5))
    tiles.write_tiles(c, str(tmp_path / "t"), 8)
    back = tiles.read_tiles(spark, str(tmp_path / "t"), 8, 3, 12, 2, 9)
    assert {tuple(r) for r in back.select("r", "c", "h").collect()} == {tuple(r) for r in c.where("r between 3 and 12 and c between 2 and 9").collect()}


def test_points_round_trip(spark, tmp_path):
    p = spark.createDataFrame([(1.5, 2.5), (3.0, -4.0)], "lon double, lat double")
    tiles.write_points(p, str(tmp_path / "p"))
    assert {tuple(r) for r in tiles.read_points(spark, str(tmp_path / "p"), "lon double, lat double").collect()} == {(1.5, 2.5), (3.0, -4.0)}


def test_listed_tiles(spark, tmp_path):
    for name in ("N25E068_dem.bin", "S03W120_dem.bin", "N26E068_dem.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = tiles.listed_tiles(spark, str(tmp_path), "*.bin", 60.0, 30.0, 70.0, 20.0).collect()
    assert [(r["lon"], r["lat"]) for r in found] == [(68, 25)]


def test_seven_tenths_of_an_observation_are_exact(spark):
    seen = spark.range(121).select("id", algebra.observed_occurrence(F.col("id")).alias("v"), algebra.combined_occurrence(F.lit(2), F.col("id")).alias("both"))
    assert {r["id"]: (r["v"], r["both"]) for r in seen.collect()} == {i: ((x := i * 7 // 10 if i <= 100 else 0), 30 + x) for i in range(121)}


def test_extents_equal_odd_and_of_any_size(spark):
    rng = random.Random(8)
    rows = []
    for i in range(700):
        x, y, w, h = rng.randrange(12), rng.randrange(12), rng.choice((0, 1, 2, 5)), rng.choice((0, 1, 3, 5))
        rows.append((i, x + 0.0, x + w + 0.0, y + 0.0, y + h + 0.0))
    # Wider than any number of the narrow buckets, a null, a row twice, and some outside of all that is large.
    rows += [(700, -1e9, 1e9, 3.0, 4.0), (701, -1e9, 1e9, 3.5, 4.0), (702, None, 1.0, 0.0, 9.0), (703, 40.0, 41.0, -5.0, -4.0), (703, 40.0, 41.0, -5.0, -4.0), (704, 40.0, 41.0, -5.0, -4.0), (705, 40.0, 40.5, -5.0, -4.5)]
    holds = lambda b, a: None not in b + a and b[0] != a[0] and b[1] <= a[1] and b[2] >= a[2] and b[3] <= a[3] and b[4] >= a[4] and (b[1:] != a[1:] or b[0] < a[0])
    want = sorted((a for a in rows if not any(holds(b, a) for b in rows)), key=repr)
    got = vector.not_contained(spark.createDataFrame(rows, "id long, x0 double, x1 double, y0 double, y1 double"), 0.1)
    assert sorted(map(tuple, got.collect()), key=repr) == want


def brute_labels(values, ncols, eight):
    label = {}
    for x in sorted(values):
        todo = [] if x in label else [x]
        while todo:
            r, c = todo.pop()
            if (r, c) not in label:
                label[r, c] = x[0] * ncols + x[1]
                todo += [n for dr, dc in grid.STEPS if (eight or not (dr and dc)) and values.get(n := (r + dr, c + dc)) == values[r, c]]
    return label


@pytest.mark.parametrize("edge,most", [(3, 1000), (4, 0), (256, 1000)])
def test_parts_of_tiles_become_components(spark, monkeypatch, edge, most):
    rng = random.Random(edge)
    values = {(r, c): rng.randint(1, 2) for r in range(-5, 18) for c in range(13) if rng.random() < 0.9}
    # A snake through all tiles.
    values |= {(r, c): 7 for r in range(20, 40) for c in range(13) if r % 2 == 0 or c == (12 if r % 4 == 1 else 0)}
    kept, real = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df, label: (kept.append(label), real(df, label))[1])
    df = spark.createDataFrame([(*x, v) for x, v in values.items()] + [(50, 0, None)], "r long, c int, v int")
    got = {(r["r"], r["c"]): (r["v"], r["label"]) for r in components.label_equal(df, "v", 13, edge, most).collect()}
    assert got == {x: (values[x], k) for x, k in brute_labels(values, 13, True).items()}
    assert most == 0 or len(kept) < 4
    one = {x: 0 for x, v in values.items() if v == 1}
    for eight in (True, False):
        got = {r["id"]: r["label"] for r in components.label_mask(spark.createDataFrame(sorted(one), "r int, c int"), 13, eight, edge, most).collect()}
        assert got == {x[0] * 13 + x[1]: k for x, k in brute_labels(one, 13, eight).items()}


@pytest.mark.parametrize("edge,most", [(3, 1000), (4, 0), (64, 1000)])
def test_fill_over_many_tiles_needs_no_rounds(spark, monkeypatch, edge, most):
    rng = random.Random(edge)
    h = {(r, c): float(rng.randint(0, 30)) for r in range(-3, 20) for c in range(11)}
    h |= {(8, 4): None, (2, 2): math.nan} | {(r, c): math.nan for r in range(11, 16) for c in range(4, 9) if max(abs(r - 13), abs(c - 6)) == 2}
    # A closed basin that is left by a long way up.
    h |= {(30 + r, c): 99.0 if max(abs(r - 6), abs(c - 6)) == 5 else float(r) for r in range(13) for c in range(13)}
    rank = lambda v: math.inf if math.isnan(v) else v
    level = {x: rank(v) for x, v in h.items() if v is not None and any(h.get((x[0] + dr, x[1] + dc)) is None for dr, dc in grid.STEPS)}
    todo = [*level]
    while todo:
        x = todo.pop()
        for dr, dc in grid.STEPS:
            if h.get(n := (x[0] + dr, x[1] + dc)) is not None and (to := max(rank(h[n]), level[x])) < level.get(n, 1e9):
                level[n] = to
                todo.append(n)
    kept, real = [], flood.materialize
    monkeypatch.setattr(flood, "materialize", lambda df, label: (kept.append(label), real(df, label))[1])
    got = flood.filled_levels(spark.createDataFrame([(*x, v) for x, v in h.items()], "r int, c int, h double"), edge, most)
    assert {(r["r"], r["c"]): rank(r["f"]) for r in got.collect()} == {x: level.get(x, math.inf) for x, v in h.items() if v is not None}
    assert most == 0 or len(kept) < 4


def test_heights_that_are_no_numbers_stay(spark):
    # A ring of them around a cell, and beside it a shallow sink.
    h = {(r, c): 1.0 for r in range(5) for c in range(9)} | {(r, c): math.nan for r in range(1, 4) for c in range(1, 4) if (r, c) != (2, 2)} | {(2, 6): 0.5}
    df = spark.createDataFrame([(*x, v) for x, v in h.items()], "r long, c long, h double")
    got = {(r["r"], r["c"]): (str(r["h"]), str(r["f"])) for r in route.fill_shallow(df, 9, 1.0, 3).collect()}
    assert got == {x: (str(v), "1.0" if x == (2, 6) else str(v)) for x, v in h.items()}
    own = components.label_equal(df, "h", 9).where("isnan(h)").collect()
    assert len(own) == 8 and {r["label"] for r in own} == {10}


def test_a_rising_fill_crosses_few_tiles(spark, monkeypatch):
    # A long strip that only its first row leaves, with ground that is no number across half of it.
    h = {(r, c): float(r * 7 % 5) for r in range(250) for c in range(2)} | {(100, 0): math.nan}
    level = {(0, 0): h[0, 0], (0, 1): h[0, 1]}
    todo = [*level]
    while todo:
        x = todo.pop()
        for dr, dc in grid.STEPS:
            n = (x[0] + dr, x[1] + dc)
            if n in h and not math.isnan(h[n]) and (to := max(h[n], level[x] + 0.5)) < level.get(n, math.inf):
                level[n] = to
                todo.append(n)
    kept, real = [], route.materialize
    monkeypatch.setattr(route, "materialize", lambda df, label: (kept.append(label), real(df, label))[1])
    df = spark.createDataFrame([(*x, v, x[0] == 0) for x, v in h.items()], "r long, c long, h double, start boolean")
    got = {(r["r"], r["c"]): (str(r["h"]), r["f"]) for r in route.fill(df, rise=0.5, start="start").collect()}
    assert got == {x: (str(v), level.get(x, math.inf)) for x, v in h.items()}
    assert len(kept) < 6
