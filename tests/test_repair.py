"""Repairs of directions against walks over small grids."""

import heapq
import random

import pytest

from rillflow.operators import flow, focal, grid, route

ROWS, COLS = 12, 10


def heights(seed, levels=40):
    rng = random.Random(seed)
    return {(r, c): float(rng.randint(0, levels)) for r in range(ROWS) for c in range(COLS)}


def frame(spark, h, **more):
    rows = [(r, c, v, *(m.get((r, c)) for m in more.values())) for (r, c), v in h.items()]
    kinds = {"dir": "int", "label": "long", "occ": "int"}
    return spark.createDataFrame(rows, "r int, c int, h double" + "".join(f", {k} {kinds[k]}" for k in more))


def below(cell, code):
    if not code:
        return None
    k = code.bit_length() - 1
    return cell[0] + grid.STEPS[k][0], cell[1] + grid.STEPS[k][1]


def end(cell, dirs):
    """Where a walk ends: a terminal, a cell without a direction here, or None for a cycle."""
    seen = set()
    while cell in dirs and dirs[cell]:
        if cell in seen:
            return None
        seen.add(cell)
        cell = below(cell, dirs[cell])
    return cell


def collected(df):
    return {(r["r"], r["c"]): r["dir"] for r in df.collect()}


def wild(seed):
    """Any direction that stays in the raster."""
    rng = random.Random(seed)
    ways = {(r, c): [1 << k for k, (dr, dc) in enumerate(grid.STEPS) if 0 <= r + dr < ROWS and 0 <= c + dc < COLS] for r in range(ROWS) for c in range(COLS)}
    return {x: rng.choice([0, *w, *w]) for x, w in ways.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_leave_their_region(spark, seed):
    h, dirs = heights(seed), wild(seed)
    out = collected(route.reroute_cycles(frame(spark, h, dir=dirs), COLS))
    assert set(out) == set(h) and all(end(x, out) is not None for x in out)
    assert all(out[x] == dirs[x] for x in h if end(x, dirs) is not None)


def test_a_raster_that_is_one_cycle_ends_at_its_lowest_cell(spark):
    h = {(0, 0): 3.0, (0, 1): 1.0}
    assert collected(route.reroute_cycles(frame(spark, h, dir={(0, 0): 1, (0, 1): 16}), 2)) == {(0, 0): 1, (0, 1): 0}


def test_no_cycles_no_change(spark):
    h = {(0, 0): 3.0, (0, 1): 1.0}
    assert collected(route.reroute_cycles(frame(spark, h, dir={(0, 0): 1, (0, 1): 0}), 2)) == {(0, 0): 1, (0, 1): 0}


def test_depressions_by_class(spark):
    h, dirs = heights(3), wild(3)
    label = {(r, c): 1 if c < 3 else 2 for r in range(2, 6) for c in (1, 2, 6, 7)}
    g = [(1, 1, 1, 1), (2, 6, 6, 3), (3, None, None, 3)]
    geo = spark.createDataFrame(g, "label long, out_r int, out_c int, sink_type int")
    out = collected(route.correct_depressions(frame(spark, h, dir=dirs, label=label), geo))
    want = dict(dirs)
    for lab, r, c, kind in g[:2]:
        own = {x for x, y in label.items() if y == lab} | {(r, c)}
        found = route.level_directions(own, (r, c)) if kind == 1 else route.flood_directions({x: h[x] for x in own}, (r, c))
        want.update(found)
    assert out == want


def brute_components(cells):
    left, out = set(cells), []
    while left:
        todo = [left.pop()]
        part = set(todo)
        while todo:
            r, c = todo.pop()
            for dr, dc in grid.STEPS:
                if (n := (r + dr, c + dc)) in left:
                    left.discard(n)
                    part.add(n)
                    todo.append(n)
        out.append(part)
    return out


@pytest.mark.parametrize("bodies", [1, 3])
def test_endorheic(spark, bodies):
    h = heights(4, 10**6)
    d = {(r["r"], r["c"]): int(r["dir"]) for r in focal.d8(frame(spark, h)).collect()}
    lakes = [{(1, 1), (1, 2), (2, 1)}, {(8, 7), (8, 8)}, {(10, 1), (10, 2)}][:bodies]
    occ = {x: 80 for lake in lakes for x in lake} | {(5, 5): 90, (0, 9): 10}
    cells = frame(spark, h, dir=d, label=dict.fromkeys(h, 7))
    water = frame(spark, {x: 0.0 for x in occ}, occ=occ).select("r", "c", "occ")
    out = collected(route.route_endorheic(cells, water, COLS, 50, 2))
    ends = {x: end(x, out) for x in out}
    assert set(out) == set(h) and None not in ends.values()
    if bodies == 1:
        low = min(h, key=lambda x: (h[x], x))
        assert set(ends.values()) == {low} and {x: y for x, y in out.items() if x != low} == route.flood_directions(h, low)
        return
    basin = {x: end(x, d) for x in h}
    # Bodies in the order of their labels; the later one wins.
    want = {}
    for lake in sorted(lakes, key=min):
        own = {x: h[x] for x in h if basin[x] in {basin[y] for y in lake}}
        low = min(own, key=lambda x: (own[x], x))
        want |= {low: 0} | route.flood_directions(own, low)
    assert {x: out[x] for x in want} == want
    assert set(ends.values()) <= {x for x, code in want.items() if code == 0}


def crop_directions(h, inside, rise):
    """Directions of a region over its box and a cell more, filled from the box's border by one flood."""
    rs, cs = [r for r, _ in inside], [c for _, c in inside]
    crop = {x: v for x, v in h.items() if min(rs) - 1 <= x[0] <= max(rs) + 1 and min(cs) - 1 <= x[1] <= max(cs) + 1}
    around = lambda x: [(x[0] + dr, x[1] + dc) for dr, dc in grid.STEPS]
    level = {x: v if any(n not in crop for n in around(x)) else float("inf") for x, v in crop.items()}
    heap = [(v, x) for x, v in level.items()]
    heapq.heapify(heap)
    while heap:
        f, x = heapq.heappop(heap)
        for n in around(x):
            if n in crop and (to := max(crop[n], f + rise)) < level[n]:
                level[n] = to
                heapq.heappush(heap, (to, n))
    out = {}
    for x in inside:
        ways = [(-(level[x] - level[n]) / grid.FACTORS[k], k) for k, n in enumerate(around(x)) if n in level and level[n] <= level[x]]
        out[x] = 1 << min(ways)[1] if ways else 0
    return out


def test_refill_goes_over_the_crop_of_each_region(spark):
    h, dirs = heights(5, 10**6), wild(5)
    regions = {3: {(r, c) for r in range(3, 9) for c in range(2, 6)}, 50: {(r, c) for r in range(4, 8) for c in range(6, 9)}, 7: {(0, 0), (0, 1)}}
    rows = [(k, *x) for k, inside in regions.items() for x in inside]
    out = collected(route.refill_regions(frame(spark, h, dir=dirs), spark.createDataFrame(rows, "label long, r int, c int")))
    want = dict(dirs)
    for inside in regions.values():
        want |= crop_directions(h, inside, 1e-5)
    assert out == want
    assert all(out[x] for k in (3, 50) for x in regions[k])
    none = spark.createDataFrame([], "label long, r int, c int")
    assert collected(route.refill_regions(frame(spark, h, dir=dirs), none)) == dirs


def test_basins_hold_those_above(spark):
    f = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, None), (5, 3), (6, None)], "id long, next_id long")
    got = {tuple(r) for r in flow.basins_at(f, spark.createDataFrame([(2,), (4,), (6,)], "id long")).collect()}
    assert got == {(2, 1), (2, 2), (4, 1), (4, 2), (4, 3), (4, 4), (4, 5), (6, 6)}


def test_orders_beside_a_cycle(spark):
    # 5 and 6 meet in 4, which flows into the cycle 1, 2.
    f = spark.createDataFrame([(1, 2), (2, 1), (4, 1), (5, 4), (6, 4), (7, None)], "id long, next_id long")
    assert dict(map(tuple, flow.strahler(f).collect())) == {1: 0, 2: 0, 4: 2, 5: 1, 6: 1, 7: 1}


def test_turning_counterflows(spark):
    dirs = {(0, 0): 1, (0, 1): 16, (1, 0): 1, (1, 1): 0}
    out = collected(route.turn_counterflows(frame(spark, dict.fromkeys(dirs, 0.0), dir=dirs), 2))
    # The first cell skips its partner to the east and turns to the south-east.
    assert out == {**dirs, (0, 0): 2}


def test_deep_sinks_stay(spark):
    h = {(r, c): 9.0 for r in range(5) for c in range(9)} | {(2, 2): 8.0, (2, 6): 1.0}
    f = {(r["r"], r["c"]): r["f"] for r in route.fill_shallow(frame(spark, h), 9, 2.0).collect()}
    assert f[2, 2] == 9.0 and f[2, 6] == 1.0
