"""Previews, basins of connected terminals and parts from side to side, against plain versions over small rasters."""

import random

import pytest
from test_repair import brute_components

from rillflow.operators import components, flow, focal, grid, route

ROWS, COLS = 11, 9


def cells(spark, values, name, kind):
    return spark.createDataFrame([(r, c, x) for (r, c), x in values.items()], f"r int, c int, {name} {kind}")


@pytest.mark.parametrize("rows, cols", [(4, 3), (1, 1), (25, 20)])
def test_preview(spark, rows, cols):
    rng = random.Random(rows)
    h = {(r, c): None if rng.random() < 0.2 else rng.uniform(-5, 5) for r in range(ROWS) for c in range(COLS)}
    out = {(x["r"], x["c"]): x["h"] for x in focal.preview(cells(spark, h, "h", "double"), ROWS, COLS, rows, cols).collect()}

    def weight(at, i, n, out):
        step = n / out
        return max(0.0, 1 - abs(at + 0.5 - (i + 0.5) * step) / max(step, 1))

    want = {}
    for i in range(rows):
        for j in range(cols):
            w = {(r, c): weight(r, i, ROWS, rows) * weight(c, j, COLS, cols) for (r, c), x in h.items() if x is not None}
            if sum(w.values()) > 0:
                want[i, j] = sum(h[x] * y for x, y in w.items()) / sum(w.values())
    assert set(out) == set(want) and all(abs(out[x] - want[x]) < 1e-9 for x in want)


def test_preview_sizes():
    assert focal.preview_size(4096, 2048) == (1024, 512) and focal.preview_size(10, 5, 100) == (100, 50) and focal.preview_size(10**6, 3) == (1024, 1)


@pytest.mark.parametrize("seed", range(2))
def test_initial_basins(spark, seed):
    rng = random.Random(seed)
    d = {(r, c): rng.choice([None, 0, 0, *(1 << k for k in range(8))]) for r in range(ROWS) for c in range(COLS)}
    out = {(x["r"], x["c"]): x["label"] for x in flow.initial_basins(cells(spark, d, "dir", "int"), COLS).collect()}
    label = {x: min(r * COLS + c for r, c in part) for part in brute_components({x for x, y in d.items() if y == 0}) for x in part}

    def walk(x):
        seen = set()
        while d.get(x) and x not in seen:
            seen.add(x)
            dr, dc = grid.STEPS[d[x].bit_length() - 1]
            x = (x[0] + dr, x[1] + dc)
        return label.get(x)

    assert out == {x: walk(x) for x, y in d.items() if y is not None}


@pytest.mark.parametrize("seed, share", [(2, 0.6), (3, 0.3)])
def test_spanning_parts(spark, seed, share):
    rng = random.Random(seed)
    label = {(r, c): r // 6 * 10 + c // 5 for r in range(ROWS) for c in range(COLS) if rng.random() < share}
    out = {(x["r"], x["c"]): x["label"] for x in components.spanning_parts(cells(spark, label, "label", "long"), COLS).collect()}
    box = lambda part: (min(r for r, _ in part), max(r for r, _ in part), min(c for _, c in part), max(c for _, c in part))
    want = {}
    for lab in set(label.values()):
        own = {x for x, y in label.items() if y == lab}
        want |= {x: lab for part in brute_components(own) if box(part) == box(own) for x in part}
    assert out == want


def test_only_the_spanning_part_is_routed(spark):
    rows = [(r, c, float(r * 5 + c), 0) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4) or (r, c) == (2, 2)]
    low = spark.createDataFrame([(3, *x) for x in rows], "label long, r int, c int, h double, dir int")
    water = spark.createDataFrame([], "r int, c int, occ int")
    out = {(x["r"], x["c"]): x["dir"] for x in route.route_endorheic(low, water, 5).collect()}
    assert set(out) == {(r, c) for r, c, _, _ in rows} and [x for x, y in out.items() if y is None] == [(2, 2)]
    assert [x for x, y in out.items() if y == 0] == [(0, 0)]


def test_empty_rasters(spark):
    none = spark.createDataFrame([], "r int, c int, label long, dir int, h double")
    assert components.spanning_parts(none, 5).count() == 0 and flow.initial_basins(none, 5).count() == 0 and focal.preview(none, 4, 4, 2, 2).count() == 0
