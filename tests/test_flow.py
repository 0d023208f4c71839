"""Closures, lines, scans and turned cycles against walks."""

import random

import pytest
from pyspark.sql import functions as F

from rillflow.functions import names
from rillflow.operators import flow as fl
from rillflow.operators import zonal


def walks(nexts):
    """What lies below each id, as far as a way goes without coming back."""
    out = {}
    for x in nexts:
        seen, at = [], nexts[x]
        while at is not None and at not in seen:
            seen.append(at)
            at = nexts.get(at)
        out[x] = seen
    return out


def edges(spark, nexts):
    return spark.createDataFrame([(a, b) for a, b in nexts.items() if b is not None], "up_id long, down_id long")


@pytest.mark.parametrize("kind", ["forest", "cycle", "two ways"])
def test_upstream(spark, kind):
    rng = random.Random(3)
    nexts = {i: rng.randint(0, i - 1) if i and rng.random() < 0.9 else None for i in range(60)} | {100 + i: 100 + i + 1 for i in range(40 if kind == "forest" else 3)}
    if kind == "cycle":
        nexts |= {200: 201, 201: 202, 202: 200, 203: 201}
    pairs = {(b, a) for a, below in walks(nexts).items() for b in below if b != a}
    e = edges(spark, nexts)
    if kind == "two ways":
        e = e.union(spark.createDataFrame([(50, 101), (7, 7)], "up_id long, down_id long"))
        pairs |= {(b, a) for a in [50, *(x for s, x in pairs if s == 50)] for b in (101, *walks(nexts)[101])}
    for seeds in (set(range(0, 210, 7)) | {101},) if kind != "forest" else (set(range(210)), {999, 120}):
        got = [tuple(r) for r in fl.upstream(e, spark.createDataFrame([(s,) for s in seeds], "id long")).collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in pairs if p[0] in seeds}


def test_river_lines(spark):
    #  1 -> 2 -> 5 -> 6 -> 9, 3 -> 5 of the first order; 5 and 6 of the second; 7 -> 6; 20 and 21 are a ring; 30 stands alone.
    nexts = {1: 2, 2: 5, 3: 5, 5: 6, 7: 6, 6: 9, 9: None, 20: 21, 21: 20, 30: None}
    orders = {1: 1, 2: 1, 3: 1, 5: 2, 6: 2, 7: 1, 20: 1, 21: 1, 30: 1}
    f = spark.createDataFrame(list(nexts.items()), "id long, next_id long")
    lines = fl.river_lines(f, spark.createDataFrame(list(orders.items()), "id long, order int"))
    assert {tuple(r) for r in lines.collect()} == {(1, 1, 0, 1, True), (1, 1, 1, 2, True), (1, 1, 2, 5, False), (3, 1, 0, 3, True), (3, 1, 1, 5, False), (7, 1, 0, 7, True), (7, 1, 1, 6, False), (5, 2, 0, 5, True), (5, 2, 1, 6, True), (5, 2, 2, 9, False), (30, 1, 0, 30, True)}
    shapes = {r["line"]: (r["cells"], [tuple(p) for p in r["points"]]) for r in fl.line_strings(lines, 10, 0.0, 0.0, 1.0).collect()}
    assert 30 not in shapes and shapes[5] == (2, [(5.5, -0.5), (6.5, -0.5), (9.5, -0.5)])


def turned(nexts, near):
    """All ways out of cycles, one basin at a time, as the operator states it; returns what arrives and how many cells change."""
    below = walks(nexts)
    ring = {x for x in nexts if x in below[x]}
    basin = {x: min(y for y in [x, *below[x]] if y in ring) for x in nexts if x in ring or any(y in ring for y in below[x])}
    basin = {x: min(z for z in ring if z in [next(y for y in [x, *below[x]] if y in ring), *below[next(y for y in [x, *below[x]] if y in ring)]]) for x in basin}
    return basin


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_turn_round(spark, seed):
    rng, wide, high = random.Random(seed), 9, 7
    steps = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]
    cell = lambda r, c: r * wide + c if 0 <= r < high and 0 <= c < wide else None
    near = {cell(r, c): [cell(r + a, c + b) for a, b in steps] for r in range(high) for c in range(wide)}
    nexts = {x: rng.choice([y for y in ys if y is not None]) for x, ys in near.items()}
    if seed == 1:
        nexts[40] = None
    f = spark.createDataFrame(list(nexts.items()), "id long, next_id long")
    n = spark.createDataFrame([(x, k, y) for x, ys in near.items() for k, y in enumerate(ys) if y is not None], "id long, k int, to long")
    out = {r["id"]: r["next_id"] for r in fl.reverse_cycles(f, n).collect()}
    assert out.keys() == nexts.keys()
    below, before = walks(out), walks(nexts)
    assert not any(x in below[x] for x in out)
    basins = turned(nexts, near)
    assert all(out[x] == nexts[x] for x in nexts if x not in basins)
    # Without any terminal one basin has nowhere to go; else the terminal is the only end.
    ends = {x for x in out if out[x] is None}
    assert ends == {40} if seed == 1 else len(ends) == 1
    # What changed is one way in each basin, from its exit to its cycle: turned pointers lead back along old ones.
    for b in set(basins.values()):
        changed = [x for x in out if basins.get(x) == b and out[x] != nexts[x]]
        exits = [x for x in changed if out[x] is None or basins.get(out[x]) != b]
        assert len(exits) == 1 and all(nexts[out[x]] == x for x in changed if x not in exits)
        ring = {x for x in out if basins.get(x) == b and x in before[x]}
        assert sum(x in ring for x in changed) == 1


def test_outlet_scan(spark):
    rows = [  # label, seq, r, c, h, dir, to_label
        (1, 0, 0, 0, 5.0, 1, None), (1, 1, 0, 1, 4.0, 1, 1), (1, 2, 0, 2, 3.0, 1, 2), (1, 3, 0, 3, 2.0, None, None), (1, 4, 0, 4, 1.0, 1, None),
        (2, 0, 1, 0, 2.0, 1, None), (2, 1, 1, 1, 2.0, 0, None), (2, 2, 1, 2, 2.0, 1, None),
        (3, 0, 2, 0, 1.0, 1, 3), (4, 0, 3, 0, None, 0, None), (4, 1, 3, 1, 7.0, 4, 9),
    ]
    got = {tuple(r) for r in zonal.outlet_scan(spark.createDataFrame(rows, "label long, seq int, r int, c int, h double, dir int, to_label long")).collect()}
    assert got == {(1, 0, 3, 2.0), (2, 1, 0, 2.0), (4, 3, 1, 7.0)}


def test_merged_names(spark):
    df = spark.createDataFrame([(68, 25, 75, 30), (-10, -5, -3, -1), (7, 8, 7, 8)], "a int, b int, c int, d int")
    got = df.select(names.merged_name(*(F.col(k) for k in "abcd")).alias("n")).select("n", names.merged_corners(F.col("n"), 0.0).alias("x")).collect()
    assert [(r["n"], tuple(r["x"])) for r in got] == [("N2530E068075", (68, 25, 76, 31)), ("S0501W010003", (-10, -5, -2, 0)), ("N0808E007007", (7, 8, 8, 9))]
    one = df.limit(1).select(names.merged_corners(F.lit("x/N25W068_dem.tif"), 0.0).alias("x"), names.merged_corners(F.lit("none")).alias("y")).first()
    assert tuple(one["x"]) == (-68, 25, -67, 26) and one["y"]["west"] is None
