"""Outlines and level water against walks over small grids."""

import random

import pandas as pd
import pytest

from rillflow.operators import outline
from rillflow.operators.grid import STEPS


def test_rings(spark):
    # A frame with a hole, and two cells that touch at a corner only.
    frame = [(r, c) for r in range(1, 4) for c in range(1, 4) if (r, c) != (2, 2)]
    rows = [(1, r, c) for r, c in frame] + [(2, 6, 6), (2, 7, 7)]
    found = outline.outlines(spark.createDataFrame(rows, "label long, r int, c int"), 9).collect()
    rings = {}
    for e in found:
        rings.setdefault((e["label"], e["ring"]), []).append((e["step"], e["x"], e["y"], e["d"]))
    got = []
    for (label, _), edges in rings.items():
        edges.sort()
        assert [e[0] for e in edges] == list(range(len(edges)))
        for (_, x, y, d), after in zip(edges, edges[1:] + edges[:1]):
            assert (x + (d == 0) - (d == 2), y + (d == 1) - (d == 3)) == after[1:3]
        got.append((label, len(edges), sum(x if d == 1 else -x if d == 3 else 0 for _, x, _, d in edges)))
    assert sorted(got) == [(1, 4, -1), (1, 12, 9), (2, 4, 1), (2, 4, 1)]


def test_no_regions(spark):
    assert outline.outlines(spark.createDataFrame([], "label long, r int, c int"), 9).count() == 0


def brute_dams(h, wet, dams, reach):
    h = dict(h)
    for _, r, c in sorted(dams):
        seen = {x for x in wet if abs(x[0] - r) <= reach and abs(x[1] - c) <= reach and h[x] is not None}
        body, todo = ({(r, c + 1)}, [(r, c + 1)]) if (r, c + 1) in seen else (seen, [])
        while todo:
            a, b = todo.pop()
            for dr, dc in STEPS:
                if (n := (a + dr, b + dc)) in seen and n not in body:
                    body = body | {n}
                    todo.append(n)
        if body:
            h |= dict.fromkeys(body, min(h[x] for x in body))
    return h


def test_dams_in_their_order(spark):
    rng = random.Random(6)
    h = {(r, c): float(rng.randint(0, 99)) for r in range(14) for c in range(30)} | {(3, 3): None}
    wet = {x for x in h if rng.random() < 0.4}
    dams = [(i, rng.randrange(14), rng.randrange(30)) for i in range(9)]
    out = outline.flatten_dams(
        spark.createDataFrame([(*x, v) for x, v in h.items()], "r int, c int, h double"),
        spark.createDataFrame(sorted(wet), "r int, c int"),
        spark.createDataFrame(dams, "dam long, r int, c int"),
        3,
    )
    assert {(r["r"], r["c"]): r["h"] for r in out.collect()} == brute_dams(h, wet, dams, 3)


@pytest.mark.parametrize("edge", [5, 256])
def test_chains_of_dams_need_no_rounds(spark, monkeypatch, edge):
    rng = random.Random(edge)
    h = {(r, c): float(rng.randint(0, 999)) for r in range(40) for c in range(9)} | {(3, 3): None, (20, 4): None}
    wet = {x for x in h if rng.random() < 0.5}
    # Down and up again, several at one cell or of one number, some beside the raster and far from it.
    dams = [(i, i % 40, rng.randrange(9)) for i in range(40)] + [(100 - i, i, rng.randrange(9)) for i in range(0, 40, 3)]
    dams += [(7, 7, 2), (200, 5, 5), (201, 5, 5), (202, 5, 5), (203, -2, 4), (204, 41, 9), (205, 900, -900)]
    kept, real = [], outline.materialize
    monkeypatch.setattr(outline, "materialize", lambda df, label: (kept.append(label), real(df, label))[1])
    frames = [([(*x, v) for x, v in h.items()], "r int, c int, h double"), (sorted(wet), "r int, c int"), ([*dams, (206, None, 3)], "dam long, r int, c int")]
    cells, water, d = (spark.createDataFrame(*f) for f in frames)
    out = outline.flatten_dams(cells, water, d, 3, **({} if edge == 256 else {"edge": edge}))
    assert {(r["r"], r["c"]): r["h"] for r in out.collect()} == brute_dams(h, wet, dams, 3)
    assert len(kept) < 9
    assert {(r["r"], r["c"]): r["h"] for r in outline.flatten_dams(cells, water, d.where("dam < 0")).collect()} == h


def test_a_dam_over_two_batches():
    rows = [(0, 1, 0, 5.0), (0, 2, 0, 9.0), (1, 2, 1, None), (1, 3, 2, None), (0, 3, 0, 4.0), (1, 4, 2, None)]
    whole = pd.DataFrame(rows, columns=["kind", "n", "p", "h"])
    for k in range(len(rows)):
        got = pd.concat(outline._levels_of_dams([whole[:k], whole[k:]]))
        assert got.groupby("n")["level"].min().to_dict() == {1: 5.0, 2: 5.0, 3: 4.0, 4: 5.0}


def test_polygons_become_one_with_holes_and_an_island(spark):
    # Two halves of a frame around a frame around a cell, and a piece that touches at a corner only.
    cells = {(r, c): 1 if c < 4 else 2 for r in range(9) for c in range(9) if max(abs(r - 4), abs(c - 4)) != 3}
    cells = {x: v for x, v in cells.items() if max(abs(x[0] - 4), abs(x[1] - 4)) != 1} | {(9, 9): 3, (20, 20): 9}
    frame = spark.createDataFrame([(v, *x) for x, v in cells.items()], "label long, r long, c long")
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (9, None), (50, 7)], "label long, group long").where("group is not null")
    rings = outline.dissolve_outlines(outline.outlines(frame, 30), groups, 30)
    parts = {r["ring"]: r for r in outline.shells(rings).collect()}
    found = sorted((r["area"], parts[r["shell"]]["area"], r["first_x"], r["first_y"]) for r in parts.values())
    # Outer frame 81 with a hole of 49, inner frame 25 with a hole of 9, the middle cell, and the one at the corner.
    assert found == [(-49, 81, 1, 8), (-9, 25, 3, 6), (1, 1, 4, 4), (1, 1, 9, 9), (25, 25, 2, 2), (81, 81, 0, 0)]
    assert all(r["label"] == 7 for r in parts.values())
