import numpy as np

from rillflow.llm.ann import nearest


def exact(rows, k=20):
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for i, v in good:
        if i % 20 == 0:
            s = np.where(ids == i, -np.inf, (x * v).sum(axis=1))
            order = np.lexsort((ids, -s))[:k]
            out[i] = [(int(ids[j]), float(s[j])) for j in order if s[j] > -np.inf]
    return out


def answers(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def ask(spark, rows):
    df = spark.createDataFrame([(i, v, "own") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return answers(nearest(df, df.where("vec_id % 20 = 0")))


def test_recall_and_scores(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(3000)]
    got, want = ask(spark, rows), exact(rows)
    assert got.keys() == want.keys()
    assert sum(len({*got[i]} & {*want[i]}) for i in want) >= 0.9 * sum(map(len, want.values()))


def test_ties_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    same = rng.normal(size=8).tolist()
    rows = [(i, same) for i in range(700)] + [(i, rng.normal(size=8).tolist()) for i in range(700, 800)]
    rows += [(800, None), (820, []), (840, [0.0] * 8), (860, [1.0] * 7), (880, [float("nan")] + same[1:]), (900, [float("inf")] + same[1:]), (920, [None] + same[1:]), (None, same)]
    got, want = ask(spark, rows), exact(rows)
    assert got.keys() == want.keys()
    for i in range(0, 700, 20):
        if want[i][0][1] == want[i][-1][1]:
            assert got[i] == want[i]


def test_few_rows(spark):
    assert ask(spark, []) == {} and ask(spark, [(1, [1.0] * 8)]) == {} and ask(spark, [(0, [1.0] * 8)]) == {}
    assert ask(spark, [(0, [1.0] * 8), (1, [2.0] * 8)]) == {0: [(1, 16.0)]}
