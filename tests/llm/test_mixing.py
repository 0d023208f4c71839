import numpy as np
from pyspark.sql import functions as F

from rillflow.llm import mixing
from rillflow.llm.mixing import branches, mixed_documents, mixed_sizes, plan_mix, splitting_tree, targets


def test_targets():
    assert targets([100, 100, 100]) == [187.5, 75.0, 37.5]
    assert targets([10, 1000, 1000])[0] == 30 and abs(sum(targets([10, 1000, 1000])) - 2010) < 1e-6
    assert targets([]) == [] and targets([0, 0]) == [0.0, 0.0]
    for sizes in ([1, 50, 7, 900], [5, 5, 5, 5, 5, 5], [1, 1, 10**6]):
        assert all(t <= 3 * s + 1e-9 for t, s in zip(targets(sizes), sizes)) and abs(sum(targets(sizes)) - sum(sizes)) < 1e-6


def test_splitting_tree_is_exact():
    units = np.array([70, 0, 13, 917])
    out = splitting_tree(units, 7, np.random.default_rng(1))
    assert out.shape == (7, 4) and (out.sum(axis=0) == units).all() and out.sum(axis=1).max() - out.sum(axis=1).min() <= 2


def docs(spark, prose):
    rows = [(i, prose(1 + i * 37 % 90, i), ("a", "b", "c", None)[0 if i % 3 == 0 else i % 4], i) for i in range(600)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int")


def test_mix(spark, prose):
    d = docs(spark, prose)
    rows = mixed_sizes(d).collect()
    assert len(rows) == 600 and sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixed_sizes(d.repartition(7)).collect()), key=repr)
    size = {r["doc_id"]: len(r["text"].split()) for r in d.collect()}
    per = {}
    for r in rows:
        assert r["size"] == size[r["doc_id"]] and r["taken"] in {k * r["size"] for k in range(4)}
        x = per.setdefault(r["source"], [0, r["target"], 0])
        x[0] += r["taken"]
        x[2] += r["size"]
        assert r["target"] == x[1]
    assert all(abs(taken - target) <= 45 for taken, target, _ in per.values())
    out = mixed_documents(d)
    assert out.columns == d.columns
    times = {r["doc_id"]: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {r["doc_id"]: r["times"] for r in rows if r["times"]}


def test_units_meet_quotas(spark, prose):
    _, decisions, units = plan_mix(docs(spark, prose))
    want = decisions.agg(F.sum(F.col("full") + F.col("part").cast("int"))).first()[0]
    assert units.count() == want == units.distinct().count()


def test_odd_rows(odd_docs, no_docs):
    rows = mixed_sizes(odd_docs).collect()
    assert len(rows) == odd_docs.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixed_documents(odd_docs).columns == odd_docs.columns
    assert mixed_sizes(no_docs).count() == 0 and mixed_documents(no_docs).count() == 0


def test_branches_are_exact():
    units = np.array([70, 0, 13, 917])
    for shards, most in ((64, 64), (7, 3), (1, 5), (5, 1), (1000, 8)):
        top = branches(units, shards, most, np.random.default_rng(2))
        assert sum(n for n, _ in top) == shards and len(top) == min(shards, most) and (sum(u for _, u in top) == units).all()
        assert all(abs(u.sum() - 1000 * n / shards) <= 7 for n, u in top)


def test_shards_below_branches(spark, prose, monkeypatch):
    monkeypatch.setattr(mixing, "LEAST_SHARDS", 10)
    monkeypatch.setattr(mixing, "BRANCHES", 3)
    _, decisions, units = plan_mix(docs(spark, prose))
    want = decisions.agg(F.sum(F.col("full") + F.col("part").cast("int"))).first()[0]
    n = {r["shard"]: r["count"] for r in units.groupBy("shard").count().collect()}
    assert sorted(n) == list(range(10)) and sum(n.values()) == want and max(n.values()) - min(n.values()) <= 4


def test_one_source_no_words_and_many_sources(spark):
    def mixed(rows):
        return mixed_sizes(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()

    assert [r["times"] for r in mixed([(i, "a b", "one") for i in range(9)])] == [1] * 9
    assert all(r["taken"] == 0 and r["target"] == 0 for r in mixed([(i, None if i % 2 else " ", str(i)) for i in range(9)]))
    rows = mixed([(i, "a b c", f"{i:03}") for i in range(300)])
    assert all(abs(r["taken"] - r["target"]) <= 1.5 for r in rows)
