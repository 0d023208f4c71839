import collections
import re

import corpus_pipeline as P

from rillflow.llm.jaccard import ngram_jaccard


def rows(df):
    return sorted(map(repr, df.collect()))


def test_stages_over_a_table(spark, small):
    docs, counts = spark.read.parquet(f"{small}/documents.parquet"), []
    raw = docs
    for name, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small).cache()
        assert docs.columns == raw.columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] == counts[2]
    packed = P.STAGES[-1][1](spark, docs, small).cache()
    used = collections.defaultdict(int)
    for r in packed.collect():
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 4096
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    assert P.run(spark, small).count() == packed.count()


def test_near_duplicates_keep_one(spark, odd_docs):
    kept = P.near_duplicates(spark, odd_docs, "")
    assert kept.columns == odd_docs.columns
    found = {(r["doc_id"], r["component_id"]) for r in ngram_jaccard(odd_docs, 5, 80, 100).collect()}
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in found if c is not None}) and ids.count(None) == 2


def test_near_duplicates_go_by_row(spark, prose):
    copy, unique, one, two, three = (prose(80, i) for i in range(21, 26))
    data = [(3, copy), (7, copy + " end"), (7, unique), (8, one), (8, two), (9, three), (9, three), (None, copy)]
    kept = P.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string"), "")
    assert rows(kept) == rows(spark.createDataFrame([(3, copy), (7, unique), (8, one), (8, two), (9, three), (None, copy)], "doc_id long, text string"))


def test_each_stage_takes_odd_and_empty_tables(spark, odd_docs):
    full = odd_docs.withColumn("n_chars", odd_docs["doc_id"])
    for df in (full, full.limit(0)):
        for name, stage in P.STAGES:
            out = stage(spark, df, "")
            assert name == P.STAGES[-1][0] or out.columns == df.columns
            out.count()


def test_secrets_go(spark):
    df = spark.createDataFrame([(1, "my token = abcdefgh12 here", "a", 26)], "doc_id long, text string, source string, n_chars long")
    (r,) = P.secrets(spark, df, "").collect()
    assert r["text"] == "my [secret] here" and r["n_chars"] == 16 and not re.search("abcdefgh", r["text"])


def test_rows_equal_but_for_their_source(spark, prose):
    data = [(5, prose(60, 3), s) for s in ("b", "a", "c", None)] + [(6, prose(60, 4), "z")]
    for parts in (1, 4):
        kept = P.near_duplicates(spark, spark.createDataFrame(data, "doc_id long, text string, source string").repartition(parts), "")
        assert sorted((r["doc_id"], r["source"]) for r in kept.collect()) == [(5, "a"), (6, "z")]
