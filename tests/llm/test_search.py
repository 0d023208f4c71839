import math
import random
import re
from collections import Counter

import pytest

from rillflow.llm import search as S
from rillflow.llm.search import lexical_index, lexical_search, op11_lexical_search, terms

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ranked(docs, items, top=50):
    """Every document scored for every item, in plain Python."""
    counts = [(d, Counter(TERM.findall((t or "").translate(UPPER)))) for d, t in docs]
    counts = [(d, c, sum(c.values())) for d, c in counts if c]
    n_docs, total = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for item, own in wanted.items():
        scores = []
        for d, c, n in counts:
            m = 100 - 50 + ((50 * n * n_docs) // total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if c[t])
            if s > 0:
                scores.append((-s, d is None, d))
        scores.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_terms():
    text = "A.b-C\tÄÖ ß9_x\x00y\x7fz\x85ü w É"
    assert [t.decode() for t in terms(text)] == TERM.findall(text.translate(UPPER))


def test_query_equals_brute_force(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    df = op11_lexical_search(spark, small)
    assert df.columns == ["item_id", "rank", "doc_id", "score"] and rows(df) == ranked(docs, items)


@pytest.mark.parametrize("top, coordinates, at_once", [(50, 2048, 200_000), (3, 7, 40), (1, 1, 1)])
def test_copies_ties_and_long_documents(spark, prose, top, coordinates, at_once):
    rng = random.Random(2)
    words = prose(60, 5).split()
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((0, 3, 12, 60))))) for i in range(150)]
    docs += [(i, "the same hot text of copies " + words[0]) for i in range(1000, 1200)] + [(2000, " ".join(rng.choices(words, k=20_000))), (None, "the same hot text of copies"), (2001, None), (7, "the same"), (7, "the same")]
    items = [(i, " ".join(rng.choices(words + ["unheard"], k=8))) for i in range(12)] + [(20, "The SAME hot text"), (21, None), (22, "nothing-known"), (None, words[3]), (20, words[1]), (23, "!?")]
    index = lexical_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    got = lexical_search(index, spark.createDataFrame(items, "item_id long, text string"), top, coordinates, at_once)
    assert rows(got) == ranked(docs, items, top)


def test_bounds_leave_documents_unscored(spark, prose, monkeypatch):
    """The bounds decide: a document whose bound is too low is not scored."""
    import numpy as np

    docs = [(i, prose(40, i)) for i in range(400)] + [(1000 + i, "alpha beta gamma " + prose(10, 1000 + i)) for i in range(4)]
    index = [tuple(r) for r in lexical_index(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    keys = S.hashed([b"alpha", b"beta", b"gamma"])
    ranking = S.Ranking(S.Queries({1: keys}, dict.fromkeys(keys.tolist(), 3000), 2048), 2)
    scored = []
    search = np.searchsorted
    monkeypatch.setattr(S.np, "searchsorted", lambda a, v: scored.append(1) or search(a, v))
    starts = np.cumsum([0] + [len(r[2]) for r in index])
    ranking.block([r[0] for r in index], starts, np.concatenate([r[2] for r in index]), np.concatenate([r[3] for r in index]), S.length_norm(np.array([r[1] for r in index]), 404, 16_000))
    assert [x[2] for x in ranking.best[0]] == [1000, 1001] and len(scored) < 20


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    items = [(1, "one two"), (2, "id"), (3, "x" * 200_000), (4, "naïve ß")]
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("key", S.F.lit(1))
    assert rows(lexical_search(lexical_index(odd_docs), frame)) == ranked(docs, items)
    assert lexical_search(lexical_index(no_docs), frame).count() == 0
    assert lexical_search(lexical_index(odd_docs), frame.limit(0)).count() == 0
