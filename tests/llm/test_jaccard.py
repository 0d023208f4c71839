import random
import tracemalloc

import pytest

from rillflow.llm.jaccard import Shingler, ngram_jaccard


def brute(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and den * len(a & b) >= num * len(a | b):
                up[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), 2**62), r[0])
    return sorted((repr((r[0], len(s), r[0] if not s or r[0] is None else least[top(i)])) for i, (r, s) in enumerate(zip(rows, sets))))


def got(df):
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in df.collect())


@pytest.mark.parametrize("n,num,den", [(4, 85, 100), (5, 80, 100)])
def test_edits_passages_and_copies(spark, prose, n, num, den):
    rng, rows = random.Random(n), []
    base, passage = prose(120, 5).split(), prose(80, 6)
    for i in range(220):
        kind = i % 5
        if kind < 2:
            w = list(base)
            for _ in range(rng.randint(0, 8)):
                w[rng.randrange(len(w))] = f"edit{rng.random()}"
            rows.append((i, " ".join(w)))
        elif kind == 2:
            rows.append((i, passage + " " + prose(rng.randint(1, 30), i)))
        elif kind == 3:
            rows.append((i, prose(rng.randint(0, 6), i % 7).upper()))
        else:
            rows.append((i, prose(40, i)))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(ngram_jaccard(df, n, num, den)) == brute(rows, n, num, den)


def test_odd_rows(odd_docs):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert got(ngram_jaccard(odd_docs)) == brute(rows, 4, 85, 100)


def test_empty_table(no_docs):
    assert ngram_jaccard(no_docs).count() == 0


def test_shingles_do_not_depend_on_neighbours(prose):
    texts = [prose(i, i) for i in range(30)] + [None, "", "a b c d", prose(40_000, 3), " a  b\tc\nd "]
    together = Shingler(4).sets(texts)
    for t, s in zip(texts, together):
        assert (Shingler(4).sets([t])[0] == s).all()
    assert (together[-1] == together[-3]).all()


def test_shingles_need_a_few_bytes_for_each_byte_of_text(prose):
    text = prose(3000, 9)
    texts = [text] * (8_000_000 // len(text))
    tracemalloc.start()
    shingler = Shingler(5)
    for at in range(0, len(texts), 40):
        shingler.sets(texts[at : at + 40])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30_000_000


def test_large_ids_beside_a_null(spark, prose):
    rows = [(2**60 + 1, prose(40, 1)), (2**60 + 3, prose(40, 1)), (None, prose(40, 1)), (2**60 + 2, prose(40, 2)), (-(2**60) - 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(ngram_jaccard(df)) == brute(rows, 4, 85, 100)
