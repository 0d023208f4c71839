import gc
import tracemalloc
import weakref
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillflow.llm.packing import pack, sum_of_squares
from rillflow.llm.tokens import BLOCK, file_blocks, flat_blocks, separator_scan, token_pieces, vocabulary


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_pieces_hold_the_tokens(spark, odd_docs, tokenizer):
    want = []
    for r in odd_docs.collect():
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r["doc_id"], i, a, len(ids[a : a + 4096]), zlib.crc32(ids[a : a + 4096].tobytes())) for i, a in enumerate(range(0, len(ids), 4096))]
    got = token_pieces(odd_docs, with_ids=True).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got)
    assert all(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in got)


def gapless(df, capacity):
    at = {}
    for r in df.collect():
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in at.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(at)


def test_odd_rows_are_packed(odd_docs):
    pieces = token_pieces(odd_docs)
    out = pack(pieces)
    assert out.count() == pieces.count()
    gapless(out, 4096)


def test_few_sequences(spark):
    p = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), (F.pmod(F.xxhash64("id"), F.lit(90)) + 1).alias("length"), F.lit("x").alias("offset"))
    total = p.agg(F.sum("length")).first()[0]
    assert gapless(pack(p, 100), 100) <= -(-total // 100) * 1.02 + 1


def test_sum_of_squares_by_hand():
    # 6 opens a bin (gap 4), 4 closes it, 6 and 5 open others; for 4, closing gap 4 leaves fewer squares than gap 5.
    bins, offsets, gaps = sum_of_squares(np.array([6, 4, 6, 5, 4]), 10)
    assert bins.tolist() == [0, 0, 1, 2, 1] and offsets.tolist() == [0, 6, 0, 0, 6] and gaps.tolist() == [0, 0, 5]


def test_empty_tables(no_docs):
    assert token_pieces(no_docs).count() == 0 and pack(token_pieces(no_docs)).count() == 0 and separator_scan(flat_blocks(no_docs)).count() == 0


def test_separator_scan_over_small_blocks(odd_docs, tokenizer):
    by_id = sorted((r["doc_id"] or -1, len(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    n = sorted(x for _, x in by_id)
    for block in (7, 1000, BLOCK):
        out = separator_scan(flat_blocks(odd_docs.repartition(3), block=block), block=block).collect()
        assert sorted(r["n_tokens"] for r in out) == n
        assert sorted((r["doc_id"] or -1, r["n_tokens"]) for r in out) == by_id
        for file in {r["file"] for r in out}:
            own = sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in out if r["file"] == file)
            assert [o for o, _, _ in own] == list(range(len(own)))
            assert all(b == a + x + 1 for (_, a, x), (_, b, _) in zip(own, own[1:])) and own[0][1] == 0


def test_raw_files(spark, tmp_path):
    a = np.array([5, 6, 9, 9, 7, 8, 3, 9, 4], "<u2")
    a.tofile(tmp_path / "a.bin")
    np.array([9], "<u2").tofile(tmp_path / "b.bin")
    np.array([], "<u2").tofile(tmp_path / "c.bin")
    out = separator_scan(file_blocks(spark, str(tmp_path / "*.bin"), 2, 2), 9, 2, "<u2").collect()
    assert sorted((r["ordinal"], r["start"], r["n_tokens"]) for r in out) == [(0, 0, 0), (0, 0, 2), (1, 3, 0), (2, 4, 3)]


def test_prefix_scan_in_groups(spark, monkeypatch):
    import rillflow.llm.tokens as tokens

    monkeypatch.setattr(tokens, "GROUP", 3)
    docs = spark.createDataFrame([(i, "a " * (i % 23)) for i in range(200)], "doc_id long, text string").repartition(2)
    assert {r["doc_id"]: r["n_tokens"] for r in separator_scan(flat_blocks(docs, block=5), block=5).collect()} == {i: i % 23 for i in range(200)}


def test_separator_in_a_text(spark, tokenizer):
    docs = spark.createDataFrame([(2**53 + 1, "a <|endoftext|> b"), (None, "c"), (None, None)], "doc_id long, text string").coalesce(1)
    assert [(r["doc_id"], r["n_tokens"]) for r in separator_scan(flat_blocks(docs, block=2), block=2).orderBy("ordinal").collect()] == [(2**53 + 1, 3), (None, 1), (None, 0)]


def test_words_equal_the_tokenizer(tokenizer):
    from rillflow.llm.tokens import WordIds

    rng, words = np.random.default_rng(5), WordIds(vocabulary())
    letters = list("abcdefghijklmnopqrstuvwxyzABCZßàéüÿÀÉÞŒœIıİΣσς'.,!?#<|>0123456789_-+/ \n\t") + ["中", "😀", "e\u0301", "\u212b", "ﬁ", "\x00", "\u200b"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 60))) for _ in range(3000)]
    for text, ids in zip(texts, words.texts(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_come_back_from_the_older_generation(monkeypatch, tokenizer):
    import rillflow.llm.tokens as tokens

    monkeypatch.setattr(tokens, "KNOWN", 3)
    monkeypatch.setattr(tokens, "SLICE", 10)
    words, texts = tokens.WordIds(vocabulary()), ["one two three", "four five one", "six one seven eight", "one nine ten", "two one"] * 3
    assert [np.frombuffer(x, "<u4").tolist() for x in words.texts(texts)] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_words_need_little_beside_what_is_known(prose):
    from rillflow.llm.tokens import WordIds

    words, text = WordIds(vocabulary()), prose(3000, 4)
    odd = " ".join(f"x{i}-{i}" for i in range(20_000))
    tracemalloc.start()
    count = sum(len(x) > 0 for x in words.texts([odd, *[text] * (6_000_000 // len(text))]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert count == 1 + 6_000_000 // len(text)
    assert peak < 20_000_000


def test_tasks_of_the_join_drop_the_words_of_the_tokenizer():
    import rillflow.llm.tokens as tokens
    from rillflow.llm.jaccard import _slices

    path = vocabulary()
    words = weakref.ref(tokens.word_ids(path))
    assert tokens.word_ids(path) is words()
    assert list(_slices(iter([]))) == []
    gc.collect()
    assert words() is None


def test_packing_over_levels(spark, monkeypatch):
    import rillflow.llm.packing as packing

    monkeypatch.setattr(packing, "SHARD", 30)
    rng = np.random.default_rng(3)
    data = [(i, 0, int(rng.integers(1, 120)), "x", 4) for i in range(600)] + [(900 + i, 0, 120, "y", 4) for i in range(5)]
    out = pack(spark.createDataFrame(data, "doc_id long, piece int, length long, _shard string, _level int"), 120).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"], r["_shard"], r["_level"]) for r in out) == sorted(data)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 120
    # Not far from what one shard of all pieces gives.
    alone = sum_of_squares(np.array(sorted((x[2] for x in data), reverse=True)), 120)[2]
    print(len(bins), len(alone))
    assert len(bins) <= 1.05 * len(alone)


def test_large_ids_beside_a_null_stay(spark):
    df = spark.createDataFrame([(2**60 + 1, "one two"), (None, "three")], "doc_id long, text string").coalesce(1)
    assert {r["doc_id"] for r in token_pieces(df).collect()} == {2**60 + 1, None}
