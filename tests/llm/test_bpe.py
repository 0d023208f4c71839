import base64
import hashlib
import random
import sys

import pytest
import tiktoken

from rillflow.llm.bpe import RANKS, ByteBPE, byte_bpe_decode, byte_bpe_encode, op13_byte_bpe, piece_pattern
from rillflow.llm.tokens import vocabulary


@pytest.fixture(scope="module")
def ranks():
    with open(vocabulary(RANKS), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=piece_pattern(), mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE(vocabulary(RANKS), piece_pattern())


def test_every_character_is_split_as_the_library_does(bpe, library):
    chars = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    for i in range(0, len(chars), 4096):
        text = "".join(f"a{c}1{c} {c}." for c in chars[i : i + 4096])
        assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_odd_texts(bpe, library, prose):
    rng = random.Random(7)
    some = ["", " ", "\n\n  \n", "a" * 5000, "ab" * 3000, " " * 3000, "\t \t  x", "<|endoftext|>", "don't we'll I'M", "ß" * 700, "日本語のテキスト" * 50, "😀" * 400, "é́" * 300, prose(4000, 3)]
    some += ["".join(rng.choices("ab", k=300)) for _ in range(60)] + ["".join(rng.choices("abcdeinorst'- \n", k=400)) for _ in range(200)]
    some += ["".join(rng.choices("éèüßñçабвгд的一是不了 ", k=300)) for _ in range(100)]
    for t in some:
        assert bpe.encode(t).tolist() == library.encode_ordinary(t), t[:50]


def test_pieces_of_any_bytes_merge_as_defined(bpe):
    rng = random.Random(11)
    for _ in range(1500):
        piece = bytes(rng.choices(range(256), k=rng.randint(1, 30)) if rng.random() < 0.4 else rng.choices(b"aeinrst \xc3\xa9\xa8", k=rng.randint(1, 60)))
        assert [bpe.tokens[i] for i in bpe.encode_piece(piece)] == bpe.merges(piece)[0] or piece in bpe.ranks


def test_unlike_vocabularies_with_made_up_ranks(tmp_path):
    rng = random.Random(5)
    for k in range(12):
        tokens = {bytes([b]): b for b in range(256)}
        names = {bytes(rng.choices(b"abc", k=rng.randint(2, 5))) for _ in range(40)}
        for t in sorted(names, key=lambda t: (rng.random(), t)):
            tokens[t] = len(tokens)
        path = tmp_path / f"ranks{k}"
        path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in tokens.items()))
        own = ByteBPE(str(path), piece_pattern())
        library = tiktoken.Encoding(f"own{k}", pat_str=piece_pattern(), mergeable_ranks=tokens, special_tokens={})
        for _ in range(200):
            t = "".join(rng.choices("abc", k=rng.randint(1, 40)))
            assert own.encode(t).tolist() == library.encode_ordinary(t)


def test_windows_change_nothing(bpe, library, monkeypatch):
    monkeypatch.setattr("rillflow.llm.bpe.WINDOW", 2 * bpe.most + 1)
    rng = random.Random(9)
    for letters in ("ab", "aeinrst", "é\u00e8a"):
        text = "".join(rng.choices(letters, k=6000))
        assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_long_texts_are_split_in_parts(bpe, library, monkeypatch):
    text = "Some words, and   spaces \n\n that 12 parts cut. \x1c\x1cA \x1d b\x85 c \xa0 d  \t  e  " * 40
    for size in (3, 100, 101):
        monkeypatch.setattr("rillflow.llm.bpe.SLICE", size)
        assert bpe.encode(text).tolist() == library.encode_ordinary(text)


def test_documents(spark, odd_docs, no_docs, library):
    got = byte_bpe_decode(byte_bpe_encode(odd_docs))
    assert got.columns == ["doc_id", "ids", "bytes"]
    want = sorted(((r["doc_id"], library.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd_docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["ids"], bytes(r["bytes"])) for r in got.collect()), key=repr) == want
    assert byte_bpe_decode(byte_bpe_encode(no_docs)).count() == 0
    assert byte_bpe_decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first()["bytes"] == b""


def test_query_equals_the_library(spark, small, library):
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    want = set()
    for r in docs:
        ids = library.encode_ordinary(r["text"] or "")
        want.add((r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert {tuple(r) for r in op13_byte_bpe(spark, small).collect()} == want
