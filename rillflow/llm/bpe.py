"""Byte-level BPE: exact ids of texts in linear time, and texts of ids.

A piece of text (a match of the pre-tokenizing pattern) is read as Latin-1, one character a byte, by an Aho-Corasick
automaton of all tokens. From each place the longest token is tried first, then the shorter ones that start there; a token
may follow another only where the merges keep the two apart. Whether they do depends on the two alone and is remembered, so
that each place of a piece is entered once. A sequence whose neighbours are all kept apart is the one that the merges give:
the first merge across a border would also happen between the two neighbours by themselves.
"""

from __future__ import annotations

import base64
import re
import sys
import types
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read
from .tokens import vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Words, pieces and pairs that a worker remembers, and characters whose words are held at once.
KNOWN, PAIRS, SLICE = 150_000, 1_000_000, 2_000_000
#: Where a piece surely begins, and what has spaces that none begins at. White space here is a little more than in patterns.
CUT, UNEVEN = re.compile(r" (?=\S)"), re.compile(r" (?:\s|\Z)")
#: Bytes of a piece that the automaton takes at once; more than twice the longest token.
WINDOW = 4096


class Remembered(dict):
    """Strings and their ids in two generations, the latest and the one before: frequent ones stay."""

    def __init__(self):
        self.older: dict[str, bytes] = {}

    def turn(self) -> None:
        if len(self) > KNOWN:
            self.older = dict(self)
            self.clear()


class ByteBPE:
    """Encodes and decodes by the ranks of a file: a base64 token and its rank in each line."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        if any(bytes([b]) not in self.ranks for b in range(256)):
            raise ValueError("every single byte must be a token")
        self.tokens = dict(zip(self.ranks.values(), self.ranks))
        self.most = max(map(len, self.ranks))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        if 2 * self.most > WINDOW:
            raise ValueError("a token is too long for the window")
        self.pattern = regex.compile(pattern)
        self.lengths = {rank: len(token) for token, rank in self.ranks.items()}
        self.size = max(self.tokens) + 1
        self.next: dict[int, int] = {}
        self.steps: dict[int, list | None] = {}
        self.apart: dict[int, bool] = {}
        self.words, self.pieces = Remembered(), Remembered()

    def merges(self, piece: bytes) -> tuple[list[bytes], list[tuple[int, bytes, bytes]]]:
        """The merges as they are defined, lowest rank first and leftmost of equals, for single tokens only: the parts that
        are left, and after each merge its rank, the first part and the last."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        ranks, none = self.ranks, sys.maxsize
        pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:])]
        steps = []
        while pairs and (rank := min(pairs)) < none:
            i = pairs.index(rank)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
            steps.append((rank, parts[0], parts[-1]))
        return parts, steps

    def grown(self, token: int) -> list[tuple[int, bytes, bytes]] | None:
        """How the merges make a token, or None if they make other ones of its bytes."""
        if token not in self.steps:
            b = self.tokens[token]
            parts, steps = self.merges(b)
            self.steps[token] = [(-1, b[:1], b[-1:]), *steps] if parts == [b] else None
        return self.steps[token]

    def kept_apart(self, a: int, b: int) -> bool:
        """Whether token b may follow token a; without one (-1), whether the merges make b at all.

        The merges inside both go on side by side, the lowest rank first, and the left one of equals; they are kept apart if
        what meets at the border never comes first.
        """
        x, y = [] if a < 0 else self.grown(a), self.grown(b)
        if a < 0 or x is None or y is None:
            return x is not None and y is not None
        i = j = 0
        none, ranks = sys.maxsize, self.ranks
        while True:
            left = x[i + 1][0] if i + 1 < len(x) else none
            right = y[j + 1][0] if j + 1 < len(y) else none
            border = ranks.get(x[i][2] + y[j][1], none)
            if border < left and border <= right:
                return False
            if left == right == none:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def shorter(self, token: int) -> int:
        """The next shorter token that this one starts with; -1 if there is none."""
        known = self.next.get(token)
        if known is None:
            b = self.tokens[token]
            known = self.next[token] = next((self.ranks[b[:k]] for k in range(len(b) - 1, 0, -1) if b[:k] in self.ranks), -1)
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece, backtracking from longest matches."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        text, n, lengths, apart, size = piece.decode("latin-1"), len(piece), self.lengths, self.apart, self.size
        # What precedes a place is settled by the place, so one that led nowhere is not entered again.
        closed, out, at, last = bytearray(n + 1), [], 0, -1
        # Longest matches, each from the end of the one before, of a window that begins at base.
        walk, ahead, base = self.automaton.iter_long(text[:WINDOW]), 0, 0
        while True:
            if ahead != at or (at + self.most > base + WINDOW and base + WINDOW < n):
                walk, base = self.automaton.iter_long(text[at : at + WINDOW]), at
            token = next(walk)[1]
            ahead = at + lengths[token]
            while True:
                if token < 0:
                    closed[at] = 1
                    token = out.pop()
                    at -= lengths[token]
                    last = out[-1] if out else -1
                    token = self.shorter(token)
                    continue
                if not closed[at + lengths[token]]:
                    pair = last * size + token
                    if pair not in apart:
                        if len(apart) >= PAIRS:
                            apart.clear()
                        apart[pair] = self.kept_apart(last, token)
                    if apart[pair]:
                        break
                token = self.shorter(token)
            out.append(token)
            at += lengths[token]
            last = token
            if at == n:
                return out

    def stretches(self, text: str) -> Iterator[str]:
        """A text in stretches of some length, cut where a piece begins."""
        start = 0
        while len(text) - start > SLICE and (cut := CUT.search(text, start + SLICE)):
            yield text[start : cut.start()]
            start = cut.start()
        yield text[start:]

    def word(self, word: str) -> bytes:
        """Ids of all pieces of a word and the space before it, where it has one."""
        out = []
        for p in self.pattern.findall(word):
            ids = self.pieces.get(p) or self.pieces.older.get(p)
            if ids is None:
                self.pieces.turn()
                ids = self.pieces[p] = np.array(self.encode_piece(p.encode()), "<i4").tobytes()
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text as 32-bit integers; null is as an empty text.

        A space before what is no white space begins a piece, so words are encoded each by itself, and remembered as their
        pieces are.
        """
        out = []
        for part in self.stretches(text or ""):
            first, *rest = CUT.split(part) if UNEVEN.search(part) else part.split(" ")
            out.append(self.word(first))
            words = self.words
            words.turn()
            for w in set(rest):
                if w not in words:
                    words[w] = words.older.get(w) or self.word(" " + w)
            out.append(b"".join(map(words.__getitem__, rest)))
        return np.frombuffer(b"".join(out), "<i4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(path: str, pattern: str) -> ByteBPE:
    """The coder of this Python worker; tasks that follow each other in it share it."""
    state = sys.modules.setdefault("_rillflow_bpe", types.ModuleType("_rillflow_bpe"))
    if getattr(state, "of", None) != (path, pattern):
        state.of, state.coder = (path, pattern), ByteBPE(path, pattern)
    return state.coder


def piece_pattern() -> str:
    """The pattern that goes with the public rank files."""
    import public_tokenizers

    return public_tokenizers.PATTERN


def byte_bpe_encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """docs (doc_id, text) as doc_id, ids: the ids of each whole text, without special tokens.

    Strings that look like special tokens are ordinary text. A null or an empty text has no ids (an empty array). Null
    doc_ids stay null, repeated rows are encoded each, other columns are left out, and an empty table gives no rows. A
    text, however long, is encoded within one task in time linear in its length; there is no shuffle.
    """
    path, pattern = path or vocabulary(RANKS), pattern or piece_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            texts, start, size, found = b.column(1), 0, 0, []
            for i in range(len(texts)):
                found.append(bpe.encode(texts[i].as_py()))
                size += len(found[-1])
                if size > SLICE or i + 1 == len(texts):
                    ends = np.cumsum([0] + [len(x) for x in found]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(found)), ids], ["doc_id", "ids"])
                    start, size, found = i + 1, 0, []

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def byte_bpe_decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded (doc_id, ids) as doc_id, ids, bytes: what the ids stand for, which need not be whole characters.

    Null ids are as none and give no bytes; an id that is no token (null inside the array too) is an error.
    """
    path, pattern = path or vocabulary(RANKS), pattern or piece_pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = coder(path, pattern)
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.slice(i, 256)
                own = pa.array([bpe.decode(x.values.to_numpy(zero_copy_only=False).tolist()) if x.is_valid else b"" for x in part.column(1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), own], ["doc_id", "ids", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, bytes binary")


def op13_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again, as counts and digests."""
    out = byte_bpe_decode(byte_bpe_encode(read(spark, sf_dir, "documents")))
    decimals = F.encode(F.concat_ws(",", F.col("ids").cast("array<string>")), "UTF-8")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimals, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
