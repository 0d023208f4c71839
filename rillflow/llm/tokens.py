"""Token ids of texts by a public tokenizer, through a cache of words; and token counts from flat token files.

The tokenizer drops white space and merges never cross it, so a text's ids are those of its space-separated words, one
after the other. Words repeat, so each task encodes every word once and joins bytes.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, materialize, read

VOCABULARY = "word_bpe_49k.json"
CAPACITY, END = 4096, 1
#: The id that ends a document in a flat token file, what stands there for a text's own token of that id (the first id
#: beyond the vocabulary), tokens in a block, how a token is stored, and blocks in a group of the prefix scan.
SEPARATOR, STAND_IN, BLOCK, KIND, GROUP = 49407, 49408, 65_536, "<u2", 4096

#: Marks after a lower-case letter and before a space: the tokenizer cuts there, so a word and its marks are kept apart.
MARKS = re.compile(rb"([.,;:!?#*$%&|](?:(?<=[a-z].)|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf].))[.,;:!?#*$%&|]*)(?=[ \t-\r]|\Z)")
#: Words of letters of which the tokenizer changes no more than their case.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+\Z")
#: Words of a generation, characters of text worked on at a time, words given to the tokenizer at a time. The last two bound
#: what a worker holds beside the words that it knows: a split text takes ten times its size, an encoded word half a kilobyte.
KNOWN, SLICE, ENCODED = 200_000, 400_000, 2000


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit integers.

    Words live in two generations: those of the latest texts, and those before. When the first is full it becomes the
    second, whose words are forgotten unless a text brings them back, so frequent words are encoded once.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks run side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.older: dict[bytes, bytes] = {}
        # Letters as the model sees them: one character for each byte. The plain ones all start with the byte C3.
        self.letters = {ord(c): self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c.isalpha()}

    def words(self, text: str | None) -> list[bytes]:
        """Words of a text with equal ids wherever they occur; capital ASCII letters are as small ones to the tokenizer."""
        b = text.encode("utf-8", "surrogatepass") if text else b""
        return b.split() if b"<|" in b else MARKS.sub(rb" \1", b.lower()).split()

    def texts(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Ids of each text."""
        held: list[list[bytes]] = []
        size = 0
        for t in texts:
            held.append(self.words(t))
            size += len(t) if t else 0
            if size >= SLICE:
                yield from self.joined(held)
                held, size = [], 0
        yield from self.joined(held)

    def joined(self, texts: list[list[bytes]]) -> Iterator[bytes]:
        if len(self) > KNOWN:
            self.older = dict(self)
            self.clear()
        new = []
        for w in set().union(*texts):
            if w not in self:
                if w in self.older:
                    self[w] = self.older[w]
                else:
                    new.append(w)
        self.learn(new)
        for words in texts:
            yield b"".join(map(self.__getitem__, words))

    def learn(self, new: list[bytes]) -> None:
        """Encodes words: plain ones by the model alone, the others by the whole tokenizer."""
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in new:
            if PLAIN.match(w):
                text = w.decode("ascii") if w.isascii() else w.decode("utf-8").lower().translate(self.letters)
                self[w] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in tokenize(text)]) else b""
            else:
                rest.append(w)
        for i in range(0, len(rest), ENCODED):
            some = rest[i : i + ENCODED]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in some], add_special_tokens=False)):
                self[w] = struct.pack(f"<{len(e.ids)}I", *e.ids)


def word_ids(path: str) -> WordIds:
    """The words that this Python worker knows; tasks that follow each other in it share them, until another operator's come."""
    return kept(("words", path), lambda: WordIds(path))


def vocabulary(name: str = VOCABULARY) -> str:
    """Path of a public tokenizer file; the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def token_pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """The token sequence of each document (doc_id, text) and its end id, cut into pieces of at most capacity.

    Returns doc_id, piece, start, length, ids_crc32, and with with_ids the piece's ids. A null text counts as empty and
    gives a single piece that holds the end id only. Texts are encoded whole, within one task each, without a shuffle.
    """
    path = path or vocabulary()

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, last = word_ids(path), np.array([end], "<u4").tobytes()
        for b in batches:
            rows = []
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), cache.texts(t.as_py() for t in b.column("text"))):
                ids += last
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((doc_id, i, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, "<u4").astype(np.int32)] if with_ids else [])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows), schema.types)], schema=schema)
        pa.default_memory_pool().release_unused()

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def flat_blocks(docs: DataFrame, path: str | None = None, separator: int = SEPARATOR, block: int = BLOCK, dtype: str = KIND) -> DataFrame:
    """Flat token streams of docs (doc_id, text) without any index: file, block, tokens, doc_ids.

    Every task writes one stream, in which each document's ids are followed by the separator; the stream is cut into
    blocks of a fixed number of tokens (little-endian binary, of 16 bits by default), wherever documents end. doc_ids names,
    in order, the documents that end in a block; null ids stay null. A text's own tokens of the separator's id are kept as
    STAND_IN, which no text yields. A null or empty text is a separator alone.
    """
    path = path or vocabulary()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        cache, last, file = word_ids(path), np.array([separator], dtype).tobytes(), TaskContext.get().partitionId()
        rest, n, step, width = bytearray(), 0, block * np.dtype(dtype).itemsize, np.dtype(dtype).itemsize
        own: deque[tuple[int, str | None]] = deque()

        def cut(size: int) -> pd.DataFrame:
            ids = []
            while own and own[0][0] < n * block + size // width:
                ids.append(own.popleft()[1])
            return pd.DataFrame({"file": [file], "block": [n], "tokens": [bytes(rest[:size])], "doc_ids": [ids]})

        for b in batches:
            for doc_id, text in zip(b["doc_id"], cache.texts(b["text"])):
                ids = np.frombuffer(text, "<u4")
                rest += np.where(ids == separator, STAND_IN, ids).astype(dtype).tobytes() + last
                own.append((n * block + len(rest) // width - 1, doc_id))
                while len(rest) >= step:
                    yield cut(step)
                    del rest[:step]
                    n += 1
        if rest:
            yield cut(len(rest))

    # As text, large ids stay whole beside nulls.
    known = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return known.mapInPandas(run, "file long, block long, tokens binary, doc_ids array<string>")


def file_blocks(spark, pattern: str, block: int = BLOCK, width: int = 2) -> DataFrame:
    """Blocks of raw token files on any store that Spark reads: file is a hash of the path."""
    raw = spark.read.format("binaryFile").load(pattern)
    step = block * width
    many = F.greatest(F.ceil(F.col("length") / step), F.lit(1)).cast("long")
    cut = raw.select(F.xxhash64("path").alias("file"), "content", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("block"))
    return cut.select("file", "block", F.substring(F.col("content"), (F.col("block") * step + 1).cast("int"), F.lit(step)).alias("tokens"))


def separator_scan(blocks: DataFrame, separator: int = SEPARATOR, block: int = BLOCK, dtype: str = KIND) -> DataFrame:
    """Documents of flat token streams (file, block, tokens, and doc_ids where known): doc_id, file, ordinal (from 0), start,
    n_tokens (without separator).

    Each block is searched for separators at once. What it leaves open is stitched by a prefix scan over two numbers a
    block, the count of separators so far and the place of the last: first over groups of GROUP blocks, then inside each
    group, so that no task holds a whole stream. Tokens after a stream's last separator form no document. All blocks but
    a stream's last hold exactly `block` tokens. Repeated blocks are not expected. An empty table gives no rows.
    """
    width = np.dtype(dtype).itemsize

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = [np.flatnonzero(np.frombuffer(t, dtype, count=len(t) // width) == separator) for t in b["tokens"]]
            yield pd.DataFrame({"file": b["file"], "block": b["block"], "ends": at, "doc_ids": b["doc_ids"]})

    ids = "doc_ids" if "doc_ids" in blocks.columns else F.lit(None).cast("array<string>").alias("doc_ids")
    found = materialize(blocks.select("file", "block", "tokens", ids).mapInPandas(run, "file long, block long, ends array<long>, doc_ids array<string>"), "separators")
    base = F.col("block") * block
    last = F.when(F.size("ends") > 0, base + F.element_at("ends", -1))
    narrow = found.select("file", "block", F.floor(F.col("block") / GROUP).alias("_g"), F.size("ends").cast("long").alias("n"), last.alias("last"))

    def before(c: str, f, *by: str):
        return f(c).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1))

    groups = narrow.groupBy("file", "_g").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    groups = groups.select("file", "_g", before("n", F.sum, "file", "_g").alias("gn"), before("last", F.max, "file", "_g").alias("glast"))
    inside = narrow.select("file", "block", "_g", before("n", F.sum, "file", "_g", "block").alias("bn"), before("last", F.max, "file", "_g", "block").alias("blast"))
    carry = inside.join(groups, ["file", "_g"]).select("file", "block", (F.coalesce("gn", F.lit(0)) + F.coalesce("bn", F.lit(0))).alias("_n"), F.coalesce("blast", "glast", F.lit(-1)).alias("_last"))
    docs = found.join(carry, ["file", "block"]).select("file", "_n", "_last", base.alias("_base"), "ends", "doc_ids", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") > 0, F.col("_base") + F.get("ends", F.col("i") - 1)).otherwise(F.col("_last")) + 1
    return docs.select(F.get("doc_ids", F.col("i")).cast("long").alias("doc_id"), "file", (F.col("_n") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("_base") + F.col("end") - start).alias("n_tokens"))


def op5_token_counts(spark, sf_dir: str) -> DataFrame:
    """Token counts of all documents, from flat streams written of them and then scanned for separators."""
    streams = materialize(flat_blocks(read(spark, sf_dir, "documents")), "streams")
    return separator_scan(streams)
