"""Exact Jaccard self-join of documents on word n-grams.

Documents with equal shingle sets form a class. Classes meet in tiles: one tile for each shingle of a class's prefix
(its rarest shingles; two sets with the wanted similarity must share one) and size band (sizes within the similarity of
each other lie in one band or the next). Inside a tile, hashed parity bitmaps bound the overlap from above:
|x & y| <= (|x| + |y| - popcount(bits(x) ^ bits(y))) / 2. Pairs that pass are intersected exactly on sorted arrays.

Shingles are 64-bit hashes and a class is identified by a 64-bit hash of its set; nothing else is approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, forget, materialize, read

N, NUM, DEN = 4, 85, 100
#: Bits of a signature, largest side of a tile, characters of text for each hash range.
BITS, TILE, RANGE_CHARS = 2048, 512, 10_000_000
#: Documents whose shared shingles meet in a task on average; partners of a row that the first sweep over tiles verifies.
BUCKET_DOCS, FIRST = 16_384, 2
#: Characters of text that a task works on at a time.
SLICE = 4_000_000
#: A shingle in at least so many classes of a batch, and this share of them, is frequent; how many frequent ones are kept.
HOT_MIN, HOT_SHARE, HOT_MOST = 32, 0.02, 1_000_000
#: Identifiers up to this number may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 2_000_000
#: A component with more than this share of all documents is hot; there are fewer than 1 / HOT_COMPONENT of them.
HOT_COMPONENT = 1 / 500
LAST = 2**31 - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted distinct hashes of the n-word shingles of texts; of the whole sequence where a text has fewer words.

    Works on about CHUNK bytes of texts at a time, for each of which some arrays hold eight bytes. A word's hash is the sum
    of its bytes' random values times powers of an odd number, taken as the difference of two prefix sums.
    """

    BASE = 0x9E3779B97F4A7C15
    CHUNK = 200_000

    def __init__(self, n: int):
        self.n = n
        self.values = np.random.default_rng(1).integers(0, 2**64, 256, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.grow(self.CHUNK + 1)

    def grow(self, size: int) -> None:
        up, down = (np.full(size, x % 2**64, np.uint64) for x in (self.BASE, pow(self.BASE, -1, 2**64)))
        up[0] = down[0] = 1
        self.up, self.down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)

    def sets(self, texts: Iterable[str | bytes | None]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        held: list[bytes] = []
        size = 0
        for t in texts:
            held.append((t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b"").lower())
            size += len(held[-1]) + 1
            if size >= self.CHUNK:
                out += self.chunk(held)
                held, size = [], 0
        return out + self.chunk(held) if held else out

    def chunk(self, texts: list[bytes]) -> list[np.ndarray]:
        b = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        if len(b) > len(self.up):
            self.grow(len(b))
        gap = self.space[b]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        starts, ends = edge[::2], edge[1::2]
        sums = np.append(np.uint64(0), np.cumsum(self.values[b] * self.up[: len(b)], dtype=np.uint64))
        w = mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))
        firsts = np.append(0, np.cumsum([len(t) + 1 for t in texts]))
        at = np.searchsorted(starts, firsts)
        whole = self.windows(w, self.n)
        return [np.empty(0, np.uint64) if a == z else self.distinct(whole[a : z - self.n + 1] if z - a >= self.n else self.windows(w[a:z], z - a)) for a, z in zip(at[:-1].tolist(), at[1:].tolist())]

    @staticmethod
    def windows(w: np.ndarray, k: int) -> np.ndarray:
        total = np.full(max(len(w) - k + 1, 0), k, np.uint64)
        for i in range(k):
            total += w[i : len(w) - k + 1 + i] * np.uint64((2 * (i + 1) * 0x9E3779B97F4A7C1 + 1) % 2**64)
        return mix(total)

    @staticmethod
    def distinct(x: np.ndarray) -> np.ndarray:
        x = np.sort(x)
        return x[np.append(True, x[1:] != x[:-1])]


def class_of(s: np.ndarray) -> int:
    """64-bit identity of a set, as a signed integer."""
    return int(mix(np.array([mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(s))], np.uint64)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap: bit i is the parity of the number of hashes that fall on i."""
    return np.packbits((np.bincount((s >> np.uint64(17)).astype(np.int64) % BITS, minlength=BITS) & 1).astype(np.uint8)).tobytes()


def least_overlap(n: int, num: int, den: int) -> int:
    """The smallest overlap that a set of n can have with a partner."""
    return -(-num * n // den)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, a bounded amount of text at a time."""
    forget()
    for b in batches:
        if b.num_rows:
            part = np.cumsum(pc.fill_null(pc.utf8_length(b.column("text")), 0).to_numpy().astype(np.int64) + 1) // SLICE
            ends = np.flatnonzero(np.append(np.diff(part) != 0, True)) + 1
            for a, z in zip(np.append(0, ends[:-1]).tolist(), ends.tolist()):
                yield b.slice(a, z - a)
    pa.default_memory_pool().release_unused()


def _texts(b: pa.RecordBatch) -> Iterator[bytes | None]:
    """The texts of a batch one after the other, so that few of them are held twice."""
    return (t.as_py() for t in b.column("text").cast(pa.binary()))


SIGNATURE = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int32()), ("cls", pa.int64())])


def _signatures(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in _slices(batches):
            sets = shingler.sets(_texts(b))
            cls = [class_of(s) if len(s) else 0 for s in sets]
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(cls), pa.int32()), b.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), pa.array(cls, pa.int64())], schema=SIGNATURE)
            each = list({c: s for c, s in zip(cls, sets) if len(s)}.values())
            if each:
                values, counts = np.unique(np.concatenate(each), return_counts=True)
                hot = values[counts >= max(HOT_MIN, HOT_SHARE * len(each))]
                yield pa.RecordBatch.from_arrays([pa.array([1] * len(hot), pa.int32()), pa.nulls(len(hot), pa.int64()), pa.array([1] * len(hot), pa.int32()), pa.array(hot.view(np.int64))], schema=SIGNATURE)

    return run


BLOCK = pa.schema([("r", pa.int32()), *((c, pa.binary()) for c in ("cls", "size", "need", "count", "tok"))])


def _blocks(n: int, num: int, den: int, ranges: int, frequent):
    """Postings by hash range, packed: for each class of a batch how many of its shingles fall there, then those.

    A class's size and need go with its first range only, and are 0 in the others.
    """

    def pack(r: int, cls, size, need, count, values) -> tuple:
        return r, *(np.asarray(x, t).tobytes() for x, t in ((cls, np.int64), (size, np.int32), (need, np.int32), (count, np.int32))), values.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hot, turn = Shingler(n), frequent.value, 0
        for b in _slices(batches):
            each = {class_of(s): s for s in shingler.sets(_texts(b)) if len(s)}
            cls, sizes, needs, cold, late = list(each), [], [], [], []
            for s in each.values():
                is_hot = hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)
                rest = s[~is_hot]
                r = ((rest >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                low = rest & np.uint64(0xFFFFFFFF)
                distinct = len(np.unique((r << np.uint64(32)) | low))
                need = len(s) - least_overlap(len(s), num, den) + 1 - distinct
                sizes.append(len(s))
                needs.append(need)
                cold.append((r.astype(np.int64), low.astype(np.uint32)))
                late.append(s[is_hot][: max(need, 0)])
            rows, of = [], np.repeat(np.arange(len(cls)), [len(x[0]) for x in cold])
            if len(of):
                r, low = (np.concatenate([x[i] for x in cold]) for i in (0, 1))
                order = np.argsort(r, kind="stable")
                r, low, of = r[order], low[order], of[order]
                ends = np.flatnonzero(np.append(np.diff(r) != 0, True)) + 1
                ids, sz, nd, told = np.array(cls), np.array(sizes), np.array(needs), np.zeros(len(cls), bool)
                for a, z in zip(np.append(0, ends[:-1]), ends):
                    own, count = np.unique(of[a:z], return_counts=True)
                    new = ~told[own]
                    told[own] = True
                    rows.append(pack(int(r[a]), ids[own], sz[own] * new, nd[own] * new, count, low[a:z]))
            if own := [i for i, x in enumerate(late) if len(x)]:
                turn += 1
                rows.append(pack(-1 - (turn * 7919 + len(of)) % ranges, [cls[i] for i in own], [sizes[i] for i in own], [needs[i] for i in own], [len(late[i]) for i in own], np.concatenate([late[i] for i in own])))
            yield pa.RecordBatch.from_arrays([pa.array(list(x), kind) for x, kind in zip(zip(*rows) if rows else [[]] * 6, BLOCK.types)], schema=BLOCK)

    return run


def _numbers(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x, kind) for x in column])


def _shared(buckets: int):
    """Of one hash range: for each class its shingles that another class has too, with their document frequency.

    Packed by bucket of classes: each class of a row has `count` of the row's shingles.
    """

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        r = key[0]
        cls, size, need, count = (_numbers(b[c], t) for c, t in (("cls", np.int64), ("size", np.int32), ("need", np.int32), ("count", np.int32)))
        tok = _numbers(b["tok"], np.uint32 if r >= 0 else np.uint64)
        order = np.argsort(cls, kind="stable")
        first = np.append(True, np.diff(cls[order]) != 0)
        index = np.empty(len(cls), np.uint32)
        index[order] = np.cumsum(first) - 1
        known = cls[order[first]]
        of = np.repeat(index, count)
        if r < 0:
            df = np.full(len(tok), LAST, np.int32)
        else:
            # In place and soon without what only one class has, as these are the largest arrays of a task.
            pair = tok.astype(np.uint64)
            pair <<= np.uint64(32)
            pair |= of
            del tok, of
            pair.sort()
            pair = pair[np.diff(pair, prepend=~pair[:1]) != 0]
            same = np.diff(pair >> np.uint64(32)) == 0
            pair = pair[(np.append(same, False) | np.append(False, same))[: len(pair)]]
            tok, of = (pair >> np.uint64(32)).astype(np.uint32), (pair & np.uint64(0xFFFFFFFF)).astype(np.int64)
            ends = np.flatnonzero(np.diff(tok)) + 1
            counts = np.diff(np.concatenate([[0], ends, [len(tok)]])).astype(np.int32)
            df = np.repeat(counts, counts)
        told_n, told_need = np.zeros(len(known), np.int32), np.zeros(len(known), np.int32)
        told_n[index[size > 0]], told_need[index[size > 0]] = size[size > 0], need[size > 0]
        own = np.flatnonzero((told_n > 0) | (np.bincount(of, minlength=len(known)) > 0))
        bucket = (known.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((of, bucket[of]))
        tok, of, df = tok[order], of[order], df[order]
        own = own[np.argsort(bucket[own], kind="stable")]
        many = np.bincount(of, minlength=len(known))[own].astype(np.int32)
        rows = []
        for k in np.unique(bucket[own]).tolist():
            a, z = np.searchsorted(bucket[own], [k, k + 1])
            x, y = np.searchsorted(bucket[of], [k, k + 1])
            rows.append((k, r, *(v.tobytes() for v in (known[own[a:z]], told_n[own[a:z]], told_need[own[a:z]], many[a:z], tok[x:y], df[x:y]))))
        return pd.DataFrame(rows, columns=["bucket", "r", "cls", "size", "need", "count", "tok", "df"])

    return run


def _prefixes(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """Of one bucket of classes: the shared shingles of each class's prefix. Rarest first; frequent ones are the last."""
    pa.default_memory_pool().release_unused()
    cls, size, need, count = (_numbers(b[c], t) for c, t in (("cls", np.int64), ("size", np.int32), ("need", np.int32), ("count", np.int32)))
    tok = np.concatenate([np.frombuffer(t, np.uint32).astype(np.uint64) | np.uint64(r << 32) if r >= 0 else np.frombuffer(t, np.uint64) for r, t in zip(b["r"].tolist(), b["tok"])])
    df = _numbers(b["df"], np.int32)
    known, index = np.unique(cls, return_inverse=True)
    n, slots = np.zeros(len(known), np.int32), np.zeros(len(known), np.int64)
    n[index[size > 0]], slots[index[size > 0]] = size[size > 0], need[size > 0]
    of = np.repeat(index, count)
    order = np.lexsort((tok, df, of))
    tok, df, of = tok[order], df[order], of[order]
    # Copies of a document in other batches repeat its frequent shingles.
    new = np.append(True, (of[1:] != of[:-1]) | (df[1:] != df[:-1]) | (tok[1:] != tok[:-1])) if len(of) else np.empty(0, bool)
    tok, df, of = tok[new], df[new], of[new]
    slots += np.bincount(of[df < LAST], minlength=len(known))
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    keep = rank < slots[of]
    tok, df, of = tok[keep], df[keep], of[keep]
    return pd.DataFrame({"cls": known[of], "n": n[of], "hot": df == LAST, "tok": tok.view(np.int64)})


SETS = pa.schema([("cls", pa.int64()), ("bits", pa.binary()), ("hashes", pa.list_(pa.int64()))])


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in _slices(batches):
            each = {class_of(s): s for s in shingler.sets(_texts(b)) if len(s)}
            if each:
                ends = np.cumsum([0, *map(len, each.values())]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(list(each.values())).view(np.int64)), type=SETS.field("hashes").type)
                yield pa.RecordBatch.from_arrays([pa.array(list(each), pa.int64()), pa.array([bitmap(s) for s in each.values()], pa.binary()), hashes], schema=SETS)

    return run


def _verify(num: int, den: int):
    def parts(column: pa.ListArray) -> tuple[np.ndarray, list[int]]:
        """All hashes of a column of sets, without a copy, and where each set starts."""
        ends = column.offsets.to_numpy()
        return column.values.to_numpy().view(np.uint64), ends.tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            keep = np.zeros(p.num_rows, bool)
            (xs, x_at), (ys, y_at) = parts(p.column("x")), parts(p.column("y"))
            for i, (bx, by) in enumerate(zip(p.column("bx"), p.column("by"))):
                x, y = xs[x_at[i] : x_at[i + 1]], ys[y_at[i] : y_at[i + 1]]
                apart = int(np.bitwise_count(np.frombuffer(bx.as_buffer(), np.uint64) ^ np.frombuffer(by.as_buffer(), np.uint64)).sum())
                most = (len(x) + len(y) - apart) // 2
                if den * most < num * (len(x) + len(y) - most):
                    continue
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum())
                keep[i] = den * both >= num * (len(x) + len(y) - both)
            yield p.select(["a", "b"]).filter(pa.array(keep))
        pa.default_memory_pool().release_unused()

    return run


def _tile(num: int, den: int, first: int | None):
    """Pairs of different components that the bounds let pass; with first, the likeliest so many of each row."""

    def run(_: tuple, t: pd.DataFrame) -> pd.DataFrame:
        t = t.drop_duplicates(["cls", "own", "other"]).sort_values("n", kind="stable")
        cls, comp, n = t["cls"].to_numpy(), t["comp"].to_numpy(), t["n"].to_numpy().astype(np.int64)
        bits = np.frombuffer(b"".join(t["bits"]), np.uint64).reshape(len(t), -1)
        left, right = t["own"].to_numpy(), t["other"].to_numpy()
        a, b = [], []
        for i in np.flatnonzero(left):
            j = np.flatnonzero(right & (comp != comp[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i])))
            if len(j):
                most = (n[j] + n[i] - np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1)) // 2
                near = den * most >= num * (n[j] + n[i] - most)
                j, most = j[near], most[near]
                if first and len(j) > first:
                    j = j[np.lexsort((cls[j], -most / (n[j] + n[i] - most)))[:first]]
                a += [cls[i]] * len(j)
                b += cls[j].tolist()
        lo, hi = np.minimum(np.array(a, np.int64), np.array(b, np.int64)), np.maximum(np.array(a, np.int64), np.array(b, np.int64))
        return pd.DataFrame({"a": lo, "b": hi}).drop_duplicates()

    return run


def _sweep(members: DataFrame, roots: DataFrame, sets: DataFrame, num: int, den: int, first: int | None) -> DataFrame:
    """Pairs (a, b) to verify, of classes that share a tile and lie in different components."""
    key = ("hot", "tok")
    labelled = members.where((F.col("cls") != F.col("pivot")) & (F.col("c") > 2)).join(roots.withColumnRenamed("v", "cls"), "cls", "left").select(*key, "cls", "n", F.coalesce("root", "cls").alias("comp"))
    labelled = materialize(labelled.withColumn("band", F.floor(F.log(F.col("n")) / (math.log(den / num) * 1.0001)).cast("int")), "labelled")
    open_ = labelled.groupBy(*key).agg((F.min("comp") != F.max("comp")).alias("open")).where("open").drop("open")
    bands = labelled.groupBy(*key, "band").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
    rows = labelled.join(open_, [*key]).join(sets.select("cls", "bits"), "cls").withColumn("at", F.explode(F.array("band", F.col("band") - 1)))
    up, down = bands.select(*key, F.col("band").alias("at"), F.col("parts").alias("mine")), bands.select(*key, (F.col("band") - 1).alias("at"), F.col("parts").alias("above"))
    rows = rows.join(up, [*key, "at"]).join(down, [*key, "at"], "left").withColumn("above", F.coalesce("above", F.lit(0)))
    # Parts of a tile: the band's own (0 .. mine-1), then those of the next band; a cell compares part i with part j >= i.
    low = F.col("at") == F.col("band")
    part = F.pmod(F.xxhash64("cls"), F.when(low, F.col("mine")).otherwise(F.col("above"))).cast("int")
    rows = rows.withColumn("part", part + F.when(low, 0).otherwise(F.col("mine")))
    parts = F.sequence(F.lit(0), F.col("mine") + F.col("above") - 1)
    cells = rows.withColumn("cell", F.explode(F.transform(parts, lambda q: F.struct(F.least("part", q).alias("i"), F.greatest("part", q).alias("j"))))).where(F.col("cell.i") < F.col("mine"))
    cells = cells.select(*key, "at", "cell.i", "cell.j", "cls", "comp", "n", "bits", (F.col("part") == F.col("cell.i")).alias("own"), (F.col("part") == F.col("cell.j")).alias("other"))
    cell = (*key, "at", "i", "j")
    dealt = cells.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell)
    return dealt.groupBy(*cell).applyInPandas(_tile(num, den, first), "a long, b long").distinct()


def ngram_jaccard(docs: DataFrame, n: int = N, num: int = NUM, den: int = DEN) -> DataFrame:
    """One row for each document (doc_id, text): doc_id, n_shingles, component_id.

    Two documents link when den * intersection >= num * union of their n-word shingle sets; component_id is the smallest
    doc_id that links reach. A document without words has no shingles and is its own component. A null doc_id takes no
    part: its component_id is null. Rows that repeat a doc_id are kept as rows. Other columns are not read; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    ranges = max(16, math.ceil(chars / RANGE_CHARS))
    found = materialize(docs.mapInArrow(_signatures(n), "kind int, doc_id long, n int, cls long"), "signatures")
    sig = found.where("kind = 0")
    hot = found.where("kind = 1").groupBy("cls").count().orderBy(F.desc("count"), "cls").limit(HOT_MOST).select("cls")
    frequent = spark.sparkContext.broadcast(np.sort(hot.toPandas()["cls"].to_numpy(np.int64).view(np.uint64)))

    known = docs.where("doc_id is not null")
    blocks = known.select("text").mapInArrow(_blocks(n, num, den, ranges, frequent), "r int, cls binary, size binary, need binary, count binary, tok binary")
    shared = blocks.groupBy("r").applyInPandas(_shared(max(4, math.ceil(sig.count() / BUCKET_DOCS))), "bucket int, r int, cls binary, size binary, need binary, count binary, tok binary, df binary")
    postings = materialize(shared.groupBy("bucket").applyInPandas(_prefixes, "cls long, n int, hot boolean, tok long"), "postings")

    # Tiles with the same members are the same work: one of them is enough.
    groups = postings.groupBy("hot", "tok").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("cls")).alias("s"), F.bit_xor(F.xxhash64("cls", F.lit(7))).alias("u"), F.min(F.struct(F.xxhash64("cls").alias("o"), "n", "cls")).alias("p"))
    once = groups.where("c > 1").groupBy("c", "s", "u").agg(F.min(F.struct("hot", "tok")).alias("g"), F.first("p").alias("p"))
    once = once.select("c", "g.hot", "g.tok", F.col("p.cls").alias("pivot"), F.col("p.n").alias("pn"))
    members = materialize(postings.join(once, ["hot", "tok"]), "members")

    ids = sig.where("n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(members.select("cls").distinct(), "cls").select("doc_id")
    ids = materialize(ids, "candidates")
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    texts = known.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select("text")
    sets = texts.mapInArrow(_sets(n), "cls long, bits binary, hashes array<long>").groupBy("cls").agg(F.first("bits").alias("bits"), F.first("hashes").alias("hashes"))
    sets = materialize(sets, "sets")

    def verified(pairs: DataFrame) -> DataFrame:
        x = sets.select(F.col("cls").alias("a"), F.col("bits").alias("bx"), F.col("hashes").alias("x"))
        y = sets.select(F.col("cls").alias("b"), F.col("bits").alias("by"), F.col("hashes").alias("y"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y", "bx", "by").mapInArrow(_verify(num, den), "a long, b long")

    close = den * F.least("n", "pn") >= num * F.greatest("n", "pn")
    stars = members.where((F.col("cls") != F.col("pivot")) & close).select(F.least("cls", "pivot").alias("a"), F.greatest("cls", "pivot").alias("b")).distinct()
    edges = materialize(verified(stars), "edges")
    roots = components(edges)

    # What the pivots have not joined is compared tile by tile: first likely pairs, then all that are still apart.
    for first in (FIRST, None):
        more = materialize(verified(_sweep(members, roots, sets, num, den, first)), "edges")
        if not more.isEmpty():
            edges = materialize(edges.union(more), "edges")
            roots = components(edges)

    per_doc = sig.join(roots.withColumnRenamed("v", "cls"), "cls", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "cls").alias("root"))
    per_doc = materialize(per_doc, "documents")
    linked = per_doc.where("n_shingles > 0 and doc_id is not null")
    least = materialize(linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("docs")), "least")
    # Hot components are few by their definition, so they are broadcast; documents of the others meet theirs by a shuffle.
    hot_roots = F.broadcast(least.where(F.col("docs") > sig.count() * HOT_COMPONENT).select("root", "component_id"))
    named = linked.join(hot_roots, "root").unionByName(linked.join(hot_roots.select("root"), "root", "left_anti").join(least.select("root", "component_id"), "root"))
    apart = per_doc.where("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return named.select("doc_id", "n_shingles", "component_id").union(apart)


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on 4-word shingles at a similarity of 0.85."""
    return ngram_jaccard(read(spark, sf_dir, "documents"))
