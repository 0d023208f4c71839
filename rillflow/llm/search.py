"""Ranked lexical search over hashed max-sketches.

An index holds each document's terms as sorted 64-bit hashes with their frequencies. At search, a document's impacts fold
into a sketch: every term falls into one of a fixed number of coordinates, which keeps the largest impact. The weights of a
query's terms, summed by coordinate, times the sketch bound the score from above, for a block of documents and all
queries at once. Documents are then scored exactly, by descending bound, until no bound reaches the worst score that is kept.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

#: ASCII characters that are no letters or digits end a term; A-Z is as a-z; all other characters belong to terms.
TABLE = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()
#: Results a query, coordinates of a sketch, documents of a block, terms of queries that are searched at once, and parts
#: in which the results of tasks are first brought together.
TOP, COORDINATES, BLOCK, QUERY_TERMS, SPREAD = 50, 2048, 512, 200_000, 64


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


def hashed(names: list[bytes]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh3_64_intdigest(t) for t in names], np.uint64).view(np.int64)


def lexical_index(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, n (terms with repeats), keys (hashes of distinct terms, ascending), tf.

    A null text and one without terms have none. Null doc_ids stay null and come last among equals; repeated rows are
    documents of their own. Other columns are left out; an empty table gives no rows. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, len(b), 256):
                part, n, keys, tf = b.slice(i, 256), [], [], []
                for text in part.column(1):
                    found = Counter(terms(text.as_py()))
                    own = hashed(list(found))
                    order = np.argsort(own)
                    keys.append(own[order])
                    tf.append(np.fromiter(found.values(), np.int64, len(found))[order])
                    n.append(int(tf[-1].sum()))
                ends = pa.array(np.cumsum([0] + [len(k) for k in keys]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (keys, tf)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "keys", "tf"])

    kind = "doc_id long, n long, keys array<long>, tf array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def query_terms(items: DataFrame) -> DataFrame:
    """items (item_id, text) as item_id, key: distinct terms. Rows of one item_id are one item; null is an item as well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(len(b)):
                own = hashed(sorted(set(terms(b.column(1)[i].as_py()))))
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(own), pa.int64()), pa.array(own, pa.int64())], ["item_id", "key"])

    return items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "item_id long, key long").distinct()


def _arrays(b: pa.RecordBatch, *columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Ends and flat values of list columns that run side by side."""
    lists = [b.column(c) for c in columns]
    return lists[0].offsets.to_numpy() - lists[0].offsets[0].as_py(), [x.flatten().to_numpy(zero_copy_only=False) for x in lists]


def document_frequencies(index: DataFrame, keys: np.ndarray) -> dict[int, int]:
    """In how many documents each of the (ascending) keys occurs; counts come from each task, not from each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(len(keys), np.int64)
        for b in batches:
            found = _arrays(b, 0)[1][0]
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            held += np.bincount(at[keys[at] == found], minlength=len(keys))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array(held[some])], ["key", "n"])

    found = index.select("keys").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in found.collect()}


class Queries:
    """A block of queries: distinct keys and their weights, and for each query its keys and what it adds to coordinates."""

    def __init__(self, own: dict[int | None, np.ndarray], weights: dict[int, int], coordinates: int):
        self.items = list(own)
        self.keys = [np.array(sorted(k for k in own[i].tolist() if weights.get(k, 0)), np.int64) for i in self.items]
        self.weights = [np.array([weights[k] for k in ks.tolist()], np.int64) for ks in self.keys]
        self.by_coordinate = np.zeros((coordinates, len(self.items)))
        for q, (ks, ws) in enumerate(zip(self.keys, self.weights)):
            np.add.at(self.by_coordinate[:, q], ks % coordinates, ws)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * tf // (1000 * tf + 20 * m)


def length_norm(n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """100 - 50 + ((50 * n * N) div L), in integers that do not overflow where n * N would."""
    if documents and total and int(n.max(initial=0)) * 50 * documents >= 2**63:
        return np.array([50 + 50 * int(x) * documents // total for x in n.tolist()], np.int64)
    return 50 + 50 * n * documents // max(total, 1)


class Ranking:
    """The best documents of each query so far, as (-score, whether doc_id is null, doc_id)."""

    def __init__(self, queries: Queries, top: int):
        self.queries, self.top = queries, top
        self.best: list[list[tuple]] = [[] for _ in queries.items]

    def block(self, ids: list[int | None], starts: np.ndarray, keys: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """Takes up documents given as slices of keys and frequencies."""
        q = self.queries
        coordinates, lengths = len(q.by_coordinate), np.diff(starts)
        value = impacts(tf, np.repeat(m, lengths))
        # Documents of equal terms score alike: one of them stands for all, in the order of their ids.
        alike: dict[bytes, int] = {}
        members: list[list[tuple]] = []
        first = []
        for d in np.flatnonzero(lengths):
            a, b = starts[d], starts[d + 1]
            g = alike.setdefault(keys[a:b].tobytes() + tf[a:b].tobytes(), len(members))
            if g == len(members):
                members.append([])
                first.append(d)
            members[g].append((ids[d] is None, ids[d] or 0))
        if not first:
            return
        members = [sorted(x)[: self.top] for x in members]
        sketch = np.zeros((len(first), coordinates))
        chosen = np.repeat(np.isin(np.arange(len(lengths)), first), lengths)
        row = np.repeat(np.arange(len(first)), lengths[first])
        np.maximum.at(sketch, (row, keys[chosen] % coordinates), value[chosen])
        bounds = sketch @ q.by_coordinate
        for i in range(len(q.items)):
            if len(q.keys[i]):
                self.query(i, bounds[:, i], members, first, starts, keys, value)

    def query(self, i: int, bounds: np.ndarray, members: list, first: list, starts: np.ndarray, keys: np.ndarray, value: np.ndarray) -> None:
        best, own, weights = self.best[i], self.queries.keys[i], self.queries.weights[i]
        worst = best[-1] if len(best) == self.top else (0, True, math.inf)
        candidates = np.flatnonzero((bounds > 0) & (bounds >= -worst[0]))
        for g in candidates[np.argsort(-bounds[candidates], kind="stable")].tolist():
            if len(best) == self.top and (-bounds[g], *members[g][0]) >= best[-1]:
                if bounds[g] < -best[-1][0]:
                    break
                continue
            a, b = starts[first[g]], starts[first[g] + 1]
            at = np.minimum(np.searchsorted(keys[a:b], own), b - a - 1) + a
            score = int((weights * value[at])[keys[at] == own].sum())
            if score:
                best += [(-score, *x) for x in members[g]]
                best.sort()
                del best[self.top :]


def lexical_search(index: DataFrame, items: DataFrame, top: int = TOP, coordinates: int = COORDINATES, query_terms_at_once: int = QUERY_TERMS) -> DataFrame:
    """The top best documents (of lexical_index) for each item (item_id, text): item_id, rank, doc_id, score.

    Queries are taken in blocks of about so many terms; each block reads the index twice (document frequencies, search).
    A block of queries is what is sent to tasks, so it is bounded however many items there are. Every task keeps the best of
    its documents for each query; those are brought together in two steps. Equal scores come by ascending doc_id, null last.
    Items without terms that any document holds, and an empty index, give no rows.
    """
    spark = index.sparkSession
    wanted = materialize(query_terms(items), "query-terms")
    stats = index.where("n > 0").agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    documents, total = stats["N"], stats["L"] or 0
    blocks = max(1, math.ceil(wanted.count() / query_terms_at_once))
    results = []
    for block in range(blocks):
        own: dict[int | None, list] = {}
        for r in wanted.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).collect():
            own.setdefault(r["item_id"], []).append(r["key"])
        if not own or not documents:
            continue
        arrays = {i: np.array(k, np.int64) for i, k in sorted(own.items(), key=lambda x: (x[0] is None, x[0] or 0))}
        df = document_frequencies(index, np.unique(np.concatenate(list(arrays.values()))))
        weights = {k: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for k, n in df.items()}
        sent = spark.sparkContext.broadcast(Queries(arrays, weights, coordinates))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            ranking = Ranking(sent.value, top)
            for b in batches:
                for i in range(0, len(b), BLOCK):
                    part = b.slice(i, BLOCK)
                    starts, (keys, tf) = _arrays(part, 2, 3)
                    ranking.block(part.column(0).to_pylist(), starts, keys, tf, length_norm(part.column(1).to_numpy(), documents, total))
            part = TaskContext.get().partitionId() % SPREAD
            for item, best in zip(sent.value.items, ranking.best):
                if best:
                    ids = [None if none else d for _, none, d in best]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(best), pa.int64()), pa.array(ids, pa.int64()), pa.array([-s for s, _, _ in best], pa.int64()), pa.array([part] * len(best), pa.int32())], ["item_id", "doc_id", "score", "part"])

        results.append(index.mapInArrow(run, "item_id long, doc_id long, score long, part int"))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = results[0]
    for r in results[1:]:
        found = found.union(r)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for by in (("item_id", "part"), ("item_id",)):
        found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= top)
    return found.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def op11_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 50 best documents for each benchmark item."""
    index = materialize(lexical_index(read(spark, sf_dir, "documents")), "lexical-index")
    return lexical_search(index, read(spark, sf_dir, "benchmark"))
