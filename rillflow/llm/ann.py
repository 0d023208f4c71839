"""Approximate nearest neighbours by inner product in a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is assigned to a leaf. A query walks the tree best bin first: a priority
queue holds branches by the inner product of query and centre, and leaves are visited as they come up. How many leaves a
query visits is calibrated: a few queries are answered exactly over all rows, and visits widen until the answers' leaves
are reached for the wanted share. Leaves are gathered into blocks of bounded size (a large leaf is split), so that hot
vectors spread over tasks, and queries meet the blocks that hold leaves they visit.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read

K = 20
#: Rows the tree is fitted on at most, children of a node, sampled rows in a leaf on average, calibration queries, recall.
SAMPLE, BRANCH, LEAF, CALIBRATION, RECALL = 65_536, 8, 48, 128, 0.96
#: Rows in a block, queries that meet it at a time, and queries that a task walks down the tree.
BLOCK, CHUNK, WALKS = 4096, 16_384, 2048


class Tree:
    """Centres of all nodes; children as (first, last) node numbers, or (-1, leaf number) at a leaf."""

    def __init__(self, x: np.ndarray, branch: int = BRANCH, leaf: int = LEAF, seed: int = 6):
        rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaves = [x.mean(axis=0) if len(x) else np.zeros(x.shape[1])], [(-1, 0)], 0
        todo = [(0, x)]
        while todo:
            node, rows = todo.pop()
            parts = self.split(rows, branch, rng) if len(rows) > leaf else []
            if len(parts) < 2:
                self.children[node] = (-1, self.leaves)
                self.leaves += 1
                continue
            first = len(self.centres)
            self.children[node] = (first, first + len(parts))
            for centre, own in parts:
                todo.append((len(self.centres), own))
                self.centres.append(centre)
                self.children.append((-1, 0))
        self.centres = np.array(self.centres)

    @staticmethod
    def split(x: np.ndarray, branch: int, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
        c = x[rng.choice(len(x), min(branch, len(x)), replace=False)]
        for _ in range(8):
            near = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
            used = np.unique(near)
            c = np.array([x[near == j].mean(axis=0) for j in used])
        near = np.argmax(x @ c.T - (c * c).sum(axis=1) / 2, axis=1)
        return [(c[j], x[near == j]) for j in range(len(c)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the tree by the nearest centre."""
        out, todo = np.zeros(len(x), np.int32), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            a, z = self.children[node]
            if a < 0:
                out[rows] = z
            elif len(rows):
                c = self.centres[a:z]
                near = np.argmax(x[rows] @ c.T - (c * c).sum(axis=1) / 2, axis=1)
                todo += [(a + j, rows[near == j]) for j in range(z - a)]
        return out

    def visits(self, q: np.ndarray, most: int) -> list[list[int]]:
        """Leaves of each query, best bin first."""
        out = []
        for dots in q @ self.centres.T:
            dots, heap, own = (-dots).tolist(), [(0.0, 0)], []
            while heap and len(own) < most:
                _, node = heapq.heappop(heap)
                a, z = self.children[node]
                if a < 0:
                    own.append(z)
                else:
                    for child in range(a, z):
                        heapq.heappush(heap, (dots[child], child))
            out.append(own)
        return out


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64) if len(column) else np.empty((0, 0))


def _best(ids: np.ndarray, x: np.ndarray, own: int, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of rows whose rough score is known (-inf: left out), by exact score, then id."""
    rough = np.where(ids == own, -np.inf, rough)
    kth = np.partition(rough, len(rough) - k)[len(rough) - k] if len(rough) > k else -np.inf
    at = np.flatnonzero((rough > -np.inf) & (rough >= kth - 1e-9 * (1 + abs(kth)) if kth > -np.inf else rough > -np.inf))
    score = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -score))[:k]
    return ids[at][order], score[order]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part: an id, the commonest length, all finite, not all zero."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and embedding is not null")
    sizes = v.groupBy(F.size("embedding").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where((F.size("embedding") == (sizes[0]["n"] if sizes else 0)) & finite & F.exists("embedding", lambda x: x != 0))


def exact(index: DataFrame, queries: np.ndarray, ids: np.ndarray, k: int) -> pd.DataFrame:
    """Brute force for a bounded set of queries over all rows: query, vec_id, leaf, score."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x, own = _matrix(b["embedding"]), b["vec_id"].to_numpy()
            leaf = dict(zip(own.tolist(), b["leaf"].tolist()))
            for q, i, rough in zip(queries, ids, queries @ x.T):
                found, score = _best(own, x, i, q, rough, k)
                yield pd.DataFrame({"query": i, "vec_id": found, "leaf": [leaf[f] for f in found.tolist()], "score": score})

    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return index.mapInPandas(run, "query long, vec_id long, leaf int, score double").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r").toPandas()


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, recall: float = RECALL) -> DataFrame:
    """The k rows of vectors (vec_id, embedding) with the largest inner product with each row of queries (same columns).

    Returns query_id, rank (from 1), vec_id, score in double precision, nearest first, ties to the smaller vec_id. A
    query's own vec_id is no candidate. Rows without an id, or whose vector is null, zero, of another length or not
    finite, take no part; of queries that repeat an id the one with the smallest vector is asked;
    candidates that repeat one are candidates each. Recall is calibrated, not exact. Empty tables give no
    rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    asked = usable(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("embedding").alias("q"))
    total = rows.count()
    share = min(1.0, SAMPLE / max(total, 1)) * 2**20
    sample = rows.where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(2**20)) < math.ceil(share)).limit(SAMPLE).toPandas().sort_values("vec_id")
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    tree = Tree(_matrix(sample["embedding"]))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["leaf"] = shared.value.assign(_matrix(b["embedding"])) if len(b) else np.empty(0, np.int32)
            yield b

    index = materialize(rows.mapInPandas(place, "vec_id long, embedding array<double>, leaf int"), "index")
    some = asked.orderBy(F.xxhash64("query_id", F.lit(2))).limit(CALIBRATION).toPandas()
    if not len(some):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    truth = exact(index, _matrix(some["q"]), some["query_id"].to_numpy(), k)
    order = dict(zip(some["query_id"].tolist(), tree.visits(_matrix(some["q"]), tree.leaves)))
    depth = np.sort([order[q].index(leaf) + 1 for q, leaf in zip(truth["query"].tolist(), truth["leaf"].tolist())])
    most = int(depth[min(len(depth) - 1, math.ceil(recall * len(depth)))]) if len(depth) else 1

    # Leaves in blocks of bounded size; the numbers of leaves and of blocks' bounds are the tree's, not the data's.
    counts = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    block_of, parts, block, held = {}, {}, 0, 0
    for leaf in range(tree.leaves):
        n = counts.get(leaf, 0)
        if held and held + n > BLOCK:
            block, held = block + 1, 0
        block_of[leaf], held = block, held + n
        if n > BLOCK:
            parts[block] = math.ceil(n / BLOCK)
            block, held = block + 1, 0
    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i, q, own in zip(b["query_id"], b["q"], shared.value.visits(_matrix(b["q"]), most) if len(b) else []):
                by: dict[int, list[int]] = {}
                for leaf in own:
                    by.setdefault(block_of[leaf], []).append(leaf)
                out += [(i, q, bl, p, leaves) for bl, leaves in by.items() for p in range(parts.get(bl, 1))]
            yield pd.DataFrame(out, columns=["query_id", "q", "block", "part", "leaves"])

    dealt = asked.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(asked.count() / WALKS)), "query_id")
    walks = materialize(dealt.mapInPandas(walk, "query_id long, q array<double>, block int, part int, leaves array<int>"), "walks")
    # A block is copied as often as the number of queries that visit it asks for; blocks are the tree's, not the data's.
    visits = {(r["block"], r["part"]): r["count"] for r in walks.groupBy("block", "part").count().collect()}
    many = {b: math.ceil(max(visits.get((b, p), 0) for p in range(parts.get(b, 1))) / CHUNK) for b in set(block_of.values())}
    blocks = F.broadcast(spark.createDataFrame([(leaf, b, parts.get(b, 1), many[b]) for leaf, b in block_of.items()], "leaf int, block int, parts int, chunks int"))
    members = index.join(blocks, "leaf").where("chunks > 0").withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int"))
    members = members.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    walks = walks.join(F.broadcast(spark.createDataFrame(list(many.items()), "block int, chunks int")), "block").withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks").cast("int")).drop("chunks")

    def score(_: tuple, m: pd.DataFrame, w: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(m) and len(w):
            m = m.sort_values(["leaf", "vec_id"])
            x, ids, leaf = _matrix(m["embedding"]), m["vec_id"].to_numpy(), m["leaf"].to_numpy()
            q = _matrix(w["q"])
            for a in range(0, len(w), 512):
                rough = q[a : a + 512] @ x.T
                for i, leaves in enumerate(w["leaves"].iloc[a : a + 512]):
                    own = int(w["query_id"].iloc[a + i])
                    found, exactly = _best(ids, x, own, q[a + i], np.where(np.isin(leaf, leaves), rough[i], -np.inf), k)
                    out.append((np.full(len(found), own), found, exactly))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out)))))

    key = ("block", "part", "chunk")
    found = members.groupBy(*key).cogroup(walks.groupBy(*key)).applyInPandas(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to each one whose vec_id is divisible by 20."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(e, e.where("vec_id % 20 = 0"))
