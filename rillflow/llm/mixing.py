"""Mixing sources to target weights in exact block quotas.

A source's documents fall into blocks by hash. Blocks are drawn in permuted order, whole, until the source's target is
met; only the block in which it is met is divided, at a document. The drawn blocks (with repeats) of all sources are then
split among output shards, 64 or more, by a tree: at every node the blocks of each source that go to the left half are one draw of a
multivariate hypergeometric distribution, so that each shard has a fair and exact quota; blocks are dealt to quotas in
permuted order, and documents are shuffled inside their shard.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, read, word_count

#: Weights of the sources in order of their names, repeating; most times that a source, or a document, is taken.
WEIGHTS, MOST = (5, 2, 1), 3
#: Documents in a block on average at most, blocks of all documents at least (where there are as many), words of a shard at
#: most, shards at least, branches of the tree that the driver splits (tasks split those), decisions and sources that may be
#: broadcast.
BLOCK_DOCS, LEAST_BLOCKS, SHARD_WORDS, LEAST_SHARDS, BRANCHES, BROADCAST_BLOCKS, BROADCAST_SOURCES = 1024, 1024, 20_000_000, 64, 64, 100_000, 20_000


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> list[float]:
    """Words of each source: all words by weight, none above most times its size, the excess shared by weight again."""
    out, w = [0.0] * len(sizes), [float(weights[i % len(weights)]) for i in range(len(sizes))]
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        share = left / sum(w[i] for i in free)
        above = [i for i in sorted(free) if w[i] * share > most * sizes[i]]
        if not above:
            for i in free:
                out[i] = w[i] * share
            break
        for i in above:
            out[i] = float(most * sizes[i])
            left -= out[i]
            free.discard(i)
        left = max(left, 0.0)
    return out


def splitting_tree(units: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Units of each source in each shard, (shards, sources): sums are exact, shards differ by a unit at most."""
    if shards == 1:
        return units[None, :]
    left = shards // 2
    total = int(units.sum())
    draw = rng.multivariate_hypergeometric(units, min(total, round(total * left / shards)), method="marginals") if total else np.zeros_like(units)
    return np.vstack([splitting_tree(draw, left, rng), splitting_tree(units - draw, shards - left, rng)])


def branches(units: np.ndarray, shards: int, most: int, rng: np.random.Generator) -> list[tuple[int, np.ndarray]]:
    """The upper levels of that tree: shards and units of each of so many branches at most."""
    if shards == 1 or most == 1:
        return [(shards, units)]
    left = shards // 2
    total = int(units.sum())
    draw = rng.multivariate_hypergeometric(units, min(total, round(total * left / shards)), method="marginals") if total else np.zeros_like(units)
    return branches(draw, left, most // 2, rng) + branches(units - draw, shards - left, most - most // 2, rng)


def _split_branches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of branches (branch, shards, units, seed): how many units of each source lie in its shards up to each."""
    for b in batches:
        for number, shards, units, seed in zip(b["branch"].tolist(), b["shards"].tolist(), b["units"], b["seed"].tolist()):
            ends = np.cumsum(splitting_tree(np.asarray(units, np.int64), shards, np.random.default_rng([seed, number])), axis=0)
            some = np.flatnonzero(ends[-1])
            if len(some):
                yield pd.DataFrame({"branch": number, "no": some.astype(np.int32), "ends": [ends[:, i].tolist() for i in some]})


def _fill(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """Documents of a divided block, in the order of h: each that fits the quota, then one more if that comes nearer."""
    p = p.sort_values("h")
    left, taken = float(p["quota"].iloc[0]), []
    over = None
    for h, size in zip(p["h"].tolist(), p["size"].tolist()):
        if size <= left:
            taken.append(h)
            left -= size
        elif over is None or size < over[0]:
            over = (size, h)
    if over and over[0] - left < left:
        taken.append(over[1])
    return pd.DataFrame({"_s": [key[0]], "_b": [key[1]], "picked": [taken]})


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of docs (doc_id, text, source): (documents, decisions, units).

    documents: doc_id, source, size, h. decisions: one row for each source and block: target, source_size, full (times
    that all of the block is taken), part (whether it is drawn once more), picked (the h of documents that the extra draw
    takes, in the one block of a source that is divided; null for all). units: source, block, copy, shard. A null text has size 0; a null source is a source, the
    last. Rows that repeat a document have its h and are taken alike. A list of sources (not of documents) is held by
    the driver.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    rows = materialize(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text").cast("string")).alias("size"), h.alias("h")), "sizes")
    stats = rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
    stats = sorted(stats, key=lambda r: (r["source"] is None, r["source"] or ""))
    want = targets([int(r["size"]) for r in stats], weights, most)
    rng = np.random.default_rng(seed)
    sources = []
    block_docs = min(BLOCK_DOCS, max(1, sum(r["n"] for r in stats) // LEAST_BLOCKS))
    for r, t in zip(stats, want):
        full = min(most, int(t // r["size"])) if r["size"] else 0
        sources.append((r["source"], int(r["size"]), t, full, max(0.0, t - full * int(r["size"])), max(1, math.ceil(r["n"] / block_docs))))
    table = spark.createDataFrame(sources, "source string, source_size long, target double, full int, rest double, blocks int") if sources else spark.createDataFrame([], "source string, source_size long, target double, full int, rest double, blocks int")
    small = F.broadcast if len(sources) <= BROADCAST_SOURCES else lambda df: df
    dealt = rows.join(small(table), rows["source"].eqNullSafe(table["source"])).drop(table["source"]).withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), "blocks").cast("int"))

    same = Window.partitionBy("source").orderBy(F.xxhash64("block", F.lit(seed)), "block")
    blocks = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), *(F.first(c).alias(c) for c in ("source_size", "target", "full", "rest", "blocks")))
    blocks = blocks.withColumn("before", F.sum("words").over(same) - F.col("words"))
    blocks = blocks.withColumn("part", F.col("before") < F.col("rest")).withColumn("cut", F.col("part") & (F.col("before") + F.col("words") > F.col("rest")))
    blocks = materialize(blocks, "blocks")
    # Only one block of a source is divided: its documents are tried in permuted order, and taken where they fit.
    cut = blocks.where("cut").select(F.col("source").alias("_s"), F.col("block").alias("_b"), (F.col("rest") - F.col("before")).alias("quota"))
    inner = dealt.select("source", "block", "h", "size").join(small(cut), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    inner = inner.groupBy("source", "block", "h").agg(F.sum("size").alias("size"), F.first("quota").alias("quota"))
    picked = inner.groupBy("source", "block").applyInPandas(_fill, "_s string, _b int, picked array<long>")
    b = blocks.join(small(picked), F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left")
    decisions = b.select("source", "block", "source_size", "target", "full", "part", "blocks", F.when(F.col("cut"), F.col("picked")).alias("picked"))
    decisions = materialize(decisions, "decisions")

    counts = decisions.groupBy("source").agg(F.sum(F.col("full") + F.col("part").cast("int")).alias("units")).collect()
    by = {r["source"]: int(r["units"]) for r in counts}
    shards = max(LEAST_SHARDS, math.ceil(sum(want) / SHARD_WORDS))
    top = branches(np.array([by.get(x[0], 0) for x in sources], np.int64), shards, BRANCHES, rng)
    ends, first = np.cumsum([u for _, u in top], axis=0), np.cumsum([0] + [n for n, _ in top]).tolist()
    upper = spark.createDataFrame([(x[0], i, ends[:, i].tolist()) for i, x in enumerate(sources)], "_s string, no int, upper array<long>")
    lower = spark.createDataFrame([(g, n, u.tolist(), seed) for g, (n, u) in enumerate(top)], "branch int, shards int, units array<long>, seed int")
    lower = lower.repartition(len(top), "branch").mapInPandas(_split_branches, "branch int, no int, ends array<long>")
    units = decisions.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("full") + F.col("part").cast("int")))).where(F.col("copy") < F.col("full") + F.col("part").cast("int"))
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("block", "copy", F.lit(seed + 1)), "block", "copy")) - 1
    units = units.select("source", "block", "copy", rank.alias("rank"))
    units = units.join(small(upper), F.col("source").eqNullSafe(F.col("_s"))).withColumn("branch", F.size(F.filter("upper", lambda x: x <= F.col("rank"))))
    units = units.withColumn("rank", F.col("rank") - F.when(F.col("branch") > 0, F.get("upper", F.col("branch") - 1)).otherwise(0))
    below = F.element_at(F.array(*map(F.lit, first)), F.col("branch") + 1) + F.size(F.filter("ends", lambda x: x <= F.col("rank")))
    units = units.drop("upper").join(materialize(lower, "branches"), ["branch", "no"]).select("source", "block", "copy", below.alias("shard"))
    return dealt.select("doc_id", "source", "size", "h", "block"), decisions, materialize(units, "units")


def _decided(rows: DataFrame, decisions: DataFrame, units: DataFrame) -> DataFrame:
    """rows (source, block, h, ...) with source_size, target, times and shards: the units of the tree that hold a document.

    A document is in all units of its block, but for the extra one where that takes other documents of a divided block.
    """
    each = units.groupBy("source", "block").agg(F.array_sort(F.collect_list(F.struct("copy", "shard"))).alias("_u"))
    d = decisions.withColumnRenamed("source", "_s").withColumnRenamed("block", "_b")
    d = d.join(each, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("source", "block")
    d = materialize(d, "taken")
    few = d.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    out = rows.join(F.broadcast(d) if few else d, F.col("source").eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")))
    out_of_extra = F.col("part") & F.col("picked").isNotNull() & ~F.array_contains("picked", F.col("h"))
    mine = F.filter(F.coalesce("_u", F.array().cast("array<struct<copy:int,shard:int>>")), lambda u: (u["copy"] < F.col("full")) | ~F.coalesce(out_of_extra, F.lit(False)))
    out = out.withColumn("shards", F.transform(mine, lambda u: u["shard"]))
    return out.withColumn("times", F.size("shards")).drop("_s", "_b", "_u", "part", "picked", "blocks")


def mixed_documents(docs: DataFrame, seed: int = 8) -> DataFrame:
    """docs (all its columns) as often as the mix takes them, dealt to shards and shuffled inside each."""
    dealt, decisions, units = plan_mix(docs, seed=seed)
    per = materialize(decisions.groupBy("source").agg(F.first("blocks").alias("_n")), "sources")
    few = per.count() <= BROADCAST_SOURCES
    # A document's own columns travel in one, so that none clashes.
    h = F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(seed))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("source").cast("string").alias("source"), h.alias("h"))
    per = per.withColumnRenamed("source", "_s")
    rows = rows.join(F.broadcast(per) if few else per, F.col("source").eqNullSafe(F.col("_s"))).withColumn("block", F.pmod(F.xxhash64("h", F.lit(1)), "_n").cast("int")).drop("_s", "_n")
    rows = _decided(rows, decisions, units).select("_row", "h", F.posexplode("shards").alias("copy", "shard"))
    rows = rows.select("_row", "shard", F.xxhash64("h", "copy", F.lit(seed + 2)).alias("order"))
    # A shard is dealt in slices, so that no task holds a whole one; a slice is a random part of its shard.
    return rows.repartition("shard", F.pmod("order", F.lit(16))).sortWithinPartitions("shard", "order").select("_row.*")


def mixed_sizes(docs: DataFrame, seed: int = 8) -> DataFrame:
    """One row for each row of docs: doc_id, source, size, source_size, target (its source's), taken, times, shards.

    shards are the output shards that the tree deals the document's units to. An empty table gives no rows.
    """
    dealt, decisions, units = plan_mix(docs, seed=seed)
    return _decided(dealt, decisions, units).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"), "times", "shards")


def op8_source_mix(spark, sf_dir: str) -> DataFrame:
    """What the mix of all documents takes of each."""
    return mixed_sizes(read(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken", F.array_join("shards", ",").alias("shards"))
