"""Best-fit packing of token pieces into sequences by the sum-of-squares rule.

A piece goes where the sum of squares of the numbers of open sequences per residual gap becomes smallest. Pieces are dealt
at random into shards of a bounded number, each packed by itself, longest first; sequences that a shard leaves with a gap
are taken apart, and their pieces are dealt into fewer shards again, until one shard is left or this saves hardly any
sequences.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructType

from .common import materialize, read
from .tokens import CAPACITY, token_pieces

#: Pieces in a shard; largest gap of a sequence that is not taken apart again, as a share of the capacity; share of the
#: sequences taken apart that packing them again has to save.
SHARD, LEAVE, GAIN = 40_000, 1 / 256, 0.01


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each piece, in the given order, and the gap of each bin."""
    open_ = np.zeros(capacity + 1, np.int64)
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, gaps = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, s in enumerate(lengths.tolist()):
        # Moving a bin from gap g to g - s changes the sum by 2 * (open[g - s] - open[g]) + 2, closing one by 1 - 2 * open[g].
        fit = np.flatnonzero(open_[s:])
        if len(fit):
            change = 2 * (open_[fit] - open_[fit + s]) + 2
            if fit[0] == 0:
                change[0] = 1 - 2 * open_[s]
            left = int(fit[np.argmin(change)])
            j = at_gap[left + s].pop()
            open_[left + s] -= 1
        else:
            left, j = capacity - s, len(gaps)
            gaps.append(capacity)
        bins[i], offsets[i] = j, capacity - gaps[j]
        gaps[j] = left
        if left:
            open_[left] += 1
            at_gap[left].append(j)
    return bins, offsets, np.array(gaps, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces (any columns, of which doc_id, piece and length are read) with sequence_id and offset.

    Each length lies in 1..capacity; within a sequence, offsets run without gaps from 0. Rows that are equal in all columns
    are packed each on its own. Columns named sequence_id or offset are replaced, all others stay. Numbers of sequences are
    unique, those of single pieces of full length negative. An empty table gives no rows.
    """
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    pieces = pieces.select(*names)
    schema = _with_place(pieces.schema)
    # A name that no column has.
    mark = "_" * (1 + max(map(len, names))) + "p"

    def shard(level: int, final: bool):
        def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            order = np.lexsort((p["piece"], p["doc_id"].fillna(-1), -p["length"]))
            p = p.iloc[order].reset_index(drop=True)
            bins, offsets, gaps = sum_of_squares(p["length"].to_numpy(np.int64), capacity)
            loose = np.zeros(len(gaps), bool) if final else gaps > capacity * LEAVE
            p["sequence_id"] = (np.int64(level) << 51) + (np.int64(key[0]) << 24) + bins
            p["offset"] = offsets
            p[mark] = loose[bins]
            return p[[*names, "sequence_id", "offset", mark]]

        return run

    # A piece of full length is a sequence; every run deals pieces out alike, by what they hold.
    whole = pieces.where(F.col("length") == capacity)
    done = [whole.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))]
    rest, held, apart, level = pieces.where(F.col("length") < capacity), None, 0, 1
    total = rest.count()
    while True:
        shards = max(1, math.ceil(total / SHARD))
        dealt = rest.withColumn(mark, F.pmod(F.xxhash64(*names, F.lit(level)), F.lit(shards)).cast("long"))
        out = dealt.groupBy(mark).applyInPandas(shard(level, shards == 1), StructType([*schema.fields]).add(mark, BooleanType()))
        if shards == 1 and held is None:
            done.append(out.drop(mark))
            break
        out = materialize(out, "packed")
        # Every sequence has one piece at offset 0.
        made, loose, total = out.agg(F.count_if(F.col("offset") == 0), F.count_if((F.col("offset") == 0) & F.col(mark)), F.count_if(mark)).first()
        if held is not None and made > apart * (1 - GAIN):
            done.append((out if made < apart else held).drop(mark))
            break
        done.append(out.where(~F.col(mark)).drop(mark))
        if not loose:
            break
        held, apart, level = out.where(mark), loose, level + 1
        rest = held.select(*names)
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result


def _with_place(schema: StructType) -> StructType:
    return StructType([*schema.fields]).add("sequence_id", LongType()).add("offset", LongType())


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as token pieces of at most 4096, packed into sequences."""
    return pack(materialize(token_pieces(read(spark, sf_dir, "documents")), "pieces"))
