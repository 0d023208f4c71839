"""Conversations brought back to alternating turns by the cheapest edits.

The turns of a conversation are layers of a DAG whose nodes are what has been said so far (nothing, a system turn, an open
question, an answered one). Each edge is an edit. A path's weight is one big integer: its high digits are the cost, its low
digits the letters of the edits, of a fixed width each and left-aligned, so that what comes first weighs most and the end is
padded with zeros. The smallest integer is then the cheapest path and among those the one whose letters come first, and its
digits are the edits themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, read

#: What has been said: nothing, a system turn, a question, a question and its answer. Where each initial leads.
NOTHING, SYSTEM, ASKED, ANSWERED = range(4)
NEXT = ({"s": SYSTEM, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
COMPLETE = (NOTHING, ANSWERED)
NAMES = {"u": "user", "a": "assistant"}
#: Costs of edits and of a truncated turn that stays. Two deletions must cost less than an insertion: then every cheapest way
#: on from a node has the same number of insertions, which is what lets blocks be joined by rank.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Digits of the letters, in ASCII order, and the bits of each. Zero pads the end.
LETTERS, BITS = " DIKR", 3
#: Turns whose letters are held by one integer.
BLOCK = 256
#: Faults by number; of these, the first two must be deleted.
FAULTS = ("", "blank", "duplicate", "truncated")


class Weights:
    """Integers of so many letters below the cost."""

    def __init__(self, letters: int):
        self.low = BITS * letters
        self.mask = (1 << self.low) - 1

    def edge(self, rest: int, cost: int, letter: str) -> int:
        """The weight of an edit followed by a way of the weight rest: its letters move one place on."""
        digit = LETTERS.index(letter) << (self.low - BITS)
        return ((rest >> self.low) + cost << self.low) | digit | ((rest & self.mask) >> BITS)

    def digits(self, weight: int) -> Iterator[int]:
        for at in range(self.low - BITS, -1, -BITS):
            yield weight >> at & (1 << BITS) - 1


def _insertions(w: Weights, ways: list[int | None]) -> None:
    """Ways on from each node at one place, through inserted turns too."""
    for _ in range(3):
        for node in range(4):
            for to in NEXT[node].values():
                if to != SYSTEM and ways[to] is not None:
                    new = w.edge(ways[to], INSERT, "I")
                    if ways[node] is None or new < ways[node]:
                        ways[node] = new


def _turn(w: Weights, ways: list[int | None], initial: str, fault: int) -> list[int | None]:
    """Smallest weights before a turn, from those after it."""
    extra, out = TRUNCATED * (fault == 3), []
    for node in range(4):
        found = [w.edge(ways[node], DELETE, "D")] if ways[node] is not None else []
        if fault not in (1, 2):
            for letter, to in NEXT[node].items():
                if ways[to] is not None:
                    if letter == initial:
                        found.append(w.edge(ways[to], KEEP + extra, "K"))
                    elif letter in NAMES:
                        found.append(w.edge(ways[to], REROLE + extra, "R"))
        out.append(min(found) if found else None)
    return out


def cheapest_edits(turns: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and letters of the edits of turns, given as (initial of the role, number of the fault).

    Blocks are worked on from the end. Where a block ends, the letters that follow are replaced by their rank among those
    of the four nodes, so integers stay short and the time is linear in the number of turns.
    """
    blocks, ways, ranked = [], None, {}
    for start in range((len(turns) - 1) // BLOCK * BLOCK if turns else 0, -1, -BLOCK):
        own = turns[start : start + BLOCK]
        w = Weights(4 * len(own) + 4)
        if ways is None:
            ways = [0 if node in COMPLETE else None for node in range(4)]
        else:
            tails = sorted({low for _, low in ways})
            ranked = {tails.index(low) + 1: node for node, (_, low) in enumerate(ways)}
            ways = [cost << w.low | tails.index(low) + 1 << (w.low - BITS) for cost, low in ways]
        _insertions(w, ways)
        for initial, fault in reversed(own):
            ways = _turn(w, ways, initial, fault)
            _insertions(w, ways)
        blocks.append((w, ways, ranked))
        ways = [(x >> w.low, x & w.mask) for x in ways]
    w, ways, _ = blocks[-1]
    cost, node, audit = ways[NOTHING] >> w.low, NOTHING, []
    for i, (w, ways, ranked) in enumerate(reversed(blocks)):
        # After the letters of its last turn, a block that is not the last has a rank.
        left = BLOCK if i + 1 < len(blocks) else -1
        for digit in w.digits(ways[node]):
            if left == 0:
                node = ranked[digit]
                break
            if digit == 0:
                break
            audit.append(LETTERS[digit])
            left -= LETTERS[digit] != "I"
    return cost, "".join(audit)


def repaired(turns: Iterable[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """Roles and texts after the edits."""
    node, turns = NOTHING, iter(turns)
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(turns)
        if letter in "IR":
            initial = next(k for k in NEXT[node] if k in NAMES)
            role = NAMES[initial]
        elif letter == "K":
            initial = role[0]
        if letter != "D":
            node = NEXT[node][initial]
            yield role, text


def _digest(*columns: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*(x for c in columns for x in (F.length(c).cast("string"), F.lit(":"), c))), 256))


def _plain(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text without nulls in role and text, and what stands for role and text together."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit(" ")), F.coalesce(F.col("text").cast("string"), F.lit(" "))
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    plain = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    return plain.withColumn("key", _digest(F.col("role"), F.col("text")))


def _in_order(rows: DataFrame, *by: Column) -> DataFrame:
    """All rows of a conversation in one partition, one after the other, without gathering them."""
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *by)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.slice(i, 4096).columns)) for b in batches for i in range(0, len(b), 4096))
    return groupby(rows, key=lambda r: r[0])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 4096, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or n >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)
            held, n = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)


_COUNTS = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string())])
_COUNTS_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def conversation_edits(turns: DataFrame) -> DataFrame:
    """What is wrong in each conversation of turns (conv_id, turn, role, text), and the cheapest edits: conv_id, gaps, blank,
    duplicate, truncated, illegal, cost, audit.

    Turns come by turn (nulls first), those of equal number by role and then by the hash of role and text. A row of which
    a column `gone` is true only names its conversation. Null roles and texts count as one space; an empty role has no
    initial and must be given one. Null conv_ids are one conversation. Repeated rows are turns, and duplicates. Other columns
    are left out. An empty table gives no rows, and a conversation without turns zeros and an empty audit.

    Turns travel without their texts. Repeated turns are found by conversation, role and text, so the turns of a long
    conversation are spread there; then they pass through one task in order, which holds a few bytes for each turn.
    """
    rows = _plain(turns)
    bare = F.regexp_replace("text", SPACES, "")
    first = F.row_number().over(Window.partitionBy("conv_id", "key", "gone").orderBy(F.col("turn").asc_nulls_first()))
    rows = rows.select("conv_id", "turn", "role", "gone", "key", (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    fault = F.when(F.col("blank"), 1).when(first > 1, 2).when(F.col("cut"), 3).otherwise(0)
    rows = rows.select("conv_id", "turn", "role", "key", "gone", fault.alias("fault"))
    rows = _in_order(rows, F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")).select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "gone", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted() -> Iterator[tuple]:
            for conv_id, own in _conversations(batches):
                kept, faults, illegal = [], [0] * 4, 0
                least = most = None
                numbers, last = 0, None
                for _, turn, initial, gone, fault in own:
                    if gone:
                        continue
                    illegal += bool(kept) and kept[-1][0] + initial not in ("su", "ua", "au")
                    kept.append((initial, fault))
                    faults[fault] += 1
                    if turn is not None:
                        least, most, numbers, last = turn if least is None else least, turn, numbers + (turn != last), turn
                cost, audit = cheapest_edits(kept) if kept else (0, "")
                yield (conv_id, most - least + 1 - numbers if numbers else 0, *faults[1:], illegal, cost, audit)

        yield from _batches(counted(), _COUNTS)

    return rows.mapInArrow(run, _COUNTS_SQL)


def _walks(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """Each conversation's edits, followed by its turns in order."""
    names = edits.columns[1:]
    rows = _plain(turns).where("not gone").select("conv_id", F.lit(1).alias("what"), "turn", "role", "text", "key", *(F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in names))
    heads = edits.select("conv_id", F.lit(0).alias("what"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("key", "binary"))), *names)
    return _in_order(heads.unionByName(rows), F.col("what"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("key")).select("conv_id", "what", "role", "text", *names)


def repaired_turns(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The turns after the edits (as of conversation_edits of the same turns): conv_id, place (from 0), role, text."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((conv_id, i, *turn) for conv_id, own in _conversations(batches) for i, turn in enumerate(_edited(own)[1]))
        yield from _batches(found, schema)

    return _walks(turns, edits).mapInArrow(run, "conv_id long, place long, role string, text string")


def _edited(own: Iterator[tuple]) -> tuple[tuple, Iterator[tuple[str, str]]]:
    head = next(own)
    return head, repaired(((r[2], r[3]) for r in own), head[-1])


def repaired_digests(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with repaired_sha256, the hash of the turns after them as `role:text` lines; texts are hashed as they pass."""
    schema = pa.schema([*_COUNTS, ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def hashed() -> Iterator[tuple]:
            for conv_id, own in _conversations(batches):
                (head, after), state = _edited(own), hashlib.sha256()
                for i, (role, text) in enumerate(after):
                    state.update(f"{chr(10) * (i > 0)}{role}:{text}".encode())
                yield (conv_id, *head[4:], state.hexdigest())

        yield from _batches(hashed(), schema)

    return _walks(turns, edits).mapInArrow(run, _COUNTS_SQL + ", repaired_sha256 string")


def damaged(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) with faults by the checksum of conv_id and turn; dropped ones stay as `gone`."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.encode(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")), "UTF-8")) % 20
    rows = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("code") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("code") == 0).alias("gone"), times.alias("_time")).drop("_time")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    turns = damaged(read(spark, sf_dir, "conversations"))
    return repaired_digests(turns, conversation_edits(turns))
