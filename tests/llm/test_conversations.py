import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from rillflow.llm import conversations as C
from rillflow.llm.conversations import cheapest_edits, conversation_edits, damaged, op12_conversation_repair, repaired, repaired_digests, repaired_turns

LEGAL = re.compile(r"(s?(ua)+)?\Z")


def best(turns, inserts=2):
    """All ways, insertions included, as (cost, letters, initials)."""
    n, found = len(turns), []
    gaps = [g for g in product(("", "u", "a", "ua", "au"), repeat=n + 1) if sum(map(len, g)) <= inserts]
    choices = []
    for initial, fault in turns:
        extra = 5 * (fault == 3)
        own = [(2, "D", "")]
        if fault not in (1, 2):
            own += [(extra, "K", initial), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        choices.append(own)
    for picked in product(*choices):
        for g in gaps:
            said = g[0] + "".join(p[2] + x for p, x in zip(picked, g[1:]))
            if LEGAL.match(said):
                letters = "I" * len(g[0]) + "".join(p[1] + "I" * len(x) for p, x in zip(picked, g[1:]))
                found.append((sum(p[0] for p in picked) + 5 * sum(map(len, g)), letters))
    return min(found)


def test_every_short_conversation():
    kinds = [("u", 0), ("a", 0), ("s", 0), ("x", 0), ("u", 1), ("a", 2), ("u", 3), ("s", 3)]
    for n in range(1, 4):
        for turns in product(kinds, repeat=n):
            assert cheapest_edits(list(turns)) == best(turns), turns


def test_longer_conversations():
    rng = random.Random(3)
    for _ in range(60):
        turns = [(rng.choice("uuuaaasx"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(4, 6))]
        assert cheapest_edits(turns) == best(turns, 1), turns


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    some = [[(rng.choice("uuaaasx"), rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(rng.randint(0, 40))] for _ in range(300)]
    some += [[("x", 0)] * 31, [("u", 1)] * 9, [("u", 0)] + [("a", 2)] * 12]
    whole = [cheapest_edits(t) if t else None for t in some]
    for block in (1, 2, 5, 8):
        monkeypatch.setattr(C, "BLOCK", block)
        assert [cheapest_edits(t) if t else None for t in some] == whole


def test_a_very_long_conversation():
    turns = [("u", 0), ("a", 0)] * 20_000 + [("x", 0)] * 20_001
    cost, audit = cheapest_edits(turns)
    assert cost == 20_002 and audit == "K" * 40_000 + "D" + "R" * 20_000


def expected(rows):
    """The contract, conversation by conversation, in plain Python."""
    out, by = {}, {}
    for r in rows:
        conv, turn, role, text = (r[c] for c in ("conv_id", "turn", "role", "text"))
        own = by.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        own += [(turn, "user" if code == 4 else role, text)] * (1 + (code == 3))
    for conv, own in by.items():
        own.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{len(t[2])}:{t[2]}".encode()).digest()))
        seen, turns, faults = set(), [], [0] * 4
        for _, role, text in own:
            solid = re.sub("[\x20\x09-\x0d]+", "", text)
            fault = 1 if not solid else 2 if (role, text) in seen else 3 if solid[-1] not in ".!?" else 0
            seen.add((role, text))
            faults[fault] += 1
            turns.append((role[:1], fault))
        numbers = {t for t, _, _ in own if t is not None}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = forward(turns) if turns else (0, "")
        text = "\n".join(f"{r}:{t}" for r, t in repaired([t[1:] for t in own], audit))
        out[conv] = (gaps, *faults[1:], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def forward(turns):
    """The smallest (cost, letters) kept for each initials' state, forwards, over whole strings."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserted(ways):
        for _ in range(3):
            for (a, by), to in step.items():
                if by != "s" and a in ways:
                    new = (ways[a][0] + 5, ways[a][1] + "I")
                    ways[to] = min(ways.get(to, new), new)
        return ways

    ways = inserted({"": (0, "")})
    for initial, fault in turns:
        new = {}
        for a, (cost, letters) in ways.items():
            options = [(a, 2, "D")]
            if fault not in (1, 2):
                extra = 5 * (fault == 3)
                options += [(to, extra if by == initial else 1 + extra, "K" if by == initial else "R") for (at, by), to in step.items() if at == a and (by == initial or by != "s")]
            for to, c, letter in options:
                w = (cost + c, letters + letter)
                new[to] = min(new.get(to, w), w)
        ways = inserted(new)
    return min(w for a, w in ways.items() if a in ("", "a"))


def rows_of(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


def test_query_equals_the_contract(spark, small):
    want = expected(spark.read.parquet(f"{small}/conversations.parquet").collect())
    df = op12_conversation_repair(spark, small)
    assert df.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(df) == want and df.count() == len(want)


@pytest.fixture(scope="module")
def odd_turns(spark, prose):
    rng = random.Random(8)
    rows = [(None, 1, "user", "Who?"), (None, None, None, None), (1, None, "user", None), (1, 3, None, "Text."), (2, 5, "", "Empty role."), (2, 6, "user", ""), (3, 1, "user", "x" * 200_000), (3, 2, "assistant", prose(20_000, 1) + "!")]
    rows += [(4, 1, "user", "Same."), (4, 1, "user", "Same."), (4, 1, "assistant", "Tie."), (4, 1, "user", "Tie."), (5, 2**40, "user", "Far."), (5, -3, "assistant", "Before."), (6, 1, "user", " \n\t"), (7, 1, "supervisor", "S."), (7, 2, "uncle", "U."), (7, 3, "aunt", "A."), (7, 4, "User", "No.")]
    rows += [(c, t, rng.choice(["system", "user", "assistant", "user", "assistant", "tool"]), rng.choice(["Yes.", "No!", "What", "", "é?", "Ends. \x0b"])) for c in range(10, 60) for t in range(rng.randint(1, 12)) for _ in range(rng.choice((1, 1, 1, 2)))]
    rows += [(99, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(1500)]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("own") for c in ("key", "fault", "code", "what", "audit", "initial")})


def test_odd_turns(spark, odd_turns):
    turns = damaged(odd_turns)
    assert rows_of(repaired_digests(turns, conversation_edits(turns))) == expected(odd_turns.collect())


def test_repaired_turns_alternate(spark, odd_turns):
    turns = damaged(odd_turns)
    edits = conversation_edits(turns)
    digests, by = rows_of(repaired_digests(turns, edits)), {}
    for r in repaired_turns(turns, edits).orderBy("place").collect():
        by.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    for conv, found in digests.items():
        own = by.get(conv, [])
        assert LEGAL.match("".join(r[0] for r, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == found[-1]


def test_no_turns(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repaired_digests(damaged(none), conversation_edits(damaged(none))).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "Hi.", True)], "conv_id long, turn long, role string, text string, gone boolean")
    assert rows_of(repaired_digests(gone, conversation_edits(gone))) == {1: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
