"""Secrets in texts, in DataFrame functions only: base patterns, and a battery of randomness tests.

Positions come from splitting the text by the pattern: a match starts after all pieces and matches before it.

The battery looks at every run of 20 or more characters that encodings use. It infers the alphabet (digits, hexadecimal,
one case or two, base32, base36, base62 or base64) and tests the characters and character pairs for uniformity, for runs
above and below the alphabet's middle and for serial correlation. What passes has as its value p the probability of its
characters and pairs in ordinary text over that in the alphabet's uniform source: by Markov's inequality, ordinary text
gives a value of p or less with probability p at most. Times the number of alphabets, p is controlled for false
discoveries among a document's tokens (Benjamini-Hochberg, weighted by length).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import read

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: False discovery rate; level of each test of the battery.
FDR, LEVEL = 0.01, 0.001

DIGITS, LOWER, UPPER, MARKS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "+/-_="
#: Pattern and characters of each alphabet, smaller ones first; what fits none is base64 of either kind.
ALPHABETS = (
    ("0-9", DIGITS), ("0-9a-f", DIGITS + LOWER[:6]), ("0-9A-F", DIGITS + UPPER[:6]), ("a-z", LOWER), ("A-Z", UPPER), ("A-Z2-7", UPPER + "234567"), ("a-z2-7", LOWER + "234567"),
    ("0-9a-z", DIGITS + LOWER), ("0-9A-Z", DIGITS + UPPER), ("A-Za-z", UPPER + LOWER), ("0-9A-Za-z", DIGITS + UPPER + LOWER),
)
BASE64 = UPPER + LOWER + DIGITS + "+/-_"
#: Ordinary text, whose letters and pairs of letters make the text model.
TEXT = (
    "the people of the town had known for a long time that nothing would change unless they asked for it and so they wrote a letter to the council about the water the roads and the schools which every child should be able to reach without walking through fields international organization of information systems requires development management configuration and application processing background service request response handler factory default value number object string index",
    "die verantwortung der gesellschaft beginnt dort wo jeder einzelne bereit ist sich mit den schwierigen fragen der gegenwart zu beschaeftigen und nicht nur auf die entscheidungen anderer zu warten denn freiheit und sicherheit gehoeren zusammen wirtschaft wissenschaft geschwindigkeit versicherung einheitlich schoepfung handschrift ausserdem zwischen",
    "les habitants de la ville avaient toujours pense que leur quartier serait protege par les anciennes lois mais le gouvernement a decide de construire une nouvelle route qui traverse les jardins et change completement la vie quotidienne des familles developpement administration question beaucoup quelque",
    "los ciudadanos que viven cerca del rio saben que cada invierno el agua puede llegar hasta las casas y por eso han construido con sus propias manos muros y canales para proteger a sus hijos y sus animales desarrollo informacion universidad conocimiento trabajo siempre ejemplo",
)
#: In ordinary text, what follows the start, a lower-case or upper-case letter, a digit or a mark: those four, in order.
FOLLOWS = ((0.6, 0.25, 0.1, 0.05), (0.88, 0.03, 0.02, 0.07), (0.5, 0.4, 0.03, 0.07), (0.06, 0.04, 0.7, 0.2), (0.6, 0.15, 0.15, 0.1))
#: Share of a letter's own frequency beside that after the letter before it.
ALONE = 0.3
SYMBOLS = LOWER + UPPER + DIGITS + MARKS


def _surprises() -> list[int]:
    """Minus the logarithm, in thousandths, of a symbol (column) after another (row; first the start) in ordinary text."""
    letters, pairs = Counter(c for x in TEXT for c in x if c != " "), Counter(x[i : i + 2] for x in TEXT for i in range(len(x) - 1) if " " not in x[i : i + 2])
    first = Counter()
    for pair, n in pairs.items():
        first[pair[0]] += n
    group = lambda c: 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3

    def chance(a: str, b: str) -> float:
        follows = FOLLOWS[group(a) + 1 if a else 0][group(b)]
        if group(b) > 1:
            return follows / (len(DIGITS), len(MARKS))[group(b) - 2]
        own = (letters[b.lower()] + 1) / (sum(letters.values()) + len(LOWER))
        if not a or group(a) > 1 or (group(a), group(b)) == (0, 1):
            return follows * own
        after = (pairs[a.lower() + b.lower()] + own) / (first[a.lower()] + 1)
        return follows * (ALONE * own + (1 - ALONE) * after)

    return [round(-1000 * math.log(chance(a, b))) for a in ("", *SYMBOLS) for b in SYMBOLS]


SURPRISES = ",".join(map(str, _surprises()))


def _tail(z: Column) -> Column:
    """P(Z > z), by a logistic approximation of the normal distribution."""
    z = F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))
    return 1 / (1 + F.exp(1.5976 * z + 0.07056 * z * z * z))


#: Matches in a group of the running sum.
GROUP = 256


def _offsets(lengths: str, gaps: str) -> Column:
    """(start, end) of each match, from the lengths of matches and of the pieces around them.

    A running sum in two levels, over groups and inside each, so that many matches cost little more than linear time.
    """
    groups = F.floor((F.size(lengths) + (GROUP - 1)) / GROUP).cast("int")
    steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lengths)), lengths, lambda g, n: F.struct(g.alias("g"), n.alias("n")))
    add = lambda a, x: a + x["g"] + x["n"]

    def inside(total: Column, own: Column) -> Column:
        none = F.struct(total.alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

        def step(a, x):
            start = a["at"] + x["g"]
            return F.struct((start + x["n"]).alias("at"), F.array_append(a["out"], F.struct(start.alias("s"), (start + x["n"]).alias("e"))).alias("out"))

        return F.aggregate(own, none, step, lambda a: a["out"])

    def split(all_: Column) -> Column:
        own = F.transform(F.sequence(F.lit(1), groups), lambda k: F.slice(all_, (k - 1) * GROUP + 1, F.lit(GROUP)))
        return _let(own, lambda parts: _let(F.transform(parts, lambda p: F.aggregate(p, F.lit(0), add)), lambda sums: _let(_running(sums), lambda before: F.flatten(F.zip_with(before, parts, inside)))))

    return F.when(F.size(lengths) > 0, _let(steps, split)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))


def _running(sums: Column) -> Column:
    """The sum of all elements before each one."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(sums, start, lambda a, x: F.struct((a["at"] + x).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])


def _matches(df: DataFrame, pattern: str, name: str, value_group: int | None = None) -> DataFrame:
    """Adds `name`: array of (s, e, v) for all matches; v is the match, or the value_group of it."""
    p = F.lit(pattern)
    df = df.withColumn(f"{name}_m", F.regexp_extract_all("_t", p, F.lit(0)))
    some = F.size(f"{name}_m") > 0
    none = F.array().cast("array<int>")
    value = F.regexp_extract_all("_t", p, F.lit(value_group)) if value_group else F.col(f"{name}_m")
    df = df.withColumns({f"{name}_n": F.when(some, F.transform(f"{name}_m", F.length)).otherwise(none), f"{name}_g": F.when(some, F.transform(F.split("_t", pattern, -1), F.length)).otherwise(none), f"{name}_v": F.when(some, value).otherwise(F.array().cast("array<string>"))})
    df = df.withColumn(f"{name}_o", _offsets(f"{name}_n", f"{name}_g"))
    return df.withColumn(name, F.zip_with(f"{name}_o", f"{name}_v", lambda o, v: F.struct(o["s"].alias("s"), o["e"].alias("e"), v.alias("v")))).drop(*(f"{name}_{x}" for x in "mngvo"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _battery(token: Column) -> Column:
    """Struct of a token: s, e, n and the value p of looking ordinary, 1 where the tests of randomness reject it."""
    text = F.rtrim(token["v"], F.lit("="))
    alphabet = None
    for pattern, letters in ALPHABETS:
        alphabet = (F if alphabet is None else alphabet).when(text.rlike(f"^[{pattern}]+$"), letters)
    return _let(F.struct(token["s"].alias("s"), token["e"].alias("e"), text.alias("t"), alphabet.otherwise(BASE64).alias("alphabet")), lambda x: _let(_codes(x), _tested))


def _codes(x: Column) -> Column:
    """A token as numbers: places of its characters in its alphabet, and in SYMBOLS (from 1), all-upper-case text folded."""
    split = lambda t: F.filter(F.split(t, ""), lambda c: c != "")
    code = F.transform(split(x["t"]), lambda c: F.instr(x["alphabet"], c))
    at = F.transform(split(F.when(F.upper(x["t"]) == x["t"], F.lower(x["t"])).otherwise(x["t"])), lambda c: F.instr(F.lit(SYMBOLS), c))
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), F.length(x["alphabet"]).cast("double").alias("k"), F.greatest(F.length(x["t"]), F.lit(2)).cast("double").alias("n"), code.alias("code"), at.alias("at"))


def _tested(x: Column) -> Column:
    n, k, code = x["n"], x["k"], x["code"]
    add = lambda a, c: a + c
    size = lambda c: F.size(c).cast("double")
    most = F.greatest(F.size(code) - 1, F.lit(0))
    squares = F.aggregate(F.array_distinct(F.split(x["t"], "")), F.lit(0.0), lambda a, c: a + F.when(c == "", 0.0).otherwise(F.pow(n - F.length(F.replace(x["t"], c, F.lit(""))), F.lit(2.0))))
    chi = k * squares / n - n
    z_chi = (F.cbrt(F.greatest(chi, F.lit(0.0)) / (k - 1)) - (1 - 2 / (9 * (k - 1)))) / F.sqrt(2 / (9 * (k - 1)))
    pairs = F.zip_with(F.slice(code, F.lit(1), most), F.slice(code, F.lit(2), most), lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    mid = (k + 1) / 2
    high = size(F.filter(code, lambda c: c > mid))
    low = n - high
    runs = 1 + F.size(F.filter(pairs, lambda p: (p["a"] > mid) != (p["b"] > mid)))
    mu = 2 * high * low / n + 1
    z_runs = F.abs(runs - mu) / F.sqrt(F.greatest((mu - 1) * (mu - 2) / (n - 1), F.lit(0.25)))
    dot = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (p["a"] - mid) * (p["b"] - mid))
    own = F.aggregate(code, F.lit(0.0), lambda a, c: a + (c - mid) * (c - mid))
    z_serial = F.abs(dot / F.greatest(own, F.lit(1.0))) * F.sqrt(n)
    # Equal pairs of neighbours, counted in their order, are about Poisson; a Chernoff bound of so many.
    ordered = F.sort_array(F.transform(pairs, lambda p: p["a"] * 100 + p["b"]))
    start = F.struct(F.lit(-1.0).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("same"))

    def count(a, c):
        run = F.when(a["last"] == c, a["run"] + 1).otherwise(0.0)
        return F.struct(c.alias("last"), run.alias("run"), (a["same"] + run).alias("same"))

    same = F.aggregate(ordered, start, count, lambda a: a["same"])
    due = F.greatest((n - 1) * (n - 2) / 2, F.lit(1.0)) / (k * k)
    pairs_p = _let(same, lambda c: F.when(c <= due, 1.0).otherwise(F.exp(c - due - c * F.log(F.greatest(c, F.lit(1.0)) / due))))
    passes = (_tail(z_chi) > LEVEL) & (_tail(z_runs) * 2 > LEVEL) & (_tail(z_serial) * 2 > LEVEL) & (pairs_p > LEVEL)
    # In logarithms: ordinary text against the uniform source.
    table = F.split(F.lit(SURPRISES), ",").cast("array<int>")
    before = F.concat(F.array(F.lit(0)), F.slice(x["at"], F.lit(1), most))
    surprise = F.aggregate(F.zip_with(before, x["at"], lambda a, b: F.get(table, a * len(SYMBOLS) + b - 1).cast("double")), F.lit(0.0), add) / 1000
    # Text in upper case throughout is one more kind of text.
    p = F.least(F.lit(1.0), F.exp(n * F.log(k) - surprise) * 2 * (len(ALPHABETS) + 1))
    return F.struct(x["s"].alias("s"), x["e"].alias("e"), n.alias("n"), F.when(passes, p).otherwise(1.0).alias("p"))


def secret_spans(docs: DataFrame) -> DataFrame:
    """All columns of docs (it needs text) and found: array of (kind, start, end), code points, by start, then kind.

    kind is 0 assign, 1 access, 2 hex (the base patterns) or 3 random (the battery; never overlapping a base span). A null
    or empty text has none. A column named found is replaced. One projection over the scan, without a shuffle: false
    discoveries are controlled within each document.
    """
    df = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for name, pattern, group in (("_a", ASSIGN, 2), ("_k", ACCESS, None), ("_x", HEX, None), ("_r", TOKEN, None)):
        df = _matches(df, pattern, name, group)
    span = lambda k: lambda x: F.struct(x["s"].alias("start"), F.lit(k).alias("kind"), x["e"].alias("end"))
    base = F.concat(F.transform(F.filter("_a", lambda x: F.length(x["v"]) >= 6), span(0)), F.transform("_k", span(1)), F.transform("_x", span(2)))
    df = df.withColumn("_base", F.array_sort(base)).withColumn("_tests", F.transform("_r", _battery))
    # Benjamini-Hochberg on p / weight, weight being the length over the mean length.
    mean = F.aggregate("_tests", F.lit(0.0), lambda a, x: a + x["n"]) / F.greatest(F.size("_tests"), F.lit(1))
    df = df.withColumn("_mean", mean).withColumn("_p", F.array_sort(F.transform("_tests", lambda x: x["p"] * F.col("_mean") / x["n"])))
    level = F.array_max(F.filter(F.transform("_p", lambda p, i: F.when(p <= FDR * (i + 1) / F.size("_p"), p)), lambda p: p.isNotNull()))
    df = df.withColumn("_level", level)
    free = lambda x: ~F.exists("_base", lambda b: (b["start"] < x["e"]) & (x["s"] < b["end"]))
    chosen = F.filter("_tests", lambda x: F.coalesce(x["p"] * F.col("_mean") / x["n"] <= F.col("_level"), F.lit(False)) & free(x))
    found = F.array_sort(F.concat("_base", F.transform(chosen, span(3))))
    return df.withColumn("found", found).drop("_t", "_a", "_k", "_x", "_r", "_base", "_tests", "_mean", "_p", "_level")


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every span of its column found replaced in text, and found dropped; overlapping spans become one mark."""
    text = F.col("text")
    first = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(a, x):
        before = F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit(mark))
        return F.struct(F.when(x["start"] >= a["at"], before).otherwise(a["out"]).alias("out"), F.greatest(a["at"], x["end"]).alias("at"))

    clean = F.aggregate("found", first, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return docs.withColumn("text", F.when(F.size("found") > 0, clean).otherwise(text)).drop("found")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts by base pattern, a digest of the base spans, and all spans."""
    df = secret_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    name = lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    joined = lambda c: F.array_join(F.transform(c, name), ",")
    return df.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
