"""Line-first quality rules, written in DataFrame functions only.

Each line of a text is judged by itself: punctuation, symbols, navigation and boilerplate. Failing lines are removed;
a document that loses too much of its text that way, or fails a base rule on words, is rejected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, SPACES, read

SYMBOLS = "#*$%&|<>"
#: Characters of which a sentence or a list has at least one.
STOPS = ".,;:!?…。、，"
#: Phrases of short lower-cased lines that belong to a page, not to its text; some only where they start or end a line.
BOILERPLATE = (
    r"(^|[^a-z])(cookie (policy|notice|settings|preferences|consent)|(uses?|accept|our) cookies|privacy policy|terms of (use|service)|all rights reserved|(log|sign) in (to|with|here)|sign up (for|now|today|here)|"
    r"subscribe (to|now|today)|(our|weekly|daily|free) newsletter|click here|enable javascript|skip to (main )?content|back to top)([^a-z]|$)|"
    r"^[^a-z]*(powered by|share (this|on))([^a-z]|$)|(^|[^a-z])read more[^a-z]*$|^[^a-z]*(advertisements?|(log|sign) ?in|sign up|subscribe|newsletter|cookies)[^a-z]*$"
)
#: A line without any of these matches none of the phrases.
MARKERS = ("cookie", "privacy", "terms of", "rights reserved", "log in", "login", "sign in", "signin", "sign up", "subscribe", "newsletter", "click here", "javascript", "skip to", "back to", "powered", "share ", "read more", "advertisement")
#: Most share of the characters in words that may be lost; least words; most percent of words in repeated windows.
MOST_LOST, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50


def _solid(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.regexp_replace(text, SPACES, ""))


def _symbols(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))


def line_fails(x: Column) -> Column:
    """True for a line (struct of l, n code points, solid ones) that breaks a rule; a blank line breaks none."""
    line, size, solid = x["l"], x["n"], x["solid"]
    gaps = size - F.length(F.replace(line, F.lit(" "), F.lit("")))
    dividers = F.regexp_count(line, F.lit(r"[|>»›•·](?= |$)(?<=(?: |^).)"))
    small, marked = F.lower(line), F.lit(False)
    for m in MARKERS:
        marked = marked | F.contains(small, F.lit(m))
    shouts = (size - F.length(F.replace(line, F.lit("!!"), F.lit("")))) / 2
    return (
        (_symbols(line) * 8 > solid)
        | ((dividers >= 1) & (dividers * 5 >= gaps))
        | ((shouts >= 2) & (shouts * 5 >= gaps + 1))
        | ((solid >= 60) & ~line.rlike(f"[{STOPS}]"))
        | ((size < 300) & marked & small.rlike(BOILERPLATE))
    )


def repeated_words(found: Column) -> Column:
    """Words that lie in a 3-word window found twice or more; found: the windows as (hash, position), sorted by hash."""
    hit = F.filter(found, lambda x, i: (x["h"] == F.get(found, i - 1)["h"]) | (x["h"] == F.get(found, i + 1)["h"]))
    places = F.flatten(F.transform(hit, lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    return F.size(F.array_distinct(places)).cast("long")


def line_quality(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """All columns of docs (it needs text) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    cleaned_text, lost_share, kept. Columns of these names that docs has already are replaced.

    A null text counts as empty: no words, so base_failed and not kept. An empty table gives no rows, repeated rows
    are judged each by itself. 3-word windows are compared by 64-bit hashes. The
    plan is one projection over the scan: no shuffle, whatever the keys or the lengths of texts.
    """
    at = lambda k: F.slice("_w", F.lit(k), F.size("_w") - 2)
    join = lambda a, b: F.xxhash64(a, b)
    windows = F.zip_with(F.zip_with(at(1), at(2), join), at(3), join)
    trimmed = F.btrim("_t", F.lit(SPACE_CHARS))
    out = docs.withColumn("_t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    out = out.withColumn("_w", F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES)))
    # A line with what its rules share, each computed once.
    out = out.withColumn("_l", F.transform(F.split("_t", "\n"), lambda x: F.struct(x.alias("l"), F.length(x).alias("n"), _solid(x).alias("solid"))))
    out = out.withColumn("_k", F.filter("_l", lambda x: ~line_fails(x))).withColumn("_f", F.transform(F.filter("_l", lambda x: x["solid"] > 0), lambda x: x["l"]))
    out = out.withColumn("_h", F.when(F.size("_w") >= 3, windows).otherwise(F.array().cast("array<bigint>")))
    # Most texts repeat no window; only the others are sorted.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    out = out.withColumn("_s", F.when(repeats, F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))
    out = out.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": _symbols(F.col("_t")).cast("long"),
        "n_dup_lines": (F.size("_f") - F.size(F.array_distinct("_f"))).cast("long"),
        "n_repeat_words": F.when(F.col("_s").isNull(), F.lit(0).cast("long")).otherwise(repeated_words(F.col("_s"))),
        "cleaned_text": F.array_join(F.transform("_k", lambda x: x["l"]), "\n"),
        "_left": F.aggregate("_k", F.lit(0).cast("long"), lambda a, x: a + x["solid"]),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    out = out.withColumn("lost_share", F.when(F.col("word_chars") > 0, 1 - F.col("_left") / F.col("word_chars")).otherwise(F.lit(0.0)))
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= most_lost))
    # Through a generator, a filter on the result stays above the projections, which would else be computed again inside it.
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "cleaned_text", "lost_share", "kept")
    rest = [c for c in docs.columns if c not in made]
    return out.select(*rest, F.explode(F.array(F.struct(*made))).alias("_q")).select(*rest, "_q.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Word, line and repetition figures of every document, and whether it is kept."""
    return line_quality(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_share")
