import random

import pytest

LETTERS = "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def prose():
    """Makes invented prose of so many words."""

    def make(words: int, seed: int = 0) -> str:
        rng = random.Random(seed)
        return " ".join("".join(rng.choices(LETTERS, k=rng.randint(2, 9))) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Documents with every oddity: nulls anywhere, empty, blank, very long and repeated texts, ties, clashing columns."""
    long = prose(30_000, 1)
    rows = [
        (1, "", "a", 1), (2, None, "a", 2), (3, " \n\t ", None, 3), (4, long, "b", 4), (5, long, "b", 5), (5, long, "b", 5), (None, "no id at all", "b", 6), (None, None, None, None),
        (7, "one two", "c", 7), (8, "one two", None, 8), (9, prose(60, 2) + ".", "c", 9), (10, prose(60, 2) + ".", "c", 10), (11, "x" * 200_000, "d", 11), (12, "😀 naïve ß Σ text".encode("utf-16", "surrogatepass").decode("utf-16"), "d", 12),
    ]
    kind = "doc_id long, text string, source string, n_words int"
    df = spark.createDataFrame(rows, kind)
    from pyspark.sql import functions as F

    clash = ("length", "size", "hash", "kept", "found", "n", "cls", "block", "h", "sequence_id", "offset", "target", "shard", "rank", "verdict", "host")
    return df.withColumns({c: F.lit(f"own {c}") for c in clash})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")
