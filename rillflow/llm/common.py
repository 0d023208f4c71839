"""Helpers shared by the corpus operators: the word rule, the shared folder and graph components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in every contract of this package (space and the ASCII controls 9 to 13).
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def word_count(text: Column) -> Column:
    """The number of words without keeping them."""
    return F.size(words(text)).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one where it is unset (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext._conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rillflow-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept(key: tuple, make: Callable[[], Any]) -> Any:
    """What this Python worker keeps for the tasks that follow each other in it: one thing at most."""
    state = sys.modules.setdefault("_rillflow_worker", types.ModuleType("_rillflow_worker"))
    if getattr(state, "key", None) != key:
        forget()
        state.key, state.value = key, make()
    return state.value


def forget() -> None:
    """Drops what the tasks of an operator before have kept in this Python worker, which Spark goes on using."""
    if state := sys.modules.get("_rillflow_worker"):
        state.key = state.value = None


def components(edges: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of edges (a, b): returns (v, root), root being the smallest vertex.

    Every round sends each vertex's label to its neighbours (a minimum, so map-side combining absorbs hubs) and then
    follows the label's own label (pointer jumping), so that long chains shorten geometrically.
    """
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), label)
    labels = materialize(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("root")), label)
    for _ in range(64):
        near = both.join(labels.select(F.col("v").alias("b"), F.col("root").alias("far")), "b").groupBy(F.col("a").alias("v")).agg(F.min("far").alias("far"))
        hooked = labels.join(near, "v").select("v", F.least("root", "far").alias("next"), F.col("root").alias("old"))
        jump = labels.select(F.col("v").alias("next"), F.col("root").alias("up"))
        new = materialize(hooked.join(jump, "next").select("v", F.least("next", "up").alias("root"), "old"), label)
        labels = new.select("v", "root")
        if new.where("root != old").isEmpty():
            return labels
    raise RuntimeError("components did not settle in 64 rounds")
