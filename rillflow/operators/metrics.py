"""Scores and their distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def relative_error(estimate: Column, base: Column) -> Column:
    return (estimate - base) / base


def symmetric_error(a: Column, b: Column) -> Column:
    return F.abs(2 * (a - b) / (a + b))


def half_error(a: Column, b: Column) -> Column:
    """As published: the difference over the sum, halved."""
    return (a - b) / (a + b) / 2


def error_class(re: Column) -> Column:
    """1 up to .05, 2 up to .1, 3 up to .2 (bounds included), 4 above."""
    e = F.abs(re)
    return F.when(e <= 0.05, 1).when(e <= 0.1, 2).when(e <= 0.2, 3).otherwise(4)


def score_shares(df: DataFrame, score: str, marks: tuple[float, ...] = (0.6, 0.8)) -> DataFrame:
    """n, mean, median of a score and the share of rows at or above each mark (at_60 for .6); nulls are left out."""
    shares = [F.round(F.avg((F.col(score) >= m).cast("int")), 6).alias(f"at_{round(100 * m)}") for m in marks]
    return df.where(F.col(score).isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean"), F.round(F.percentile(score, 0.5), 6).alias("median"), *shares)


def quantile_bins(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Median and quartiles of y in bins of x whose edges are quantiles; equal edges are one. Right-closed bins."""
    marks = [i / bins for i in range(bins + 1)]
    edges = df.agg(F.array_distinct(F.percentile(x, marks)).alias("edges"))
    inner = F.slice("edges", F.lit(2), F.greatest(F.size("edges") - 2, F.lit(0)))
    placed = df.crossJoin(F.broadcast(edges)).withColumn("bin", F.size(F.filter(inner, lambda e: e < F.col(x))))
    q = F.percentile(y, [0.25, 0.5, 0.75])
    return placed.groupBy("bin").agg(F.count("*").alias("n"), q.alias("q")).select("bin", "n", *(F.round(F.get("q", F.lit(i)), 6).alias(name) for i, name in enumerate(("q25", "median", "q75"))))


def without_outliers(df: DataFrame, x: str) -> DataFrame:
    """Rows within one and a half interquartile ranges of the quartiles."""
    q = df.agg(F.percentile(x, [0.25, 0.75]).alias("q")).select(F.get("q", F.lit(0)).alias("q1"), F.get("q", F.lit(1)).alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    return df.crossJoin(F.broadcast(q)).where(F.col(x).between(F.col("q1") - reach, F.col("q3") + reach)).drop("q1", "q3")


def histogram(df: DataFrame, x: str, bins: int) -> DataFrame:
    """Counts, density and empirical distribution function at the end of each of bins equal intervals."""
    ends = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("total"))
    at = F.least(F.floor((F.col(x) - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)), F.lit(bins - 1)).cast("int")
    n = df.where(F.col(x).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("total").alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    cdf = F.sum("n").over(Window.orderBy("bin")) / F.col("total")  # over the bins, which are few
    return n.select("bin", "n", F.round(F.col("n") / (F.col("total") * width), 6).alias("density"), F.round(cdf, 6).alias("cdf"))
