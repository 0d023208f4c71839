"""Rasters and point tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import tile_corner
from ..operators.grid import with_tile


def write_tiles(cells: DataFrame, path: str, edge: int, codec: str = "zstd") -> None:
    """Cells as Parquet by tile, so that extents prune files; each tile is written by one task, in scan order."""
    tiled = with_tile(cells, edge).repartition("tile_r", "tile_c").sortWithinPartitions("tile_r", "tile_c", "r", "c")
    tiled.write.mode("overwrite").option("compression", codec).partitionBy("tile_r", "tile_c").parquet(path)


def read_tiles(spark: SparkSession, path: str, edge: int, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of a rectangle (bounds included): only its tiles are read."""
    t = spark.read.parquet(path).where(F.col("tile_r").between(r0 // edge, r1 // edge) & F.col("tile_c").between(c0 // edge, c1 // edge))
    return t.where(F.col("r").between(r0, r1) & F.col("c").between(c0, c1)).drop("tile_r", "tile_c")


def listed_tiles(spark: SparkSession, folder: str, glob: str, left: float, top: float, right: float, bottom: float) -> DataFrame:
    """Files of a folder tree whose tile name lies in an extent (cut towards zero, bounds included): path, lon, lat, length."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(folder).select("path", "length")
    lon, lat = tile_corner(F.element_at(F.split("path", "/"), -1))
    return files.withColumn("lon", lon).withColumn("lat", lat).where(F.col("lon").between(int(left), int(right)) & F.col("lat").between(int(bottom), int(top)))


def read_points(spark: SparkSession, path: str, schema: str, header: bool = True) -> DataFrame:
    """Delimited points with a declared schema; a malformed line fails the read."""
    return spark.read.csv(path, schema=schema, header=header, mode="FAILFAST")


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").option("header", "true").csv(path)


def pending(expected: DataFrame, produced: DataFrame, key: str) -> DataFrame:
    """What is still to be made: expected keys without a product."""
    return expected.join(produced.select(key), key, "left_anti")
