"""Queries over rasters in files, other grids and other projections."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources.geotiff import geotiff_directories, read_geotiff, write_geotiff
from ..storage import shared_dir
from .inputs import DEM, WIDE, dem, query

#: Tiles of so many cells; the raster's corner in degrees, and a cell's size.
_EDGE, _NORTH, _WEST, _SIZE = 128, 50.0, 20.0, 0.25


def _written(spark, d) -> str:
    """The raster as GeoTIFF tiles in the shared folder."""
    path = f"{shared_dir(spark)}/rillflow-geotiff-{uuid.uuid4().hex}"
    write_geotiff(dem(spark, d), path, "h", _EDGE, _NORTH, _WEST, _SIZE, block=64, codec="lzw", dtype="float64")
    return path


@query(f"WITH {DEM} SELECT r, c, h AS value FROM dem WHERE r BETWEEN 100 AND 399 AND c BETWEEN 10 AND 50 AND h IS NOT NULL")
def geotiff_window(spark, d):
    """A window of the raster, out of tiles written and read as GeoTIFF; blocks outside are not read."""
    return read_geotiff(spark, _written(spark, d), (100, 399, 10, 50), (_NORTH, _WEST, _SIZE)).where("value is not null").select("r", "c", "value")


@query(f"WITH {DEM} SELECT r // {_EDGE} AS tile_r, c // {_EDGE} AS tile_c, CAST({_EDGE} AS BIGINT) AS width, CAST({_EDGE} AS BIGINT) AS height, {_NORTH}::DOUBLE - (r // {_EDGE}) * {_EDGE * _SIZE}::DOUBLE AS north, {_WEST}::DOUBLE + (c // {_EDGE}) * {_EDGE * _SIZE}::DOUBLE AS west, {_SIZE}::DOUBLE AS size, -9999::DOUBLE AS nodata, CAST(4326 AS BIGINT) AS epsg, 'f8' AS dtype, 'lzw' AS codec, CAST(4 AS BIGINT) AS blocks FROM dem GROUP BY ALL")
def geotiff_metadata(spark, d):
    """Extent, coordinate system, nodata value and layout of the tiles, from their directories."""
    t = geotiff_directories(spark, _written(spark, d))
    name = F.split(F.regexp_extract("file", r"tile_(\d+_\d+)\.tif$", 1), "_")
    return t.select(name[0].cast("long").alias("tile_r"), name[1].cast("long").alias("tile_c"), "width", "height", "north", "west", F.col("size_x").alias("size"), "nodata", "epsg", "dtype", "codec", "blocks")
