"""Names of tiles by their lower-left corner, and conversions between pixels and coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tile_name(lon: Column, lat: Column) -> Column:
    """Such as N25E068 or S03W120."""
    ns, ew = F.when(lat >= 0, "N").otherwise("S"), F.when(lon >= 0, "E").otherwise("W")
    return F.concat(ns, F.lpad(F.abs(lat).cast("int").cast("string"), 2, "0"), ew, F.lpad(F.abs(lon).cast("int").cast("string"), 3, "0"))


def tile_corner(name: Column) -> tuple[Column, Column]:
    """Longitude and latitude of a tile name; null where there is none in the text."""
    p = r"([NS])(\d{2})([EW])(\d{3})"
    part = lambda i: F.nullif(F.regexp_extract(name, p, i), F.lit(""))
    signed = lambda letter, digits, negative: F.when(letter == negative, -digits.cast("int")).otherwise(digits.cast("int"))
    return signed(part(3), part(4), "W"), signed(part(1), part(2), "S")


def merged_name(lon0: Column, lat0: Column, lon1: Column, lat1: Column) -> Column:
    """Of an extent of tiles, such as N2530E068075; the letters are those of the smaller corner."""
    west, east, south, north = F.least(lon0, lon1), F.greatest(lon0, lon1), F.least(lat0, lat1), F.greatest(lat0, lat1)
    digits = lambda x, n: F.lpad(F.abs(x).cast("int").cast("string"), n, "0")
    return F.concat(F.when(south >= 0, "N").otherwise("S"), digits(south, 2), digits(north, 2), F.when(west >= 0, "E").otherwise("W"), digits(west, 3), digits(east, 3))


def merged_corners(name: Column, cell: float = 0.00027777778) -> Column:
    """The extent that a merged or a single tile name stands for: west, south, east, north, the last cell's corner included.

    A letter holds for both of its numbers, so names of extents across the equator or the first meridian come back with
    the sign of their smaller corner on both. Null where there is no name.
    """
    pattern = r"([NS])(\d{2})(\d{2})?([EW])(\d{3})(\d{3})?"
    part = lambda i: F.nullif(F.regexp_extract(name, pattern, i), F.lit(""))
    signed = lambda letter, i, other: F.coalesce(part(i), part(other)).cast("int") * F.when(part(letter).isin("S", "W"), -1).otherwise(1)
    return F.struct(signed(4, 5, 5).alias("west"), signed(1, 2, 2).alias("south"), (signed(4, 6, 5) + 1 - cell).alias("east"), (signed(1, 3, 2) + 1 - cell).alias("north"))


def pixel_to_lonlat(r: Column, c: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """Upper-left corner of a pixel."""
    return x0 + c * dx, y0 + r * dy


def lonlat_to_pixel(lon: Column, lat: Column, x0: float, dx: float, y0: float, dy: float) -> tuple[Column, Column]:
    """Row and column, cut towards zero."""
    return ((lat - y0) / dy).cast("int"), ((lon - x0) / dx).cast("int")


def coordinate_list(text: Column) -> Column:
    """Text such as [(1, 2), (3, 4)] as an array of arrays."""
    return F.from_json(F.translate(text, "()", "[]"), "array<array<int>>")


def id_filter(field: str, ids: list[int]) -> str:
    """A filter text that selects ids of a field."""
    return f"{field} IN ({', '.join(map(str, ids))})"
