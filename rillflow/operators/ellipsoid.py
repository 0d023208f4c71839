"""Distances, areas and an equal-area projection on an ellipsoid, as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    f: float

    @property
    def b(self) -> float:
        return self.a * (1 - self.f)

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)


#: Fixed values of the two systems.
WGS84, GRS80 = Ellipsoid(6378137.0, 1 / 298.257223563), Ellipsoid(6378137.0, 1 / 298.257222101)
#: Steps of the iteration for distances, and the change at which it has converged.
STEPS, SETTLED = 200, 1e-12


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.transform(F.array(value), use)[0]


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column, on: Ellipsoid = WGS84) -> Column:
    """Metres along the geodesic between two points in degrees, by Vincenty's inverse iteration, as a struct: metres, converged.

    The iteration does not settle for points that are nearly opposite; metres is null and converged false there. Nulls give null metres.
    """
    f, b = on.f, on.b
    ends = F.struct(*(g(F.atan((1 - f) * F.tan(F.radians(x)))).alias(n) for x, t in ((lat1, "1"), (lat2, "2")) for g, n in ((F.sin, "s" + t), (F.cos, "c" + t))), F.radians(lon2 - lon1).alias("l"))

    def angles(u: Column, lam: Column) -> Column:
        across = F.pow(u["c2"] * F.sin(lam), 2) + F.pow(u["c1"] * u["s2"] - u["s1"] * u["c2"] * F.cos(lam), 2)
        along = u["s1"] * u["s2"] + u["c1"] * u["c2"] * F.cos(lam)
        first = F.struct(F.sqrt(across).alias("ss"), along.alias("cs"))

        def azimuth(g: Column) -> Column:
            alpha = F.when(g["ss"] == 0, 0.0).otherwise(u["c1"] * u["c2"] * F.sin(lam) / g["ss"])
            return _let(F.struct(g["ss"].alias("ss"), g["cs"].alias("cs"), F.atan2(g["ss"], g["cs"]).alias("sigma"), alpha.alias("sa"), (1 - alpha * alpha).alias("c2a")), middle)

        def middle(g: Column) -> Column:
            return F.struct(g["ss"].alias("ss"), g["cs"].alias("cs"), g["sigma"].alias("sigma"), g["sa"].alias("sa"), g["c2a"].alias("c2a"), F.when(g["c2a"] == 0, 0.0).otherwise(g["cs"] - 2 * u["s1"] * u["s2"] / g["c2a"]).alias("m"))

        return _let(first, azimuth)

    def step(u: Column, s: Column) -> Column:
        def turned(g: Column) -> Column:
            c = f / 16 * g["c2a"] * (4 + f * (4 - 3 * g["c2a"]))
            lam = u["l"] + (1 - c) * f * g["sa"] * (g["sigma"] + c * g["ss"] * (g["m"] + c * g["cs"] * (2 * g["m"] * g["m"] - 1)))
            return F.struct(lam.alias("lam"), s["lam"].alias("was"))

        return F.when(F.abs(s["lam"] - s["was"]) <= SETTLED, s).otherwise(_let(angles(u, s["lam"]), turned))

    def length(u: Column, s: Column) -> Column:
        def metres(g: Column) -> Column:
            w = g["c2a"] * (on.a**2 - b**2) / b**2
            big = 1 + w / 16384 * (4096 + w * (-768 + w * (320 - 175 * w)))
            small = w / 1024 * (256 + w * (-128 + w * (74 - 47 * w)))
            m2 = g["m"] * g["m"]
            less = small * g["ss"] * (g["m"] + small / 4 * (g["cs"] * (2 * m2 - 1) - small / 6 * g["m"] * (4 * g["ss"] * g["ss"] - 3) * (4 * m2 - 3)))
            return b * big * (g["sigma"] - less)

        settled = F.coalesce((F.abs(s["lam"] - s["was"]) <= SETTLED) & (F.abs(s["lam"]) <= math.pi), F.lit(False))
        return F.struct(F.when(settled, _let(angles(u, s["lam"]), metres)).alias("metres"), settled.alias("converged"))

    def whole(u: Column) -> Column:
        start = F.struct(u["l"].alias("lam"), F.lit(float("inf")).alias("was"))
        return _let(F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, lambda s, _: step(u, s)), lambda s: length(u, s))

    return _let(ends, whole)


def _zone(lat: Column, on: Ellipsoid) -> Column:
    """Square metres between the equator and a latitude, for a radian of longitude."""
    e = math.sqrt(on.e2)
    s = F.sin(F.radians(lat))
    return on.b**2 / 2 * (s / (1 - on.e2 * s * s) + F.log((1 + e * s) / (1 - e * s)) / (2 * e))


def cell_area(lat: Column, height: float, width: float, on: Ellipsoid = WGS84) -> Column:
    """Square metres of a cell of so many degrees whose lower edge is at a latitude; exact."""
    return math.radians(width) * (_zone(lat + height, on) - _zone(lat, on))


def edge_area(lon1: Column, lat1: Column, lon2: Column, lat2: Column, on: Ellipsoid = WGS84) -> Column:
    """What an edge of a ring adds to the area inside, in square metres: sum it over the ring.

    Exact for edges along meridians and parallels, as outlines of cells have; other edges count as straight between the zones
    of their ends. Positive for rings that go clockwise (north up), negative for holes that go the other way.
    """
    return F.radians(lon2 - lon1) * (_zone(lat1, on) + _zone(lat2, on)) / 2


@dataclass(frozen=True)
class Albers:
    """Albers' equal-area conic projection: standard parallels, origin, ellipsoid; x and y in metres."""

    lat1: float = 29.5
    lat2: float = 45.5
    lat0: float = 23.0
    lon0: float = -96.0
    on: Ellipsoid = GRS80

    def _q(self, lat: float) -> float:
        e, s = math.sqrt(self.on.e2), math.sin(math.radians(lat))
        return (1 - self.on.e2) * (s / (1 - self.on.e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))

    @property
    def constants(self) -> tuple[float, float, float]:
        """n, C and rho of the origin."""
        m = [math.cos(math.radians(x)) / math.sqrt(1 - self.on.e2 * math.sin(math.radians(x)) ** 2) for x in (self.lat1, self.lat2)]
        q1, q2 = self._q(self.lat1), self._q(self.lat2)
        n = (m[0] ** 2 - m[1] ** 2) / (q2 - q1)
        c = m[0] ** 2 + n * q1
        return n, c, self.on.a * math.sqrt(c - n * self._q(self.lat0)) / n

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, c, rho0 = self.constants
        e, s = math.sqrt(self.on.e2), F.sin(F.radians(lat))
        q = (1 - self.on.e2) * (s / (1 - self.on.e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
        rho, theta = self.on.a * F.sqrt(c - n * q) / n, n * F.radians(lon - self.lon0)
        return rho * F.sin(theta), rho0 - rho * F.cos(theta)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, c, rho0 = self.constants
        e2 = self.on.e2
        rho2 = x * x + (rho0 - y) * (rho0 - y)
        beta = F.asin((c - rho2 * n * n / self.on.a**2) / n / self._q(90))
        lat = beta + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * beta) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * beta) + 761 * e2**3 / 45360 * F.sin(6 * beta)
        return F.degrees(F.atan2(x, rho0 - y)) / n + self.lon0, F.degrees(lat)


def region_area(cells: DataFrame, group: str, north: float, size: float, on: Ellipsoid = WGS84) -> DataFrame:
    """Square metres of regions of cells (group, r) of so many degrees below a northern edge: group, m2."""
    return cells.groupBy(group, "r").agg(F.count("*").alias("n")).groupBy(group).agg(F.sum(F.col("n") * cell_area(north - (F.col("r") + 1) * size, size, size, on)).alias("m2"))
