"""Tables that queries start from, each as a DataFrame and as the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.focal import d8, flow_edges
from ..operators.grid import cells_from_arrays
from ..storage import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as a raster: a row for each vector, a column for each position."""
    return cells_from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")


def ncols(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]


def nrows(spark: SparkSession, sf_dir: str) -> int:
    return table(spark, sf_dir, "embeddings").agg(F.max("vec_id")).first()[0] + 1


def water(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dem(spark, sf_dir).where("h < -0.12")


def flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(flow_edges(d8(dem(spark, sf_dir)), ncols(spark, sf_dir)), "flow")


DEM = "dem AS MATERIALIZED (SELECT vec_id AS r, CAST(unnest(range(len(embedding))) AS BIGINT) AS c, CAST(unnest(embedding) AS DOUBLE) AS h FROM embeddings)"
WIDE = "(SELECT max(len(embedding)) FROM embeddings)"
D8 = "d8(k, dr, dc, f) AS (VALUES (0,0,1,1.0::DOUBLE),(1,1,1,sqrt(2.0::DOUBLE)),(2,1,0,1.0::DOUBLE),(3,1,-1,sqrt(2.0::DOUBLE)),(4,0,-1,1.0::DOUBLE),(5,-1,-1,sqrt(2.0::DOUBLE)),(6,-1,0,1.0::DOUBLE),(7,-1,1,sqrt(2.0::DOUBLE)))"
NEAR = f"{DEM}, {D8}, step AS MATERIALIZED (SELECT r, c, h, k, f, r + dr AS nr, c + dc AS nc FROM dem, d8), near AS MATERIALIZED (SELECT s.*, b.h AS nh FROM step s JOIN dem b ON b.r = s.nr AND b.c = s.nc)"
DIRS = f"{NEAR}, best AS (SELECT r, c, k, nr, nc FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY (h - nh) / f DESC, k) AS i FROM near WHERE nh <= h) WHERE i = 1), dirs AS MATERIALIZED (SELECT dem.r, dem.c, h, CAST(coalesce(1 << k, 0) AS SMALLINT) AS dir, nr, nc FROM dem LEFT JOIN best USING (r, c))"
FLOW = f"{DIRS}, flow AS MATERIALIZED (SELECT r * {WIDE} + c AS id, nr * {WIDE} + nc AS next_id FROM dirs)"
#: Every cell with the cells that it reaches.
DOWN = f"{FLOW}, down AS MATERIALIZED (WITH RECURSIVE w AS (SELECT id, id AS pos, 0 AS step FROM flow UNION ALL SELECT w.id, next_id, step + 1 FROM w JOIN flow ON flow.id = w.pos WHERE next_id IS NOT NULL) SELECT * FROM w)"
ACC = f"{DOWN}, acc AS MATERIALIZED (SELECT pos AS id, count(*) - 1 AS acc FROM down GROUP BY pos)"
#: Components of low cells: the smallest id among those that a cell reaches.
WATER = f"{NEAR}, wet AS MATERIALIZED (SELECT r * {WIDE} + c AS a, nr * {WIDE} + nc AS b FROM near WHERE h < -0.12 AND nh < -0.12), reach AS (WITH RECURSIVE w AS (SELECT r * {WIDE} + c AS id, r * {WIDE} + c AS pos FROM dem WHERE h < -0.12 UNION SELECT w.id, b FROM w JOIN wet ON wet.a = w.pos) SELECT * FROM w), comp AS MATERIALIZED (SELECT id, min(pos) AS label FROM reach GROUP BY id)"
