"""Queries over stations, scores, catalogues and tile names."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import algebra, catalog, metrics, vector
from ..operators.flow import upstream
from ..sources.tiles import pending
from ..streaming.gauges import window_levels
from .inputs import DEM, dem, query, table

_LON, _LAT = "(c_custkey * 37) % 360 - 180", "(c_custkey * 17) % 140 - 60"


def _stations(spark, d):
    """Customers as stations: id, area, lon, lat."""
    key = F.col("c_custkey")
    return table(spark, d, "customer").select(key.alias("id"), F.abs("c_acctbal").alias("area"), (key * 37 % 360 - 180).alias("lon"), (key * 17 % 140 - 60).alias("lat"), F.col("c_nationkey").alias("region"))


_ST = f"st AS (SELECT c_custkey AS id, abs(c_acctbal) AS area, {_LON} AS lon, {_LAT} AS lat, c_nationkey AS region FROM customer)"


@query(f"WITH {_ST} SELECT id, area, lon, lat FROM st WHERE area > 100 AND lon > -120 AND lon < 120 AND lat > -40 AND lat < 60")
def station_filter(spark, d):
    return _stations(spark, d).where("area > 100 and lon > -120 and lon < 120 and lat > -40 and lat < 60").drop("region")


@query(f"WITH {_ST} SELECT region, floor(min(lon) / 10.0) - 3 AS x0, ceil(max(lon) / 10.0) + 2 AS x1, floor(min(lat) / 10.0) - 3 AS y0, ceil(max(lat) / 10.0) + 2 AS y1 FROM st GROUP BY region")
def region_extent(spark, d):
    low, high = (lambda c: F.floor(F.min(c) / 10.0).cast("double") - 3), (lambda c: F.ceil(F.max(c) / 10.0).cast("double") + 2)
    return _stations(spark, d).groupBy("region").agg(low("lon").alias("x0"), high("lon").alias("x1"), low("lat").alias("y0"), high("lat").alias("y1"))


_NAME = "CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(CAST(abs(lat) AS VARCHAR), 2, '0') || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(CAST(abs(lon) AS VARCHAR), 3, '0')"


@query(f"WITH {_ST} SELECT id, {_NAME} AS name, CAST(lon AS INT) AS lon, CAST(lat AS INT) AS lat FROM st")
def tile_name_roundtrip(spark, d):
    named = _stations(spark, d).select("id", names.tile_name(F.col("lon"), F.col("lat")).alias("name"))
    lon, lat = names.tile_corner(F.col("name"))
    return named.select("id", "name", lon.alias("lon"), lat.alias("lat"))


@query(f"WITH {_ST} SELECT {_NAME} AS name, count(*) AS n FROM st WHERE lon BETWEEN -30 AND 60 AND lat BETWEEN -10 AND 40 GROUP BY 1")
def tile_selection(spark, d):
    named = _stations(spark, d).select(F.concat(names.tile_name(F.col("lon"), F.col("lat")), F.lit("_dem.tif")).alias("file"))
    lon, lat = names.tile_corner(F.col("file"))
    chosen = named.withColumn("lon", lon).withColumn("lat", lat).where(F.col("lon").between(-30, 60) & F.col("lat").between(-10, 40))
    return chosen.groupBy(F.substring("file", 1, 7).alias("name")).agg(F.count("*").alias("n"))


@query(f"WITH {_ST}, e AS (SELECT region, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM st GROUP BY region) SELECT region, gx AS lon, gy AS lat FROM e, (SELECT unnest(range(-180, 181, 10)) AS gx), (SELECT unnest(range(-60, 81, 10)) AS gy) WHERE gx >= x0 // 10 * 10 AND gx <= x1 AND gy >= y0 // 10 * 10 AND gy <= y1".replace("x0 // 10 * 10", "floor(x0 / 10.0) * 10").replace("y0 // 10 * 10", "floor(y0 / 10.0) * 10"))
def tile_lattice(spark, d):
    """Ten-degree tiles that cover each region."""
    e = _stations(spark, d).groupBy("region").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    steps = lambda a, z: F.explode(F.sequence(F.floor(F.col(a) / 10.0) * 10, F.col(z).cast("long"), F.lit(10).cast("long")))
    return e.withColumn("lon", steps("x0", "x1")).withColumn("lat", steps("y0", "y1")).select("region", "lon", "lat")


@query(f"WITH {_ST}, p AS (SELECT id, CASE WHEN lon <> 0 AND lat <> 0 THEN lon ELSE region END AS x, CASE WHEN lon <> 0 AND lat <> 0 THEN lat ELSE -region END AS y FROM st) SELECT id, CAST(trunc((y - 80.0) / -0.25) AS INT) AS r, CAST(trunc((x + 180.0) / 0.25) AS INT) AS c FROM p")
def dam_points(spark, d):
    """Pixels of dams: by their own coordinates unless either is 0, else by the river's."""
    own = (F.col("lon") != 0) & (F.col("lat") != 0)
    p = _stations(spark, d).select("id", F.when(own, F.col("lon")).otherwise(F.col("region")).alias("x"), F.when(own, F.col("lat")).otherwise(-F.col("region")).alias("y"))
    r, c = names.lonlat_to_pixel(F.col("x"), F.col("y"), -180.0, 0.25, 80.0, -0.25)
    return p.select("id", r.alias("r"), c.alias("c"))


@query(f"WITH {_ST} SELECT id, x + 0.25 * CAST(trunc((lon - x) / 0.25) AS INT) AS lon, 80.0 - 0.25 * CAST(trunc((lat - 80.0) / -0.25) AS INT) AS lat FROM (SELECT *, -180.0 AS x FROM st)".replace("x + 0.25", "CAST(x + 0.25").replace("AS INT) AS lon,", "AS INT) AS DOUBLE) AS lon,").replace("80.0 - 0.25 *", "CAST(80.0 - 0.25 *").replace("AS INT) AS lat", "AS INT) AS DOUBLE) AS lat"))
def pixel_corners(spark, d):
    r, c = names.lonlat_to_pixel(F.col("lon"), F.col("lat"), -180.0, 0.25, 80.0, -0.25)
    p = _stations(spark, d).select("id", r.alias("r"), c.alias("c"))
    lon, lat = names.pixel_to_lonlat(F.col("r"), F.col("c"), -180.0, 0.25, 80.0, -0.25)
    return p.select("id", lon.alias("lon"), lat.alias("lat"))


@query(f"WITH {_ST} SELECT st.id, area, n_name, r_name FROM st JOIN nation ON n_nationkey = region JOIN region ON r_regionkey = n_regionkey")
def station_attributes(spark, d):
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # both have fixed sizes
    return _stations(spark, d).join(F.broadcast(nations), F.col("region") == F.col("n_nationkey")).select("id", "area", "n_name", "r_name")


@query(f"WITH {_ST}, ref AS (SELECT lon, lat, max(area) AS ref_area FROM st GROUP BY lon, lat) SELECT id, ref_area FROM st JOIN ref USING (lon, lat)")
def reference_lookup(spark, d):
    """Reference area at the same place, by whole coordinates."""
    s = _stations(spark, d)
    return s.join(s.groupBy("lon", "lat").agg(F.max("area").alias("ref_area")), ["lon", "lat"]).select("id", "ref_area")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice AS base, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS est FROM lineitem WHERE abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_extendedprice) > 0.1 AND abs(l_extendedprice * (1 - l_discount) * (1 + l_tax) / l_extendedprice) < 10")
def ratio_filter(spark, d):
    x = _scores(spark, d)
    ratio = F.abs(F.col("est") / F.col("base"))
    return x.where((ratio > 0.1) & (ratio < 10)).select("l_orderkey", "l_linenumber", "base", F.round("est", 6).alias("est"))


def _scores(spark, d):
    """Line items as scores: base, est."""
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").alias("base"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("est"))


_SC = "sc AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_extendedprice AS base, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS est FROM lineitem)"


@query(f"WITH {_SC} SELECT l_orderkey, l_linenumber, round(est / base, 6) AS csi FROM sc WHERE est / base < 0.95")
def low_score_selection(spark, d):
    csi = F.col("est") / F.col("base")
    return _scores(spark, d).where(csi < 0.95).select("l_orderkey", "l_linenumber", F.round(csi, 6).alias("csi"))


@query("SELECT o_custkey AS c_custkey FROM (SELECT c_custkey AS o_custkey FROM customer) ANTI JOIN (SELECT DISTINCT o_custkey FROM orders) USING (o_custkey)")
def missing_outputs(spark, d):
    """Customers without an order: expected results that nothing has produced."""
    return pending(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity >= 49)")
def keep_listed(spark, d):
    big = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("s_suppkey"))
    return table(spark, d, "supplier").join(big, "s_suppkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT event_id, event_type, value FROM events WHERE (event_type = 'click' AND value > 0.3) OR (event_type <> 'click' AND value BETWEEN 10 AND 20)")
def sensor_filter(spark, d):
    ok = F.when(F.col("event_type") == "click", F.col("value") > 0.3).otherwise(F.col("value").between(10, 20))
    return table(spark, d, "events").where(ok).select("event_id", "event_type", "value")


@query(f"WITH {_SC}, q AS (SELECT quantile_cont(base, 0.25) AS q1, quantile_cont(base, 0.75) AS q3 FROM sc) SELECT l_orderkey, l_linenumber, base FROM sc, q WHERE base BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
def iqr_filter(spark, d):
    return metrics.without_outliers(_scores(spark, d).select("l_orderkey", "l_linenumber", "base"), "base")


@query(f"WITH {_SC}, e AS (SELECT (est - base) / base AS re, CASE WHEN abs((est - base) / base) <= 0.05 THEN 1 WHEN abs((est - base) / base) <= 0.1 THEN 2 WHEN abs((est - base) / base) <= 0.2 THEN 3 ELSE 4 END AS cls FROM sc) SELECT cls, count(*) AS n, round(count(*) / (SELECT count(*) FROM e), 6) AS share, round(avg(re), 6) AS mean, round(median(re), 6) AS median FROM e GROUP BY cls")
def relative_error_bins(spark, d):
    e = _scores(spark, d).select(metrics.relative_error(F.col("est"), F.col("base")).alias("re")).withColumn("cls", metrics.error_class(F.col("re")))
    total = e.agg(F.count("*").alias("total"))
    g = e.groupBy("cls").agg(F.count("*").alias("n"), F.round(F.avg("re"), 6).alias("mean"), F.round(F.percentile("re", 0.5), 6).alias("median"))
    return g.crossJoin(F.broadcast(total)).select("cls", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), "mean", "median")


@query(f"WITH {_SC} SELECT l_orderkey, l_linenumber, round((est - base) / base, 9) AS re, round(abs(2 * (est - base) / (est + base)), 9) AS re_sym, round((est - base) / (est + base) / 2, 9) AS re_half, round(CASE WHEN abs((est - base) / base) <= abs((est * 1.01 - base) / base) THEN (est - base) / base ELSE (est * 1.01 - base) / base END, 9) AS re_best FROM sc")
def error_measures(spark, d):
    a, b = F.col("est"), F.col("base")
    one, two = metrics.relative_error(a, b), metrics.relative_error(a * 1.01, b)
    return _scores(spark, d).select("l_orderkey", "l_linenumber", F.round(one, 9).alias("re"), F.round(metrics.symmetric_error(a, b), 9).alias("re_sym"), F.round(metrics.half_error(a, b), 9).alias("re_half"), F.round(F.when(F.abs(one) <= F.abs(two), one).otherwise(two), 9).alias("re_best"))


@query(f"WITH {_SC}, e AS (SELECT unnest(list_distinct(quantile_cont(base, [0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS e FROM sc), b AS (SELECT base, est, (SELECT count(*) FROM e WHERE e.e < base AND e.e > (SELECT min(e) FROM e) AND e.e < (SELECT max(e) FROM e)) AS bin FROM sc) SELECT CAST(bin AS INT) AS bin, count(*) AS n, round(quantile_cont(est, 0.25), 6) AS q25, round(quantile_cont(est, 0.5), 6) AS median, round(quantile_cont(est, 0.75), 6) AS q75 FROM b GROUP BY bin")
def quantile_bins(spark, d):
    return metrics.quantile_bins(_scores(spark, d), "base", "est", 5)


@query("WITH s AS (SELECT o_orderkey % 6 + 1 AS ord, o_custkey % 8 AS continent, CAST(o_totalprice AS DECIMAL(18,2)) AS len FROM orders), g AS (SELECT continent, ord, sum(len) AS len FROM s GROUP BY ALL) SELECT continent, ord, CAST(len AS DOUBLE) AS length, CAST(sum(len) OVER (PARTITION BY continent ORDER BY ord) AS DOUBLE) AS running FROM g")
def order_length_rollup(spark, d):
    from pyspark.sql import Window

    s = table(spark, d, "orders").select((F.col("o_orderkey") % 6 + 1).alias("ord"), (F.col("o_custkey") % 8).alias("continent"), F.col("o_totalprice").cast("decimal(18,2)").alias("len"))
    g = s.groupBy("continent", "ord").agg(F.sum("len").alias("len"))
    running = F.sum("len").over(Window.partitionBy("continent").orderBy("ord"))
    return g.select("continent", "ord", F.col("len").cast("double").alias("length"), running.cast("double").alias("running"))


@query(f"WITH {_ST}, a AS (SELECT CASE WHEN area < 1000 THEN 1 WHEN area < 5000 THEN 2 ELSE 3 END AS cls, CAST(area AS DECIMAL(18,2)) AS area FROM st) SELECT cls, count(*) AS n, round(CAST(sum(area) AS DOUBLE) / (SELECT CAST(sum(area) AS DOUBLE) FROM a), 6) AS share FROM a GROUP BY cls")
def area_classes(spark, d):
    a = _stations(spark, d).select(F.when(F.col("area") < 1000, 1).when(F.col("area") < 5000, 2).otherwise(3).alias("cls"), F.col("area").cast("decimal(18,2)").alias("area"))
    g = a.groupBy("cls").agg(F.count("*").alias("n"), F.sum("area").cast("double").alias("s"))
    total = a.agg(F.sum("area").cast("double").alias("total"))
    return g.crossJoin(F.broadcast(total)).select("cls", "n", F.round(F.col("s") / F.col("total"), 6).alias("share"))


@query("WITH t AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, count(*) AS n FROM lineitem), b AS (SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 60)), 59) AS INT) AS bin, lo, hi, t.n AS total FROM lineitem, t), g AS (SELECT bin, count(*) AS n, any_value(hi - lo) / 60 AS w, any_value(total) AS total FROM b GROUP BY bin) SELECT bin, n, round(n / (total * w), 6) AS density, round(sum(n) OVER (ORDER BY bin) / total, 6) AS cdf FROM g")
def hist_cdf(spark, d):
    return metrics.histogram(table(spark, d, "lineitem"), "l_extendedprice", 60)


_EXT = "e AS (SELECT p_partkey AS id, CAST((p_partkey * 13) % 300 AS DOUBLE) AS x0, CAST((p_partkey * 13) % 300 + p_size AS DOUBLE) AS x1, CAST((p_partkey * 29) % 300 AS DOUBLE) AS y0, CAST((p_partkey * 29) % 300 + p_size AS DOUBLE) AS y1 FROM part)"


@query(f"WITH {_EXT} SELECT a.id, a.x0, a.x1, a.y0, a.y1 FROM e a WHERE NOT EXISTS (SELECT 1 FROM e b WHERE b.id <> a.id AND b.x0 <= a.x0 AND b.x1 >= a.x1 AND b.y0 <= a.y0 AND b.y1 >= a.y1 AND (NOT (b.x0 = a.x0 AND b.x1 = a.x1 AND b.y0 = a.y0 AND b.y1 = a.y1) OR b.id < a.id))")
def extent_containment(spark, d):
    x, y, size = F.col("p_partkey") * 13 % 300, F.col("p_partkey") * 29 % 300, F.col("p_size")
    e = table(spark, d, "part").select(F.col("p_partkey").alias("id"), x.cast("double").alias("x0"), (x + size).cast("double").alias("x1"), y.cast("double").alias("y0"), (y + size).cast("double").alias("y1"))
    return vector.not_contained(e, 50.0)


_DEP = "dep AS (SELECT doc_id AS sink_id, n_chars % 3 + 1 AS sink_type FROM documents)"


def _depressions(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("sink_id"), (F.col("n_chars") % 3 + 1).alias("sink_type"))


@query(f"WITH {_DEP} SELECT sink_id, sink_type FROM dep WHERE sink_type = 2")
def catalog_by_type(spark, d):
    return catalog.of_type(_depressions(spark, d), 2)


@query(f"WITH {_DEP} SELECT sink_id, coalesce(CASE WHEN quality = 1 THEN 3 WHEN quality IS NOT NULL THEN 2 END, sink_type) AS sink_type FROM dep LEFT JOIN labels ON doc_id = sink_id")
def override_update(spark, d):
    o = table(spark, d, "labels").select(F.col("doc_id").alias("record"), F.when(F.col("quality") == 1, 3).otherwise(2).alias("newtype"))
    return catalog.override_types(_depressions(spark, d), o).select("sink_id", F.col("sink_type").cast("long").alias("sink_type"))


@query("SELECT p_partkey, coalesce(x.v, p_retailprice) AS v FROM part LEFT JOIN (SELECT l_partkey, max(l_extendedprice) AS v FROM lineitem WHERE l_quantity > 48 GROUP BY 1) x ON l_partkey = p_partkey")
def replace_processed(spark, d):
    done = table(spark, d, "lineitem").where("l_quantity > 48").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_extendedprice").alias("v"))
    return catalog.replace_processed(table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("v")), done, "p_partkey", "v")


_TILE = f"WITH {DEM}, t AS (SELECT c // 16 AS grp, r // (50 - 2 * (c // 16 % 2)) AS i, count(DISTINCT r) AS nrows, count(DISTINCT c) AS ncols, min(c) AS x0 FROM dem GROUP BY ALL)"


@query(f"{_TILE} SELECT grp, count(DISTINCT (nrows, ncols, x0)) = 1 AS aligned, count(*) AS n FROM t GROUP BY grp")
def alignment_check(spark, d):
    """Whether the tiles of each column of tiles lie on one grid: rows and columns that they have, and where they begin."""
    grp = F.floor(F.col("c") / 16)
    t = dem(spark, d).groupBy(grp.alias("grp"), F.floor(F.col("r") / (50 - 2 * (grp % 2))).alias("i")).agg(F.count_distinct("r").alias("nrows"), F.count_distinct("c").alias("ncols"), F.min("c").alias("x0"))
    return catalog.same_grid(t.select("grp", "nrows", "ncols", "x0", F.lit(0.0).alias("y0"), F.lit(1.0).alias("dx"), F.lit(-1.0).alias("dy")))


@query(f"WITH {_ST}, e AS (SELECT region, min(lon) AS w, min(lat) AS s, max(lon) AS e, max(lat) AS n FROM st GROUP BY region), m AS (SELECT region, CASE WHEN s >= 0 THEN 'N' ELSE 'S' END AS ns, CASE WHEN w >= 0 THEN 'E' ELSE 'W' END AS ew, abs(s) AS s, abs(n) AS n, abs(w) AS w, abs(e) AS e FROM e) SELECT region, ns || lpad(CAST(s AS VARCHAR), 2, '0') || lpad(CAST(n AS VARCHAR), 2, '0') || ew || lpad(CAST(w AS VARCHAR), 3, '0') || lpad(CAST(e AS VARCHAR), 3, '0') AS name, CAST(CASE ew WHEN 'W' THEN -w ELSE w END AS INT) AS west, CAST(CASE ns WHEN 'S' THEN -s ELSE s END AS INT) AS south, CASE ew WHEN 'W' THEN -e ELSE e END + 1 - 0.00027777778::DOUBLE AS east, CASE ns WHEN 'S' THEN -n ELSE n END + 1 - 0.00027777778::DOUBLE AS north FROM m")
def merged_name_roundtrip(spark, d):
    """Names of the extents of regions, and the extents that they stand for."""
    e = _stations(spark, d).groupBy("region").agg(F.min("lon").alias("w"), F.min("lat").alias("s"), F.max("lon").alias("e"), F.max("lat").alias("n"))
    named = e.select("region", names.merged_name(F.col("w"), F.col("s"), F.col("e"), F.col("n")).alias("name"))
    return named.select("region", "name", names.merged_corners(F.col("name")).alias("x")).select("region", "name", "x.*")


@query(f"WITH sc AS (SELECT least(est, base) / greatest(est, base) AS csi FROM ({_SC[_SC.index('(') + 1:_SC.rindex(')')]})) SELECT count(*) AS n, round(avg(csi), 6) AS mean, round(median(csi), 6) AS median, round(avg(CAST(csi >= 0.6 AS INT)), 6) AS at_60, round(avg(CAST(csi >= 0.8 AS INT)), 6) AS at_80 FROM sc WHERE csi IS NOT NULL")
def score_shares(spark, d):
    """Shares of basins whose score reaches marks."""
    both = F.least("est", "base") / F.greatest("est", "base")
    return metrics.score_shares(_scores(spark, d).select(both.alias("csi")), "csi")


@query(f"WITH {_EXT} SELECT id, (x1 - x0) * (y1 - y0) AS area FROM e")
def extents_by_area(spark, d):
    """Extents from the smallest to the largest area."""
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), (size * size).alias("area")).orderBy("area", "id")


@query(f"WITH {_ST}, p AS (SELECT s_suppkey AS site, CAST((s_suppkey * 53) % 360 - 180 AS DOUBLE) AS x, CAST((s_suppkey * 31) % 140 - 60 AS DOUBLE) AS y FROM supplier), t AS (SELECT id AS point, site, (st.lon - x) * (st.lon - x) + (st.lat - y) * (st.lat - y) AS d2 FROM st, p) SELECT point, site, d2 FROM (SELECT *, row_number() OVER (PARTITION BY point ORDER BY d2, site) AS i FROM t) WHERE i = 1")
def nearest_river(spark, d):
    points = _stations(spark, d).select(F.col("id").alias("point"), F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y"))
    key = F.col("s_suppkey")
    sites = table(spark, d, "supplier").select(key.alias("site"), (key * 53 % 360 - 180).cast("double").alias("x"), (key * 31 % 140 - 60).cast("double").alias("y"))
    return vector.nearest(points, sites, 8.0, 512.0)


@query(f"WITH {_ST}, t AS (SELECT id, radians(lat) AS p1, radians(lat + 0.5) AS p2, radians(0.5) AS dl FROM st) SELECT id, round(2 * 6371008.8 * asin(sqrt(sin((p2 - p1) / 2) ** 2 + cos(p1) * cos(p2) * sin(dl / 2) ** 2)), 3) AS ds, round(2 * 6371008.8 * asin(sqrt(cos(p1) * cos(p1) * sin(dl / 2) ** 2)), 3) AS dx, round(2 * 6371008.8 * asin(sqrt(sin((p2 - p1) / 2) ** 2)), 3) AS dy FROM t")
def geodesic_distance(spark, d):
    lon, lat = F.col("lon").cast("double"), F.col("lat").cast("double")
    at = lambda a, b: F.round(vector.haversine(lon, lat, lon + a, lat + b), 3)
    return _stations(spark, d).select("id", at(0.5, 0.5).alias("ds"), at(0.5, 0.0).alias("dx"), at(0.0, 0.5).alias("dy"))


@query(f"WITH {_ST}, p AS (SELECT region, id, lon AS x, lat AS y FROM st) SELECT region, count(*) AS points, CAST(arg_min(x, id) AS BIGINT) AS first_x, CAST(arg_max(y, id) AS BIGINT) AS last_y FROM p GROUP BY region HAVING count(*) > 1")
def station_lines(spark, d):
    """Stations of a region, in order, as one line."""
    p = _stations(spark, d).select("region", "id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    x = vector.lines(p, "region", "id")
    return x.select("region", F.size("points").cast("long").alias("points"), F.col("points")[0]["x"].alias("first_x"), F.element_at("points", -1)["y"].alias("last_y"))


@query("SELECT doc_id, n_chars % 7 AS a, n_chars % 11 AS b FROM documents")
def coordinate_lists(spark, d):
    """Coordinate lists through their text form and back."""
    t = table(spark, d, "documents").select("doc_id", F.concat(F.lit("[("), F.col("n_chars") % 7, F.lit(", "), F.col("n_chars") % 11, F.lit(")]")).alias("t"))
    x = t.withColumn("x", names.coordinate_list(F.col("t")))
    return x.select("doc_id", F.col("x")[0][0].cast("long").alias("a"), F.col("x")[0][1].cast("long").alias("b"))


@query("SELECT 'customer' AS layer, c_custkey AS id FROM customer UNION ALL SELECT 'supplier', s_suppkey FROM supplier")
def layer_union(spark, d):
    a = table(spark, d, "customer").select(F.lit("customer").alias("layer"), F.col("c_custkey").alias("id"))
    return a.unionByName(table(spark, d, "supplier").select(F.lit("supplier").alias("layer"), F.col("s_suppkey").alias("id")))


@query("WITH RECURSIVE e AS (SELECT c_custkey AS up_id, c_custkey // 2 AS down_id, CAST(abs(c_acctbal) AS DECIMAL(18,2)) AS area FROM customer), w AS (SELECT up_id AS id, down_id AS seed FROM e UNION SELECT w.id, e.down_id FROM w JOIN e ON e.up_id = w.seed) SELECT c.up_id AS basin, CAST(c.area + coalesce(sum(u.area), 0) AS DOUBLE) AS total FROM e c LEFT JOIN (SELECT seed, area FROM w JOIN e ON e.up_id = w.id WHERE seed <> w.id) u ON u.seed = c.up_id GROUP BY c.up_id, c.area")
def upstream_area(spark, d):
    """Area of each basin with all basins above it."""
    e = table(spark, d, "customer").select(F.col("c_custkey").alias("up_id"), F.floor(F.col("c_custkey") / 2).alias("down_id"), F.abs("c_acctbal").cast("decimal(18,2)").alias("area"))
    above = upstream(e, e.select(F.col("up_id").alias("id"))).join(e.select(F.col("up_id").alias("id"), "area"), "id").groupBy(F.col("seed").alias("up_id")).agg(F.sum("area").alias("more"))
    total = F.col("area") + F.coalesce("more", F.lit(0).cast("decimal(28,2)"))
    return e.join(above, "up_id", "left").select(F.col("up_id").alias("basin"), total.cast("double").alias("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM events WHERE value BETWEEN 0 AND 20 GROUP BY ALL")
def gauge_windows(spark, d):
    """The statistics that the stream gives, over the whole table at once."""
    return window_levels(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
