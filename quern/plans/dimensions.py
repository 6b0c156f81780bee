"""Queries on places, grids, folds and feature descriptions, all taken from the given tables.

Suppliers are sites, nations their cities; a nation's centre is a station of its region. Parts describe features, customers are
cells of grids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions.geo import haversine
from quern.operators import nowcast as nc, rasters, specs, splits
from quern.plans.hourly import DISTANCES, HAVERSINE, PLACES, places, r
from quern.plans.registry import PANEL, query
from quern.sources import sinks, tables as src

SITES = """sites AS (SELECT 's' || s_suppkey AS station_id, 'n' || s_nationkey AS city, 37 + (s_suppkey * 37 % 1500) * CAST(0.01 AS DOUBLE) AS latitude, 55 + (s_suppkey * 53 % 2200) * CAST(0.01 AS DOUBLE) AS longitude FROM supplier),
centres AS (SELECT n_name AS station_id, 'r' || n_regionkey AS city, avg(latitude) AS latitude, avg(longitude) AS longitude FROM sites JOIN nation ON sites.city = 'n' || n_nationkey GROUP BY 1, 2)"""


def sites(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return src.table(spark, sf, "supplier").select(F.concat(F.lit("s"), k).alias("station_id"), F.concat(F.lit("n"), "s_nationkey").alias("city"), (37 + (k * 37 % 1500) * 0.01).alias("latitude"), (55 + (k * 53 % 2200) * 0.01).alias("longitude"))


def centres(spark: SparkSession, sf: str) -> DataFrame:
    n = src.table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("city"), F.col("n_name").alias("station_id"), F.concat(F.lit("r"), "n_regionkey").alias("region"))
    return sites(spark, sf).drop("station_id").join(n, "city").groupBy("station_id", F.col("region").alias("city")).agg(F.avg("latitude").alias("latitude"), F.avg("longitude").alias("longitude"))


# --- places ---


@query(f"WITH {SITES} SELECT max(latitude) + 0.5 AS north, min(longitude) - 0.5 AS west, min(latitude) - 0.5 AS south, max(longitude) + 0.5 AS east FROM sites")
def station_bbox(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.bounding_box(sites(spark, sf))


@query(f"WITH {SITES} SELECT a.station_id, b.station_id AS donor, round({HAVERSINE.format(r=6371.0088, a='a', b='b')}, 4) AS km FROM centres a JOIN centres b ON a.station_id <> b.station_id")
def pairwise_distance(spark: SparkSession, sf: str) -> DataFrame:
    return nc.distances(centres(spark, sf)).select("station_id", "donor", r("km", 4))


#: Reference points (degrees).
POINTS = [("p0", 45.20, 59.00), ("p1", 44.60, 58.80), ("p2", 44.30, 59.60), ("p3", 44.90, 60.20), ("p4", 43.90, 59.20), ("p5", 45.60, 60.50)]
SQL_POINTS = "points AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in POINTS) + ") v(point, latitude, longitude))"


@query(f"WITH {SITES}, {SQL_POINTS} SELECT s.station_id, round(min({HAVERSINE.format(r=6371.0088, a='s', b='p')}), 2) AS km, arg_min(point, {HAVERSINE.format(r=6371.0088, a='s', b='p')}) AS nearest FROM sites s CROSS JOIN points p GROUP BY 1")
def distance_to_reference_points(spark: SparkSession, sf: str) -> DataFrame:
    each = F.array(*[F.struct(haversine(F.col("latitude"), F.col("longitude"), F.lit(a), F.lit(b)).alias("km"), F.lit(n).alias("point")) for n, a, b in POINTS])
    return sites(spark, sf).withColumn("p", F.array_min(each)).select("station_id", F.round("p.km", 2).alias("km"), F.col("p.point").alias("nearest"))


# --- grids ---

#: A grid's axes, latitudes from the north on, as such files have them.
LATITUDES = [round(54.8 - 0.4 * i, 4) for i in range(60)]
LONGITUDES = [round(52.2 + 0.4 * i, 4) for i in range(80)]


def _nearest_sql(axis: list[float], value: str) -> str:
    return f"(SELECT arg_min(x, (abs(x - {value}), i)) FROM (SELECT unnest({axis}::DOUBLE[]) AS x, unnest(range({len(axis)})) AS i))"


CELL = f"{SITES}, cell AS (SELECT station_id, {_nearest_sql(LATITUDES, 'latitude')} AS cell_lat, {_nearest_sql(LONGITUDES, 'longitude')} AS cell_lon, latitude, longitude FROM sites)"


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """Each site's nearest cell, on each axis for itself."""
    return sites(spark, sf).withColumns({"cell_lat": rasters.nearest_on(LATITUDES, F.col("latitude")), "cell_lon": rasters.nearest_on(LONGITUDES, F.col("longitude"))})


@query(f"WITH {CELL} SELECT station_id, round(cell_lat, 4) AS cell_lat, round(cell_lon, 4) AS cell_lon, round(111 * sqrt(pow(latitude - cell_lat, 2) + pow((longitude - cell_lon) * cos(radians(latitude)), 2)), 4) AS offset_km FROM cell")
def nearest_grid_cell(spark: SparkSession, sf: str) -> DataFrame:
    off = 111 * F.sqrt(F.pow(F.col("latitude") - F.col("cell_lat"), 2) + F.pow((F.col("longitude") - F.col("cell_lon")) * F.cos(F.radians("latitude")), 2))
    return cells(spark, sf).select("station_id", r("cell_lat", 4), r("cell_lon", 4), F.round(off, 4).alias("offset_km"))


@query(f"WITH {CELL} SELECT round(cell_lat, 4) AS cell_lat, round(cell_lon, 4) AS cell_lon, count(*) AS n, string_agg(station_id, ',' ORDER BY station_id) AS stations FROM cell GROUP BY 1, 2 HAVING count(*) > 1")
def cell_collisions(spark: SparkSession, sf: str) -> DataFrame:
    by = cells(spark, sf).groupBy(r("cell_lat", 4), r("cell_lon", 4)).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("station_id")), ",").alias("stations"))
    return by.where("n > 1")


@query(
    f"""WITH {CELL}, grid AS (SELECT CAST(54.8 - 0.4 * (c_custkey % 60) AS DOUBLE) AS glat, CAST(52.2 + 0.4 * (c_custkey * 7 % 80) AS DOUBLE) AS glon, c_custkey % 3 AS time, avg(c_acctbal) * 1e-9 AS value FROM customer GROUP BY ALL)
SELECT station_id, CAST(time AS INT) AS time, round(value * 1e9, 4) AS value FROM cell LEFT JOIN grid ON round(glat, 4) = round(cell_lat, 4) AND round(glon, 4) = round(cell_lon, 4)"""
)
def point_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Sites' cells of a gridded field in kg per m³, in µg; cells that the field hasn't stay null."""
    k = F.col("c_custkey")
    axis = lambda values, i: F.get(F.array(*map(F.lit, values)), i.cast("int"))
    field = src.table(spark, sf, "customer").groupBy(axis(LATITUDES, k % 60).alias("cell_lat"), axis(LONGITUDES, k * 7 % 80).alias("cell_lon"), (k % 3).cast("int").alias("time")).agg((F.avg("c_acctbal") * 1e-9).alias("value"))
    return rasters.extract_points(field, cells(spark, sf), "value", 1e9).select("station_id", "time", F.round("value", 4).alias("value"))


@query(f"WITH {DISTANCES}, {PLACES} SELECT s.station_id, round(avg(p.id) FILTER (WHERE {HAVERSINE.format(r=6371.0088, a='s', b='p')} > 100 AND {HAVERSINE.format(r=6371.0088, a='s', b='p')} <= 500), 5) AS mean, count(*) FILTER (WHERE {HAVERSINE.format(r=6371.0088, a='s', b='p')} > 100 AND {HAVERSINE.format(r=6371.0088, a='s', b='p')} <= 500) AS n FROM stations s CROSS JOIN places p GROUP BY 1")
def annulus_mean(spark: SparkSession, sf: str) -> DataFrame:
    return rasters.ring_mean(src.stations(spark), places(spark, sf), 100, 500, "id").select("station_id", r("mean"), "n")


CUSTOMER_CELLS = "cc AS (SELECT c_custkey AS id, c_acctbal AS value, c_custkey % 4 AS epoch, 36 + (c_custkey * 29 % 1700) * CAST(0.01 AS DOUBLE) AS latitude, 54 + (c_custkey * 31 % 2400) * CAST(0.01 AS DOUBLE) AS longitude FROM customer)"
KM = HAVERSINE.format(r=6371.0088, a="s", b="c")
OUTER = [150.0, 300.0, 500.0]
OFF = 1.3e-6  # means of cents end halfway between two roundings; off it they are rounded alike everywhere


def customer_cells(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return src.table(spark, sf, "customer").select(k.alias("id"), F.col("c_acctbal").alias("value"), (k % 4).alias("epoch"), (36 + (k * 29 % 1700) * 0.01).alias("latitude"), (54 + (k * 31 % 2400) * 0.01).alias("longitude"))


@query(
    f"""WITH {SITES}, {CUSTOMER_CELLS}, met AS (SELECT s.station_id, c.*, {KM} AS km FROM sites s JOIN cc c ON {KM} <= 500),
ground AS (SELECT station_id, avg(value) FILTER (WHERE km <= 120) AS elevation, {", ".join(f"avg(value) FILTER (WHERE km > 50 AND km <= {o}) AS annulus_{o:g}km" for o in OUTER)} FROM met GROUP BY 1),
people AS (SELECT station_id, avg(value) * 100 AS population FROM met WHERE epoch = 2 AND km <= 120 GROUP BY 1),
lights AS (SELECT station_id, avg(o_totalprice) AS lights FROM met JOIN orders ON o_custkey = id WHERE km <= 120 AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' GROUP BY 1)
SELECT station_id, round(elevation + {OFF}, 4) AS elevation, {", ".join(f"round(annulus_{o:g}km + {OFF}, 4) AS annulus_{o:g}km, round(elevation - annulus_{o:g}km + {OFF}, 4) AS basin_{o:g}km" for o in OUTER)}, round(population + {OFF}, 4) AS population, round(lights + {OFF}, 4) AS lights
FROM ground JOIN people USING (station_id) JOIN lights USING (station_id) WHERE elevation IS NOT NULL AND {" AND ".join(f"annulus_{o:g}km IS NOT NULL" for o in OUTER)}"""
)
def static_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Three rings around each site in one scan, one epoch of counts as a density, lights of the training window only."""
    cc = customer_cells(spark, sf)
    orders = src.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("lit"))
    lights = cc.select("id", "latitude", "longitude").join(orders, "id").select("latitude", "longitude", "date", F.col("lit").alias("value"))
    train = next((b, e) for name, b, e in splits.DAILY_BLOCKS if name == "train")
    out = rasters.static_features(sites(spark, sf).drop("city"), cc.drop("epoch"), cc, lights, 2, train, 120.0, 50.0, OUTER)
    return out.select("station_id", *[F.round(F.col(c) + OFF, 4).alias(c) for c in out.columns[1:]])


# --- splits ---


@query(f"WITH {SITES}, f AS (SELECT city, CAST(row_number() OVER (ORDER BY city) - 1 AS INT) AS fold FROM (SELECT DISTINCT city FROM centres)) SELECT fold, f.city AS held_out_city, station_id, CASE WHEN centres.city = f.city THEN 'test' ELSE 'train' END AS role FROM f CROSS JOIN centres")
def loco_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leave_city_out(centres(spark, sf))


@query(f"WITH {SITES} SELECT city, station_id, count(*) OVER (PARTITION BY city) AS n_in_city, count(*) OVER (PARTITION BY city) >= 2 AS eligible FROM sites")
def lso_folds(spark: SparkSession, sf: str) -> DataFrame:
    return splits.leave_station_out(sites(spark, sf))


@query(
    f"""WITH {SITES}, f AS (SELECT city, CAST(row_number() OVER (ORDER BY city) - 1 AS INT) AS fold FROM (SELECT DISTINCT city FROM centres)),
j AS (SELECT '{{"fold":' || fold || ',"held_out_city":"' || f.city || '","role":"' || CASE WHEN centres.city = f.city THEN 'test' ELSE 'train' END || '","station_id":"' || station_id || '"}}' AS j FROM f CROSS JOIN centres)
SELECT sha256(string_agg(j, ',' ORDER BY j)) AS sha256 FROM j"""
)
def splits_digest(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of the folds as canonical JSON: sorted rows, one text."""
    rows = splits.leave_city_out(centres(spark, sf)).select(F.to_json(F.struct("fold", "held_out_city", "role", "station_id")).alias("j"))
    return rows.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("j")), ","), 256).alias("sha256"))  # a few rows for each station


@query(f"WITH {PANEL} SELECT b AS block, CAST(date_diff('hour', x, y) AS BIGINT) AS hours, count(DISTINCT ts) AS n_hours, count(value) AS n FROM panel JOIN blocks ON ts BETWEEN x AND y GROUP BY ALL")
def block_hours(spark: SparkSession, sf: str) -> DataFrame:
    """A block's length, from its first to its last hour, and the hours and values that the panel has in it."""
    b = splits.blocks(spark)
    length = ((F.unix_timestamp(F.col("end").cast("timestamp")) - F.unix_timestamp(F.col("begin").cast("timestamp"))) / 3600).cast("long")
    held = src.hourly_panel(spark, sf).join(F.broadcast(b), F.col("ts").between(F.col("begin"), F.col("end")))  # three rows
    return held.groupBy("block", length.alias("hours")).agg(F.countDistinct("ts").alias("n_hours"), F.count("value").alias("n"))


@query(
    f"""WITH {PANEL}, held AS (SELECT b AS name, strftime(x, '%Y-%m-%d %H:%M') AS begin_at, strftime(y, '%Y-%m-%d %H:%M') AS end_at, count(DISTINCT ts) AS hours, count(value) AS n FROM panel JOIN blocks ON ts BETWEEN x AND y GROUP BY ALL) SELECT name, begin_at, end_at, hours, n, true AS unchanged FROM held"""
)
def frozen_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The splits document, made from the panel and the centres, frozen, frozen again without a change, and read back."""
    path = sinks.new_path(spark, "splits")
    document = splits.document(src.hourly_panel(spark, sf), centres(spark, sf))
    first = sinks.freeze(spark, document, path, "2024-02-01T00:00:00Z")
    again = sinks.freeze(spark, splits.document(src.hourly_panel(spark, sf).repartition(3), centres(spark, sf)), path, "2030-01-01T00:00:00Z")
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", "blocks map<string,struct<begin:string,end:string,hours:long,n:long>>").alias("d"))
    blocks = text.select(F.explode("d.blocks").alias("name", "b"))
    return blocks.select("name", F.col("b.begin").alias("begin_at"), F.col("b.end").alias("end_at"), "b.hours", "b.n", F.lit(first == again).alias("unchanged"))


# --- feature descriptions ---

SPECS = """specs AS (SELECT p_brand || ' ' || p_type AS set_name, 'f' || p_partkey AS name, CASE p_size % 5 WHEN 0 THEN 'derived' WHEN 1 THEN 'gee' WHEN 2 THEN 'ads' WHEN 3 THEN 'lance' ELSE 'cds' END AS source, p_partkey % 2 = 0 AS available_at_runtime,
 CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS DOUBLE) END AS latency_hours, p_partkey % 4 <> 0 AS has_reduction, p_size % 7 = 0 AS requires_raster, p_partkey % 5 <> 0 AS verified, CASE p_size % 3 WHEN 0 THEN 'KEY_A' WHEN 1 THEN 'KEY_B' ELSE '' END AS credential, p_type = 'ECONOMY' AS deployable FROM part)"""


def feature_specs(spark: SparkSession, sf: str) -> DataFrame:
    """Descriptions, right and wrong ones, a row for each part; a set for each brand and type."""
    k, size = F.col("p_partkey"), F.col("p_size")
    source = F.get(F.array(*map(F.lit, ("derived", "gee", "ads", "lance", "cds"))), (size % 5).cast("int"))
    credential = F.when(size % 3 == 0, "KEY_A").when(size % 3 == 1, "KEY_B").otherwise("")
    return src.table(spark, sf, "part").select(
        F.concat_ws(" ", "p_brand", "p_type").alias("set_name"), F.concat(F.lit("f"), k).alias("name"), source.alias("source"), (k % 2 == 0).alias("available_at_runtime"),
        F.when(k % 3 != 0, size.cast("double")).alias("latency_hours"), (k % 4 != 0).alias("has_reduction"), (size % 7 == 0).alias("requires_raster"), (k % 5 != 0).alias("verified"),
        credential.alias("credential"), (F.col("p_type") == "ECONOMY").alias("deployable"),
    )


@query(f"WITH {SPECS} SELECT name, concat_ws('; ', CASE WHEN available_at_runtime AND latency_hours IS NULL THEN 'available without a latency' END, CASE WHEN NOT available_at_runtime AND latency_hours IS NOT NULL THEN 'latency without availability' END, CASE WHEN NOT has_reduction AND source <> 'derived' AND NOT requires_raster THEN 'gridded without a reduction' END) AS problems FROM specs")
def feature_spec_problems(spark: SparkSession, sf: str) -> DataFrame:
    return specs.spec_problems(feature_specs(spark, sf)).select("name", F.array_join("problems", "; ").alias("problems"))


@query(f"WITH {SPECS} SELECT set_name, count(*) AS n, bool_or(deployable) AS deployable, coalesce(max(latency_hours), 0.0)::DOUBLE AS max_latency_hours, coalesce(string_agg(DISTINCT nullif(credential, ''), ',' ORDER BY nullif(credential, '')), '') AS credentials, count(*) FILTER (WHERE requires_raster) AS n_raster, count(*) FILTER (WHERE NOT verified) AS n_unverified, coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE NOT available_at_runtime), '') AS oracle_features, NOT bool_or(deployable) OR count(*) FILTER (WHERE NOT available_at_runtime) = 0 AS valid FROM specs GROUP BY 1")
def feature_set_summary(spark: SparkSession, sf: str) -> DataFrame:
    return specs.set_summary(feature_specs(spark, sf))


SAID = "said AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN p_size || ' km' WHEN 1 THEN '~1KM grid' WHEN 2 THEN p_size * 100 || ' m' WHEN 3 THEN '375 m at nadir' WHEN 4 THEN p_size || '0 m' WHEN 5 THEN '0.' || p_size || ' degrees' END AS said FROM part)"


@query(f"WITH {SAID} SELECT p_partkey, said, CASE WHEN lower(said) LIKE '%1 km%' OR lower(said) LIKE '%1km%' THEN 1000 WHEN lower(said) LIKE '%500 m%' THEN 500 WHEN lower(said) LIKE '%375 m%' THEN 375 WHEN lower(said) LIKE '%100 m%' THEN 100 WHEN lower(said) LIKE '%30 m%' THEN 30 WHEN lower(said) LIKE '%km%' THEN 7000 ELSE 1000 END AS metres FROM said")
def native_scale(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    forms = [F.concat(size, F.lit(" km")), F.lit("~1KM grid"), F.concat(size * 100, F.lit(" m")), F.lit("375 m at nadir"), F.concat(size, F.lit("0 m")), F.concat(F.lit("0."), size, F.lit(" degrees")), F.lit(None).cast("string")]
    return src.table(spark, sf, "part").withColumn("said", F.get(F.array(*forms), (k % 7).cast("int"))).select("p_partkey", "said", specs.native_scale_m(F.col("said")).alias("metres"))
