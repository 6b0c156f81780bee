"""Typed sources, and the adapters that give station data from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The stations' cities, coordinates (degrees) and time zone.
STATIONS = [
    ("s0", "c0", 41.3255, 69.2947), ("s1", "c1", 43.2380, 76.9450), ("s2", "c2", 37.9340, 58.3860), ("s3", "c3", 38.5730, 68.7860),
    ("s4", "c3", 38.5600, 68.7800), ("s5", "c4", 42.8560, 74.6010), ("s6", "c4", 42.8890, 74.6120), ("s7", "c5", 51.1605, 71.4704),
]
ZONE = "Asia/Tashkent"

#: A location record of the ingestion source; unknown fields are ignored.
LOCATION = (
    "id:bigint, name:string, locality:string, timezone:string, country:struct<id:int,code:string,name:string>, provider:struct<id:int,name:string>,"
    "isMobile:boolean, isMonitor:boolean, sensors:array<struct<id:bigint,name:string,parameter:struct<id:int,name:string,units:string>>>,"
    "coordinates:struct<latitude:double,longitude:double>, datetimeFirst:struct<utc:string>, datetimeLast:struct<utc:string>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a given schema; NaN and blanks are null."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return no_nans(df)


#: Columns of a satellite table that are no measurement.
NOT_VALUES = ("station_id", "ts", "date", "valid_pixels", "n_pixels", "fixture", "city")


def satellite(df: DataFrame) -> DataFrame:
    """(station_id, date, value, valid_px) from a table whose one measurement has any name: the first column that isn't an id, a
    time or a count. Ids become text, times dates; NaN is null.
    """
    names = [c for c in df.columns if c not in NOT_VALUES]
    if not names:
        raise ValueError(f"no column of {df.columns} is a measurement")
    when = "ts" if "ts" in df.columns else "date"
    pixels = F.col("valid_pixels").cast("long") if "valid_pixels" in df.columns else F.lit(None).cast("long")
    return no_nans(df.select(F.col("station_id").cast("string").alias("station_id"), F.to_date(when).alias("date"), F.col(names[0]).cast("double").alias("value"), pixels.alias("valid_px")))


def no_nans(df: DataFrame) -> DataFrame:
    """Null is the only mark of a missing value."""
    return df.withColumns({f.name: F.nanvl(f.name, F.lit(None).cast(f.dataType)) for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))})


def locations(spark: SparkSession, path: str) -> DataFrame:
    """Census rows from documents that hold records under `results`."""
    return location_rows(spark.read.schema(f"results array<struct<{LOCATION}>>").option("multiLine", True).json(path).select(F.explode("results").alias("r")))


def location_rows(records: DataFrame) -> DataFrame:
    """Census rows from location records, a struct r of LOCATION each."""
    pm = F.filter("r.sensors", lambda s: s["parameter"]["name"] == "pm25")
    first, last = F.try_to_timestamp(F.col("r.datetimeFirst.utc")), F.try_to_timestamp(F.col("r.datetimeLast.utc"))
    days = (F.unix_timestamp(last) - F.unix_timestamp(first)) / 86400
    return records.select(
        F.col("r.id").cast("string").alias("location_id"), "r.name", "r.locality", F.col("r.country.code").alias("country"), "r.coordinates.latitude", "r.coordinates.longitude",
        "r.timezone", F.col("r.isMonitor").alias("is_monitor"), F.col("r.isMobile").alias("is_mobile"), F.col("r.provider.name").alias("provider"), F.size(pm).alias("n_pm25_sensors"),
        F.array_join(F.transform(pm, lambda s: s["id"].cast("string")), ",").alias("pm25_sensor_ids"), first.alias("datetime_first"), last.alias("datetime_last"), days.alias("span_days"), (days / 365.25).alias("span_years"),
    )


def stations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(STATIONS, "station_id string, city string, latitude double, longitude double")


def hourly_obs(events: DataFrame) -> DataFrame:
    """(station_id, ts, value): hourly means of eight stations."""
    station = F.concat(F.lit("s"), F.col("user_id") % 8)
    return events.groupBy(station.alias("station_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("value"))


def hourly_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stations' complete hourly grid; gaps are rows with a null value."""
    from quern.operators.grid import regrid_hourly

    return regrid_hourly(hourly_obs(table(spark, sf_dir, "events")))


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(station_id, city, date, target, n, aod, valid_px, forecast): one row for each nation and ship date."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    customer, nation = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("k")), table(spark, sf_dir, "nation")
    buyers = orders.join(customer, orders.o_custkey == customer.c_custkey).select("l_orderkey", "k")  # first, so that lines move once
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), "l_quantity", "l_extendedprice", "l_tax", (F.col("l_returnflag") == "R").alias("returned"))
    by = line.join(buyers, "l_orderkey").groupBy("k", "date").agg(
        F.avg("l_quantity").alias("target"), F.count("*").alias("n"), F.avg(F.when(F.col("returned"), F.col("l_tax"))).alias("aod"),
        F.count_if("returned").alias("valid_px"), (F.avg("l_extendedprice") / 1500).alias("forecast"),
    )
    names = nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("station_id"), F.concat(F.lit("r"), "n_regionkey").alias("city"))
    return by.join(names, "k").drop("k")
