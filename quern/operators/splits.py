"""Frozen time blocks with purge gaps, and folds by city and station."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Closed blocks of the hourly and the daily panel. What lies between is purged.
HOURLY_BLOCKS = [("train", "2024-01-01 00:00", "2024-01-12 23:00"), ("val", "2024-01-17 00:00", "2024-01-19 23:00"), ("test", "2024-01-24 00:00", "2024-01-30 23:00")]
DAILY_BLOCKS = [("train", "1995-01-01", "1998-12-31"), ("val", "1999-01-11", "1999-12-31"), ("test", "2000-01-11", "2000-12-31")]


def blocks(spark, rows=HOURLY_BLOCKS) -> DataFrame:
    df = spark.createDataFrame(rows, "block string, begin string, end string")
    return df.select("block", F.col("begin").cast("timestamp_ntz").alias("begin"), F.col("end").cast("timestamp_ntz").alias("end"))


def block_of(ts, rows=HOURLY_BLOCKS):
    """Name of the block that a time lies in; purge for the gaps between, null outside of all."""
    out = F.when(ts.between(F.lit(rows[0][1]).cast("timestamp_ntz"), F.lit(rows[-1][2]).cast("timestamp_ntz")), F.lit("purge"))
    name = F.lit(None).cast("string")
    for block, begin, end in rows:
        name = F.when(ts.between(F.lit(begin).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")), F.lit(block)).otherwise(name)
    return F.coalesce(name, out)


def block_bounds(panel: DataFrame, max_lag_h: int, horizon_h: int) -> DataFrame:
    """One row: the hours in which any station has a value, floored, and the purge that lags and horizon need."""
    return panel.where("value is not null").agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("first_ts"), F.date_trunc("hour", F.max("ts")).cast("timestamp_ntz").alias("last_ts")).withColumn("purge_hours", F.lit(max_lag_h + horizon_h))


def leave_city_out(stations: DataFrame) -> DataFrame:
    """(fold, held_out_city, station_id, role): every station in every city's fold."""
    folds = stations.select("city").distinct().select((F.row_number().over(Window.orderBy("city")) - 1).alias("fold"), F.col("city").alias("held_out_city"))
    return folds.crossJoin(stations.select("station_id", "city")).select("fold", "held_out_city", "station_id", F.when(F.col("city") == F.col("held_out_city"), "test").otherwise("train").alias("role"))


def leave_station_out(stations: DataFrame) -> DataFrame:
    """(city, station_id, n_in_city, eligible): a station can be left out if its city has another."""
    n = F.count("*").over(Window.partitionBy("city"))
    return stations.select("city", "station_id", n.alias("n_in_city"), (n >= 2).alias("eligible"))


def document(panel: DataFrame, stations: DataFrame, rows=HOURLY_BLOCKS, max_lag_h: int = 72, horizon_h: int = 24) -> dict:
    """The splits as one document: what the panel spans, its blocks with the hours and values they hold, folds and the purge.

    A few rows for each station and block; a block that the panel doesn't reach into is an error.
    """
    spark = panel.sparkSession
    span = block_bounds(panel, max_lag_h, horizon_h).first()
    held = {r["block"]: r for r in panel.join(F.broadcast(blocks(spark, rows)), F.col("ts").between(F.col("begin"), F.col("end"))).groupBy("block").agg(F.countDistinct("ts").alias("hours"), F.count("value").alias("n")).collect()}
    for name, _, _ in rows:
        if name not in held or not held[name]["n"]:
            raise ValueError(f"the panel has no value in block {name}")
    folds: dict[str, list[str]] = {}
    for r in leave_city_out(stations).where("role = 'test'").orderBy("held_out_city", "station_id").collect():
        folds.setdefault(r["held_out_city"], []).append(r["station_id"])
    alone = sorted(r["station_id"] for r in leave_station_out(stations).where("not eligible").collect())
    return {
        "span": [str(span["first_ts"]), str(span["last_ts"])], "purge_hours": span["purge_hours"],
        "blocks": {name: {"begin": begin, "end": end, "hours": held[name]["hours"], "n": held[name]["n"]} for name, begin, end in rows},
        "leave_city_out": [{"fold": i, "held_out_city": c, "test": ids} for i, (c, ids) in enumerate(folds.items())],
        "leave_station_out": {"ineligible": alone},
    }
