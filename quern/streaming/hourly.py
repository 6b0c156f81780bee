"""The hourly means and the deduplication of readings as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def hourly_means(readings: DataFrame, late: str = "2 hours") -> DataFrame:
    """(station_id, ts, value, n) of each closed hour; readings later than `late` are left out.

    readings: a stream of (station_id, ts timestamp, reading_id, value); one with the same id counts once.
    """
    once = readings.withWatermark("ts", late).dropDuplicatesWithinWatermark(["reading_id"])
    by = once.groupBy("station_id", F.window("ts", "1 hour")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return by.select("station_id", F.col("window.start").alias("ts"), "value", "n")
