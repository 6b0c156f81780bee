"""Daily features, forecast bias and missingness, none of which sees the future."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def calendar(date: Column) -> dict[str, Column]:
    doy = F.dayofyear(date)
    return {
        "doy_sin": F.sin(2 * F.pi() * doy / 365.25), "doy_cos": F.cos(2 * F.pi() * doy / 365.25), "month": F.month(date).cast("long"), "dow": F.weekday(date).cast("long"),
        "is_heating_season": F.month(date).isin(10, 11, 12, 1, 2, 3).cast("long"),
    }


def local_lags(df: DataFrame, target: str = "target", lags: tuple[int, ...] = (1, 2, 7), means: tuple[int, ...] = (7, 30)) -> DataFrame:
    """Row lags by station, the change from lag 2 to lag 1, and rolling means of lag 1 (null under a third of the rows)."""
    w = Window.partitionBy("station_id").orderBy("date")
    out = df.withColumns({f"lag_{k}": F.lag(target, k).over(w) for k in lags}).withColumn("delta", F.col("lag_1") - F.col("lag_2"))
    for n in means:
        over = w.rowsBetween(-(n - 1), 0)
        out = out.withColumn(f"mean_{n}", F.when(F.count("lag_1").over(over) >= max(2, n // 3), F.avg("lag_1").over(over)))
    return out


def neighbours(df: DataFrame, held_out: str | None = None, target: str = "target") -> DataFrame:
    """(station_id, date, nb_mean, nb_n): mean of the other stations that day, none of the held-out city.

    From sums by date, so no day's stations are paired.
    """
    usable = F.when(F.lit(True) if held_out is None else F.col("city") != held_out, F.col(target))
    day = Window.partitionBy("date")
    s, n = F.sum(usable).over(day) - F.coalesce(usable, F.lit(0.0)), F.count(usable).over(day) - usable.isNotNull().cast("int")
    return df.withColumns({"nb_n": n, "nb_mean": F.when(n > 0, s / n)}).select("station_id", "date", "nb_mean", "nb_n")


def station_bias(df: DataFrame, train_end: str, least: int = 30) -> DataFrame:
    """(station_id, bias, n): mean forecast less observation in the training block; stations of enough rows."""
    t = df.where((F.col("date") <= F.lit(train_end).cast("date")) & F.col("target").isNotNull() & F.col("forecast").isNotNull())
    return t.groupBy("station_id").agg(F.avg(F.col("forecast") - F.col("target")).alias("bias"), F.count("*").alias("n")).where(F.col("n") >= least)


def debias_local(df: DataFrame, bias: DataFrame) -> DataFrame:
    """debiased: less the station's bias, or the mean of all stations' for one without."""
    pooled = bias.agg(F.coalesce(F.avg("bias"), F.lit(0.0)).alias("_pooled"))
    return df.join(bias.select("station_id", "bias"), "station_id", "left").crossJoin(F.broadcast(pooled)).withColumn("debiased", F.col("forecast") - F.coalesce("bias", "_pooled")).drop("_pooled")


def pooled_bias(bias: DataFrame, stations: DataFrame) -> DataFrame:
    """(held_out_city, pooled): the mean of the biases of the other cities' stations."""
    cities = stations.select(F.col("city").alias("held_out_city")).distinct()
    other = bias.join(stations, "station_id").crossJoin(cities).where("city <> held_out_city")
    return cities.join(other.groupBy("held_out_city").agg(F.avg("bias").alias("pooled")), "held_out_city", "left").fillna(0.0, ["pooled"])


def missingness(df: DataFrame, column: str, keys: list[str], target: str = "target") -> DataFrame:
    """How often a column has a value, and how the target differs where it has none."""
    has = F.col(column).isNotNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n"), (100 * F.avg(has.cast("int"))).alias("pct"), (F.median(F.when(~has, F.col(target))) - F.median(F.when(has, F.col(target)))).alias("d_median"))


def forecast_at(rows: DataFrame, lead_h: int = 24) -> DataFrame:
    """The forecasts of one lead, by the time they hold for: rows (issued, lead_h, ...) with valid = issued + lead_h.

    A lead of 0 is no forecast: it holds what was observed.
    """
    if lead_h <= 0:
        raise ValueError("a lead of 0 looks ahead")
    return rows.where(F.col("lead_h") == lead_h).withColumn("valid", F.col("issued") + F.make_dt_interval(hours=F.col("lead_h")))
