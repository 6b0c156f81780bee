"""Forecasting baselines on a complete hourly grid. Times are lags in hours, never in rows that exist."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F


def _by_time() -> Window:
    return Window.partitionBy("station_id").orderBy("ts")


def persistence(panel: DataFrame, hours: int) -> DataFrame:
    """pred: the value exactly so many hours before, else null."""
    return panel.withColumn("pred", F.lag("value", hours).over(_by_time()))


def persistence_asof(panel: DataFrame, hours: int) -> DataFrame:
    """pred: the last value known at the origin, so many hours before."""
    w = _by_time()
    known = panel.withColumn("_k", F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return known.withColumn("pred", F.lag("_k", hours).over(w)).drop("_k")


def diurnal_persistence(panel: DataFrame, hours: int) -> DataFrame:
    """pred: the last value known whole days before the target, at or before the origin."""
    return persistence_asof(panel, 24 * math.ceil(hours / 24))


def same_hour(panel: DataFrame, hours: int, days: int, how: str = "mean") -> DataFrame:
    """pred: mean or median of the values at hours, hours + 24, ... before; nulls don't count."""
    shifts = F.array_compact(F.array(*[F.lag("value", hours + 24 * k).over(_by_time()) for k in range(days)]))
    n, s = F.size("_s"), F.array_sort("_s")
    mean = F.aggregate("_s", F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    median = F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    return panel.withColumn("_s", shifts).withColumn("pred", mean if how == "mean" else median).drop("_s")


def same_hour_last(panel: DataFrame, hours: int, n: int) -> DataFrame:
    """pred: mean of the last n values there are at the target's hour of day, up to the origin."""
    at_hour = Window.partitionBy("station_id", F.hour("ts")).orderBy("ts")
    days = math.ceil(hours / 24)
    # Each known row has its last n; a row then takes over the list of the last known row, so no row holds its whole history.
    lists = F.array_compact(F.array(*[F.lag("value", k).over(at_hour) for k in range(n)]))
    known = panel.where("value is not null").select("station_id", "ts", lists.alias("_l"))
    rows = panel.join(known, ["station_id", "ts"], "left")
    rows = rows.withColumn("_last", F.last("_l", True).over(at_hour.rowsBetween(Window.unboundedPreceding, -days)))
    return rows.withColumn("pred", F.aggregate("_last", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size("_last"), F.lit(0))).drop("_l", "_last")


def climatology_cells(train: DataFrame, least: int = 1) -> DataFrame:
    """(station_id, level, month, hour, mean, median, n) of month and hour, hour, month and all, in one scan. UTC cells."""
    t = train.where("value is not null").select("station_id", F.month("ts").alias("month"), F.hour("ts").alias("hour"), "value")
    return t.sparkSession.sql(
        "SELECT station_id, CASE grouping_id(station_id, month, hour) WHEN 0 THEN 'month_hour' WHEN 2 THEN 'hour' WHEN 1 THEN 'month' ELSE 'global' END AS level, month, hour,"
        " avg(value) AS mean, median(value) AS median, count(*) AS n FROM {t}"
        " GROUP BY GROUPING SETS ((station_id, month, hour), (station_id, hour), (station_id, month), (station_id))",
        t=t,
    )


def climatology(panel: DataFrame, train: DataFrame) -> DataFrame:
    """pred and cell_source: the finest cell that the training block has for a target's month and hour."""
    return climatology_of(panel, climatology_cells(train))


def climatology_of(panel: DataFrame, cells: DataFrame) -> DataFrame:
    out = panel.withColumns({"_m": F.month("ts"), "_h": F.hour("ts")})
    for level, keys in (("month_hour", ["month", "hour"]), ("hour", ["hour"]), ("month", ["month"]), ("global", [])):
        c = cells.where(F.col("level") == level).select("station_id", *[F.col(k).alias(f"_{k[0]}") for k in keys], F.col("mean").alias(f"_{level}"))
        out = out.join(c, ["station_id", *[f"_{k[0]}" for k in keys]], "left")
    levels = ("month_hour", "hour", "month", "global")
    source = F.coalesce(*[F.when(F.col(f"_{x}").isNotNull(), F.lit(x)) for x in levels])
    return out.withColumns({"pred": F.coalesce(*[F.col(f"_{x}") for x in levels]), "cell_source": source}).select(*panel.columns, "pred", "cell_source")


def ladder(panel: DataFrame, train: DataFrame, horizons: list[int], days: int) -> DataFrame:
    """(station_id, ts, value, model, horizon_h, pred) of every baseline at every horizon.

    All lags come from one sort of the panel by station and time; the models are unpivoted afterwards.
    """
    w = _by_time()
    wide = climatology(panel, train).withColumnRenamed("pred", "_clim").withColumn("_known", F.last("value", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    columns, models = {}, []
    for h in horizons:
        columns |= {f"_p{h}": F.lag("value", h).over(w), f"_d{h}": F.lag("_known", 24 * math.ceil(h / 24)).over(w), f"_s{h}": F.array_compact(F.array(*[F.lag("value", h + 24 * k).over(w) for k in range(days)]))}
        mean = F.aggregate(f"_s{h}", F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(f"_s{h}"), F.lit(0))
        for name, pred in (("persistence", F.col(f"_p{h}")), ("diurnal_persistence", F.col(f"_d{h}")), ("same_hour_mean", mean), ("climatology_mean", F.col("_clim"))):
            models.append(F.struct(F.lit(name).alias("model"), F.lit(h).alias("horizon_h"), pred.alias("pred")))
    long = wide.withColumns(columns).withColumn("_x", F.explode(F.array(*models)))
    return long.select("station_id", "ts", "value", "_x.model", "_x.horizon_h", "_x.pred")
