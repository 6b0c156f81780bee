"""Learned daily models. Training rows lie before the validation block; folds are frozen, never drawn at random.

Every fit reads one design that was written once: the features of all tiers and, for each day, sums of the target by city, from
which a fold's neighbour columns follow without its held-out city. Fits of city, seed and tier run at the same time in a pool.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.operators import features, metrics, splits
from quern.operators.selection import FixedSplit, FixedSplitModel, at_once
from quern.sources.sinks import kept

CALENDAR = ["doy_sin", "doy_cos", "month", "dow", "is_heating_season"]
FORECAST, SATELLITE, SPATIAL = ["forecast"], ["aod", "valid_px"], ["nb_mean", "nb_n"]
LAGS = ["lag_1", "lag_2", "lag_7", "mean_7", "mean_30", "delta"]
INPUTS = [*LAGS, "nb_mean", *FORECAST, *SATELLITE, "doy_sin", "doy_cos", "dow"]  # of the linear model
TIERS = ["static_only", "deployable", "retrospective"]
#: What a feature's name says of its family; the first line that fits, else the last name.
FAMILIES = [
    (["nb_"], "spatial_neighbour"), (["lag_", "mean_7", "mean_30", "delta"], "local"), (["valid_px"], "satellite_missingness"), (["aod", "aerosol", "no2", "so2", "co_col"], "satellite"),
    (["forecast"], "cams_forecast"), (["doy", "month", "dow", "heating"], "calendar"),
]
OTHER = "static_geography"
#: The grid of settings (step, depth as 2^5 and 2^6 leaves, rows of a leaf, share of features), and what a fold needs.
GRID = [{"stepSize": s, "maxDepth": d, "minInstancesPerNode": n, "featureSubsetStrategy": f} for s, d, n, f in product([0.03, 0.08], [5, 6], [20, 40], ["0.7", "0.9"])]
LEAST = {"train": 200, "val": 50, "test": 30}
TASK_ROWS = 32_768  # of a design in a task: trees are many small jobs, which cost by their tasks


def family(name: Column) -> Column:
    out = F.lit(OTHER)
    for parts, label in reversed(FAMILIES):
        out = F.when(reduce(Column.__or__, [F.contains(name, F.lit(p)) for p in parts]), label).otherwise(out)
    return out


def columns(tier: str, static: list[str]) -> list[str]:
    """A tier's features: static_only knows place and calendar, deployable the forecast too, retrospective also the satellite."""
    have = {"static_only": [], "deployable": FORECAST, "retrospective": [*SATELLITE, *FORECAST]}
    if tier not in have:
        raise ValueError(f"unknown tier {tier!r}")
    return [*have[tier], *static, *CALENDAR]


def design(daily: DataFrame, static: DataFrame | None = None) -> DataFrame:
    """Features with the block of each row, written once; missing values are training medians (approximate; 0 where training has no value).

    static: (station_id, ...) with numbers that don't change. The vector x holds the linear model's inputs. by_city: for each
    city the day's sum of the target and its count. daily is worked out once, then read: it has a row a station and date, however
    many rows it was made of.
    """
    daily = kept(daily, "daily")
    tasks = max(1, math.ceil(daily.count() / TASK_ROWS))
    day = daily.where("target is not null").groupBy("date", "city").agg(F.sum("target").alias("s"), F.count("*").alias("n")).groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("city", F.struct("s", "n")))).alias("by_city"))  # cities are few
    full = features.local_lags(daily).join(features.neighbours(daily).select("station_id", "date", "nb_mean"), ["station_id", "date"]).withColumns(features.calendar(F.col("date")))
    full = full.withColumn("block", splits.block_of(F.col("date").cast("timestamp_ntz"), splits.DAILY_BLOCKS)).where(F.col("target").isNotNull())
    full = full.join(day, "date")
    own = [c for c in static.columns if c != "station_id"] if static is not None else []
    full = full.join(static, "station_id", "left") if own else full
    numbers = [*dict.fromkeys([*INPUTS, *LAGS, *CALENDAR, *FORECAST, *SATELLITE, *own])]
    full = full.withColumns({c: F.col(c).cast("double") for c in numbers})
    medians = full.where("block = 'train'").agg(*[F.percentile_approx(c, 0.5).alias(c) for c in numbers]).first().asDict()
    full = full.fillna({c: 0.0 if m is None else m for c, m in medians.items()})
    # Bagging draws rows by their place: files by hash, sorted, make a seed give the same model again.
    return kept(VectorAssembler(inputCols=INPUTS, outputCol="x").transform(full).repartition(tasks, "station_id", "date").sortWithinPartitions("station_id", "date"), "design")


def without_city(rows: DataFrame, held_out: str) -> DataFrame:
    """nb_mean and nb_n of a fold: the day's other stations, none of the held-out city; where there is none, the row's forecast stands in for the mean."""
    others = F.filter(F.map_entries("by_city"), lambda e: e["key"] != held_out)
    own = F.col("city") != held_out
    s = F.aggregate(others, F.lit(0.0), lambda a, e: a + e["value"]["s"]) - F.when(own, F.col("target")).otherwise(0.0)
    n = F.aggregate(others, F.lit(0).cast("long"), lambda a, e: a + e["value"]["n"]) - F.when(own, 1).otherwise(0)
    return rows.withColumns({"_s": s, "_n": n}).withColumns({"nb_n": F.col("_n").cast("double"), "nb_mean": F.when(F.col("_n") > 0, F.col("_s") / F.col("_n")).otherwise(F.coalesce(F.col("forecast"), F.lit(0.0)))}).drop("_s", "_n")


def assembled(rows: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="x").transform(rows.drop("x"))


def ridge(rows: DataFrame, penalty: float = 1.0) -> DataFrame:
    model = LinearRegression(featuresCol="x", labelCol="target", predictionCol="pred", regParam=penalty, elasticNetParam=0.0).fit(rows.where("block = 'train'"))
    return model.transform(rows.where("block = 'test'"))


def regressor(trees: int, depth: int, seed: int, share: float, step: float = 0.1) -> GBTRegressor:
    return GBTRegressor(featuresCol="x", labelCol="target", predictionCol="pred", maxIter=trees, maxDepth=depth, stepSize=step, seed=seed, subsamplingRate=share)


def folds(rows: DataFrame, least: dict[str, int] | None = None) -> list[str]:
    """Cities that can be held out: enough training (and validation) rows of others, and test rows of their own."""
    least = LEAST if least is None else least
    counts = {(r["city"], r["block"]): r["n"] for r in rows.groupBy("city", "block").agg(F.count("*").alias("n")).collect()}  # a row for each city and block
    total = lambda block, but: sum(n for (c, b), n in counts.items() if b == block and c != but)
    cities = sorted({c for c, _ in counts})
    return [c for c in cities if all(total(b, c) >= least[b] for b in ("train", "val") if b in least) and counts.get((c, "test"), 0) >= least.get("test", 0)]


def leave_city_out(rows: DataFrame, static: list[str], tiers: tuple[str, ...] = tuple(TIERS), seeds: tuple[int, ...] = (0, 1, 2, 3, 4), trees: int = 20, depth: int = 4, share: float = 0.8, least: dict[str, int] | None = None, parallel: int = 8) -> DataFrame:
    """Test rows of each city with pred, tier and seed, from models fitted without the city. All fits share one pool.

    Cities, tiers and seeds are parameters of the study, not data: their product is the number of models.
    """
    keep = ["station_id", "city", "date", "target"]

    def fit(tier: str, city: str, seed: int) -> DataFrame:
        x = assembled(rows, columns(tier, static))
        model = regressor(trees, depth, seed, share).fit(x.where((F.col("block") == "train") & (F.col("city") != city)))
        test = model.transform(x.where((F.col("block") == "test") & (F.col("city") == city)))
        return test.select(*keep, "pred", F.lit(tier).alias("tier"), F.lit(seed).alias("seed"))

    jobs = [lambda t=t, c=c, s=s: fit(t, c, s) for t, c, s in product(tiers, folds(rows, least), seeds)]
    parts = at_once(jobs, parallel)
    return reduce(DataFrame.unionByName, parts) if parts else rows.limit(0).select(*keep, F.lit(0.0).alias("pred"), F.lit("").alias("tier"), F.lit(0).alias("seed"))


def tuned(rows: DataFrame, names: list[str], settings: list[dict] | None = None, trees: int = 40, share: float = 0.8, parallel: int = 8) -> FixedSplitModel:
    """Settings chosen on the validation block alone, refitted on training and validation rows."""
    x = assembled(rows, names)
    own = regressor(trees, 5, 0, share)
    own.set(own.validationTol, 0.0)  # small steps gain little each: stop where the error rises, not where it falls slowly
    return FixedSplit(estimator=own, settings=GRID if settings is None else settings, splitCol="block", parallelism=parallel).fit(x)


def seeded(rows: DataFrame, names: list[str], chosen: dict, seeds: tuple[int, ...], share: float = 0.8, parallel: int = 8) -> list:
    """Models with the chosen settings, one for each seed, fitted on training and validation rows."""
    both = assembled(rows, names).where(F.col("block").isin("train", "val"))
    own = regressor(1, 5, 0, share)

    def fit(seed: int):
        return own.copy({**{own.getParam(k): v for k, v in chosen.items()}, own.getParam("seed"): seed}).fit(both)

    return at_once([lambda s=s: fit(s) for s in seeds], parallel)


def tuned_study(rows: DataFrame, names: list[str], test: Column, train: Column, seeds: tuple[int, ...] = (0, 1, 2, 3, 4), **how) -> tuple[DataFrame, FixedSplitModel, list]:
    """(test rows with pred and seed, the selection, the seeds' models): tuned on rows where `train` holds, scored where `test` does."""
    best = tuned(rows.where(train), names, **how)
    models = seeded(rows.where(train), names, best.chosen, seeds)
    x = assembled(rows, names).where(test & (F.col("block") == "test"))
    parts = [m.transform(x).withColumn("seed", F.lit(s)) for s, m in zip(seeds, models, strict=True)]
    return reduce(DataFrame.unionByName, parts), best, models


def ensemble(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """The seeds' mean prediction for each station and date (and further keys)."""
    return rows.groupBy(*keys, "station_id", "city", "date").agg(F.first("target").alias("target"), F.avg("pred").alias("pred"), F.count("*").alias("n_seeds"))


def score(rows: DataFrame, keys: list[str]) -> DataFrame:
    return metrics.regression(rows, keys, "target", "pred")


def importance(rows: DataFrame) -> DataFrame:
    """(family, share): the ridge's mean absolute contributions, by family of features, in per cent."""
    train = rows.where("block = 'train'")
    model = LinearRegression(featuresCol="x", labelCol="target", regParam=1.0, elasticNetParam=0.0).fit(train)
    x = train.withColumn("v", vector_to_array("x"))
    means = x.agg(*[F.avg(F.col("v")[i]).alias(f"m{i}") for i in range(len(INPUTS))])
    parts = x.crossJoin(F.broadcast(means)).agg(*[F.avg(F.abs((F.col("v")[i] - F.col(f"m{i}")) * float(c))).alias(f"c{i}") for i, c in enumerate(model.coefficients)])
    listed = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"c{i}").alias("c")) for i, n in enumerate(INPUTS)])
    by = parts.select(F.explode(listed).alias("p")).groupBy(family(F.col("p.feature")).alias("family")).agg(F.sum("p.c").alias("c"))
    return by.select("family", (100 * F.col("c") / F.sum("c").over(Window.partitionBy())).alias("share"))  # a row for each family
