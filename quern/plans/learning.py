"""Queries on learned daily models: boosted trees by held-out city, seed and tier, tuning on the validation block, attribution.

They have no SQL: tests hold selection, folds and attributions against plain versions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quern.operators import attribution, features as ft, learned, metrics, stats
from quern.plans.daily import TRAIN_END, target
from quern.plans.registry import query
from quern.sources import tables as src
from quern.sources.sinks import kept

CHUNK = 100_000  # rows of a long series that are tested together
TREES = 20  # of the untuned models, and at most of tuned ones


def static(spark: SparkSession, sf: str) -> DataFrame:
    """(station_id, n_suppliers, mean_acctbal): what doesn't change at a place."""
    s, n = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation")
    by = s.groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers"), F.avg("s_acctbal").alias("mean_acctbal"))
    return n.join(by, n.n_nationkey == by.k).select(F.col("n_name").alias("station_id"), "n_suppliers", "mean_acctbal")


STATIC = ["n_suppliers", "mean_acctbal"]


def design(spark: SparkSession, sf: str) -> DataFrame:
    return learned.design(target(spark, sf), static(spark, sf))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return learned.leave_city_out(design(spark, sf), STATIC, trees=TREES)


@query()
def gbt_loco(spark: SparkSession, sf: str) -> DataFrame:
    """Every city held out in turn, three tiers, five seeds; the seeds' predictions are averaged."""
    return learned.score(learned.ensemble(runs(spark, sf), ("tier",)), ["tier", "city"])


def by_seed(spark: SparkSession, sf: str) -> DataFrame:
    return learned.score(runs(spark, sf), ["tier", "city", "seed"])


@query()
def gbt_seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    """How much the seed alone moves the error of a tier and city, and whether it does at all."""
    return metrics.spread(by_seed(spark, sf), ["tier", "city"], "rmse")


@query()
def gbt_tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Means over cities and seeds by tier, with the sample deviation of the error."""
    return by_seed(spark, sf).groupBy("tier").agg(F.count("*").alias("n_models"), *[F.avg(c).alias(c) for c in ("rmse", "mae", "r2")], F.stddev_samp("rmse").alias("rmse_sd"))


@query()
def gbt_city_by_tier(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.pivot_mean(by_seed(spark, sf), "city", "tier", learned.TIERS, "rmse")


def settled(chosen: dict) -> Column:
    return F.lit(", ".join(f"{k}={v}" for k, v in sorted(chosen.items())))


def tuned_cities(spark: SparkSession, sf: str, tier: str = "retrospective", seeds: tuple[int, ...] = (0, 1, 2, 3, 4)) -> DataFrame:
    """Test rows with pred, seed, params and val_rmse of Task N: tuned without the city."""
    rows = design(spark, sf)
    names = [*learned.columns(tier, STATIC), *learned.SPATIAL]

    def study(city: str):
        own = learned.without_city(rows, city)
        return learned.tuned_study(own, names, F.col("city") == city, F.col("city") != city, seeds, trees=TREES)

    cities = learned.folds(rows)
    done = learned.at_once([lambda c=c: study(c) for c in cities], 3)  # each tunes in a pool of its own
    parts = [p.withColumns({"params": settled(best.chosen), "val_rmse": F.lit(float(min(best.errors)))}) for p, best, _ in done]
    none = rows.limit(0).select("city", "target", F.lit(0.0).alias("pred"), F.lit(0).alias("seed"), F.lit("").alias("params"), F.lit(0.0).alias("val_rmse"))
    for p in parts:  # none, where no city has enough rows
        none = none.unionByName(p.select(*none.columns))
    return none


@query()
def task_n_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Sixteen settings for each held-out city, chosen on the validation block of the others, refitted for five seeds."""
    return learned.score(tuned_cities(spark, sf), ["city", "seed", "params", "val_rmse"])


@query()
def task_f_tuned(spark: SparkSession, sf: str) -> DataFrame:
    """Own past allowed: local lags besides each tier's features, all stations, tuned and refitted the same way."""
    rows, out = design(spark, sf), None
    for tier in learned.TIERS:
        names = [*learned.columns(tier, STATIC), *learned.LAGS]
        scored, best, _ = learned.tuned_study(rows, names, F.lit(True), F.lit(True), trees=TREES)
        one = learned.score(scored.withColumns({"tier": F.lit(tier), "params": settled(best.chosen), "val_rmse": F.lit(float(min(best.errors)))}), ["tier", "seed", "params", "val_rmse"])
        out = one if out is None else out.unionByName(one)
    return out


def explained(spark: SparkSession, sf: str) -> tuple[DataFrame, list[str]]:
    """(fold, station_id, date, shap, base) of the test rows, from each fold's first seed; and the features' names."""
    rows = design(spark, sf)
    out = rows.limit(0).select(F.lit("").alias("fold"), "station_id", "date", F.array().cast("array<double>").alias("shap"), F.lit(0.0).alias("base"))
    names = [*learned.columns("retrospective", STATIC), *learned.SPATIAL]

    def fit(city: str):
        x = learned.assembled(learned.without_city(rows, city), names)
        model = learned.regressor(TREES, 5, 0, 0.8).fit(x.where(F.col("block").isin("train", "val") & (F.col("city") != city)))
        test = x.where((F.col("block") == "test") & (F.col("city") == city)).withColumn("fold", F.lit(city))
        return attribution.explain(model, test, ["fold", "station_id", "date"])

    for part in learned.at_once([lambda c=c: fit(c) for c in learned.folds(rows)]):
        out = out.unionByName(part)
    return out, names


@query()
def shap_top_features(spark: SparkSession, sf: str) -> DataFrame:
    """The twelve features with the largest mean size of attributions, over folds: a top-k report."""
    found, names = explained(spark, sf)
    by = attribution.by_feature(found, names, ["fold"]).groupBy("feature").agg(F.avg("mean_abs").alias("mean_abs"))
    return by.orderBy(F.desc("mean_abs"), "feature").limit(12)


@query()
def shap_by_family(spark: SparkSession, sf: str) -> DataFrame:
    found, names = explained(spark, sf)
    return attribution.by_family(attribution.by_feature(found, names, ["fold"]), learned.family)


def losses(spark: SparkSession, sf: str) -> DataFrame:
    """Squared errors of the boosted ensemble (la) and the forecast less the other cities' bias (lb), by test row."""
    days = kept(target(spark, sf), "days")
    rows = learned.design(days, static(spark, sf))
    scored = learned.ensemble(learned.leave_city_out(rows, STATIC, ("retrospective",), trees=TREES))
    bias = ft.station_bias(days, TRAIN_END)
    pooled = ft.pooled_bias(bias, days.select("station_id", "city").distinct())
    both = scored.join(days.select("station_id", "date", "forecast"), ["station_id", "date"]).join(pooled, F.col("city") == F.col("held_out_city"))
    e, f = F.col("pred") - F.col("target"), F.col("forecast") - F.col("pooled") - F.col("target")
    return kept(both.select("city", "station_id", "date", (e * e).alias("la"), (f * f).alias("lb")), "losses")


@query()
def dm_boosted_by_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Boosted trees against the debiased forecast: a row for each city and one POOLED, with the automatic lag of all rows."""
    d = losses(spark, sf).withColumn("fold", F.explode(F.array(F.col("city"), F.lit("POOLED"))))
    d = d.withColumn("at", F.concat(F.col("date").cast("string"), F.lit(" "), "station_id"))
    n = d.where("fold = 'POOLED'").count()
    lags = int(4 * (n / 100) ** (2 / 9))
    out = stats.diebold_mariano(d, ["fold"], lags, order="at", chunk=CHUNK)
    p = stats.t_pvalue(F.col("dm"), F.col("n") - 1.0)
    return out.select("fold", "n", F.lit(lags).alias("lags"), "mean_diff", "dm", p.alias("p_value"))


@query()
def dm_boosted_lags(spark: SparkSession, sf: str) -> DataFrame:
    """The same test over all rows at lags of 0, 5, 14, 30 and 60 days."""
    d = losses(spark, sf).withColumns({"fold": F.lit("POOLED"), "at": F.concat(F.col("date").cast("string"), F.lit(" "), "station_id")})
    out = None
    for lags in (0, 5, 14, 30, 60):
        one = stats.diebold_mariano(d, ["fold"], lags, order="at", chunk=CHUNK).select(F.lit(lags).alias("lags"), "n", "mean_diff", "dm")
        out = one if out is None else out.unionByName(one)
    return out
