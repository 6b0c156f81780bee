"""Scores of predictions: regression, exceedance, spreads and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.operators.qc import local


def regression(df: DataFrame, keys: list[str], obs: str = "value", pred: str = "pred") -> DataFrame:
    """n, rmse, mae, bias (pred - obs), r2 against the scored mean, and median absolute error; pairs with a null don't count.

    One aggregate: the total sum of squares is the population variance times n, which is exact for r2 where all are equal, too.
    """
    e = F.col(pred) - F.col(obs)
    d = df.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    total = F.var_pop(obs) * F.count("*")
    return d.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        F.when(F.max(obs) > F.min(obs), 1 - F.sum(e * e) / total).alias("r2"), F.median(F.abs(e)).alias("median_ae"),
    )


def daily(df: DataFrame, keys: list[str], columns: list[str], zone: str, least: int = 18) -> DataFrame:
    """Means by local calendar date; null for a column with fewer values that day than least."""
    by = df.groupBy(*keys, F.to_date(local(zone=zone)).alias("date"))
    return by.agg(*[F.when(F.count(c) >= least, F.avg(c)).alias(c) for c in columns])


def confusion(days: DataFrame, keys: list[str], threshold: float, obs: str = "value", pred: str = "pred") -> DataFrame:
    d = days.where(F.col(obs).isNotNull() & F.col(pred).isNotNull())
    o, p = F.col(obs) > threshold, F.col(pred) > threshold
    return d.groupBy(*keys).agg(F.count_if(o & p).alias("tp"), F.count_if(~o & p).alias("fp"), F.count_if(o & ~p).alias("fn"), F.count_if(~o & ~p).alias("tn"))


def skill(counts: DataFrame) -> DataFrame:
    """precision, recall, f1, base_rate, f1_trivial (always say yes), Peirce's skill, beats_trivial; null where undefined."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: a / F.nullif(b, F.lit(0.0))
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "base_rate": ratio(tp + fn, tp + fp + fn + tn), "peirce": ratio(tp, tp + fn) - ratio(fp, fp + tn)})
    f1 = F.when(tp + fp + fn > 0, 2 * tp / (2 * tp + fp + fn))
    trivial = F.when(F.col("base_rate") == 0, F.lit(0.0)).otherwise(2 * F.col("base_rate") / (F.col("base_rate") + 1))
    return out.withColumns({"f1": f1, "f1_trivial": trivial}).withColumn("beats_trivial", F.coalesce(F.col("f1") > F.col("f1_trivial"), F.lit(False)))


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and population deviation over seeds, and whether they are all the same."""
    sd = F.stddev_pop(value)
    return rows.groupBy(*keys).agg(F.count("*").alias("n_seeds"), F.avg(value).alias("mean"), sd.alias("sd"), (sd < 1e-12).alias("deterministic"))


def pivot_mean(rows: DataFrame, index: str, column: str, names: list[str], value: str) -> DataFrame:
    return rows.groupBy(index).pivot(column, names).agg(F.avg(value))


def rollup_pooled(df: DataFrame, fold: str, metric: Column, name: str) -> DataFrame:
    """A row for each fold and one named POOLED over all rows."""
    out = df.rollup(fold).agg(F.count("*").alias("n"), metric.alias(name), F.grouping(fold).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "POOLED").otherwise(F.col(fold).cast("string")).alias(fold), "n", name)
