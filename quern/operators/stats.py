"""Significance of differences between forecasts, and rank statistics."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from quern.operators.grid import mid_ranks, positions
from quern.sources.sinks import kept


MANY = 48  # lags; more are taken as one list a row instead of a column each


def long_run_variance(d: DataFrame, keys: list[str], lags: int, value: str = "d", order: str = "ts", own: str | None = None, chunk: int | None = None) -> DataFrame:
    """(*keys, n, mean, lrv): Bartlett weights, autocovariances over n; lags count rows with a value.

    own: a column with each key's own number of lags, of which lags is the most. chunk: rows of a key that are handled together,
    for keys of any number of rows; each chunk has the last `lags` rows of the one before it as context.
    """
    span = F.col(own) if own else F.lit(lags)
    d = d.where(F.col(value).isNotNull())
    if chunk:
        return _chunked_variance(d, keys, lags, value, order, span, max(chunk, lags))
    w = Window.partitionBy(*keys).orderBy(order)
    if lags > MANY:
        before = F.collect_list("_c").over(w.rowsBetween(-lags, -1))  # at most lags values, the nearest last
        x = d.withColumns({"_m": F.avg(value).over(Window.partitionBy(*keys))}).withColumn("_c", F.col(value) - F.col("_m")).withColumn("_l", F.reverse(before))
        weighed = F.transform("_l", lambda c, k: F.greatest(F.lit(0.0), 1 - (k + 1) / (span + 1)) * c)
        terms = F.col("_c") * F.col("_c") + 2 * F.col("_c") * F.aggregate(weighed, F.lit(0.0), lambda a, b: a + b)
        return x.withColumn("_t", terms).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), (F.sum("_t") / F.count("*")).alias("lrv"))
    x = d.withColumns({"_rn": F.row_number().over(w), "_c": F.col(value) - F.avg(value).over(Window.partitionBy(*keys)), "_m": F.avg(value).over(Window.partitionBy(*keys))})
    terms = F.col("_c") * F.col("_c")
    for lag in range(1, lags + 1):
        terms = terms + 2 * F.greatest(F.lit(0.0), 1 - lag / (span + 1)) * F.col("_c") * F.coalesce(F.lag("_c", lag).over(w), F.lit(0.0))
    return x.withColumn("_t", terms).groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), (F.sum("_t") / F.count("*")).alias("lrv"))


def _chunked_variance(d: DataFrame, keys: list[str], lags: int, value: str, order: str, span: Column, chunk: int) -> DataFrame:
    at = positions(d, keys, [order]).join(d.groupBy(*keys).agg(F.avg(value).alias("_m")), keys)
    at = at.withColumns({"_c": F.col(value) - F.col("_m"), "_chunk": F.floor(F.col("pos") / chunk)})
    # A chunk's last rows are the next one's context.
    part = F.when(F.col("pos") % chunk >= chunk - lags, F.array(F.struct(F.col("_chunk").alias("k"), F.lit(True).alias("own")), F.struct((F.col("_chunk") + 1).alias("k"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(F.col("_chunk").alias("k"), F.lit(True).alias("own"))))
    x = at.withColumn("_part", F.explode(part)).withColumns({"_k": F.col("_part.k"), "_own": F.col("_part.own")})
    w = Window.partitionBy(*keys, "_k").orderBy("pos")
    terms = F.col("_c") * F.col("_c")
    for lag in range(1, lags + 1):
        terms = terms + 2 * F.greatest(F.lit(0.0), 1 - lag / (span + 1)) * F.col("_c") * F.coalesce(F.lag("_c", lag).over(w), F.lit(0.0))
    return x.withColumn("_t", terms).where("_own").groupBy(*keys).agg(F.count("*").alias("n"), F.first("_m").alias("mean"), (F.sum("_t") / F.count("*")).alias("lrv"))


def verdict(rows: DataFrame, alpha: float = 0.05) -> DataFrame:
    """rows (model_a, model_b, n, dm, p_value) with better and said: which model is better, and a sentence on it.

    A negative statistic means that a's losses are lower. Nothing is better where there is no statistic, or no significance.
    """
    better = F.when(F.col("dm").isNull() | F.col("p_value").isNull() | (F.col("p_value") >= alpha), None).when(F.col("dm") < 0, F.col("model_a")).otherwise(F.col("model_b"))
    worse = F.when(F.col("better") == F.col("model_a"), F.col("model_b")).otherwise(F.col("model_a"))
    numbers = F.format_string("DM %.2f, p %.4f, n %d", "dm", "p_value", "n")
    said = F.when(F.col("dm").isNull(), F.concat_ws(" ", "model_a", F.lit("and"), "model_b", F.lit("can't be told apart: too few rows"))).when(F.col("better").isNull(), F.concat(F.col("model_a"), F.lit(" and "), F.col("model_b"), F.lit(" don't differ ("), numbers, F.lit(")")))
    return rows.withColumn("better", better).withColumn("said", said.otherwise(F.concat(F.col("better"), F.lit(" beats "), worse, F.lit(" ("), numbers, F.lit(")"))))


def bandwidth(n):
    """The automatic lag, floor(4 (n / 100)^(2/9))."""
    return F.floor(4 * F.pow(n / 100, F.lit(2 / 9)))


def diebold_mariano(losses: DataFrame, keys: list[str], lags: int, least: int = 10, order: str = "ts", own: str | None = None, chunk: int | None = None) -> DataFrame:
    """(*keys, n, mean_diff, lrv, dm) from columns la, lb: the statistic with the small-sample factor for h = lags + 1.

    Null under `least` rows or without variance; 0 if no two losses differ by more than 1e-8.
    """
    d = losses.where(F.col("la").isNotNull() & F.col("lb").isNotNull()).withColumn("d", F.col("la") - F.col("lb"))
    out = long_run_variance(d, keys, lags, order=order, own=own, chunk=chunk)
    tie = d.groupBy(*keys).agg(F.max(F.abs("d")).alias("_top"))
    h, n = (F.col(own) if own else F.lit(lags)) + 1, F.col("n")
    factor = F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    dm = F.when(n < least, None).when(F.col("_top") <= 1e-8, F.lit(0.0)).when(F.col("lrv") <= 0, None).otherwise(F.col("mean") / F.sqrt(F.col("lrv") / n) * factor)
    return out.join(tie, keys).select(*keys, "n", F.col("mean").alias("mean_diff"), "lrv", dm.alias("dm"))


def pairwise(scored: DataFrame, keys: list[str], least_lags: int = 0, absolute: bool = False, order: str = "ts", least: int = 10) -> DataFrame:
    """(*keys, model_a, model_b, n, lags, mean_diff, dm) for every pair of model names in order, from obs `value` and `pred`.

    Losses are squared or absolute errors; rows where one of the two has no prediction don't count. lags is the automatic
    bandwidth, at least least_lags. The rows of one time are gathered: there are as many as models.
    """
    e = F.col("pred") - F.col("value")
    told = scored.where("value is not null and pred is not null").groupBy(*keys, order).agg(F.array_sort(F.collect_list(F.struct("model", (F.abs(e) if absolute else e * e).alias("l")))).alias("_m"))
    pairs = F.flatten(F.transform("_m", lambda a: F.transform(F.filter("_m", lambda b: b["model"] > a["model"]), lambda b: F.struct(a["model"].alias("model_a"), b["model"].alias("model_b"), a["l"].alias("la"), b["l"].alias("lb")))))
    rows = told.select(*keys, order, F.explode(pairs).alias("p")).select(*keys, order, "p.*")
    by = [*keys, "model_a", "model_b"]
    n = F.count("*").over(Window.partitionBy(*by))
    rows = rows.withColumn("lags", F.greatest(bandwidth(n), F.lit(least_lags)).cast("int"))
    most = rows.agg(F.max("lags")).first()[0] or 0
    out = diebold_mariano(rows, [*by, "lags"], most, least, order, own="lags")
    return out.select(*by, "n", "lags", "mean_diff", "dm")


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by Lentz's method."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    out = d
    for m in range(1, 400):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + top / c
            c = c if abs(c) > 1e-300 else 1e-300
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    x, a, b = df / (df + t * t), df / 2, 0.5
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


@pandas_udf(DoubleType())
def t_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2))).astype("float64")


def mann_whitney(df: DataFrame, keys: list[str], value: str, group: str) -> DataFrame:
    """(*keys, n1, n2, u, z): group is a boolean column; mid-ranks, tie correction, continuity correction.

    Equal values are counted first, and the different ones ranked by range over all partitions: no task holds a key's rows.
    """
    x = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    counts = x.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.count_if(group).alias("_n1"))
    ranked = positions(counts, keys, [value], "_n").withColumn("_r", F.col("pos") + (F.col("_n") + 1) / 2)
    size = F.col("_n").cast("double")
    s = ranked.groupBy(*keys).agg(F.sum("_n1").alias("n1"), F.sum(F.col("_n") - F.col("_n1")).alias("n2"), F.sum(F.when(F.col("_n1") > 0, F.col("_r") * F.col("_n1"))).alias("r1"), F.sum(size * (size * size - 1)).alias("ties"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.coalesce(F.col("ties") / F.nullif(n * (n - 1), F.lit(0.0)), F.lit(0.0))))
    z = (F.abs(u - n1 * n2 / 2) - 0.5) / F.nullif(sd, F.lit(0.0))
    return s.select(*keys, "n1", "n2", u.alias("u"), z.alias("z"))


def spearman(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """(*keys, n, rho) of mid-ranks, ranked as in mann_whitney(). Keys with a null drop out.

    The values are written once: ranks are joined on them, and a mean that is worked out again may differ in its last digit.
    """
    x = kept(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(*keys, F.col(a).alias("_a"), F.col(b).alias("_b")), "ranked")
    for c in ("_a", "_b"):
        x = x.join(mid_ranks(x, keys, c).select(*keys, c, F.col("rank").alias(f"_r{c}")), [*keys, c])
    return x.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("_r_a", "_r_b").alias("rho"))


def autocorrelation(d: DataFrame, keys: list[str], lags: list[int], value: str = "d", order: str = "ts") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    x = d.where(F.col(value).isNotNull()).withColumns({f"_l{k}": F.lag(value, k).over(w) for k in lags})
    return x.groupBy(*keys).agg(*[F.corr(F.when(F.col(f"_l{k}").isNotNull(), F.col(value)), f"_l{k}").alias(f"acf_{k}") for k in lags])
