"""Queries on tails of distributions, drift by year, supports, choices, reductions and sizes of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as tx
from quern.operators import features as ft, ingest, job, metrics, qc, rasters, specs, splits, stats, works
from quern.plans.census import T_P, with_p
from quern.plans.daily import RANKS, target, tokens_sql
from quern.plans.hourly import COMPOSITE, LOSSES, dm, hour, ladder, losses, lrv, r, train_block
from quern.plans.registry import PANEL, query
from quern.sources import tables as src

# --- tests ---


@query(f"WITH {LOSSES}, {lrv(23)}, t AS (SELECT station_id, n, {dm(23)} AS dm FROM lv23) SELECT station_id, n, round(dm, 5) AS dm, round({T_P}, 5) AS p_value FROM t")
def dm_pvalue(spark: SparkSession, sf: str) -> DataFrame:
    return with_p(stats.diebold_mariano(losses(spark, sf), ["station_id"], 23)).select("station_id", "n", r("dm"), r("p_value"))


NORMAL = "CASE WHEN z IS NOT NULL THEN 1 - 2 * least(abs(z), 9.0) / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow(least(abs(z), 9.0) * i / 400.0, 2) / 2))) END"


@query(f"WITH {RANKS}, zs AS (SELECT city, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, (abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0) AS z FROM s) SELECT city, n1, n2, round(z, 5) AS z, round({NORMAL}, 5) AS p_value FROM zs")
def mann_whitney_p(spark: SparkSession, sf: str) -> DataFrame:
    z = stats.mann_whitney(target(spark, sf).withColumn("gone", F.col("aod").isNull()), ["city"], "target", "gone")
    return z.select("city", "n1", "n2", r("z"), F.round(stats.normal_pvalue("z"), 5).alias("p_value"))


SWEEP = (0, 24, 48, 168, 336)


def swept(lags: int) -> str:
    """The statistic at many lags: covariances by pairs of rows."""
    h = lags + 1
    return f"""SELECT c.station_id, {lags} AS lags, round(CASE WHEN any_value(n) < 10 THEN NULL WHEN any_value(top) <= 1e-8 THEN 0.0 WHEN sum(w * cc) / any_value(n) <= 0 THEN NULL
 ELSE any_value(mean) / sqrt(sum(w * cc) / any_value(n) / any_value(n)) * sqrt(greatest((any_value(n) + 1 - 2 * {h} + {h} * ({h} - 1) / CAST(any_value(n) AS DOUBLE)) / any_value(n), 0)) END, 4) AS dm
 FROM (SELECT station_id, cc, CASE WHEN k = 0 THEN 1.0 ELSE 2 * (1 - k / {h}.0) END AS w FROM cov WHERE k <= {lags}) c JOIN st USING (station_id) GROUP BY c.station_id"""


@query(
    f"""WITH {LOSSES}, st AS (SELECT station_id, count(*) AS n, avg(d) AS mean, max(abs(d)) AS top FROM dd GROUP BY 1),
cov AS (SELECT a.station_id, a.rn - b.rn AS k, sum(a.c * b.c) AS cc FROM dd a JOIN dd b ON a.station_id = b.station_id AND b.rn BETWEEN a.rn - 336 AND a.rn GROUP BY ALL)
{" UNION ALL ".join(map(swept, SWEEP))}"""
)
def dm_lag_sweep(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the verdict depends on the truncation: five lags of hours."""
    d, out = losses(spark, sf), None
    for lags in SWEEP:
        one = stats.diebold_mariano(d, ["station_id"], lags).select("station_id", F.lit(lags).alias("lags"), r("dm", 4))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOSSES}, {lrv(23)}, t AS (SELECT station_id, n, {dm(23)} AS dm FROM lv23), p AS (SELECT *, {T_P} AS p FROM t) SELECT station_id, CASE WHEN dm IS NULL OR p >= 0.05 THEN NULL WHEN dm < 0 THEN 'persistence' ELSE 'climatology_mean' END AS better, CASE WHEN dm IS NULL THEN 'persistence and climatology_mean can''t be told apart: too few rows' WHEN p >= 0.05 THEN 'none' WHEN dm < 0 THEN 'persistence beats climatology_mean' ELSE 'climatology_mean beats persistence' END AS said FROM p")
def dm_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    named = with_p(stats.diebold_mariano(losses(spark, sf), ["station_id"], 23)).withColumns({"model_a": F.lit("persistence"), "model_b": F.lit("climatology_mean")})
    v = stats.verdict(named)
    return v.select("station_id", "better", F.when(F.col("better").isNull() & F.col("dm").isNotNull(), "none").otherwise(F.split("said", r" \(")[0]).alias("said"))


# --- quality control ---

YEARS = PANEL.replace("'s' || (user_id % 8) AS station_id, date_trunc('hour', ts) AS ts", "'s' || (user_id % 4) || '|' || extract(year FROM ts + CASE WHEN user_id % 8 >= 4 THEN INTERVAL 366 DAY ELSE INTERVAL 0 DAY END) AS station_id, date_trunc('hour', ts) AS ts").replace(
    "panel AS (SELECT station_id, ts, value FROM (SELECT DISTINCT station_id FROM obs) CROSS JOIN hours LEFT JOIN obs USING (station_id, ts))",
    "panel AS (SELECT * FROM obs WHERE station_id IN (SELECT station_id FROM obs GROUP BY 1 HAVING count(value) >= 336))",
)


@query(
    f"""WITH {COMPOSITE.replace(PANEL, YEARS)}, d AS (SELECT split_part(station_id, '|', 1) AS station_id, CAST(split_part(station_id, '|', 2) AS INT) AS period, (SELECT count(value) FROM panel WHERE panel.station_id = best.station_id) AS n, lag_hours FROM best),
e AS (SELECT *, coalesce(lag_hours - lag(lag_hours) OVER (PARTITION BY station_id ORDER BY period), 0) AS shift FROM d)
SELECT station_id, period, n, lag_hours, shift, max(abs(shift)) OVER (PARTITION BY station_id) > 1 AS suspected FROM e"""
)
def offset_drift_by_year(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the sensors stand for the next year: each station's lag by year, of years with two weeks of hours at least."""
    k = F.col("user_id")
    e = src.table(spark, sf, "events").select(F.concat(F.lit("s"), k % 4).alias("station_id"), F.date_trunc("hour", F.col("ts") + F.when(k % 8 >= 4, F.expr("interval 366 days")).otherwise(F.expr("interval 0 days"))).cast("timestamp_ntz").alias("ts"), "value")
    panel = e.groupBy("station_id", "ts").agg(F.avg("value").alias("value"))
    enough = panel.withColumn("period", F.year("ts"))
    enough = enough.join(enough.groupBy("station_id", "period").agg(F.count("value").alias("n")).where("n >= 336").drop("n"), ["station_id", "period"])
    ref = qc.median_composite(qc.diurnal_composite(enough, ["station_id", "period"], src.ZONE), [])
    return qc.offset_drift(panel, ref, src.ZONE).select("station_id", "period", "n", "lag_hours", "shift", "suspected")


# --- supports, choices and sizes ---


@query(f"WITH {PANEL} SELECT station_id, count(value) AS n_train, count(value) >= 720 AS enough FROM train GROUP BY 1")
def training_support(spark: SparkSession, sf: str) -> DataFrame:
    """A forecast needs 720 training hours with a value; what nowcasts need is counted by fold, in learned.folds()."""
    return train_block(src.hourly_panel(spark, sf)).groupBy("station_id").agg(F.count("value").alias("n_train"), (F.count("value") >= 720).alias("enough"))


@query(f"WITH {PANEL}, t AS (SELECT station_id, ts BETWEEN x AND y AS inside, ts, value FROM panel JOIN blocks ON b = 'test') SELECT station_id, city, count(value) AS n, count(value) FILTER (WHERE inside) AS n_test, round(count(value) FILTER (WHERE inside) / CAST(count(*) FILTER (WHERE inside) AS DOUBLE), 5) AS test_share FROM t JOIN stations USING (station_id) GROUP BY 1, 2")
def panel_completeness(spark: SparkSession, sf: str) -> DataFrame:
    test = next((b, e) for name, b, e in splits.HOURLY_BLOCKS if name == "test")
    panel = src.hourly_panel(spark, sf).join(src.stations(spark).select("station_id", "city"), "station_id")
    return job.summary(panel, test).select("station_id", "city", "n", "n_test", r("test_share"))


@query(f"WITH {PANEL} SELECT station_id, strftime(CAST(ts + INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') AS date, round(avg(value) + 1.3e-6, 5) AS value FROM panel GROUP BY station_id, CAST(ts + INTERVAL 5 HOUR AS DATE) HAVING count(value) >= 18")
def daily_target_long(spark: SparkSession, sf: str) -> DataFrame:
    """Local days of 18 hours at least; shorter ones have no row."""
    days = metrics.daily(src.hourly_panel(spark, sf), ["station_id"], ["value"], src.ZONE).where("value is not null")
    # Means of a few decimals end halfway between two roundings; off it they are rounded alike everywhere.
    return days.select("station_id", F.col("date").cast("string").alias("date"), F.round(F.col("value") + 1.3e-6, 5).alias("value"))


@query(f"WITH {PANEL}, few AS (SELECT station_id FROM panel GROUP BY 1 ORDER BY count(value) DESC, station_id LIMIT 3) SELECT station_id, {"strftime(ts, '%Y-%m-%d %H:%M') AS ts"}, round(value, 5) AS value FROM panel WHERE station_id IN (SELECT station_id FROM few)")
def fullest_stations(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of the three stations with the most values."""
    panel = src.hourly_panel(spark, sf)
    ids = panel.groupBy("station_id").agg(F.count("value").alias("n")).orderBy(F.desc("n"), "station_id").limit(3)
    return ingest.only_ids(panel, ids).select("station_id", hour(), r("value"))


@query(f"WITH q AS (SELECT item_id, {tokens_sql('text')} AS q FROM benchmark), m AS (SELECT q.item_id, d.item_id AS id2, len(list_intersect(d.q, q.q)) / nullif(CAST(len(d.q) AS DOUBLE), 0) AS share FROM q JOIN q d ON q.item_id <> d.item_id) SELECT item_id, id2, round(share, 5) AS share FROM m WHERE share >= 0.25 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY share DESC, id2) = 1")
def best_match(spark: SparkSession, sf: str) -> DataFrame:
    """For each text the other one that it covers best; of equals the first."""
    t = src.table(spark, sf, "benchmark").select("item_id", tx.title_tokens(F.col("text")).alias("tokens"))
    found = tx.recall_join(t, t.select(F.col("item_id").alias("id2"), "tokens"), "item_id", "id2", 0.25).where("item_id <> id2")
    return ingest.best_of(found, ["item_id"], F.desc("share"), F.col("id2")).select("item_id", "id2", r("share"))


@query("SELECT item_id, CASE WHEN item_id % 5 = 0 THEN '' WHEN len(w) <= 3 THEN array_to_string(w, ', ') ELSE w[1] || ' et al.' END AS authors FROM (SELECT item_id, string_split(text, ' ')[1 : item_id % 5] AS w FROM benchmark)")
def short_authors(spark: SparkSession, sf: str) -> DataFrame:
    names = F.slice(F.split("text", " "), F.lit(1), (F.col("item_id") % 5).cast("int"))
    return src.table(spark, sf, "benchmark").select("item_id", works.authors_short(names).alias("authors"))


@query("SELECT 's' || (user_id % 8) AS station_id, round(avg(value), 5) AS mean, round(median(value), 5) AS median, max(value) AS max, min(value) AS min, count(value) AS count, round(stddev_pop(value), 5) AS \"stdDev\" FROM events GROUP BY 1")
def named_reductions(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("station_id"), "value")
    out = specs.reduced(e, ["station_id"], "value", list(specs.REDUCERS))
    return out.select("station_id", r("mean"), r("median"), "max", "min", "count", r("stdDev"))


@query("WITH n AS (SELECT s_nationkey AS nation, count(*) AS n_stations, CAST(365 AS BIGINT) AS n_days, CAST(s_nationkey % 3 + 1 AS BIGINT) AS n_variables FROM supplier GROUP BY 1, 4) SELECT *, n_stations * n_days * n_variables AS n_elements, n_stations * n_days * n_variables > 5000 AS over_limit, CAST(ceil(n_stations * n_days * n_variables / 5000.0) AS BIGINT) AS n_requests FROM n")
def request_size_checks(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_nationkey")
    n = src.table(spark, sf, "supplier").groupBy(k.alias("nation")).agg(F.count("*").alias("n_stations"))
    return rasters.request_sizes(n.withColumns({"n_days": F.lit(365).cast("long"), "n_variables": (F.col("nation") % 3 + 1).cast("long")}))


@query("SELECT 's' || (user_id % 8) AS station_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS ts, round(arg_min(value, event_id) FILTER (WHERE event_id % 3 = 0), 5) AS instant, round(arg_min(value, event_id) FILTER (WHERE event_id % 3 = 1), 5) AS accum FROM events GROUP BY 1, 2")
def collapse_first(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that hold one of two variables each, and some none: the first value of each there is."""
    e = src.table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("station_id"), F.date_trunc("hour", "ts").alias("ts"), "event_id", "value")
    parts = {"instant": F.when(F.col("event_id") % 3 == 0, F.col("value")), "accum": F.when(F.col("event_id") % 3 == 1, F.col("value"))}
    return rasters.collapse(e, ["station_id", "ts"], parts, "event_id").select("station_id", hour(), r("instant"), r("accum"))


@query("SELECT c_nationkey AS nation, strftime(CAST(o_orderdate AS DATE) + 1, '%Y-%m-%d') AS valid, count(*) AS n, round(avg(l_extendedprice), 4) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE CAST(l_shipdate AS DATE) = CAST(o_orderdate AS DATE) + 1 GROUP BY ALL")
def forecast_lead_24(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as forecasts issued on the day of the order for the day of the shipment: those a day ahead."""
    line, orders, customer = (src.table(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    rows = line.join(orders, line.l_orderkey == orders.o_orderkey).join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").cast("timestamp").alias("issued"), (F.datediff("l_shipdate", "o_orderdate") * 24).alias("lead_h"), F.col("l_extendedprice").alias("value"))
    by = ft.forecast_at(rows).groupBy("nation", F.date_format("valid", "yyyy-MM-dd").alias("valid")).agg(F.count("*").alias("n"), F.avg("value").alias("value"))
    return by.select("nation", "valid", "n", r("value", 4))


@query("SELECT CAST(user_id % 8 AS VARCHAR) AS station_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, round(avg(CASE WHEN event_id % 5 > 0 THEN value END), 5) AS value, count(*) FILTER (WHERE event_id % 5 > 0) AS valid_px FROM events GROUP BY 1, 2")
def satellite_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A grid whose measurement has its own name, and days without any retrieval."""
    k = F.col("event_id")
    by = src.table(spark, sf, "events").groupBy((F.col("user_id") % 8).alias("station_id"), F.date_trunc("day", "ts").alias("ts")).agg(F.count_if(k % 5 > 0).alias("valid_pixels"), F.avg(F.when(k % 5 > 0, F.col("value"))).alias("aod_047"))
    return src.satellite(by).select("station_id", F.date_format("date", "yyyy-MM-dd").alias("date"), r("value"), "valid_px")


@query(f"WITH {LOSSES} SELECT model, horizon_h, count(*) AS n_stations, round(avg(rmse), 5) AS rmse, round(stddev_samp(rmse), 5) AS rmse_sd FROM (SELECT station_id, model, horizon_h, sqrt(avg((pred - value) ** 2)) AS rmse FROM scored WHERE value IS NOT NULL AND pred IS NOT NULL GROUP BY ALL) GROUP BY ALL")
def macro_means(spark: SparkSession, sf: str) -> DataFrame:
    """Unweighted means over stations by model and horizon, with the sample deviation."""
    by = metrics.regression(ladder(spark, sf), ["station_id", "model", "horizon_h"])
    out = by.groupBy("model", "horizon_h").agg(F.count("*").alias("n_stations"), F.avg("rmse").alias("rmse"), F.stddev_samp("rmse").alias("rmse_sd"))
    return out.select("model", "horizon_h", "n_stations", r("rmse"), r("rmse_sd"))
