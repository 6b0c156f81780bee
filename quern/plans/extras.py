"""Queries on requests, composites, coverage, reshaping and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import text as tx
from quern.operators import qc, rasters
from quern.plans.daily import daily, tokens_sql
from quern.plans.hourly import COMPOSITE, LADDER, PANEL, composites, hour, ladder, r
from quern.plans.registry import DAILY, query
from quern.sources import tables as src


@query(f"WITH {DAILY}, s AS (SELECT min(date) AS a, max(date) AS z FROM daily), c AS (SELECT CAST(unnest(generate_series(a, z, INTERVAL 200 DAY)) AS DATE) AS f, z FROM s) SELECT strftime(f, '%Y-%m-%d') AS date_from, strftime(least(f + 199, z), '%Y-%m-%d') AS date_to FROM c")
def chunk_date_range(spark: SparkSession, sf: str) -> DataFrame:
    span = daily(spark, sf).agg(F.min("date").alias("a"), F.max("date").alias("z"))
    return rasters.date_chunks(span, 25).select(F.col("date_from").cast("string").alias("date_from"), F.col("date_to").cast("string").alias("date_to"))


@query(f"WITH {DAILY}, s AS (SELECT date_trunc('month', min(date)) AS a, date_trunc('month', max(date)) AS z FROM daily), m AS (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS m FROM s), b AS (SELECT CAST(extract(year FROM m) AS INT) AS year, CAST(floor((row_number() OVER (PARTITION BY extract(year FROM m) ORDER BY m) - 1) / 5) AS BIGINT) AS block FROM m) SELECT year, block, count(*) AS n FROM b GROUP BY ALL")
def month_blocks(spark: SparkSession, sf: str) -> DataFrame:
    span = daily(spark, sf).agg(F.trunc(F.min("date"), "month").alias("a"), F.trunc(F.max("date"), "month").alias("z"))
    return rasters.year_blocks(span.select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("m")), 5)


@query("WITH c AS (SELECT 's' || (user_id % 8) AS station_id, CAST(ts AS DATE) AS d, event_type, avg(value) AS v FROM events GROUP BY ALL) SELECT station_id, strftime(d, '%Y-%m-%d') AS date, round(avg(v), 5) AS value, count(v) AS valid_cells FROM c GROUP BY station_id, d")
def daily_composite(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("station_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("cell"), F.col("value").alias("v"))
    return rasters.daily_composite(e, ["station_id", "date"], "cell", "v").select("station_id", "date", r("value"), "valid_cells")


@query("SELECT 's' || (user_id % 8) AS station_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS ts, round(max(CASE WHEN event_id % 2 = 0 THEN value END), 5) AS instant, round(max(CASE WHEN event_id % 2 = 1 THEN value END), 5) AS accum FROM events GROUP BY 1, 2")
def instant_accum_collapse(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select(F.concat(F.lit("s"), F.col("user_id") % 8).alias("station_id"), F.date_trunc("hour", "ts").alias("ts"), "event_id", "value")
    parts = {"instant": F.when(F.col("event_id") % 2 == 0, F.col("value")), "accum": F.when(F.col("event_id") % 2 == 1, F.col("value"))}
    return rasters.collapse(e, ["station_id", "ts"], parts).select("station_id", hour(), r("instant"), r("accum"))


@query(f"WITH {PANEL}, c AS (SELECT event_type, min(ts) AS a, max(ts) AS z FROM events GROUP BY 1) SELECT event_type, b AS block, a <= x AND z >= y AS covers FROM c CROSS JOIN blocks")
def collection_coverage(spark: SparkSession, sf: str) -> DataFrame:
    from quern.operators.splits import blocks

    c = src.table(spark, sf, "events").groupBy("event_type").agg(F.min("ts").alias("a"), F.max("ts").alias("z"))
    return c.crossJoin(F.broadcast(blocks(spark))).select("event_type", "block", ((F.col("a") <= F.col("begin")) & (F.col("z") >= F.col("end"))).alias("covers"))


@query("SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 5")
def provider_histogram(spark: SparkSession, sf: str) -> DataFrame:
    s, n = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "n_name").limit(5)


@query("SELECT s_nationkey, s_suppkey FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) <= 2")
def stratified_head(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    return src.table(spark, sf, "supplier").withColumn("_rn", F.row_number().over(w)).where("_rn <= 2").select("s_nationkey", "s_suppkey")


@query(f"WITH {PANEL} SELECT strftime(ts, '%Y-%m-%d %H:%M') AS ts, " + ", ".join(f"round(max(CASE WHEN station_id = 's{i}' THEN value END), 5) AS s{i}" for i in range(8)) + " FROM panel GROUP BY panel.ts")
def panel_pivot(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"s{i}" for i in range(8)]
    return src.hourly_panel(spark, sf).groupBy("ts").pivot("station_id", names).agg(F.first("value")).select(hour(), *[r(n) for n in names])


@query(f"WITH {DAILY}, d AS (SELECT * FROM daily WHERE n >= 3), l AS (SELECT station_id, date, 'target' AS name, target AS value FROM d UNION ALL SELECT station_id, date, 'forecast', forecast FROM d) SELECT station_id, name, count(value) AS n, round(avg(value), 5) AS mean FROM l GROUP BY ALL")
def daily_unpivot(spark: SparkSession, sf: str) -> DataFrame:
    long = daily(spark, sf).where("n >= 3").unpivot(["station_id", "date"], ["target", "forecast"], "name", "value")
    return long.groupBy("station_id", "name").agg(F.count("value").alias("n"), F.round(F.avg("value"), 5).alias("mean"))


@query(f"WITH t AS (SELECT item_id, {tokens_sql('text')} AS t FROM benchmark) SELECT item_id, len(list_filter(['erer', 'thea'], lambda x: NOT list_contains(t, x))) = 0 AS passes FROM t")
def required_token_gate(spark: SparkSession, sf: str) -> DataFrame:
    need = F.array(F.lit("erer"), F.lit("thea"))
    return src.table(spark, sf, "benchmark").select("item_id", (F.size(F.array_except(need, tx.title_tokens(F.col("text")))) == 0).alias("passes"))


@query(f"WITH {LADDER} SELECT station_id, model, horizon_h, count(*) AS n, count(*) >= 100 AS enough FROM scored WHERE value IS NOT NULL AND pred IS NOT NULL GROUP BY ALL")
def minimum_support(spark: SparkSession, sf: str) -> DataFrame:
    return ladder(spark, sf).where("value is not null and pred is not null").groupBy("station_id", "model", "horizon_h").agg(F.count("*").alias("n"), (F.count("*") >= 100).alias("enough"))


@query(
    f"""WITH {COMPOSITE}, pb AS (SELECT station_id, CASE WHEN extract(day FROM ts) <= 15 THEN 1 ELSE 2 END AS period, CAST(extract(hour FROM ts + INTERVAL 5 HOUR) AS INT) AS hour, CASE WHEN count(value) >= 5 THEN avg(value) END AS m FROM panel GROUP BY ALL),
pz AS (SELECT station_id, period, hour, m FROM pb), full24 AS (SELECT station_id, period FROM pz GROUP BY ALL HAVING count(m) = 24),
pc AS (SELECT station_id, period, lag, corr(m, ref) AS r FROM pz JOIN full24 USING (station_id, period) CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS lag) JOIN ref ON ref.hour = (pz.hour - lag + 24) % 24 GROUP BY ALL),
bl AS (SELECT station_id, period, CASE WHEN lag > 12 THEN lag - 24 ELSE lag END AS lag_hours FROM pc WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id, period ORDER BY round(r, 10) DESC, lag) = 1),
df AS (SELECT *, coalesce(lag_hours - lag(lag_hours) OVER (PARTITION BY station_id ORDER BY period), 0) AS change FROM bl)
SELECT station_id, period, lag_hours, change, abs(change) > 1 AS suspected FROM df"""
)
def offset_change_by_period(spark: SparkSession, sf: str) -> DataFrame:
    """Periods with all 24 hours; their lag behind the whole panel's reference, and how it changes."""
    panel = src.hourly_panel(spark, sf).withColumn("period", F.when(F.dayofmonth("ts") <= 15, 1).otherwise(2))
    keys = ["station_id", "period"]
    shapes = qc.diurnal_composite(panel, keys, src.ZONE, least_bins=24)
    best = qc.best_lag(qc.lag_correlations(shapes, qc.median_composite(composites(spark, sf), []), keys, []), keys)
    change = F.coalesce(F.col("lag_hours") - F.lag("lag_hours").over(Window.partitionBy("station_id").orderBy("period")), F.lit(0))
    return best.select(*keys, "lag_hours", change.alias("change")).withColumn("suspected", F.abs("change") > 1)


@query(f"WITH {PANEL}, f AS (SELECT station_id, min(ts) FILTER (WHERE value IS NOT NULL) AS a, max(ts) FILTER (WHERE value IS NOT NULL) AS z, count(value) AS n FROM panel GROUP BY 1) SELECT station_id, strftime(a, '%Y-%m-%d %H:%M') AS first_valid, strftime(z, '%Y-%m-%d %H:%M') AS last_valid, n FROM f")
def panel_summary(spark: SparkSession, sf: str) -> DataFrame:
    seen = F.when(F.col("value").isNotNull(), F.col("ts"))
    f = src.hourly_panel(spark, sf).groupBy("station_id").agg(F.min(seen).alias("a"), F.max(seen).alias("z"), F.count("value").alias("n"))
    return f.select("station_id", F.date_format("a", "yyyy-MM-dd HH:mm").alias("first_valid"), F.date_format("z", "yyyy-MM-dd HH:mm").alias("last_valid"), "n")
