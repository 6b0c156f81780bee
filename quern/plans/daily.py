"""Queries on the daily panel and on the dimension tables: features, bias, missingness, ranks, geography, text and learning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import text as tx
from quern.operators import features as ft, learned, metrics, splits, stats
from quern.plans.hourly import REGRESSION, ROUNDED, r
from quern.plans.registry import DAILY, query
from quern.sources import tables as src

SQL_D = "strftime(date, '%Y-%m-%d') AS date"
TRAIN_END = "1998-12-31"
LEAST_ROWS = 3  # of a day


def day():
    return F.date_format("date", "yyyy-MM-dd").alias("date")


def daily(spark: SparkSession, sf: str) -> DataFrame:
    return src.daily_panel(spark, sf)


def target(spark: SparkSession, sf: str) -> DataFrame:
    return daily(spark, sf).where(F.col("n") >= LEAST_ROWS)


TARGET = f"{DAILY}, t AS (SELECT * FROM daily WHERE n >= 3)"


@query(f"WITH {TARGET} SELECT station_id, city, {SQL_D}, round(target, 5) AS target FROM t")
def daily_target(spark: SparkSession, sf: str) -> DataFrame:
    return target(spark, sf).select("station_id", "city", day(), r("target"))


@query(f"WITH {TARGET} SELECT DISTINCT {SQL_D}, round(sin(2 * pi() * extract(doy FROM date) / 365.25), 8) AS doy_sin, round(cos(2 * pi() * extract(doy FROM date) / 365.25), 8) AS doy_cos, CAST(extract(month FROM date) AS BIGINT) AS month, CAST(extract(isodow FROM date) - 1 AS BIGINT) AS dow, CAST(extract(month FROM date) IN (10, 11, 12, 1, 2, 3) AS BIGINT) AS is_heating_season FROM t")
def calendar_encodings(spark: SparkSession, sf: str) -> DataFrame:
    days = target(spark, sf).select("date").distinct().withColumns(ft.calendar(F.col("date")))
    return days.select(day(), r("doy_sin", 8), r("doy_cos", 8), "month", "dow", "is_heating_season")


LAG = "OVER (PARTITION BY station_id ORDER BY date)"
LAGGED = f"{TARGET}, l AS (SELECT *, lag(target, 1) {LAG} AS lag_1, lag(target, 2) {LAG} AS lag_2, lag(target, 7) {LAG} AS lag_7 FROM t)"


@query(f"WITH {LAGGED} SELECT station_id, {SQL_D}, round(lag_1, 5) AS lag_1, round(lag_2, 5) AS lag_2, round(lag_7, 5) AS lag_7, round(lag_1 - lag_2, 5) AS delta FROM l")
def local_lags(spark: SparkSession, sf: str) -> DataFrame:
    return ft.local_lags(target(spark, sf)).select("station_id", day(), *[r(c) for c in ("lag_1", "lag_2", "lag_7", "delta")])


def rolling(n: int) -> str:
    w = f"OVER (PARTITION BY station_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"round(CASE WHEN count(lag_1) {w} >= {max(2, n // 3)} THEN avg(lag_1) {w} END, 4) AS mean_{n}"


@query(f"WITH {LAGGED} SELECT station_id, {SQL_D}, {rolling(7)}, {rolling(30)} FROM l")
def rolling_means(spark: SparkSession, sf: str) -> DataFrame:
    return ft.local_lags(target(spark, sf)).select("station_id", day(), r("mean_7", 4), r("mean_30", 4))


@query(f"WITH {TARGET} SELECT a.station_id, strftime(a.date, '%Y-%m-%d') AS date, round(avg(b.target), 4) AS nb_mean, count(b.target) AS nb_n FROM t a LEFT JOIN t b ON a.date = b.date AND a.station_id <> b.station_id AND b.city <> 'r0' GROUP BY a.station_id, a.date")
def spatial_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return ft.neighbours(target(spark, sf), "r0").select("station_id", day(), r("nb_mean", 4), F.col("nb_n").cast("long").alias("nb_n"))


@query(f"WITH {TARGET} SELECT station_id, count(*) AS n, count(*) FILTER (WHERE date <= DATE '{TRAIN_END}') AS n_train, count(*) FILTER (WHERE date <= DATE '{TRAIN_END}') = 0 AS zero_shot FROM t GROUP BY 1")
def training_coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = F.count_if(F.col("date") <= F.lit(TRAIN_END).cast("date"))
    return target(spark, sf).groupBy("station_id").agg(F.count("*").alias("n"), n.alias("n_train"), (n == 0).alias("zero_shot"))


@query(f"WITH {DAILY}, a AS (SELECT station_id, date, aod FROM daily WHERE valid_px > 0), b AS (SELECT station_id, date, forecast FROM daily WHERE n >= 3) SELECT coalesce(a.station_id, b.station_id) AS station_id, strftime(coalesce(a.date, b.date), '%Y-%m-%d') AS date, round(aod, 6) AS aod, round(forecast, 5) AS forecast FROM a FULL JOIN b ON a.station_id = b.station_id AND a.date = b.date")
def satellite_outer_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    a, b = d.where("valid_px > 0").select("station_id", "date", "aod"), d.where("n >= 3").select("station_id", "date", "forecast")
    return a.join(b, ["station_id", "date"], "fullouter").select("station_id", day(), r("aod", 6), r("forecast"))


@query(f"WITH {LAGGED}, f AS (SELECT l.*, nb.nb_mean FROM l LEFT JOIN (SELECT a.station_id, a.date, avg(b.target) AS nb_mean FROM t a JOIN t b ON a.date = b.date AND a.station_id <> b.station_id GROUP BY ALL) nb USING (station_id, date)) SELECT station_id, city, {SQL_D}, round(target, 5) AS target, round(aod, 6) AS aod, valid_px, round(forecast, 5) AS forecast, round(lag_1, 5) AS lag_1, round(nb_mean, 4) AS nb_mean, CAST(extract(month FROM date) AS BIGINT) AS month FROM f")
def feature_table(spark: SparkSession, sf: str) -> DataFrame:
    t = target(spark, sf)
    full = ft.local_lags(t).join(ft.neighbours(t), ["station_id", "date"], "left").withColumns(ft.calendar(F.col("date")))
    return full.select("station_id", "city", day(), r("target"), r("aod", 6), "valid_px", r("forecast"), r("lag_1"), r("nb_mean", 4), "month")


BIAS = f"{TARGET}, bias AS (SELECT station_id, avg(forecast - target) AS bias, count(*) AS n FROM t WHERE date <= DATE '{TRAIN_END}' GROUP BY 1 HAVING count(*) >= 30)"


@query(f"WITH {BIAS} SELECT station_id, round(bias, 5) AS bias, n FROM bias")
def forecast_bias_table(spark: SparkSession, sf: str) -> DataFrame:
    return ft.station_bias(target(spark, sf), TRAIN_END).select("station_id", r("bias"), "n")


@query(f"WITH {BIAS} SELECT t.station_id, {SQL_D}, round(forecast - coalesce(bias, (SELECT coalesce(avg(bias), 0) FROM bias)), 4) AS debiased FROM t LEFT JOIN bias USING (station_id)")
def debias_local(spark: SparkSession, sf: str) -> DataFrame:
    t = target(spark, sf)
    return ft.debias_local(t, ft.station_bias(t, TRAIN_END)).select("station_id", day(), r("debiased", 4))


@query(f"WITH {BIAS}, c AS (SELECT DISTINCT station_id, city FROM daily) SELECT h.city AS held_out_city, round(coalesce(avg(bias) FILTER (WHERE c.city <> h.city), 0), 5) AS pooled FROM (SELECT DISTINCT city FROM c) h CROSS JOIN c LEFT JOIN bias USING (station_id) GROUP BY 1")
def debias_pooled_loco(spark: SparkSession, sf: str) -> DataFrame:
    d = daily(spark, sf)
    return ft.pooled_bias(ft.station_bias(target(spark, sf), TRAIN_END), d.select("station_id", "city").distinct()).select("held_out_city", r("pooled"))


@query(f"WITH {TARGET} SELECT city, count(*) AS n, round(100 * avg(CAST(aod IS NOT NULL AS INT)), 4) AS pct, round(median(target) FILTER (WHERE aod IS NULL) - median(target) FILTER (WHERE aod IS NOT NULL), 4) AS d_median FROM t GROUP BY 1")
def retrieval_missingness(spark: SparkSession, sf: str) -> DataFrame:
    return ft.missingness(target(spark, sf), "aod", ["city"]).select("city", "n", r("pct", 4), r("d_median", 4))


@query(f"WITH {TARGET} SELECT CAST(extract(month FROM date) AS INT) AS month, count(*) AS n, round(100 * avg(CAST(aod IS NOT NULL AS INT)), 4) AS pct FROM t GROUP BY 1")
def retrieval_by_month(spark: SparkSession, sf: str) -> DataFrame:
    return ft.missingness(target(spark, sf).withColumn("month", F.month("date")), "aod", ["month"]).select("month", "n", r("pct", 4))


@query(f"WITH {DAILY} SELECT round(100 * avg(CAST(a AND b AS INT)), 4) AS pct_both, round(100 * avg(CAST(a AND NOT b AS INT)), 4) AS pct_first, round(100 * avg(CAST(NOT a AND NOT b AS INT)), 4) AS pct_neither, round(100 * avg(CAST(a OR b AS INT)), 4) AS pct_either FROM (SELECT aod IS NOT NULL AS a, n >= 3 AS b FROM daily)")
def complementarity(spark: SparkSession, sf: str) -> DataFrame:
    a, b = F.col("aod").isNotNull(), F.col("n") >= 3
    pct = lambda c, name: F.round(100 * F.avg(c.cast("int")), 4).alias(name)
    return daily(spark, sf).agg(pct(a & b, "pct_both"), pct(a & ~b, "pct_first"), pct(~a & ~b, "pct_neither"), pct(a | b, "pct_either"))


RANKS = f"{TARGET}, x AS (SELECT city, target, aod IS NULL AS gone, rank() OVER (PARTITION BY city ORDER BY target) + (count(*) OVER (PARTITION BY city, target) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY city, target) AS same FROM t), s AS (SELECT city, CAST(count(*) FILTER (WHERE gone) AS DOUBLE) AS n1, CAST(count(*) FILTER (WHERE NOT gone) AS DOUBLE) AS n2, sum(rk) FILTER (WHERE gone) AS r1, sum(CAST(same AS DOUBLE) ** 2 - 1) AS ties FROM x GROUP BY 1)"


@query(f"WITH {RANKS} SELECT city, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, r1 - n1 * (n1 + 1) / 2 AS u, round((abs(r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) - 0.5) / nullif(sqrt(n1 * n2 / 12 * ((n1 + n2 + 1) - ties / ((n1 + n2) * (n1 + n2 - 1)))), 0), 5) AS z FROM s")
def mann_whitney_u(spark: SparkSession, sf: str) -> DataFrame:
    return stats.mann_whitney(target(spark, sf).withColumn("gone", F.col("aod").isNull()), ["city"], "target", "gone").select("city", "n1", "n2", "u", r("z"))


@query(f"WITH {TARGET}, x AS (SELECT city, rank() OVER (PARTITION BY city ORDER BY target) + (count(*) OVER (PARTITION BY city, target) - 1) / 2.0 AS a, rank() OVER (PARTITION BY city ORDER BY forecast) + (count(*) OVER (PARTITION BY city, forecast) - 1) / 2.0 AS b FROM (SELECT city, round(target, 6) AS target, round(forecast, 6) AS forecast FROM t)) SELECT city, count(*) AS n, round(corr(a, b), 5) AS rho FROM x GROUP BY 1")
def spearman_by_city(spark: SparkSession, sf: str) -> DataFrame:
    t = target(spark, sf).select("city", r("target", 6), r("forecast", 6))
    return stats.spearman(t, ["city"], "target", "forecast").select("city", "n", r("rho"))


@query(f"WITH {TARGET} SELECT city, {REGRESSION} FROM (SELECT city, target AS value, forecast AS pred, avg(target) OVER (PARTITION BY city) AS ybar FROM t) GROUP BY 1")
def regression_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression(target(spark, sf), ["city"], "target", "forecast").select("city", "n", *[r(c) for c in ROUNDED])


@query(f"WITH {DAILY} SELECT station_id, CASE WHEN date <= DATE '1998-12-31' AND date >= DATE '1995-01-01' THEN 'train' WHEN date BETWEEN DATE '1999-01-11' AND DATE '1999-12-31' THEN 'val' WHEN date BETWEEN DATE '2000-01-11' AND DATE '2000-12-31' THEN 'test' WHEN date BETWEEN DATE '1995-01-01' AND DATE '2000-12-31' THEN 'purge' END AS block, count(*) AS n FROM daily GROUP BY ALL")
def daily_block_assignment(spark: SparkSession, sf: str) -> DataFrame:
    block = splits.block_of(F.col("date").cast("timestamp_ntz"), splits.DAILY_BLOCKS)
    return daily(spark, sf).groupBy("station_id", block.alias("block")).agg(F.count("*").alias("n"))


# --- geography and calendars ---

@query("WITH b AS (SELECT date_trunc('month', min(ts)) AS a, date_trunc('month', max(ts)) AS z FROM events), m AS (SELECT unnest(generate_series(a, z, INTERVAL 1 MONTH)) AS m FROM b) SELECT strftime(m, '%Y-%m-%d') AS date_from, strftime(m + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS date_to FROM m")
def month_chunks(spark: SparkSession, sf: str) -> DataFrame:
    span = src.table(spark, sf, "events").agg(F.trunc(F.min("ts"), "month").alias("a"), F.trunc(F.max("ts"), "month").alias("z"))
    m = span.select(F.explode(F.sequence("a", "z", F.expr("interval 1 month"))).alias("m"))
    return m.select(F.date_format("m", "yyyy-MM-dd").alias("date_from"), F.date_format(F.last_day("m"), "yyyy-MM-dd").alias("date_to"))


@query(f"WITH {DAILY} SELECT station_id, CAST(floor(date_diff('day', DATE '1995-01-01', date) / 200) AS BIGINT) AS chunk, count(*) AS n_returned, 200 AS n_expected, count(*) = 200 AS complete FROM daily GROUP BY 1, 2")
def request_blocks(spark: SparkSession, sf: str) -> DataFrame:
    chunk = F.floor(F.datediff("date", F.lit("1995-01-01").cast("date")) / 200)
    by = daily(spark, sf).groupBy("station_id", chunk.cast("long").alias("chunk")).agg(F.count("*").alias("n_returned"))
    return by.withColumns({"n_expected": F.lit(200), "complete": F.col("n_returned") == 200})


# --- text ---

STOP = ", ".join(f"'{w}'" for w in tx.STOPWORDS)


def tokens_sql(text: str) -> str:
    return f"list_distinct(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: length(w) > 2 AND w NOT IN ({STOP})))"


@query(f"WITH q AS (SELECT item_id, {tokens_sql('text')} AS q FROM benchmark), m AS (SELECT q.item_id, d.item_id AS id2, len(list_intersect(d.q, q.q)) / nullif(CAST(len(d.q) AS DOUBLE), 0) AS share FROM q JOIN q d ON true) SELECT item_id, id2, round(share, 5) AS share, true AS matches FROM m WHERE share >= 0.62")
def token_recall_match(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of items where the one's whole text has 62 % or more of the other's tokens."""
    t = src.table(spark, sf, "benchmark").select("item_id", tx.title_tokens(F.col("text")).alias("tokens"))
    found = tx.recall_join(t, t.select(F.col("item_id").alias("id2"), "tokens"), "item_id", "id2", 0.62)
    return found.select("item_id", "id2", F.round("share", 5).alias("share"), F.lit(True).alias("matches"))


@query(f"WITH a AS (SELECT page_id, {tokens_sql("regexp_extract(html, '<title>([^<]*)', 1)")} AS a, {tokens_sql("regexp_extract(html, '<h1>([^<]*)', 1)")} AS b FROM pages) SELECT page_id, round(len(list_intersect(a, b)) / nullif(CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 0), 5) AS jaccard, coalesce(len(list_intersect(a, b)) / nullif(CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 0) >= 0.85, false) AS same FROM a")
def jaccard_identity(spark: SparkSession, sf: str) -> DataFrame:
    tag = lambda name: tx.title_tokens(F.regexp_extract("html", f"<{name}>([^<]*)", 1))
    p = src.table(spark, sf, "pages").select("page_id", tag("title").alias("a"), tag("h1").alias("b"))
    j = tx.jaccard(F.col("a"), F.col("b"))
    return p.select("page_id", F.round(j, 5).alias("jaccard"), F.coalesce(j >= 0.85, F.lit(False)).alias("same"))


@query("SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS title FROM pages")
def strip_tags(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("title"))


MISSING = "(" + ", ".join(f"'{m}'" for m in tx.MISSING) + ")"
NAMED = """l AS (SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN n_name WHEN 1 THEN 'N/A' WHEN 2 THEN '  ' WHEN 3 THEN ' -- ' END AS loc,
 CASE s_suppkey % 7 WHEN 0 THEN 'US Diplomatic Post: ' || s_name WHEN 1 THEN 'us embassy ' || s_name WHEN 2 THEN 'US Consulate' WHEN 3 THEN 'StateAir: : ' || s_name WHEN 4 THEN 'unknown' WHEN 5 THEN ' ' || s_name || ' ' END AS nm FROM supplier JOIN nation ON s_nationkey = n_nationkey),
p AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(nm), '^us diplomatic post:[: ]*', '', 'i'), '^us embassy[: ]*', '', 'i'), '^us consulate[: ]*', '', 'i'), '^stateair[: ]*', '', 'i')) AS lab FROM l)"""


def named_places(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, loc, nm): localities and names, many of which mean a missing value."""
    s, n = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation")
    pick = lambda m, *values: F.get(F.array(*[v if v is not None else F.lit(None).cast("string") for v in values]), (F.col("s_suppkey") % m).cast("int"))
    name = F.col("s_name")
    names = [F.concat(F.lit("US Diplomatic Post: "), name), F.concat(F.lit("us embassy "), name), F.lit("US Consulate"), F.concat(F.lit("StateAir: : "), name), F.lit("unknown"), F.concat(F.lit(" "), name, F.lit(" ")), None]
    return s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", pick(5, F.col("n_name"), F.lit("N/A"), F.lit("  "), F.lit(" -- "), None).alias("loc"), pick(7, *names).alias("nm"))


@query(f"WITH {NAMED} SELECT s_suppkey, CASE WHEN loc IS NOT NULL AND trim(loc) <> '' AND lower(trim(loc)) NOT IN {MISSING} THEN trim(loc) WHEN nm IS NULL OR trim(nm) = '' OR lower(trim(nm)) IN {MISSING} OR lab = '' OR lower(lab) IN {MISSING} THEN NULL ELSE lab END AS city FROM p")
def city_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return named_places(spark, sf).select("s_suppkey", tx.city_of(F.col("loc"), F.col("nm")).alias("city"))


@query("SELECT source, count(*) AS n, count(*) FILTER (WHERE trim(lang) = '' OR lower(trim(lang)) IN ('n/a', 'na', 'n.a.', 'none', 'null', 'nil', 'unknown', '-', '--', '?') OR lang IS NULL) AS n_missing FROM documents GROUP BY 1")
def missing_sentinels(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(tx.is_missing(F.col("lang"))).alias("n_missing"))


# --- learning ---


@query()
def ridge_forecast(spark: SparkSession, sf: str) -> DataFrame:
    return learned.score(learned.ridge(learned.design(target(spark, sf))), ["station_id"])


@query()
def feature_importance_by_family(spark: SparkSession, sf: str) -> DataFrame:
    return learned.importance(learned.design(target(spark, sf)))
