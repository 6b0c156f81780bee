"""Queries on records, census rows, feature descriptions, works and the whole run of quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import ingest, merge, metrics, nowcast as nc, qc, specs, stats, works
from quern.plans.daily import DAILY, MISSING, NAMED, day, named_places, target, tokens_sql
from quern.plans.hourly import COMPOSITE, LADDER, MASKS, MERGED, NOWCASTS, WRAP, composites, hour, ladder, level, nowcasts, r, test_block, train_block
from quern.plans.registry import PANEL, query
from quern.sources import sinks, tables as src

# --- ingestion ---

RECORDS = "recs AS (SELECT user_id % 8 AS sensor_id, event_id AS position, CASE WHEN event_id % 17 <> 0 THEN strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%SZ') WHEN event_id % 2 = 0 THEN 'n/a' END AS period_start, value, event_id % 101 AS percent_complete FROM events)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly records of eight sensors, some without a readable start, several for many hours."""
    e, k = src.table(spark, sf, "events"), F.col("event_id")
    start = F.when(k % 17 != 0, F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k % 2 == 0, "n/a")
    return e.select((F.col("user_id") % 8).alias("sensor_id"), k.alias("position"), start.alias("period_start"), "value", (k % 101).alias("percent_complete"))


@query(f"WITH {RECORDS} SELECT sensor_id, replace(left(period_start, 16), 'T', ' ') AS ts, round(value, 5) AS value, CAST(percent_complete AS DOUBLE) AS percent_complete FROM recs WHERE length(period_start) = 20 QUALIFY row_number() OVER (PARTITION BY sensor_id, period_start ORDER BY position) = 1")
def records_to_series(spark: SparkSession, sf: str) -> DataFrame:
    s = ingest.records_to_series(records(spark, sf), ["sensor_id"])
    return s.select("sensor_id", hour(), r("value"), "percent_complete")


@query(f"WITH {RECORDS}, w AS (SELECT DISTINCT user_id % 8 AS sensor_id, CAST(ts AS DATE) AS d FROM events), n AS (SELECT user_id % 8 AS sensor_id, CAST(ts AS DATE) AS d, count(*) AS n_records FROM events GROUP BY ALL) SELECT sensor_id, strftime(d, '%Y-%m-%d') AS date, n_records, 24 AS expected_hours, n_records > 24 * 1.05 + 1 AS impossible FROM w JOIN n USING (sensor_id, d)")
def impossible_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = src.table(spark, sf, "events").select((F.col("user_id") % 8).alias("sensor_id"), F.to_date("ts").alias("d"))
    lo = F.col("d").cast("timestamp")
    windows = e.distinct().withColumns({"lo": lo, "hi": lo + F.expr("interval '23:59:59' hour to second")})
    return ingest.impossible_windows(e, windows, ["sensor_id", "d"]).select("sensor_id", F.col("d").cast("string").alias("date"), "n_records", F.col("expected_hours").cast("int").alias("expected_hours"), "impossible")


CENSUS = f"""{NAMED}, census AS (SELECT s.s_suppkey, n_name AS country, CASE WHEN loc IS NOT NULL AND trim(loc) <> '' AND lower(trim(loc)) NOT IN {MISSING} THEN trim(loc) WHEN nm IS NULL OR trim(nm) = '' OR lower(trim(nm)) IN {MISSING} OR lab = '' OR lower(lab) IN {MISSING} THEN NULL ELSE lab END AS city,
 loc AS locality, nm AS name, CAST(len(list_filter(range(s.s_suppkey % 3), lambda k: (s.s_suppkey + k) % 2 = 0)) AS INT) AS n_pm25_sensors, array_to_string(list_transform(list_filter(range(s.s_suppkey % 3), lambda k: (s.s_suppkey + k) % 2 = 0), lambda k: CAST(s.s_suppkey * 10 + k AS VARCHAR)), ',') AS pm25_sensor_ids,
 CASE WHEN s.s_suppkey % 6 <> 0 THEN CAST(s.s_suppkey * 37 % 2000 AS DOUBLE) END AS span_days, CASE s.s_suppkey % 4 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_mobile FROM supplier s JOIN nation ON s_nationkey = n_nationkey JOIN p ON p.s_suppkey = s.s_suppkey),
c AS (SELECT *, coalesce(n_pm25_sensors > 0 AND NOT coalesce(is_mobile, false) AND span_days / 365.25 >= 2, false) AS span_ok_upper_bound FROM census)"""


def census(spark: SparkSession, sf: str) -> DataFrame:
    """Census rows from nested location documents, written as JSON and read by the source's schema."""
    s, n, k = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation"), F.col("s_suppkey")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "n_name").join(named_places(spark, sf), "s_suppkey")
    sensor = lambda i: F.struct((k * 10 + i).alias("id"), F.struct(F.when((k + i) % 2 == 0, "pm25").otherwise("o3").alias("name")).alias("parameter"))
    last = F.when(k % 6 == 0, "never").otherwise(F.date_format(F.date_add(F.lit("2018-01-01").cast("date"), (k * 37 % 2000).cast("int")), "yyyy-MM-dd'T'00:00:00'Z'"))
    document = F.struct(
        k.alias("id"), F.col("nm").alias("name"), F.col("loc").alias("locality"), F.lit(src.ZONE).alias("timezone"), F.struct(F.col("n_name").alias("code")).alias("country"),
        F.when(k % 4 == 0, True).when(k % 4 == 1, None).otherwise(False).alias("isMobile"), F.slice(F.array(sensor(0), sensor(1)), F.lit(1), (k % 3).cast("int")).alias("sensors"),
        F.struct(F.lit("2018-01-01T00:00:00Z").alias("utc")).alias("datetimeFirst"), F.struct(last.alias("utc")).alias("datetimeLast"), F.lit("x").alias("unknownField"),
    )
    return ingest.census(src.location_rows(rows.select(F.from_json(F.to_json(document), f"struct<{src.LOCATION}>").alias("r"))))


@query(f"WITH {CENSUS} SELECT CAST(s_suppkey AS VARCHAR) AS location_id, country, city, n_pm25_sensors, pm25_sensor_ids, round(span_days, 4) AS span_days, span_ok_upper_bound FROM c")
def census_rows(spark: SparkSession, sf: str) -> DataFrame:
    return census(spark, sf).select("location_id", "country", "city", "n_pm25_sensors", "pm25_sensor_ids", r("span_days", 4), "span_ok_upper_bound")


@query(f"WITH {CENSUS} SELECT country, count(*) AS n, count(*) FILTER (WHERE n_pm25_sensors > 0) AS n_with_pm25, count(*) FILTER (WHERE span_ok_upper_bound) AS n_eligible, count(DISTINCT city) FILTER (WHERE span_ok_upper_bound) AS n_cities FROM c GROUP BY 1")
def census_by_country(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.country_rollup(census(spark, sf))


@query(f"WITH {CENSUS} SELECT CAST(s_suppkey AS VARCHAR) AS location_id, country, locality, name FROM c ORDER BY country NULLS LAST, locality NULLS LAST, name NULLS LAST, s_suppkey LIMIT 40")
def census_head(spark: SparkSession, sf: str) -> DataFrame:
    """The first rows of the sorted census; missing names last."""
    return census(spark, sf).orderBy(*ingest.census_order(), F.col("location_id").cast("long")).select("location_id", "country", "locality", "name").limit(40)


@query(f"WITH {CENSUS} SELECT CAST(s_suppkey AS VARCHAR) AS location_id, country, city FROM c WHERE span_ok_upper_bound")
def eligible_locations(spark: SparkSession, sf: str) -> DataFrame:
    return census(spark, sf).where("span_ok_upper_bound").select("location_id", "country", "city")


@query("SELECT page_id, left(sha256('{\"params\": {\"a\\\"b\": \"' || page_id || '\", \"url\": \"' || replace(replace(url, '\\', '\\\\'), '\"', '\\\"') || '\"}, \"url\": \"' || replace(replace(url, '\\', '\\\\'), '\"', '\\\"') || '\"}'), 16) AS request_hash FROM pages")
def request_hashes(spark: SparkSession, sf: str) -> DataFrame:
    params = F.create_map(F.lit("url"), F.col("url"), F.lit('a"b'), F.col("page_id").cast("string"))
    return src.table(spark, sf, "pages").select("page_id", ingest.request_hash(F.col("url"), params).alias("request_hash"))


# --- features ---

def wide_features(spark: SparkSession, sf: str) -> DataFrame:
    """The daily table with columns of all tiers: the stored AOD scaled, an index with a sign, a forecast, a static column."""
    t, c = target(spark, sf), F.col
    static = src.table(spark, sf, "nation").select(F.col("n_name").alias("station_id"), (F.col("n_nationkey") * 10.0).alias("elevation"))
    wide = t.select("station_id", "date", "target", specs.scaled(c("aod") * 1000, specs.COMPOSITES[0]).alias("aod_055"), c("valid_px").alias("aod_055_valid_px"), (c("forecast") - 25).alias("absorbing_aerosol_index"), c("n").alias("absorbing_aerosol_index_valid_px"), c("forecast").alias("cams_pm25_forecast"))
    from quern.operators.features import calendar

    return wide.join(static, "station_id", "left").withColumns(calendar(c("date")))


T3 = f"{DAILY}, t AS (SELECT * FROM daily WHERE n >= 3)"


@query(f"WITH {T3} SELECT station_id, strftime(date, '%Y-%m-%d') AS date, round(target, 5) AS target, round(forecast - 25 + 1e-9, 5) AS absorbing_aerosol_index, n AS absorbing_aerosol_index_valid_px, round(forecast + 1e-9, 5) AS cams_pm25_forecast, n_nationkey * 10.0::DOUBLE AS elevation, CAST(extract(month FROM date) AS BIGINT) AS month FROM t JOIN nation ON n_name = station_id")
def deployable_tier(spark: SparkSession, sf: str) -> DataFrame:
    f = specs.tier(wide_features(spark, sf), "deployable", ["station_id", "date"])
    return f.drop("doy_sin", "doy_cos", "dow", "is_heating_season").withColumns({"target": F.round("target", 5), **{c: F.round(F.col(c) + 1e-9, 5) for c in ("absorbing_aerosol_index", "cams_pm25_forecast")}}).withColumn("date", F.col("date").cast("string"))


@query(f"WITH {T3} SELECT station_id, count(*) AS n, round(avg(aod), 6) AS aod_mean, count(*) FILTER (WHERE forecast - 25 < 0) AS n_negative, count(*) FILTER (WHERE forecast - 25 > 8) AS n_implausible FROM t GROUP BY 1")
def composite_units(spark: SparkSession, sf: str) -> DataFrame:
    """Stored values in units; a signed index keeps its sign, what is above its bound is counted."""
    w, index = wide_features(spark, sf), F.col("absorbing_aerosol_index")
    return w.groupBy("station_id").agg(F.count("*").alias("n"), F.round(F.avg("aod_055"), 6).alias("aod_mean"), F.count_if(index < 0).alias("n_negative"), F.count_if(specs.implausible(index, specs.COMPOSITES[1])).alias("n_implausible"))


@query(f"WITH {T3} SELECT station_id, strftime(date, '%Y-%m-%d') AS date, round(sqrt(target * target + forecast * forecast) + 1e-9, 5) AS wind, round(forecast - target + 1e-9, 5) AS inversion, round(aod * 1e-9 * 1e9, 5) AS micrograms FROM t")
def weather_columns(spark: SparkSession, sf: str) -> DataFrame:
    t = target(spark, sf)
    wind, inversion, mass = specs.wind_speed(F.col("target"), F.col("forecast")), specs.inversion_strength(F.col("forecast"), F.col("target")), specs.micrograms(F.col("aod") * 1e-9)
    return t.select("station_id", day(), F.round(wind + 1e-9, 5).alias("wind"), F.round(inversion + 1e-9, 5).alias("inversion"), F.round(mass, 5).alias("micrograms"))


@query(f"WITH {T3}, q AS (SELECT city, quantile_cont(target, 0.9) AS q FROM t GROUP BY 1) SELECT city, count(*) FILTER (WHERE target >= q) AS n_worst, round(100 * avg(CAST(aod IS NOT NULL AS INT)) FILTER (WHERE target >= q), 4) AS pct_worst, round(100 * avg(CAST(forecast - 25 < 0 AS INT)), 4) AS pct_negative FROM t JOIN q USING (city) GROUP BY 1")
def missingness_extremes(spark: SparkSession, sf: str) -> DataFrame:
    """Retrieval on the days of the worst decile, and how often a signed index is below 0."""
    t = target(spark, sf)
    worst = t.groupBy("city").agg(F.percentile("target", 0.9).alias("q"))  # a row for each city
    rows, high = t.join(worst, "city"), F.col("target") >= F.col("q")
    return rows.groupBy("city").agg(
        F.count_if(high).alias("n_worst"), F.round(100 * F.avg(F.when(high, F.col("aod").isNotNull().cast("int"))), 4).alias("pct_worst"), F.round(100 * F.avg((F.col("forecast") - 25 < 0).cast("int")), 4).alias("pct_negative"),
    )


# --- works ---


@query("SELECT item_id, nullif(array_to_string(list_filter(string_split_regex(text, '[^A-Za-z]+'), lambda w: w <> ''), ' '), '') AS text FROM benchmark")
def abstract_of_positions(spark: SparkSession, sf: str) -> DataFrame:
    """A map from words to positions, built and undone."""
    words = F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")
    at = src.table(spark, sf, "benchmark").select("item_id", F.posexplode_outer(words).alias("at", "word"))
    spots = at.groupBy("item_id", "word").agg(F.collect_list("at").alias("spots"))
    index = spots.groupBy("item_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("word").isNotNull(), F.struct("word", "spots")))).alias("index"))
    return index.select("item_id", works.text_of_positions(F.col("index")).alias("text"))


WORKS = f"""src AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS t1, regexp_extract(html, '<h1>([^<]*)', 1) AS t2, CASE WHEN page_id % 3 = 0 THEN '10.1/A' || page_id END AS d1, CASE page_id % 4 WHEN 0 THEN '10.1/a' || page_id WHEN 1 THEN '10.2/' || page_id END AS d2, CASE WHEN page_id % 5 = 0 THEN 'PMC' || page_id ELSE '' END AS pmcid, CASE WHEN page_id % 2 = 0 THEN 'text' END AS abstract FROM pages),
tok AS (SELECT *, {tokens_sql('t1')} AS a, {tokens_sql('t2')} AS b FROM src),
fit AS (SELECT *, coalesce(lower(d1) = lower(d2), false) OR ((d1 IS NULL OR d2 IS NULL) AND coalesce(len(list_intersect(a, b)) / nullif(CAST(len(list_distinct(list_concat(a, b))) AS DOUBLE), 0) >= 0.85, false)) AS fits FROM tok),
merged AS (SELECT page_id, nullif(t1, '') AS title, coalesce(d1, CASE WHEN fits THEN d2 END) AS doi, CASE WHEN fits THEN nullif(pmcid, '') END AS pmcid, CASE WHEN fits THEN abstract END AS abstract, CASE WHEN fits THEN 'one,two' ELSE 'one' END AS apis, CASE WHEN fits THEN '' ELSE 'two:' || left(coalesce(nullif(t2, ''), '?'), 40) END AS merge_conflicts FROM fit)"""


def work_records(spark: SparkSession, sf: str) -> DataFrame:
    """Two records of each page's work, from two services that may disagree."""
    p, k = src.table(spark, sf, "pages"), F.col("page_id")
    none, ident = F.lit(None).cast("string"), k.cast("string")
    tag = lambda name: F.regexp_extract("html", f"<{name}>([^<]*)", 1)
    rest = {c: none.alias(c) for c in ("year", "venue", "arxiv", "oa_pdf")}
    one = p.select("page_id", F.lit(1).alias("n"), F.lit("one").alias("source_api"), tag("title").alias("title"), F.when(k % 3 == 0, F.concat(F.lit("10.1/A"), ident)).alias("doi"), none.alias("pmcid"), none.alias("abstract"), *rest.values())
    doi = F.when(k % 4 == 0, F.concat(F.lit("10.1/a"), ident)).when(k % 4 == 1, F.concat(F.lit("10.2/"), ident))
    two = p.select("page_id", F.lit(2).alias("n"), F.lit("two").alias("source_api"), tag("h1").alias("title"), doi.alias("doi"), F.when(k % 5 == 0, F.concat(F.lit("PMC"), ident)).otherwise("").alias("pmcid"), F.when(k % 2 == 0, "text").alias("abstract"), *rest.values())
    return one.unionByName(two)


@query(f"WITH {WORKS} SELECT page_id, title, doi, pmcid, abstract, apis, merge_conflicts FROM merged")
def merged_works(spark: SparkSession, sf: str) -> DataFrame:
    return works.merge_records(work_records(spark, sf), "page_id", "n").select("page_id", "title", "doi", "pmcid", "abstract", "apis", "merge_conflicts")


@query(f"WITH {WORKS}, d AS (SELECT *, CASE WHEN pmcid IS NOT NULL THEN 'FULL' WHEN abstract IS NOT NULL THEN 'ABSTRACT' WHEN title IS NOT NULL THEN 'SNIPPET' ELSE 'UNRESOLVED' END AS depth FROM merged) SELECT depth, count(*) AS n, count(doi) AS n_doi, depth IN ('FULL', 'ABSTRACT') AS usable FROM d GROUP BY ALL")
def depth_counts(spark: SparkSession, sf: str) -> DataFrame:
    return works.depth_counts(works.merge_records(work_records(spark, sf), "page_id", "n"))


# --- the whole run of quality control ---

BOUNDS = (0.0, 300.0)
LEAST = 0.82  # completeness: about half of the stations have it at sf0.01
_GRID = "panel AS (SELECT station_id, ts, value FROM (SELECT DISTINCT station_id FROM obs) CROSS JOIN hours LEFT JOIN obs USING (station_id, ts)),"
_TAIL = lambda text: text[len(PANEL) :]
SURVIVORS = PANEL.replace(
    _GRID,
    _GRID.replace("panel AS", "panel0 AS")
    + f"""
st AS (SELECT station_id, count(value) AS n, date_diff('hour', min(ts), max(ts)) + 1.0 AS hours, CASE WHEN median(value) BETWEEN 1 AND 500 THEN 'pass' ELSE 'reject' END AS q4 FROM panel0 GROUP BY 1),
st7 AS (SELECT *, CASE WHEN hours / 24 >= 20 AND n / hours >= {LEAST} THEN 'pass' ELSE 'reject' END AS q7 FROM st),
panel AS (SELECT panel0.* FROM panel0 JOIN st7 USING (station_id) WHERE q4 = 'pass' AND q7 = 'pass'),""",
)
QC_RUN = f"""{SURVIVORS}{_TAIL(COMPOSITE)}, amb AS (SELECT lag, corr(a.ref, b.ref) AS amb FROM ref a CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS lag) JOIN ref b ON b.hour = (a.hour - lag + 24) % 24 GROUP BY 1),
q6 AS (SELECT pk.station_id, CASE WHEN (SELECT count(DISTINCT station_id) FROM panel) < 2 THEN NULL WHEN lag_hours IS NULL OR r IS NULL THEN 'flag' WHEN r < 0.5 THEN 'flag' WHEN abs(lag_hours) <= 1 THEN 'pass' WHEN amb > 0.5 THEN 'flag' WHEN abs({WRAP.format('low_hour - rl')}) <= 1 AND abs({WRAP.format('high_hour - rh')}) <= 1 THEN 'flag' ELSE 'reject' END AS verdict FROM pk CROSS JOIN refpk LEFT JOIN best USING (station_id) LEFT JOIN amb ON amb.lag = (lag_hours + 24) % 24){_TAIL(MASKS)},
alive AS (SELECT st7.station_id FROM st7 LEFT JOIN q6 USING (station_id) WHERE q4 = 'pass' AND q7 = 'pass' AND coalesce(verdict, 'pass') <> 'reject'),
m AS (SELECT station_id, count(value) AS n, count(*) FILTER (WHERE q1) AS n1, count(*) FILTER (WHERE q2) AS n2, count(*) FILTER (WHERE q3) AS n3 FROM masks JOIN alive USING (station_id) GROUP BY 1),
findings AS (SELECT 'Q4' AS rule, 'station' AS scope, station_id, q4 AS verdict, n AS n_total, CASE WHEN q4 = 'reject' THEN n ELSE 0 END AS n_flagged FROM st7 UNION ALL SELECT 'Q7', 'station', station_id, q7, n, CASE WHEN q7 = 'reject' THEN n ELSE 0 END FROM st7
UNION ALL SELECT 'Q6', 'station', station_id, verdict, n, CASE WHEN verdict = 'reject' THEN n ELSE 0 END FROM q6 JOIN st7 USING (station_id) WHERE verdict IS NOT NULL
UNION ALL SELECT 'Q1', 'row', station_id, CASE WHEN n1 > 0 THEN 'flag' ELSE 'pass' END, n, n1 FROM m UNION ALL SELECT 'Q2', 'row', station_id, CASE WHEN n2 > 0 THEN 'flag' ELSE 'pass' END, n, n2 FROM m UNION ALL SELECT 'Q3', 'row', station_id, CASE WHEN n3 > 0 THEN 'flag' ELSE 'pass' END, n, n3 FROM m)"""


def qc_run(spark: SparkSession, sf: str) -> qc.Outcome:
    how = qc.Rules(BOUNDS[0], BOUNDS[1], level(), 3, 6, 20, LEAST)
    return qc.run(src.hourly_panel(spark, sf), src.ZONE, how)


@query(f"WITH {QC_RUN} SELECT *, round(CASE WHEN n_total > 0 THEN 100.0 * n_flagged / n_total ELSE 0 END, 3) AS pct_flagged FROM findings")
def qc_findings(spark: SparkSession, sf: str) -> DataFrame:
    return qc_run(spark, sf).findings


@query(f"WITH {QC_RUN} SELECT station_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, CASE WHEN NOT masked THEN round(value, 5) END AS value FROM masks JOIN alive USING (station_id)")
def qc_kept_panel(spark: SparkSession, sf: str) -> DataFrame:
    return qc_run(spark, sf).kept.select("station_id", hour(), r("value"))


@query(f"WITH {QC_RUN} SELECT station_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM findings WHERE verdict = 'reject' GROUP BY 1")
def qc_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return qc_run(spark, sf).rejected


# --- models against each other ---

T_P = "CASE WHEN dm IS NOT NULL THEN 1 - 2 * abs(dm) / 1200 * exp(lgamma(n / 2.0) - lgamma((n - 1) / 2.0)) / sqrt((n - 1) * pi()) * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow(abs(dm) * i / 400.0, 2) / (n - 1), -n / 2.0))) END"


def pairs_sql(scored: str, key: str, loss: str, least: int) -> str:
    """Every pair of models in order, by Simpson's rule where a p-value is asked for."""
    return f"""l AS (SELECT {key}, ts, model, {loss} AS l FROM {scored} WHERE value IS NOT NULL AND pred IS NOT NULL),
x AS (SELECT a.{key}, a.model AS model_a, b.model AS model_b, a.ts, a.l - b.l AS d, row_number() OVER (PARTITION BY a.{key}, a.model, b.model ORDER BY a.ts) AS rn FROM l a JOIN l b ON a.{key} = b.{key} AND a.ts = b.ts AND a.model < b.model),
g AS (SELECT {key}, model_a, model_b, count(*) AS n, avg(d) AS mean, max(abs(d)) AS top, CAST(greatest(floor(4 * pow(count(*) / 100.0, 2 / 9.0)), {least}) AS INT) AS lags FROM x GROUP BY ALL),
cov AS (SELECT x.{key}, x.model_a, x.model_b, x.rn - y.rn AS k, sum((x.d - mean) * (y.d - mean)) / any_value(n) AS c, any_value(lags) AS lags FROM x JOIN g ON g.{key} = x.{key} AND g.model_a = x.model_a AND g.model_b = x.model_b JOIN x y ON y.{key} = x.{key} AND y.model_a = x.model_a AND y.model_b = x.model_b AND y.rn BETWEEN x.rn - lags AND x.rn GROUP BY ALL),
v AS (SELECT {key}, model_a, model_b, sum(CASE WHEN k = 0 THEN c ELSE 2 * (1 - k / (lags + 1.0)) * c END) AS lrv FROM cov GROUP BY ALL),
pairs AS (SELECT g.{key}, g.model_a, g.model_b, n, lags, CASE WHEN n < 10 THEN NULL WHEN top <= 1e-8 THEN 0.0 WHEN lrv <= 0 THEN NULL ELSE mean / sqrt(lrv / n) * sqrt(greatest((n + 1 - 2 * (lags + 1) + (lags + 1) * lags / CAST(n AS DOUBLE)) / n, 0)) END AS dm FROM g JOIN v ON g.{key} = v.{key} AND g.model_a = v.model_a AND g.model_b = v.model_b)"""


def with_p(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("p_value", stats.t_pvalue(F.col("dm"), F.col("n") - 1.0))


F24 = f"{LADDER}, s24 AS (SELECT * FROM scored WHERE horizon_h = 24)"


@query(f"WITH {F24}, {pairs_sql('s24', 'station_id', '(pred - value) ** 2', 0)} SELECT station_id, model_a, model_b, n, lags, round(dm, 5) AS dm, round({T_P}, 6) AS p_value FROM pairs")
def dm_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Every pair of models on the hours that both predict, by station; the automatic bandwidth."""
    out = with_p(stats.pairwise(ladder(spark, sf).where("horizon_h = 24"), ["station_id"]))
    return out.select("station_id", "model_a", "model_b", "n", "lags", r("dm"), r("p_value", 6))


@query(f"WITH {F24}, {pairs_sql('s24', 'station_id', '(pred - value) ** 2', 0)}, q AS (SELECT *, {T_P} AS p FROM pairs) SELECT model_a, model_b, count(*) AS n_tests, count(*) FILTER (WHERE p < 0.05) AS n_significant, round(median(p), 6) AS median_p FROM q GROUP BY ALL")
def dm_pair_summary(spark: SparkSession, sf: str) -> DataFrame:
    out = with_p(stats.pairwise(ladder(spark, sf).where("horizon_h = 24"), ["station_id"]))
    return out.groupBy("model_a", "model_b").agg(F.count("*").alias("n_tests"), F.count_if(F.col("p_value") < 0.05).alias("n_significant"), F.round(F.median("p_value"), 6).alias("median_p"))


NDAY = f"{NOWCASTS}, nday AS (SELECT city, model, ts, avg(value) AS value, avg(pred) AS pred FROM nscored GROUP BY ALL)"


@query(f"WITH {NDAY}, {pairs_sql('nday', 'city', 'abs(pred - value)', 24)} SELECT city, model_a, model_b, n, lags, round(dm, 5) AS dm, round({T_P}, 6) AS p_value FROM pairs")
def dm_pairs_nowcast(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of nowcasts by city on absolute errors of the city's hourly means; a day's lags at least."""
    means = nowcasts(spark, sf).groupBy("city", "model", "ts").agg(F.avg("value").alias("value"), F.avg("pred").alias("pred"))
    out = with_p(stats.pairwise(means, ["city"], 24, absolute=True))
    return out.select("city", "model_a", "model_b", "n", "lags", r("dm"), r("p_value", 6))


@query()
def task_n_ladder_kriging(spark: SparkSession, sf: str) -> DataFrame:
    """The nowcast ladder with its fourth model, ordinary kriging with each city held out in turn."""
    panel, st = src.hourly_panel(spark, sf), src.stations(spark)
    pairs = [(x.km, x.gamma) for x in nc.variogram(train_block(panel), st).orderBy("a", "b").collect()]  # pairs of stations
    kriged = nc.kriging(test_block(panel), st, nc.fit_exponential(pairs)).select("station_id", "ts", "pred").withColumn("model", F.lit("ordinary_kriging"))
    scored = kriged.join(test_block(panel), ["station_id", "ts"]).join(st.select("station_id", "city"), "station_id")
    both = nowcasts(spark, sf).select("city", "model", "value", "pred").unionByName(scored.select("city", "model", "value", "pred"))
    return metrics.regression(both, ["city", "model"]).select("city", "model", "n", "rmse", "mae", "bias", "r2")


@query(f"WITH {PANEL}, rej AS (SELECT station_id FROM panel GROUP BY 1 HAVING median(value) < (SELECT median(value) FROM panel)) SELECT station_id, count(*) AS n FROM panel WHERE station_id NOT IN (SELECT station_id FROM rej) GROUP BY 1")
def drop_rejected(spark: SparkSession, sf: str) -> DataFrame:
    panel = src.hourly_panel(spark, sf)
    medians = panel.groupBy("station_id").agg(F.median("value").alias("m")).crossJoin(panel.agg(F.median("value").alias("all")))  # a row a station
    verdicts = medians.select("station_id", F.when(F.col("m") < F.col("all"), "reject").otherwise("pass").alias("verdict"))
    return ingest.drop_rejected(panel, verdicts).groupBy("station_id").agg(F.count("*").alias("n"))


# --- sinks and grids ---

OBS = "obs AS (SELECT 's' || (user_id % 8) AS station_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)"


def _observed(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly means, some of them missing, written and read by the queries below."""
    o = src.hourly_obs(src.table(spark, sf, "events"))
    return o.select("station_id", hour(), F.when(F.hour("ts") % 5 != 0, F.round("value", 5)).alias("value"), (F.hour("ts") % 2 == 0).alias("even"))


WRITTEN = f"WITH {OBS} SELECT station_id, strftime(ts, '%Y-%m-%d %H:%M') AS ts, CASE WHEN extract(hour FROM ts) % 5 <> 0 THEN round(value, 5) END AS value, extract(hour FROM ts) % 2 = 0 AS even FROM obs"


@query(WRITTEN)
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.new_path(spark, "csv")
    sinks.write(_observed(spark, sf), path, "csv")
    return src.csv(spark, path, "station_id string, ts string, value double, even boolean")


@query(WRITTEN)
def json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = sinks.new_path(spark, "json")
    sinks.write(_observed(spark, sf), path, "json")
    return spark.read.schema("station_id string, ts string, value double, even boolean").json(path)


@query(f"WITH {COMPOSITE} SELECT pk.station_id, low_hour, high_hour, round(max(z) - min(z), 5) AS amplitude FROM pk JOIN comp USING (station_id) GROUP BY ALL")
def regime_summary(spark: SparkSession, sf: str) -> DataFrame:
    c = composites(spark, sf)
    spread = c.groupBy("station_id").agg((F.max("z") - F.min("z")).alias("amplitude"))
    return qc.peaks(c, ["station_id"]).join(spread, "station_id").select("station_id", "low_hour", "high_hour", r("amplitude"))


@query(f"WITH {MERGED}, d AS (SELECT abs(p - s) AS d FROM merged WHERE p IS NOT NULL AND s IS NOT NULL) SELECT round(100 * avg(CAST(d < 30 AS INT)), 5) AS pct_agree, coalesce(100 * avg(CAST(d < 30 AS INT)) >= 95, false) AS clean_duplicate FROM d")
def clean_duplicate_feeds(spark: SparkSession, sf: str) -> DataFrame:
    report = merge.merge_report(merge.merge_feeds(src.hourly_panel(spark, sf), "s3", "s4"), 30.0)
    return merge.clean_duplicate(report).select(r("pct_agree"), "clean_duplicate")


