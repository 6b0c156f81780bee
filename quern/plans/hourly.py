"""Queries on the hourly panel: grid, quality control, merge, splits, forecasts, nowcasts and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import forecast as fc, grid, merge, metrics, nowcast as nc, qc, splits, stats
from quern.plans.registry import PANEL, query
from quern.sources import tables as src

SQL_T = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"
DAYS = 3  # of the same-hour means on a panel of a month
THRESHOLD = 50.0


def hour():
    return F.date_format("ts", "yyyy-MM-dd HH:mm").alias("ts")


def level():
    return F.floor(F.col("value") / 50)


def r(column: str, digits: int = 5):
    return F.round(column, digits).alias(column)


def test_block(df: DataFrame) -> DataFrame:
    return df.where(splits.block_of(F.col("ts")) == "test")


def train_block(df: DataFrame) -> DataFrame:
    return df.where(splits.block_of(F.col("ts")) == "train")


@query(f"WITH {PANEL} SELECT station_id, {SQL_T}, round(value, 5) AS value FROM panel")
def hourly_regrid(spark: SparkSession, sf: str) -> DataFrame:
    return src.hourly_panel(spark, sf).select("station_id", hour(), r("value"))


@query("SELECT user_id, event_type, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    first = grid.first_of(src.table(spark, sf, "events"), ["user_id", "event_type"], F.col("ts"), F.col("event_id"))
    return first.select("user_id", "event_type", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("SELECT station_id, sensor, n FROM (SELECT 's' || (user_id % 8) AS station_id, event_type AS sensor, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY n DESC, sensor) = 1")
def best_sensor_per_location(spark: SparkSession, sf: str) -> DataFrame:
    counts = src.table(spark, sf, "events").groupBy(F.concat(F.lit("s"), F.col("user_id") % 8).alias("station_id"), F.col("event_type").alias("sensor")).agg(F.count("*").alias("n"))
    return grid.first_of(counts, ["station_id"], F.desc("n"), F.col("sensor"))


@query("SELECT event_type, sum(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT))::BIGINT AS k_sum, count(*) AS n FROM events GROUP BY 1")
def props_json_extract(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return src.table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("k_sum"), F.count("*").alias("n"))


@query("SELECT r_name AS country, count(*) AS n, count(*) FILTER (WHERE s_acctbal > 0) AS n_positive, max(s_acctbal) AS top, count(*) FILTER (WHERE s_acctbal > 5000) AS n_eligible, count(DISTINCT n_name) AS n_cities FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def census_rollup(spark: SparkSession, sf: str) -> DataFrame:
    s, n, g = (src.table(spark, sf, t) for t in ("supplier", "nation", "region"))
    joined = s.join(n, s.s_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return joined.groupBy(F.col("r_name").alias("country")).agg(F.count("*").alias("n"), F.count_if(F.col("s_acctbal") > 0).alias("n_positive"), F.max("s_acctbal").alias("top"), F.count_if(F.col("s_acctbal") > 5000).alias("n_eligible"), F.countDistinct("n_name").alias("n_cities"))


# --- quality control ---

MASKS = f"""{PANEL},
lv AS (SELECT *, floor(value / 50) AS lvl, coalesce(value < 0 OR value > 300, false) AS q1, CASE WHEN floor(value / 50) <> 0 THEN floor(value / 50) END AS f, coalesce(floor(value / 50) = 0, false) AS z FROM panel),
r1 AS (SELECT *, sum(nf) OVER (PARTITION BY station_id ORDER BY ts) AS runf, sum(nz) OVER (PARTITION BY station_id ORDER BY ts) AS runz FROM (
 SELECT *, CASE WHEN f IS NULL OR lag(f) OVER w IS NULL OR f <> lag(f) OVER w THEN 1 ELSE 0 END AS nf, CASE WHEN lag(z) OVER w IS NULL OR z <> lag(z) OVER w THEN 1 ELSE 0 END AS nz FROM lv WINDOW w AS (PARTITION BY station_id ORDER BY ts))),
masks AS (SELECT *, q1 OR q2 OR q3 AS masked FROM (SELECT *, f IS NOT NULL AND count(*) OVER (PARTITION BY station_id, runf) >= 3 AS q2, z AND count(*) OVER (PARTITION BY station_id, runz) >= 6 AS q3 FROM r1))
"""


def masks(spark: SparkSession, sf: str) -> DataFrame:
    return qc.row_masks(src.hourly_panel(spark, sf), 0.0, 300.0, level(), 3, 6)


@query(f"WITH {MASKS} SELECT station_id, {SQL_T}, round(value, 5) AS value FROM masks WHERE q1")
def q1_range(spark: SparkSession, sf: str) -> DataFrame:
    return qc.flag_range(src.hourly_panel(spark, sf), 0.0, 300.0).where("q1").select("station_id", hour(), r("value"))


@query(f"WITH {MASKS} SELECT station_id, {SQL_T} FROM masks WHERE q2")
def q2_flatline(spark: SparkSession, sf: str) -> DataFrame:
    return qc.flag_flatline(src.hourly_panel(spark, sf), level(), 3).where("q2").select("station_id", hour())


@query(f"WITH {MASKS} SELECT station_id, {SQL_T} FROM masks WHERE q3")
def q3_zero_run(spark: SparkSession, sf: str) -> DataFrame:
    return qc.flag_zero_run(src.hourly_panel(spark, sf), level(), 6).where("q3").select("station_id", hour())


@query(f"WITH {MASKS} SELECT station_id, {SQL_T}, masked, CASE WHEN NOT masked THEN round(value, 5) END AS kept FROM masks")
def qc_row_mask_union(spark: SparkSession, sf: str) -> DataFrame:
    return masks(spark, sf).select("station_id", hour(), "masked", F.when(~F.col("masked"), F.round("value", 5)).alias("kept"))


@query(f"WITH {MASKS} SELECT station_id, count(*) AS n_grid, count(value) AS n_before, count(value) FILTER (WHERE NOT masked) AS n_after, count(*) FILTER (WHERE q1) AS n_q1, count(*) FILTER (WHERE q2) AS n_q2, count(*) FILTER (WHERE q3) AS n_q3, count(*) FILTER (WHERE masked) AS n_masked FROM masks GROUP BY 1")
def qc_n_effect(spark: SparkSession, sf: str) -> DataFrame:
    return qc.n_effect(masks(spark, sf))


@query(f"WITH {PANEL} SELECT station_id, round(median(value), 5) AS median, CASE WHEN median(value) BETWEEN 1 AND 500 THEN 'pass' ELSE 'reject' END AS verdict FROM panel GROUP BY 1")
def q4_unit_sanity(spark: SparkSession, sf: str) -> DataFrame:
    return qc.unit_sanity(src.hourly_panel(spark, sf)).select("station_id", r("median"), "verdict")


PLACES = "places AS (SELECT s_suppkey AS id, 'n' || s_nationkey AS location_id, 40 + (s_suppkey % 50) * 0.001 + (s_suppkey % 3) * 0.0002 AS latitude, 70 + (s_suppkey % 7) * 0.5 AS longitude FROM supplier)"
HAVERSINE = "2 * {r} * asin(sqrt(pow(sin(radians({b}.latitude - {a}.latitude) / 2), 2) + cos(radians({a}.latitude)) * cos(radians({b}.latitude)) * pow(sin(radians({b}.longitude - {a}.longitude) / 2), 2)))"


def places(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return src.table(spark, sf, "supplier").select(k.alias("id"), F.concat(F.lit("n"), "s_nationkey").alias("location_id"), (40 + (k % 50) * 0.001 + (k % 3) * 0.0002).alias("latitude"), (70 + (k % 7) * 0.5).alias("longitude"))


@query(f"WITH {PLACES} SELECT a.location_id, round(max({HAVERSINE.format(r=6371000.0, a='a', b='b')}), 2) AS spread_m, CASE WHEN max({HAVERSINE.format(r=6371000.0, a='a', b='b')}) > 150 THEN 'reject' ELSE 'pass' END AS verdict FROM places a JOIN places b USING (location_id) GROUP BY 1")
def q5a_moved_ids(spark: SparkSession, sf: str) -> DataFrame:
    return qc.moved_ids(places(spark, sf)).select("location_id", r("spread_m", 2), "verdict")


@query(f"""WITH RECURSIVE {PLACES}, pairs AS (SELECT a.id AS a, b.id AS b FROM places a JOIN places b ON a.id <> b.id WHERE {HAVERSINE.format(r=6371000.0, a='a', b='b')} <= 150),
reach(id, c) AS (SELECT id, id FROM places UNION SELECT pairs.b, reach.c FROM reach JOIN pairs ON reach.id = pairs.a),
comp AS (SELECT id, min(c) AS component FROM reach GROUP BY 1)
SELECT component, count(*) AS n, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids FROM comp GROUP BY 1 HAVING count(*) >= 2""")
def q5b_colocated_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return qc.colocated_clusters(places(spark, sf))


@query(f"WITH {PANEL}, c AS (SELECT station_id, date_diff('hour', min(ts), max(ts)) + 1.0 AS n_hours, count(value) AS n_observed FROM panel GROUP BY 1) SELECT station_id, n_hours, n_observed, round(n_hours / 24, 5) AS span_days, round(n_observed / n_hours, 5) AS completeness, CASE WHEN n_hours / 24 >= 20 AND n_observed / n_hours >= 0.6 THEN 'pass' ELSE 'reject' END AS verdict FROM c")
def q7_completeness(spark: SparkSession, sf: str) -> DataFrame:
    return qc.completeness(src.hourly_panel(spark, sf), 20, 0.6).select("station_id", "n_hours", "n_observed", r("span_days"), r("completeness"), "verdict")


COMPOSITE = f"""{PANEL},
bins AS (SELECT station_id, CAST(extract(hour FROM ts + INTERVAL 5 HOUR) AS INT) AS hour, CASE WHEN count(value) >= 5 THEN avg(value) END AS m FROM panel GROUP BY ALL),
g AS (SELECT s.station_id, h.hour, m, count(m) OVER (PARTITION BY s.station_id) AS nb FROM (SELECT DISTINCT station_id FROM panel) s CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS hour) h LEFT JOIN bins USING (station_id, hour)),
k AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN hour END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY hour) AS ph, last_value(m IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY hour) AS pm,
 first_value(CASE WHEN m IS NOT NULL THEN hour END IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qh, first_value(m IGNORE NULLS) OVER (PARTITION BY station_id ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS qm FROM g),
x AS (SELECT station_id, hour, CASE WHEN nb >= 12 THEN coalesce(m, pm + (qm - pm) * (hour - ph) / nullif(qh - ph, 0), pm, qm) END AS x FROM k),
comp AS (SELECT station_id, hour, CASE WHEN stddev_samp(x) OVER w = 0 THEN 0.0 ELSE (x - avg(x) OVER w) / stddev_samp(x) OVER w END AS z FROM x WINDOW w AS (PARTITION BY station_id)),
ref AS (SELECT hour, median(z) AS ref FROM comp WHERE z IS NOT NULL GROUP BY 1),
cors AS (SELECT station_id, lag, CASE WHEN count(z) = 24 THEN corr(z, ref) END AS r FROM comp CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS lag) JOIN ref ON ref.hour = (comp.hour - lag + 24) % 24 GROUP BY ALL),
best AS (SELECT station_id, CASE WHEN lag > 12 THEN lag - 24 ELSE lag END AS lag_hours, r FROM cors WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY round(r, 10) DESC, lag) = 1),
pk AS (SELECT station_id, arg_min(hour, (round(z, 10), hour)) AS low_hour, arg_max(hour, (round(z, 10), -hour)) AS high_hour FROM comp WHERE z IS NOT NULL GROUP BY 1),
refpk AS (SELECT arg_min(hour, (round(ref, 10), hour)) AS rl, arg_max(hour, (round(ref, 10), -hour)) AS rh FROM ref)
"""
WRAP = "CASE WHEN (({0}) % 24 + 24) % 24 > 12 THEN (({0}) % 24 + 24) % 24 - 24 ELSE (({0}) % 24 + 24) % 24 END"


def composites(spark: SparkSession, sf: str) -> DataFrame:
    return qc.diurnal_composite(src.hourly_panel(spark, sf), ["station_id"], src.ZONE)


@query(f"WITH {COMPOSITE} SELECT station_id, hour, round(z, 5) AS z FROM comp")
def diurnal_composite(spark: SparkSession, sf: str) -> DataFrame:
    return composites(spark, sf).select("station_id", "hour", r("z"))


@query(f"WITH {COMPOSITE} SELECT hour, round(ref, 5) AS ref FROM ref")
def reference_composite(spark: SparkSession, sf: str) -> DataFrame:
    return qc.median_composite(composites(spark, sf), []).select("hour", r("ref"))


@query(f"WITH {COMPOSITE} SELECT station_id, lag_hours, round(r, 5) AS r FROM best")
def q6_best_lag(spark: SparkSession, sf: str) -> DataFrame:
    c = composites(spark, sf)
    return qc.best_lag(qc.lag_correlations(c, qc.median_composite(c, []), ["station_id"], []), ["station_id"]).select("station_id", "lag_hours", r("r"))


@query(f"WITH {COMPOSITE} SELECT lag, round(corr(a.ref, b.ref), 5) AS r FROM ref a CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS lag) JOIN ref b ON b.hour = (a.hour - lag + 24) % 24 GROUP BY 1")
def lag_identifiability(spark: SparkSession, sf: str) -> DataFrame:
    ref = qc.median_composite(composites(spark, sf), [])
    return qc.lag_correlations(ref.select("hour", F.col("ref").alias("z")), ref, [], []).select("lag", r("r"))


@query(f"WITH {COMPOSITE} SELECT station_id, low_hour, high_hour, {WRAP.format('low_hour - rl')} AS low_offset, {WRAP.format('high_hour - rh')} AS high_offset FROM pk CROSS JOIN refpk")
def peak_alignment(spark: SparkSession, sf: str) -> DataFrame:
    c = composites(spark, sf)
    ref = qc.peaks(qc.median_composite(c, []), [], "ref").select(F.col("low_hour").alias("rl"), F.col("high_hour").alias("rh"))
    return qc.peaks(c, ["station_id"]).crossJoin(ref).select("station_id", "low_hour", "high_hour", qc.wrap(F.col("low_hour") - F.col("rl")).alias("low_offset"), qc.wrap(F.col("high_hour") - F.col("rh")).alias("high_offset"))


@query(f"""WITH {COMPOSITE}, amb AS (SELECT lag, corr(a.ref, b.ref) AS amb FROM ref a CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS lag) JOIN ref b ON b.hour = (a.hour - lag + 24) % 24 GROUP BY 1)
SELECT pk.station_id, lag_hours, CASE WHEN lag_hours IS NULL OR r IS NULL THEN 'flag' WHEN r < 0.5 THEN 'flag' WHEN abs(lag_hours) <= 1 THEN 'pass' WHEN amb > 0.5 THEN 'flag' WHEN abs({WRAP.format('low_hour - rl')}) <= 1 AND abs({WRAP.format('high_hour - rh')}) <= 1 THEN 'flag' ELSE 'reject' END AS verdict
FROM pk CROSS JOIN refpk LEFT JOIN best USING (station_id) LEFT JOIN amb ON amb.lag = (lag_hours + 24) % 24""")
def q6_verdict(spark: SparkSession, sf: str) -> DataFrame:
    c = composites(spark, sf)
    ref = qc.median_composite(c, [])
    best = qc.best_lag(qc.lag_correlations(c, ref, ["station_id"], []), ["station_id"])
    ambiguity = qc.lag_correlations(ref.select("hour", F.col("ref").alias("z")), ref, [], []).select(F.col("lag").alias("al"), F.col("r").alias("amb"))
    top = qc.peaks(ref, [], "ref").select(F.col("low_hour").alias("rl"), F.col("high_hour").alias("rh"))
    rows = qc.peaks(c, ["station_id"]).crossJoin(top).join(best, "station_id", "left").join(ambiguity, F.pmod(F.col("lag_hours"), F.lit(24)) == F.col("al"), "left")
    verdict = qc.shift_verdict(F.col("lag_hours"), F.col("r"), F.col("amb"), qc.wrap(F.col("low_hour") - F.col("rl")), qc.wrap(F.col("high_hour") - F.col("rh")))
    return rows.select("station_id", "lag_hours", verdict.alias("verdict"))


@query(f"""WITH {COMPOSITE}, cc AS (SELECT station_id, city, hour, z FROM comp JOIN stations USING (station_id)), cref AS (SELECT city, hour, median(z) AS ref FROM cc WHERE z IS NOT NULL GROUP BY ALL),
ccor AS (SELECT station_id, cc.city, lag, CASE WHEN count(z) = 24 THEN corr(z, ref) END AS r FROM cc CROSS JOIN (SELECT CAST(unnest(range(24)) AS INT) AS lag) JOIN cref ON cref.city = cc.city AND cref.hour = (cc.hour - lag + 24) % 24 GROUP BY ALL),
cb AS (SELECT station_id, city, CASE WHEN lag > 12 THEN lag - 24 ELSE lag END AS lag_hours FROM ccor WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY round(r, 10) DESC, lag) = 1),
cn AS (SELECT city, count(*) AS n FROM stations GROUP BY 1),
cpk AS (SELECT city, arg_min(hour, (round(ref, 10), hour)) AS rl, arg_max(hour, (round(ref, 10), -hour)) AS rh FROM cref GROUP BY 1)
SELECT station_id, city, CASE WHEN n < 2 THEN 'pass' WHEN lag_hours IS NULL THEN 'flag' WHEN abs(lag_hours) <= 1 AND abs({WRAP.format('low_hour - rl')}) <= 1 AND abs({WRAP.format('high_hour - rh')}) <= 1 THEN 'pass' ELSE 'reject' END AS verdict
FROM stations JOIN cn USING (city) LEFT JOIN cb USING (station_id, city) LEFT JOIN pk USING (station_id) LEFT JOIN cpk USING (city)""")
def q6a_within_city(spark: SparkSession, sf: str) -> DataFrame:
    st = src.stations(spark).select("station_id", "city")
    return qc.within_city(composites(spark, sf).join(st, "station_id"), st).select("station_id", "city", "verdict")


@query(f"WITH {COMPOSITE} SELECT station_id, low_hour, CASE WHEN low_hour BETWEEN 11 AND 18 THEN 'afternoon-minimum' WHEN low_hour <= 8 THEN 'pre-dawn' ELSE 'other' END AS regime FROM pk")
def q6b_regime(spark: SparkSession, sf: str) -> DataFrame:
    return qc.peaks(composites(spark, sf), ["station_id"]).select("station_id", "low_hour", qc.regime(F.col("low_hour")).alias("regime"))


# --- merge ---

MERGED = f"{PANEL}, merged AS (SELECT coalesce(p.ts, s.ts) AS ts, p.value AS p, s.value AS s FROM (SELECT * FROM panel WHERE station_id = 's3') p FULL JOIN (SELECT * FROM panel WHERE station_id = 's4') s ON p.ts = s.ts)"


@query(f"WITH {MERGED} SELECT {SQL_T}, round(coalesce(p, s), 5) AS value, CASE WHEN p IS NOT NULL THEN 's3' WHEN s IS NOT NULL THEN 's4' ELSE '' END AS source FROM merged")
def merge_precedence(spark: SparkSession, sf: str) -> DataFrame:
    return merge.merge_feeds(src.hourly_panel(spark, sf), "s3", "s4").select(hour(), r("value"), "source")


@query(f"WITH {MERGED}, d AS (SELECT *, abs(p - s) AS d FROM merged) SELECT count(p) AS n_primary, count(s) AS n_secondary, count(d) AS n_overlap, count(*) FILTER (WHERE p IS NULL AND s IS NOT NULL) AS n_filled, count(coalesce(p, s)) AS n_merged, round(100 * avg(CAST(d < 5 AS INT)), 5) AS pct_agree, round(median(d), 5) AS median_diff, round(quantile_cont(d, 0.95), 5) AS p95_diff, round(max(d), 5) AS max_diff FROM d")
def merge_report(spark: SparkSession, sf: str) -> DataFrame:
    out = merge.merge_report(merge.merge_feeds(src.hourly_panel(spark, sf), "s3", "s4"), 5.0)
    return out.select("n_primary", "n_secondary", "n_overlap", "n_filled", "n_merged", *[r(c) for c in ("pct_agree", "median_diff", "p95_diff", "max_diff")])


@query(f"WITH {MERGED} SELECT CAST(extract(day FROM ts) AS INT) AS period, count(*) AS n, round(100 * avg(CAST(abs(p - s) <= 5 AS INT)), 5) AS pct_agree FROM merged WHERE p IS NOT NULL AND s IS NOT NULL GROUP BY 1")
def feed_divergence(spark: SparkSession, sf: str) -> DataFrame:
    return merge.agreement_by(merge.merge_feeds(src.hourly_panel(spark, sf), "s3", "s4"), F.dayofmonth("ts"), 5.0).select("period", "n", r("pct_agree"))


@query(f"WITH {PANEL} SELECT city, station_id AS \"primary\", count(value) AS n FROM panel JOIN stations USING (station_id) GROUP BY city, station_id QUALIFY row_number() OVER (PARTITION BY city ORDER BY count(value) DESC, station_id) = 1")
def choose_primary(spark: SparkSession, sf: str) -> DataFrame:
    return merge.choose_primary(src.hourly_panel(spark, sf).join(F.broadcast(src.stations(spark)), "station_id"))


# --- splits ---


@query(f"WITH {PANEL} SELECT strftime(min(ts), '%Y-%m-%d %H') AS first_ts, strftime(max(ts), '%Y-%m-%d %H') AS last_ts, 96 AS purge_hours FROM panel WHERE value IS NOT NULL")
def temporal_blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = splits.block_bounds(src.hourly_panel(spark, sf), 72, 24)
    return b.select(F.date_format("first_ts", "yyyy-MM-dd HH").alias("first_ts"), F.date_format("last_ts", "yyyy-MM-dd HH").alias("last_ts"), "purge_hours")


@query(f"WITH {PANEL} SELECT station_id, coalesce(b, CASE WHEN ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-30 23:00' THEN 'purge' END) AS block, count(*) AS n, count(value) AS n_observed FROM panel LEFT JOIN blocks ON ts BETWEEN x AND y GROUP BY ALL")
def block_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return src.hourly_panel(spark, sf).groupBy("station_id", splits.block_of(F.col("ts")).alias("block")).agg(F.count("*").alias("n"), F.count("value").alias("n_observed"))


# --- forecasts ---

W = "OVER (PARTITION BY station_id ORDER BY ts)"


def lagged(hours: int) -> str:
    return f"lag(value, {hours}) {W}"


def asof(hours: int) -> str:
    return f"lag(k, {hours}) {W} AS pred FROM (SELECT *, last_value(value IGNORE NULLS) {W} AS k FROM panel)"


def shown(df: DataFrame) -> DataFrame:
    return df.select("station_id", hour(), r("value"), r("pred"))


SHOW = f"SELECT station_id, {SQL_T}, round(value, 5) AS value, round(pred, 5) AS pred FROM"


@query(f"WITH {PANEL} {SHOW} (SELECT *, {lagged(24)} AS pred FROM panel)")
def persistence_h24(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.persistence(src.hourly_panel(spark, sf), 24))


@query(f"WITH {PANEL} {SHOW} (SELECT *, {lagged(48)} AS pred FROM panel)")
def persistence_h48(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.persistence(src.hourly_panel(spark, sf), 48))


@query(f"WITH {PANEL} {SHOW} (SELECT *, {asof(24)})")
def persistence_asof(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.persistence_asof(src.hourly_panel(spark, sf), 24))


@query(f"WITH {PANEL} {SHOW} (SELECT *, {asof(24)})")
def diurnal_persistence_h5(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.diurnal_persistence(src.hourly_panel(spark, sf), 5))


LAGS = ", ".join(lagged(24 + 24 * k) for k in range(DAYS))


@query(f"WITH {PANEL} {SHOW} (SELECT *, list_avg([{LAGS}]) AS pred FROM panel)")
def same_hour_mean(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.same_hour(src.hourly_panel(spark, sf), 24, DAYS))


@query(f"WITH {PANEL} {SHOW} (SELECT *, list_median([{LAGS}]) AS pred FROM panel)")
def same_hour_median(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.same_hour(src.hourly_panel(spark, sf), 24, DAYS, "median"))


@query(f"""WITH {PANEL}, known AS (SELECT * FROM panel WHERE value IS NOT NULL)
{SHOW} (SELECT p.station_id, p.ts, p.value, (SELECT avg(v) FROM (SELECT k.value AS v FROM known k WHERE k.station_id = p.station_id AND extract(hour FROM k.ts) = extract(hour FROM p.ts) AND k.ts <= p.ts - INTERVAL 24 HOUR ORDER BY k.ts DESC LIMIT 3)) AS pred FROM panel p)""")
def same_hour_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return shown(fc.same_hour_last(src.hourly_panel(spark, sf), 24, DAYS))


CELLS = """cells AS (SELECT station_id, CASE grouping_id(month, hour) WHEN 0 THEN 'month_hour' WHEN 2 THEN 'hour' WHEN 1 THEN 'month' ELSE 'global' END AS level, month, hour, avg(value) AS mean, median(value) AS median, count(*) AS n
FROM (SELECT station_id, CAST(extract(month FROM ts) AS INT) AS month, CAST(extract(hour FROM ts) AS INT) AS hour, value FROM train WHERE value IS NOT NULL) GROUP BY GROUPING SETS ((station_id, month, hour), (station_id, hour), (station_id, month), (station_id)))"""
CLIMATE = f"""{CELLS}, clim AS (SELECT p.station_id, p.ts, p.value, coalesce(a.mean, b.mean, c.mean, d.mean) AS pred, CASE WHEN a.mean IS NOT NULL THEN 'month_hour' WHEN b.mean IS NOT NULL THEN 'hour' WHEN c.mean IS NOT NULL THEN 'month' WHEN d.mean IS NOT NULL THEN 'global' END AS cell_source FROM panel p
LEFT JOIN cells a ON a.level = 'month_hour' AND a.station_id = p.station_id AND a.month = extract(month FROM p.ts) AND a.hour = extract(hour FROM p.ts)
LEFT JOIN cells b ON b.level = 'hour' AND b.station_id = p.station_id AND b.hour = extract(hour FROM p.ts)
LEFT JOIN cells c ON c.level = 'month' AND c.station_id = p.station_id AND c.month = extract(month FROM p.ts)
LEFT JOIN cells d ON d.level = 'global' AND d.station_id = p.station_id)"""


@query(f"WITH {PANEL}, {CELLS} SELECT station_id, level, month, hour, round(mean, 5) AS mean, round(median, 5) AS median, n FROM cells")
def climatology_cells(spark: SparkSession, sf: str) -> DataFrame:
    return fc.climatology_cells(train_block(src.hourly_panel(spark, sf))).select("station_id", "level", "month", "hour", r("mean"), r("median"), "n")


@query(f"WITH {PANEL}, {CLIMATE} SELECT station_id, {SQL_T}, round(pred, 5) AS pred, cell_source FROM clim JOIN blocks ON b = 'test' AND ts BETWEEN x AND y")
def climatology_forecast(spark: SparkSession, sf: str) -> DataFrame:
    panel = src.hourly_panel(spark, sf)
    return fc.climatology(test_block(panel), train_block(panel)).select("station_id", hour(), r("pred"), "cell_source")


LADDER = f"""{PANEL}, {CLIMATE}, preds AS (
SELECT station_id, ts, value, 'persistence' AS model, 24 AS horizon_h, {lagged(24)} AS pred FROM panel UNION ALL SELECT station_id, ts, value, 'persistence', 48, {lagged(48)} FROM panel
UNION ALL SELECT station_id, ts, value, 'diurnal_persistence', 24, {asof(24)} UNION ALL SELECT station_id, ts, value, 'diurnal_persistence', 48, {asof(48)}
UNION ALL SELECT station_id, ts, value, 'same_hour_mean', 24, list_avg([{LAGS}]) FROM panel UNION ALL SELECT station_id, ts, value, 'same_hour_mean', 48, list_avg([{", ".join(lagged(48 + 24 * k) for k in range(DAYS))}]) FROM panel
UNION ALL SELECT station_id, ts, value, 'climatology_mean', 24, pred FROM clim UNION ALL SELECT station_id, ts, value, 'climatology_mean', 48, pred FROM clim),
scored AS (SELECT preds.* FROM preds JOIN blocks ON b = 'test' AND ts BETWEEN x AND y)"""
REGRESSION = "count(*) AS n, round(sqrt(avg((pred - value) ** 2)), 5) AS rmse, round(avg(abs(pred - value)), 5) AS mae, round(avg(pred - value), 5) AS bias, round(1 - sum((pred - value) ** 2) / nullif(sum((value - ybar) ** 2), 0), 5) AS r2, round(median(abs(pred - value)), 5) AS median_ae"
ROUNDED = ("rmse", "mae", "bias", "r2", "median_ae")


def ladder(spark: SparkSession, sf: str) -> DataFrame:
    panel = src.hourly_panel(spark, sf)
    return test_block(fc.ladder(panel, train_block(panel), [24, 48], DAYS))


@query(f"WITH {LADDER} SELECT station_id, model, horizon_h, {REGRESSION} FROM (SELECT *, avg(value) OVER (PARTITION BY station_id, model, horizon_h) AS ybar FROM scored WHERE value IS NOT NULL AND pred IS NOT NULL) GROUP BY ALL")
def task_f_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression(ladder(spark, sf), ["station_id", "model", "horizon_h"]).select("station_id", "model", "horizon_h", "n", *[r(c) for c in ROUNDED])


@query(f"WITH {LADDER} SELECT model, round(avg(h24), 5) AS h24, round(avg(h48), 5) AS h48 FROM (SELECT station_id, model, CASE WHEN horizon_h = 24 THEN sqrt(avg((pred - value) ** 2)) END AS h24, CASE WHEN horizon_h = 48 THEN sqrt(avg((pred - value) ** 2)) END AS h48 FROM scored WHERE value IS NOT NULL AND pred IS NOT NULL GROUP BY station_id, model, horizon_h) GROUP BY 1")
def model_horizon_pivot(spark: SparkSession, sf: str) -> DataFrame:
    rows = metrics.regression(ladder(spark, sf), ["station_id", "model", "horizon_h"]).withColumn("h", F.concat(F.lit("h"), "horizon_h"))
    return metrics.pivot_mean(rows, "model", "h", ["h24", "h48"], "rmse").select("model", r("h24"), r("h48"))


DAILY_SCORES = f"{LADDER}, days AS (SELECT station_id, model, horizon_h, CAST(ts + INTERVAL 5 HOUR AS DATE) AS date, CASE WHEN count(value) >= 18 THEN avg(value) END AS value, CASE WHEN count(pred) >= 18 THEN avg(pred) END AS pred FROM scored GROUP BY ALL), conf AS (SELECT station_id, model, horizon_h, count(*) FILTER (WHERE value > 50 AND pred > 50) AS tp, count(*) FILTER (WHERE value <= 50 AND pred > 50) AS fp, count(*) FILTER (WHERE value > 50 AND pred <= 50) AS fn, count(*) FILTER (WHERE value <= 50 AND pred <= 50) AS tn FROM days WHERE value IS NOT NULL AND pred IS NOT NULL GROUP BY ALL)"
KEYS = ["station_id", "model", "horizon_h"]


def scored_days(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily(ladder(spark, sf), KEYS, ["value", "pred"], src.ZONE)


@query(f"WITH {PANEL} SELECT station_id, strftime(CAST(ts + INTERVAL 5 HOUR AS DATE), '%Y-%m-%d') AS date, CASE WHEN count(value) >= 18 THEN round(avg(value), 5) END AS value FROM panel GROUP BY ALL")
def daily_mean_local(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.daily(src.hourly_panel(spark, sf), ["station_id"], ["value"], src.ZONE).select("station_id", F.col("date").cast("string").alias("date"), r("value"))


@query(f"WITH {DAILY_SCORES} SELECT * FROM conf")
def exceedance_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.confusion(scored_days(spark, sf), KEYS, THRESHOLD)


@query(f"""WITH {DAILY_SCORES}, s AS (SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall, CAST(tp + fn AS DOUBLE) / nullif(tp + fp + fn + tn, 0) AS base_rate,
CAST(tp AS DOUBLE) / nullif(tp + fn, 0) - CAST(fp AS DOUBLE) / nullif(fp + tn, 0) AS peirce, CASE WHEN tp + fp + fn > 0 THEN 2.0 * tp / (2 * tp + fp + fn) END AS f1 FROM conf),
t AS (SELECT *, CASE WHEN base_rate = 0 THEN 0.0 ELSE 2 * base_rate / (base_rate + 1) END AS f1_trivial FROM s)
SELECT station_id, model, horizon_h, round(precision, 5) AS precision, round(recall, 5) AS recall, round(base_rate, 5) AS base_rate, round(peirce, 5) AS peirce, round(f1, 5) AS f1, round(f1_trivial, 5) AS f1_trivial, coalesce(f1 > f1_trivial, false) AS beats_trivial FROM t""")
def exceedance_skill(spark: SparkSession, sf: str) -> DataFrame:
    s = metrics.skill(metrics.confusion(scored_days(spark, sf), KEYS, THRESHOLD))
    return s.select(*KEYS, *[r(c) for c in ("precision", "recall", "base_rate", "peirce", "f1", "f1_trivial")], "beats_trivial")


# --- nowcasts ---

DISTANCES = f"{PANEL}, dist AS (SELECT a.station_id, a.city, b.station_id AS donor, b.city AS donor_city, {HAVERSINE.format(r=6371.0088, a='a', b='b')} AS km FROM stations a JOIN stations b ON a.station_id <> b.station_id)"
DONORS = f"{DISTANCES}, donors AS (SELECT d.station_id, d.city, p.ts, donor, km, p.value AS v, row_number() OVER (PARTITION BY d.station_id, p.ts ORDER BY km, donor) AS rank FROM test p JOIN dist d ON d.donor = p.station_id AND d.city <> d.donor_city WHERE p.value IS NOT NULL)"


def test_donors(spark: SparkSession, sf: str) -> DataFrame:
    return nc.donors(test_block(src.hourly_panel(spark, sf)), src.stations(spark))


def near_donors(spark: SparkSession, sf: str, k: int) -> DataFrame:
    st = src.stations(spark)
    return nc.nearest_usable(test_block(src.hourly_panel(spark, sf)), st, st, k)


@query(f"WITH {PANEL} SELECT c.city AS held_out_city, round(avg(value), 5) AS mean, round(median(value), 5) AS median, count(*) AS n FROM (SELECT DISTINCT city FROM stations) c JOIN stations s ON s.city <> c.city JOIN train USING (station_id) WHERE value IS NOT NULL GROUP BY 1")
def pool_mean(spark: SparkSession, sf: str) -> DataFrame:
    out = nc.pool_mean(train_block(src.hourly_panel(spark, sf)), splits.leave_city_out(src.stations(spark)))
    return out.select("held_out_city", r("mean"), r("median"), "n")


@query(f"WITH {DONORS} SELECT station_id, {SQL_T}, round(v, 5) AS pred FROM donors WHERE rank = 1")
def nearest_monitor(spark: SparkSession, sf: str) -> DataFrame:
    return nc.nearest(near_donors(spark, sf, 1)).select("station_id", hour(), r("pred"))


@query(f"WITH {DONORS} SELECT station_id, {SQL_T}, round(sum(v / km ** 2) / sum(1 / km ** 2), 5) AS pred FROM donors WHERE rank <= 5 GROUP BY station_id, donors.ts")
def idw_k5_p2(spark: SparkSession, sf: str) -> DataFrame:
    return nc.idw(near_donors(spark, sf, 5)).select("station_id", hour(), r("pred"))


@query(f"WITH {DISTANCES} SELECT a.station_id AS a, b.station_id AS b, round(any_value(km), 4) AS km, round(0.5 * avg((a.value - b.value) ** 2), 4) AS gamma, count(*) AS n FROM train a JOIN train b ON a.ts = b.ts AND a.station_id < b.station_id JOIN dist ON dist.station_id = a.station_id AND donor = b.station_id WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10")
def empirical_variogram(spark: SparkSession, sf: str) -> DataFrame:
    return nc.variogram(train_block(src.hourly_panel(spark, sf)), src.stations(spark)).select("a", "b", r("km", 4), r("gamma", 4), "n")


@query(f"WITH {DONORS}, p AS (SELECT station_id, ts, string_agg(donor, ',' ORDER BY donor) AS pattern FROM donors GROUP BY ALL) SELECT station_id, pattern, count(*) AS n FROM p GROUP BY ALL")
def kriging_availability_patterns(spark: SparkSession, sf: str) -> DataFrame:
    sets = test_donors(spark, sf).groupBy("station_id", "ts").agg(F.array_join(F.sort_array(F.collect_list("donor")), ",").alias("pattern"))
    return sets.groupBy("station_id", "pattern").agg(F.count("*").alias("n"))


def kriged(spark: SparkSession, sf: str) -> DataFrame:
    panel, st = src.hourly_panel(spark, sf), src.stations(spark)
    pairs = [(x.km, x.gamma) for x in nc.variogram(train_block(panel), st).orderBy("a", "b").collect()]  # pairs of stations
    return nc.kriging(test_block(panel), st, nc.fit_exponential(pairs))


@query()
def ordinary_kriging(spark: SparkSession, sf: str) -> DataFrame:
    return kriged(spark, sf).select("station_id", hour(), r("pred"), "fallback")


@query()
def kriging_fallback_rate(spark: SparkSession, sf: str) -> DataFrame:
    return kriged(spark, sf).groupBy("station_id").agg(F.count("*").alias("n"), F.avg(F.col("fallback").cast("int")).alias("fallback_rate"))


NOWCASTS = f"{DONORS}, pool AS (SELECT c.station_id, avg(value) AS mean FROM stations c JOIN stations s ON s.city <> c.city JOIN train ON train.station_id = s.station_id WHERE value IS NOT NULL GROUP BY 1), npreds AS (SELECT station_id, ts, 'nearest_monitor' AS model, v AS pred FROM donors WHERE rank = 1 UNION ALL SELECT station_id, ts, 'idw_k5_p2', sum(v / km ** 2) / sum(1 / km ** 2) FROM donors WHERE rank <= 5 GROUP BY station_id, ts UNION ALL SELECT station_id, ts, 'training_pool_mean', mean FROM test JOIN pool USING (station_id)), nscored AS (SELECT npreds.*, test.value, city FROM npreds JOIN test USING (station_id, ts) JOIN stations USING (station_id) WHERE test.value IS NOT NULL AND pred IS NOT NULL)"


def nowcasts(spark: SparkSession, sf: str) -> DataFrame:
    """(station_id, ts, city, value, model, pred) of the test block, each city held out in turn."""
    panel, st = src.hourly_panel(spark, sf), src.stations(spark)
    test = test_block(panel)
    ranked = nc.nearest_usable(test, st, st, 5)
    pool = nc.pool_mean(train_block(panel), splits.leave_city_out(st)).select(F.col("held_out_city").alias("city"), F.col("mean").alias("pred"))
    constant = test.join(st, "station_id").join(F.broadcast(pool), "city").select("station_id", "ts", "pred")
    preds = nc.nearest(ranked).withColumn("model", F.lit("nearest_monitor")).unionByName(nc.idw(ranked).withColumn("model", F.lit("idw_k5_p2"))).unionByName(constant.withColumn("model", F.lit("training_pool_mean")))
    return preds.join(test, ["station_id", "ts"]).join(F.broadcast(st.select("station_id", "city")), "station_id").where("value is not null and pred is not null")


@query(f"WITH {NOWCASTS} SELECT city, model, {REGRESSION} FROM (SELECT *, avg(value) OVER (PARTITION BY city, model) AS ybar FROM nscored) GROUP BY ALL")
def task_n_ladder(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.regression(nowcasts(spark, sf), ["city", "model"]).select("city", "model", "n", *[r(c) for c in ROUNDED])


@query(f"WITH {NOWCASTS} SELECT CASE WHEN grouping(city) = 1 THEN 'POOLED' ELSE city END AS city, count(*) AS n, round(sqrt(avg((pred - value) ** 2)), 5) AS rmse FROM nscored WHERE model = 'idw_k5_p2' GROUP BY ROLLUP (city)")
def fold_rollup_pooled(spark: SparkSession, sf: str) -> DataFrame:
    one = nowcasts(spark, sf).where("model = 'idw_k5_p2'")
    return metrics.rollup_pooled(one, "city", F.round(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("value"), 2))), 5), "rmse")


@query(f"WITH {NOWCASTS}, s AS (SELECT city, model, sqrt(avg((pred - value) ** 2)) AS rmse FROM nscored GROUP BY ALL) SELECT model, count(*) AS n_seeds, round(avg(rmse), 5) AS mean, round(stddev_pop(rmse), 5) AS sd, stddev_pop(rmse) < 1e-12 AS deterministic FROM s GROUP BY 1")
def seed_spread(spark: SparkSession, sf: str) -> DataFrame:
    return metrics.spread(metrics.regression(nowcasts(spark, sf), ["city", "model"]), ["model"], "rmse").select("model", "n_seeds", r("mean"), r("sd"), "deterministic")


@query(f"WITH {NOWCASTS} SELECT city, " + ", ".join(f"round(sqrt(avg((pred - value) ** 2) FILTER (WHERE model = '{m}')), 5) AS {m}" for m in ("idw_k5_p2", "nearest_monitor", "training_pool_mean")) + " FROM nscored GROUP BY 1")
def model_city_pivot(spark: SparkSession, sf: str) -> DataFrame:
    names = ["idw_k5_p2", "nearest_monitor", "training_pool_mean"]
    return metrics.pivot_mean(metrics.regression(nowcasts(spark, sf), ["city", "model"]), "city", "model", names, "rmse").select("city", *[r(c) for c in names])


# --- significance ---

LOSSES = f"{LADDER}, losses AS (SELECT a.station_id, a.ts, (a.pred - a.value) ** 2 AS la, (b.pred - b.value) ** 2 AS lb, row_number() OVER (PARTITION BY a.station_id ORDER BY a.ts) AS rn FROM scored a JOIN scored b USING (station_id, ts) WHERE a.model = 'persistence' AND b.model = 'climatology_mean' AND a.horizon_h = 24 AND b.horizon_h = 24 AND a.value IS NOT NULL AND a.pred IS NOT NULL AND b.pred IS NOT NULL), dd AS (SELECT station_id, ts, rn, la - lb AS d, (la - lb) - avg(la - lb) OVER (PARTITION BY station_id) AS c FROM losses)"


def lrv(lags: int) -> str:
    terms = " + ".join(["c * c", *[f"2 * (1 - {k} / {lags + 1}.0) * c * coalesce(lag(c, {k}) OVER (PARTITION BY station_id ORDER BY rn), 0)" for k in range(1, lags + 1)]])
    return f"lv{lags} AS (SELECT station_id, count(*) AS n, avg(d) AS mean, sum(t) / count(*) AS lrv, max(abs(d)) AS top FROM (SELECT *, {terms} AS t FROM dd) GROUP BY 1)"


def dm(lags: int) -> str:
    h = lags + 1
    return f"CASE WHEN n < 10 THEN NULL WHEN top <= 1e-8 THEN 0.0 WHEN lrv <= 0 THEN NULL ELSE mean / sqrt(lrv / n) * sqrt(greatest((n + 1 - 2 * {h} + {h} * ({h} - 1) / CAST(n AS DOUBLE)) / n, 0)) END"


def losses(spark: SparkSession, sf: str) -> DataFrame:
    rows = ladder(spark, sf).where("horizon_h = 24 and value is not null and pred is not null").withColumn("l", F.pow(F.col("pred") - F.col("value"), 2))
    pick = lambda m, c: rows.where(F.col("model") == m).select("station_id", "ts", F.col("l").alias(c))
    return pick("persistence", "la").join(pick("climatology_mean", "lb"), ["station_id", "ts"])


@query(f"WITH {LOSSES}, {lrv(24)} SELECT station_id, n, round(mean, 3) AS mean, round(lrv, 2) AS lrv FROM lv24")
def newey_west_lrv(spark: SparkSession, sf: str) -> DataFrame:
    return stats.long_run_variance(losses(spark, sf).withColumn("d", F.col("la") - F.col("lb")), ["station_id"], 24).select("station_id", "n", r("mean", 3), r("lrv", 2))


@query(f"WITH {LOSSES}, {lrv(23)} SELECT station_id, n, round(mean, 3) AS mean_diff, round({dm(23)}, 5) AS dm FROM lv23")
def dm_statistic(spark: SparkSession, sf: str) -> DataFrame:
    return stats.diebold_mariano(losses(spark, sf), ["station_id"], 23).select("station_id", "n", r("mean_diff", 3), r("dm"))


@query(f"WITH {LOSSES}, {lrv(0)}, {lrv(6)}, {lrv(24)} SELECT station_id, 0 AS lags, round({dm(0)}, 5) AS dm FROM lv0 UNION ALL SELECT station_id, 6, round({dm(6)}, 5) FROM lv6 UNION ALL SELECT station_id, 24, round({dm(24)}, 5) FROM lv24")
def dm_lag_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    d, out = losses(spark, sf), None
    for lags in (0, 6, 24):
        one = stats.diebold_mariano(d, ["station_id"], lags).select("station_id", F.lit(lags).alias("lags"), r("dm"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"WITH {LOSSES} SELECT station_id, " + ", ".join(f"round(corr(CASE WHEN l{k} IS NOT NULL THEN d END, l{k}), 5) AS acf_{k}" for k in (1, 2, 24)) + " FROM (SELECT *, " + ", ".join(f"lag(d, {k}) OVER (PARTITION BY station_id ORDER BY rn) AS l{k}" for k in (1, 2, 24)) + " FROM dd) GROUP BY 1")
def loss_acf(spark: SparkSession, sf: str) -> DataFrame:
    return stats.autocorrelation(losses(spark, sf).withColumn("d", F.col("la") - F.col("lb")), ["station_id"], [1, 2, 24]).select("station_id", r("acf_1"), r("acf_2"), r("acf_24"))
