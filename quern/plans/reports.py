"""Queries on reductions at stations, on numbers in texts and on highlights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import report
from quern.operators import reductions
from quern.plans.dimensions import CUSTOMER_CELLS, KM, OFF, SITES, customer_cells, sites
from quern.plans.registry import query
from quern.sources import tables as src

_POINT = "'{\"latitude\":' || latitude || ',\"longitude\":' || longitude || ',\"station_id\":\"' || station_id || '\"}'"
QUARTERS = SITES.replace("37 + (s_suppkey * 37 % 1500) * CAST(0.01 AS DOUBLE)", "37 + (s_suppkey * 37 % 1500) * CAST(0.25 AS DOUBLE)").replace("55 + (s_suppkey * 53 % 2200) * CAST(0.01 AS DOUBLE)", "55 + (s_suppkey * 53 % 2200) * CAST(0.25 AS DOUBLE)")


@query(
    f"""WITH {QUARTERS}, n AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY station_id) - 1) / 13.0) AS BIGINT) AS request_no FROM sites),
t AS (SELECT request_no, count(*) AS n_stations, '{{"buffer_m":1000,"date_from":"2023-01-01","date_to":"2023-12-31","feature":"aod","stations":[' || string_agg({_POINT}, ',' ORDER BY station_id) || '],"statistic":"mean"}}' AS request FROM n GROUP BY 1)
SELECT request_no, n_stations, n_stations * 365 AS n_elements, request, left(sha256(request), 16) AS fingerprint FROM t"""
)
def raster_requests(spark: SparkSession, sf: str) -> DataFrame:
    """A year at all sites, in requests of at most 5,000 elements."""
    k = F.col("s_suppkey")
    st = src.table(spark, sf, "supplier").select(F.concat(F.lit("s"), k).alias("station_id"), (37 + (k * 37 % 1500) * 0.25).alias("latitude"), (55 + (k * 53 % 2200) * 0.25).alias("longitude"))
    return reductions.requests(st, F.lit("aod"), 1000, "mean", "2023-01-01", "2023-12-31")


@query(f"WITH {SITES}, {CUSTOMER_CELLS} SELECT s.station_id, c.epoch AS image, round(avg(value) + {OFF}, 4) AS mean, count(value) AS count, max(value) AS max, round(stddev_pop(value), 4) AS \"stdDev\" FROM sites s JOIN cc c ON {KM} <= 100 GROUP BY 1, 2")
def raster_reduction(spark: SparkSession, sf: str) -> DataFrame:
    """Cells within 100 km of each site, for each of four images."""
    cells = customer_cells(spark, sf).withColumnRenamed("epoch", "image")
    out = reductions.reduce_at(sites(spark, sf), cells, 100.0, ["image"], "value", ["mean", "count", "max", "stdDev"])
    return out.select("station_id", "image", F.round(F.col("mean") + OFF, 4).alias("mean"), "count", "max", F.round("stdDev", 4).alias("stdDev"))


@query("SELECT CAST(user_id % 8 AS VARCHAR) AS station_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS date, round(CASE WHEN extract(day FROM ts) % 3 <> 0 THEN max(value) END * 0.001, 6) AS value, count(*) AS valid_px, true AS fixture FROM events GROUP BY 1, 2, extract(day FROM ts)")
def tidy_features(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded answers, a document a day; days without a retrieval keep their row."""
    e = src.table(spark, sf, "events").withColumn("date", F.to_date("ts"))
    by = e.groupBy((F.col("user_id") % 8).cast("string").alias("station_id"), "date").agg(F.max("value").alias("v"), F.count("*").alias("n"))
    seen = F.when(F.dayofmonth("date") % 3 != 0, F.col("v"))
    features = F.struct(F.struct("station_id", F.col("date").cast("string").alias("date"), seen.alias("value"), F.col("n").alias("count")).alias("properties"))
    answers = by.groupBy("date").agg(F.collect_list(features).alias("features")).select(F.to_json(F.struct("features")).alias("json"))  # the stations of a day
    return reductions.tidy(answers, 0.001, fixture=True).select("station_id", F.date_format("date", "yyyy-MM-dd").alias("date"), F.round("value", 6).alias("value"), "valid_px", "fixture")


TOLD = "told AS (SELECT n_nationkey AS k, n_name, CAST(count(*) AS VARCHAR) AS n, format('{:.2f}', avg(s_acctbal) + 1.3e-6) AS mean, format('{:+.1f}', min(s_acctbal) / 7 + 1.3e-6) AS low, format('{:.1f}%', 100 * count(*) FILTER (WHERE s_acctbal > 5000) / CAST(count(*) AS DOUBLE) + 1.3e-6) AS rich, format('{:,}', CAST(sum(s_acctbal) AS BIGINT)) AS total FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"


def told(spark: SparkSession, sf: str) -> DataFrame:
    s, n = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation")
    by = s.join(n, s.s_nationkey == n.n_nationkey).groupBy(F.col("n_nationkey").alias("k"), "n_name").agg(F.count("*").alias("c"), F.avg("s_acctbal").alias("m"), F.min("s_acctbal").alias("l"), F.count_if(F.col("s_acctbal") > 5000).alias("r"), F.sum("s_acctbal").alias("t"))
    return by.select("k", "n_name", report.fixed(F.col("c"), 0).alias("n"), report.fixed(F.col("m") + OFF).alias("mean"), report.signed(F.col("l") / 7 + OFF).alias("low"), report.percent(F.col("r") / F.col("c") + OFF / 100).alias("rich"), report.thousands(F.round("t")).alias("total"))


@query(f"WITH {TOLD} SELECT * FROM told")
def number_texts(spark: SparkSession, sf: str) -> DataFrame:
    return told(spark, sf)


@query(f"WITH {TOLD} SELECT k, n_name || ': ' || n || ' suppliers with ' || mean || ' on average, ' || rich || ' above 5,000.' AS filled FROM told")
def filled_templates(spark: SparkSession, sf: str) -> DataFrame:
    """A sentence for each nation, from a template for each and one table of numbers."""
    t = told(spark, sf)
    numbers = report.named(t.select("k", "n_name", "n", "mean", "rich"), ["k"])
    place = lambda name: F.concat(F.lit("{{ " + name + "_"), F.col("k"), F.lit(" }}"))
    text = F.concat(place("n_name"), F.lit(": "), place("n"), F.lit(" suppliers with "), place("mean"), F.lit(" on average, "), place("rich"), F.lit(" above 5,000."))
    return report.fill(t.select("k", text.alias("text")), numbers).select("k", "filled")


@query("WITH b AS (SELECT item_id, unnest(string_split(text, '. ')) AS t FROM benchmark) SELECT item_id, count(*) AS n_bullets, count(*) FILTER (WHERE length(t) > 85) AS n_over, CAST(0 AS BIGINT) AS n_acronyms, count(*) BETWEEN 3 AND 5 AND count(*) FILTER (WHERE length(t) > 85) = 0 AS ok FROM b GROUP BY 1")
def highlight_lint(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences as highlights; the made-up prose has no acronym."""
    bullets = src.table(spark, sf, "benchmark").select("item_id", F.explode(F.split("text", r"\. ")).alias("text"))
    return report.lint(bullets, "item_id")
