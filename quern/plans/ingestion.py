"""Queries on stored pages of a service, and on the benchmark job. The pages are written from the given tables first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import grid, ingest, job, qc, splits
from quern.plans.census import BOUNDS, LEAST
from quern.plans.hourly import hour, level, r
from quern.plans.registry import query
from quern.sources import paged, tables as src
from quern.sources.sinks import new_path

LIMIT = 3  # records of a page of locations


def countries(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers of each nation through the paged source. Two nations in five have a page that isn't JSON: the second, or the first."""
    spark.dataSource.register(paged.PagedSource)
    s, n = src.table(spark, sf, "supplier"), src.table(spark, sf, "nation")
    rows = s.join(n, s.s_nationkey == n.n_nationkey).select("s_suppkey", "s_name", F.concat(F.lit("n"), "s_nationkey").alias("k"))
    pages = paged.paged(rows, F.col("k"), "s_suppkey", F.struct(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), LIMIT)
    kind = F.substring("path", 2, 9).cast("int") % 5
    broken = ((kind == 1) & (F.col("page") == 2)) | ((kind == 2) & (F.col("page") == 1))
    base = new_path(spark, "pages")
    paged.store(pages.withColumn("value", F.when(broken, "<html>").otherwise(F.col("value"))), base)
    sizes = n.join(s, s.s_nationkey == n.n_nationkey, "left").groupBy("n_nationkey").agg(F.count("s_suppkey").alias("n")).orderBy("n_nationkey").collect()  # a row for each country
    parts = [{**paged.locations(f"n{x.n_nationkey}"), "path": f"part=n{x.n_nationkey}", "max_pages": max(paged.MOST_PAGES, x.n // LIMIT + 1)} for x in sizes]
    return spark.read.format("paged").option("base", base).option("limit", LIMIT).option("parts", paged.parts_json(parts)).load()


COUNTED = "p AS (SELECT 'n' || n_nationkey AS part, n_nationkey % 5 AS kind, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)"


@query(f"WITH {COUNTED} SELECT part, CASE WHEN kind = 2 OR n = 0 THEN 0 WHEN kind = 1 AND n >= 3 THEN 3 ELSE n END AS n_records, CASE WHEN n = 0 OR kind = 2 THEN 'failed' WHEN kind = 1 AND n >= 3 THEN 'partial' ELSE 'complete' END AS status FROM p")
def census_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """One broken page takes nothing from other countries, nor the pages before it."""
    return paged.outcomes(countries(spark, sf)).select("part", "n_records", "status")


@query(f"WITH {COUNTED}, s AS (SELECT 'n' || s_nationkey AS part, s_suppkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier) SELECT part, s_suppkey AS id, s_name AS name FROM s JOIN p USING (part) WHERE kind <> 2 AND (kind <> 1 OR rn <= 3)")
def census_kept_records(spark: SparkSession, sf: str) -> DataFrame:
    return paged.records(countries(spark, sf), "id long, name string").select("part", "r.id", "r.name")


HOURS = "h AS (SELECT user_id % 8 AS sensor, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL)"


@query(f"WITH {HOURS}, e AS (SELECT sensor, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1) SELECT CAST(sensor AS VARCHAR) AS sensor, strftime(ts, '%Y-%m-%d %H:%M') AS ts, round(value, 5) AS value FROM e LEFT JOIN h USING (sensor, ts)")
def paged_series(spark: SparkSession, sf: str) -> DataFrame:
    """Each sensor's hours by monthly windows, through pages, checked against the hours a window has, on a gapless grid."""
    spark.dataSource.register(paged.PagedSource)
    obs = src.table(spark, sf, "events").groupBy((F.col("user_id") % 8).cast("string").alias("sensor"), F.date_trunc("hour", "ts").alias("ts")).agg(F.avg("value").alias("value"))
    rows = obs.withColumn("month", F.date_format(F.trunc("ts", "month"), "yyyy-MM-dd"))
    start = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    base, limit = new_path(spark, "pages"), 100
    paged.store(paged.paged(rows, F.concat_ws("_", "sensor", "month"), "ts", F.struct("value", start.alias("start")), limit), base)
    months = rows.select("sensor", "month").distinct().collect()  # the requests
    parts = [{**paged.sensor_hours(m.sensor, m.month, m.month, 31 * 24, limit), "path": f"part={m.sensor}_{m.month}"} for m in sorted(months)]
    got = spark.read.format("paged").option("base", base).option("limit", limit).option("parts", paged.parts_json(parts)).load()
    found = paged.records(got, "value double, start string").select(F.split("part", ":")[0].alias("sensor"), F.split("part", ":")[1].alias("month"), "position", "r.*")
    lo = F.col("month").cast("timestamp")
    windows = found.select("sensor", "month").distinct().withColumns({"lo": lo, "hi": lo + F.expr("interval 1 month") - F.expr("interval 1 hour")})
    ingest.complete_or_raise(ingest.impossible_windows(found, windows, ["sensor", "month"]))
    series = ingest.records_to_series(found.withColumn("percent_complete", F.lit(None).cast("double")), ["sensor"], "start")
    return grid.regrid_own(series.select(F.col("sensor").alias("station_id"), "ts", "value")).select(F.col("station_id").alias("sensor"), hour(), r("value"))


def benchmark(spark: SparkSession, sf: str) -> DataFrame:
    """The panel that the job leaves behind after two runs; the second has nothing to write."""
    out, st = new_path(spark, "benchmark"), src.stations(spark)
    rules = qc.Rules(BOUNDS[0], BOUNDS[1], level(), 3, 6, 20, LEAST)
    first = job.build(src.hourly_panel(spark, sf), st, out, src.ZONE, rules)
    again = job.build(src.hourly_panel(spark, sf), st, out, src.ZONE, rules)
    if again.written or again.dropped or again.unchanged != len(first.written):
        raise RuntimeError(f"a rerun over the same tables changed {again}")
    return job.load(spark, out)


@query()
def benchmark_panel(spark: SparkSession, sf: str) -> DataFrame:
    return benchmark(spark, sf).select("station_id", "city", hour(), r("value"), "source")


@query()
def benchmark_summary(spark: SparkSession, sf: str) -> DataFrame:
    test = next((b, e) for name, b, e in splits.HOURLY_BLOCKS if name == "test")
    s = job.summary(benchmark(spark, sf), test)
    return s.select("station_id", "city", "n", F.date_format("first_valid", "yyyy-MM-dd HH:mm").alias("first_valid"), F.date_format("last_valid", "yyyy-MM-dd HH:mm").alias("last_valid"), "n_test", r("test_share"))
