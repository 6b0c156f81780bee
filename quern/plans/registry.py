"""Registered queries, each with its DuckDB counterpart where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


#: CTEs that give the adapters' tables in DuckDB.
PANEL = """
obs AS (SELECT 's' || (user_id % 8) AS station_id, date_trunc('hour', ts) AS ts, avg(value) AS value FROM events GROUP BY ALL),
hours AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS ts FROM (SELECT min(ts) a, max(ts) b FROM obs)),
panel AS (SELECT station_id, ts, value FROM (SELECT DISTINCT station_id FROM obs) CROSS JOIN hours LEFT JOIN obs USING (station_id, ts)),
stations AS (SELECT * FROM (VALUES ('s0','c0',41.3255,69.2947),('s1','c1',43.2380,76.9450),('s2','c2',37.9340,58.3860),('s3','c3',38.5730,68.7860),
 ('s4','c3',38.5600,68.7800),('s5','c4',42.8560,74.6010),('s6','c4',42.8890,74.6120),('s7','c5',51.1605,71.4704)) v(station_id, city, latitude, longitude)),
blocks AS (SELECT b, CAST(x AS TIMESTAMP) x, CAST(y AS TIMESTAMP) y FROM (VALUES ('train','2024-01-01 00:00','2024-01-12 23:00'),('val','2024-01-17 00:00','2024-01-19 23:00'),('test','2024-01-24 00:00','2024-01-30 23:00')) v(b, x, y)),
train AS (SELECT panel.* FROM panel JOIN blocks ON b = 'train' AND ts BETWEEN x AND y),
test AS (SELECT panel.* FROM panel JOIN blocks ON b = 'test' AND ts BETWEEN x AND y)
"""

DAILY = """
daily AS (SELECT n_name AS station_id, 'r' || n_regionkey AS city, CAST(l_shipdate AS DATE) AS date, avg(l_quantity) AS target, count(*) AS n,
 avg(l_tax) FILTER (WHERE l_returnflag = 'R') AS aod, count(*) FILTER (WHERE l_returnflag = 'R') AS valid_px, avg(l_extendedprice) / 1500 AS forecast
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
"""
