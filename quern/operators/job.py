"""The benchmark panel as a job that can be run again: quality control, merging of co-located feeds, timing within cities, and
a partitioned table in which only what changed is overwritten.

Two digests make a rerun cheap. The first is of each feed's input: if none changed and the rules are the same, nothing else is
worked out. The second is of each output station: only partitions whose digest changed are written, by dynamic overwrite;
partitions of stations that are gone are dropped. Digests are sums over rows, so neither order nor partitioning matters.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.operators import qc
from quern.sources.sinks import kept


@dataclass(frozen=True)
class Built:
    """written and dropped: the stations whose partitions this run changed; unchanged: how many it left alone."""

    written: list[str]
    dropped: list[str]
    unchanged: int


def digests(rows: DataFrame, key: str) -> DataFrame:
    """(key, digest, n) of each key's rows, whatever their order: two sums of 64-bit hashes over all columns."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(rows.columns) if c != key]
    h = lambda salt: F.sum(F.xxhash64(F.lit(salt), *columns).cast("decimal(38,0)")).cast("string")
    return rows.groupBy(key).agg(F.concat_ws(":", h(1), h(2), F.count("*").cast("string")).alias("digest"), F.count("*").alias("n"))


def merged_feeds(panel: DataFrame, stations: DataFrame, metres: float = 150.0) -> DataFrame:
    """(station_id, city, ts, value, source): co-located stations become one, named by its city; others keep their id.

    In a cluster the station with more values comes first (of equals the smaller id), and the first that has a value in an hour
    gives it: never a mean. source is the giving station, empty where none has a value. Of several clusters in a city the later
    ones by their smallest id have it appended.
    """
    here = stations.join(panel.select("station_id").distinct(), "station_id", "left_semi")
    found = qc.components(qc.colocated_links(here.select(F.col("station_id").alias("id"), "latitude", "longitude"), metres), here.select(F.col("station_id").alias("id")))
    sizes = found.groupBy("component").agg(F.count("*").alias("members"))
    first = Window.partitionBy("city").orderBy("component")
    named = here.select(F.col("station_id").alias("id"), "city").join(found, "id").join(sizes, "component")
    heads = named.where("members > 1 and id = component").withColumn("nth", F.row_number().over(first)).select("component", F.when(F.col("nth") == 1, F.col("city")).otherwise(F.concat_ws("-", "city", "component")).alias("name"), F.col("city").alias("own_city"))
    counts = panel.groupBy("station_id").agg(F.count("value").alias("n"))
    member = named.join(heads, "component", "left").join(counts, F.col("id") == F.col("station_id")).select("station_id", F.coalesce("name", "id").alias("merged"), F.coalesce("own_city", "city").alias("city"), F.row_number().over(Window.partitionBy("component").orderBy(F.desc("n"), "id")).alias("place"))
    rows = panel.join(F.broadcast(member) if member.count() <= 100_000 else member, "station_id")  # stations are a dimension
    best = F.min_by(F.struct("value", F.col("station_id").alias("source")), F.when(F.col("value").isNotNull(), F.col("place")))
    out = rows.groupBy("merged", "city", "ts").agg(best.alias("b"))
    return out.select(F.col("merged").alias("station_id"), "city", "ts", "b.value", F.when(F.col("b.value").isNotNull(), F.col("b.source")).otherwise("").alias("source"))


def panel_of(panel: DataFrame, stations: DataFrame, zone: str, rules: qc.Rules, moved: DataFrame | None = None) -> DataFrame:
    """The benchmark panel (station_id, city, ts, value, source): what quality control keeps, merged, less stations whose timing
    is rejected within their city.
    """
    merged = kept(merged_feeds(qc.run(panel, zone, rules, moved).kept, stations), "merged")
    places = merged.select("station_id", "city").distinct()
    shapes = qc.diurnal_composite(merged, ["station_id"], zone).join(places, "station_id")
    bad = qc.within_city(shapes, places).where("verdict = 'reject'").select("station_id")
    return merged.join(bad, "station_id", "left_anti")


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _table(spark: SparkSession, path: str) -> dict[str, str]:
    """A small table (key, digest) of stations, or nothing if there is none yet."""
    return {r["key"]: r["digest"] for r in spark.read.schema("key string, digest string").parquet(path).collect()} if _exists(spark, path) else {}


def build(panel: DataFrame, stations: DataFrame, out: str, zone: str, rules: qc.Rules, moved: DataFrame | None = None) -> Built:
    """Bring the table at `out` up to date: out/panel by station_id, out/inputs and out/outputs with the digests.

    A run that is cut off leaves old digests, so the next one writes its partitions again: the panel first, the digests after.
    """
    spark = panel.sparkSession
    told = hashlib.sha256(repr((zone, rules.low, rules.high, str(rules.level), rules.flat, rules.zeros, rules.least_days, rules.least_share)).encode()).hexdigest()
    inputs = {r["station_id"]: r["digest"] for r in digests(panel.select("station_id", "ts", "value"), "station_id").collect()}  # a row for each station
    places = stations if moved is None else stations.join(moved.select("station_id", F.col("verdict").alias("moved")), "station_id", "left")
    inputs |= {"\0rules": told, "\0stations": ";".join(sorted(f"{r['station_id']}={r['digest']}" for r in digests(places, "station_id").collect()))}
    before = _table(spark, f"{out}/outputs")
    if before and _table(spark, f"{out}/inputs") == inputs:
        return Built([], [], len(before))
    final = kept(panel_of(panel, stations, zone, rules, moved), "panel")
    now = {r["station_id"]: r["digest"] for r in digests(final, "station_id").collect()}
    changed = sorted(k for k, d in now.items() if before.get(k) != d)
    dropped = sorted(set(before) - set(now))
    if changed:
        rows = final.join(F.broadcast(spark.createDataFrame([(k,) for k in changed], "station_id string")), "station_id")
        rows.repartition("station_id").sortWithinPartitions("station_id", "ts").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("station_id").parquet(f"{out}/panel")
    for k in dropped:
        _delete(spark, f"{out}/panel/station_id={k}")
    for name, table in (("outputs", now), ("inputs", inputs)):
        spark.createDataFrame(sorted(table.items()), "key string, digest string").coalesce(1).write.mode("overwrite").parquet(f"{out}/{name}")
    return Built(changed, dropped, len(now) - len(changed))


def load(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("city string, ts timestamp_ntz, value double, source string, station_id string").parquet(f"{out}/panel")


def summary(panel: DataFrame, test: tuple[str, str]) -> DataFrame:
    """(station_id, city, n, first_valid, last_valid, n_test, test_share): how complete each station is, also in the test block."""
    seen, inside = F.when(F.col("value").isNotNull(), F.col("ts")), F.col("ts").between(*[F.lit(t).cast("timestamp_ntz") for t in test])
    by = panel.groupBy("station_id", "city").agg(F.count("value").alias("n"), F.min(seen).alias("first_valid"), F.max(seen).alias("last_valid"), F.count(F.when(inside, F.col("value"))).alias("n_test"), F.count_if(inside).alias("_t"))
    return by.withColumn("test_share", F.col("n_test") / F.nullif(F.col("_t"), F.lit(0))).drop("_t")
