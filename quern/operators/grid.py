"""Grids, runs and choices within groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.sources.sinks import kept


def regrid_hourly(obs: DataFrame) -> DataFrame:
    """Every station at every hour from the first to the last of all; (station_id, ts, value)."""
    hours = obs.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select(F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
    grid = obs.select("station_id").distinct().crossJoin(hours)  # a dimension of stations by a calendar
    return grid.join(obs, ["station_id", "ts"], "left")


def regrid_own(obs: DataFrame) -> DataFrame:
    """Every station at every hour from its own first to its own last; (station_id, ts, value)."""
    hours = obs.groupBy("station_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).select("station_id", F.explode(F.sequence("a", "b", F.expr("interval 1 hour"))).alias("ts"))
    return hours.join(obs, ["station_id", "ts"], "left")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in the order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def run_length(df: DataFrame, value: Column, keys: list[str], order: str) -> DataFrame:
    """Adds run_n: how many neighbouring rows have the same value; a null is a run of its own."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumn("_v", value)
    new = F.when(F.col("_v").isNull() | F.lag("_v").over(w).isNull() | (F.col("_v") != F.lag("_v").over(w)), 1).otherwise(0)
    df = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("run_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_run"))).drop("_new", "_run")


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 200) -> DataFrame:
    """(id, component): the least id reachable over edges (a, b), by the least label of neighbours, then of the label itself.

    If so many rounds aren't enough, that is an error, not a partial answer.
    """
    both = kept(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = nodes.select("id", F.col("id").alias("component"))
    before = None
    for _ in range(rounds):
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        new = labels.join(near, labels.id == near.a, "left").select("id", F.least("component", F.coalesce("m", "component")).alias("component"))
        jump = new.select(F.col("id").alias("j"), F.col("component").alias("jc"))
        labels = new.join(jump, new.component == jump.j).select("id", F.col("jc").alias("component"))
        labels = kept(labels, "labels")
        state = labels.agg(F.sum(F.xxhash64("id", "component").cast("decimal(38,0)"))).first()
        if state == before:
            return labels
        before = state
    raise RuntimeError(f"components aren't settled after {rounds} rounds")


def positions(df: DataFrame, keys: list[str], order: list[str], weight: str | None = None) -> DataFrame:
    """df with pos: how many rows of its keys (or how much weight) come before a row in `order`, nulls first; rows that are
    equal in all of order are placed as they are read.

    No task holds a key: rows are sorted by range over all partitions and written, and each partition's total is added to the
    places in the later ones. A window runs over the totals, of which a key has one for each partition.
    """
    sort = [*keys, *order]
    numbered = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    rows = kept(numbered.select(*df.columns, F.shiftright("_id", 33).alias("_part"), F.col("_id").bitwiseAND(2**33 - 1).alias("_seq")), "positions")
    w = F.col(weight) if weight else F.lit(1)
    by_part = Window.partitionBy("_part", *keys).orderBy("_seq").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(w).over(by_part), F.lit(0))
    totals = rows.groupBy("_part", *keys).agg(F.sum(w).alias("_w"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(k).alias(f"_k_{k}") for k in keys], F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_before"))
    same = F.col("_part") == F.col("_p")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.withColumn("_inside", inside).join(offsets, same).select(*df.columns, (F.col("_inside") + F.col("_before")).alias("pos"))


def mid_ranks(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(*keys, value, n, rank): for each different value its rows and the mean of their ranks, from 1, by positions()."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return positions(counts, keys, [value], "n").select(*keys, value, "n", (F.col("pos") + (F.col("n") + 1) / 2).alias("rank"))
