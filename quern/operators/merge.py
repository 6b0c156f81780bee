"""Merging duplicate feeds by precedence, with each row's source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def feed(panel: DataFrame, station: str, name: str) -> DataFrame:
    return panel.where(F.col("station_id") == station).select("ts", F.col("value").alias(name))


def merge_feeds(panel: DataFrame, primary: str, secondary: str) -> DataFrame:
    """(ts, p, s, value, source): the primary where it has a value, else the secondary; never their mean."""
    both = feed(panel, primary, "p").join(feed(panel, secondary, "s"), "ts", "fullouter")
    source = F.when(F.col("p").isNotNull(), primary).when(F.col("s").isNotNull(), secondary).otherwise("")
    return both.withColumns({"value": F.coalesce("p", "s"), "source": source})


def merge_report(merged: DataFrame, tolerance: float, strict: bool = True) -> DataFrame:
    """One row: counts, overlap, gaps filled, and how the feeds differ where both have a value."""
    d = F.when(F.col("p").isNotNull() & F.col("s").isNotNull(), F.abs(F.col("p") - F.col("s")))
    near = d < tolerance if strict else d <= tolerance
    return merged.withColumn("d", d).agg(
        F.count("p").alias("n_primary"), F.count("s").alias("n_secondary"), F.count("d").alias("n_overlap"),
        F.count_if(F.col("p").isNull() & F.col("s").isNotNull()).alias("n_filled"), F.count("value").alias("n_merged"),
        (100 * F.avg(near.cast("int"))).alias("pct_agree"), F.median("d").alias("median_diff"), F.percentile("d", F.lit(0.95)).alias("p95_diff"), F.max("d").alias("max_diff"),
    )


def agreement_by(merged: DataFrame, period, tolerance: float) -> DataFrame:
    both = merged.where(F.col("p").isNotNull() & F.col("s").isNotNull())
    return both.groupBy(period.alias("period")).agg(F.count("*").alias("n"), (100 * F.avg((F.abs(F.col("p") - F.col("s")) <= tolerance).cast("int"))).alias("pct_agree"))


def clean_duplicate(report: DataFrame, least: float = 95.0) -> DataFrame:
    """A merge report with whether the feeds agree on so many per cent of their overlap: then they are one instrument."""
    return report.withColumn("clean_duplicate", F.coalesce(F.col("pct_agree") >= least, F.lit(False)))


def choose_primary(panel: DataFrame, group: str = "city") -> DataFrame:
    """In each group the station with more observations; of equals the smaller id."""
    counts = panel.groupBy(group, "station_id").agg(F.count("value").alias("n"))
    return counts.withColumn("_rn", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "station_id"))).where("_rn = 1").select(group, F.col("station_id").alias("primary"), "n")
