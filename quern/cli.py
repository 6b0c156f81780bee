"""Jobs from the command line: python -m quern.cli census | splits | benchmark ..."""

from __future__ import annotations

import argparse
import datetime
import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import ingest, job, qc, reductions, splits
from quern.session import get_session, ship
from quern.settings import Settings
from quern.sources import paged, sinks, tables as src

def rules() -> qc.Rules:
    """Bounds of hourly values, and the least runs, span and completeness."""
    return qc.Rules(0.0, 1000.0, F.col("value"), 24, 6, 2 * 365.25, 0.6)


def census(spark: SparkSession, settings: Settings, base: str, limit: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(census rows of all countries that answered, how each ended): one failing country doesn't stop the others."""
    spark.dataSource.register(paged.PagedSource)
    reader = spark.read.format("paged").option("base", base).option("limit", limit).option("parts", paged.parts_json([paged.locations(c) for c in settings.countries]))
    rows = sinks.kept((reader.option("key", settings.key) if settings.key else reader).load(), "census-pages")  # pages are asked for once
    found = paged.records(rows, f"struct<{src.LOCATION}>").select("r")
    return ingest.census(src.location_rows(found)).withColumn("fixture", F.lit(settings.recorded)), paged.outcomes(rows)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> int:
    """0 if the job did its work; 1 if no country answered."""
    parser = argparse.ArgumentParser(prog="quern")
    jobs = parser.add_subparsers(dest="job", required=True)
    for name, options in (("census", ("base", "out")), ("splits", ("panel", "stations", "out")), ("benchmark", ("panel", "stations", "out"))):
        own = jobs.add_parser(name)
        for o in options:
            own.add_argument(f"--{o}", required=True)
        own.add_argument("--limit", type=int, default=1000)
        own.add_argument("--zone", default=src.ZONE)
    how = parser.parse_args(argv)
    spark, settings = spark or get_session("quern"), settings or Settings.from_env()
    ship(spark)
    if how.job == "census":
        rows, ends = census(spark, settings, how.base, how.limit)
        rows.write.mode("overwrite").parquet(f"{how.out}/census")
        ingest.country_rollup(spark.read.parquet(f"{how.out}/census")).write.mode("overwrite").parquet(f"{how.out}/by-country")
        told = {r["part"]: [r["status"], r["n_records"]] for r in ends.collect()}  # a row for each country
        print(json.dumps({**settings.provenance(), "outcomes": told}, sort_keys=True))
        return int(all(status == "failed" for status, _ in told.values()))
    reductions.require_inputs(spark, {how.panel: "an hourly panel (station_id, ts, value) as Parquet", how.stations: "stations (station_id, city, latitude, longitude) as Parquet"})
    panel, stations = spark.read.parquet(how.panel), spark.read.parquet(how.stations)
    if how.job == "splits":
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        frozen = sinks.freeze(spark, splits.document(panel, stations), how.out, now)
        print(json.dumps({"sha256": frozen["sha256"], "frozen_at": frozen["frozen_at"]}))
        return 0
    built = job.build(panel, stations, how.out, how.zone, rules())
    print(json.dumps({"written": built.written, "dropped": built.dropped, "unchanged": built.unchanged}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
