import json

import pytest
from pyspark.sql import functions as F

from quern import cli
from quern.settings import Settings
from quern.sources import paged


def location(i, country):
    return {"id": i, "name": f"Place {i}", "locality": None, "country": {"code": country}, "isMobile": False, "sensors": [{"id": i * 10, "parameter": {"name": "pm25"}}], "datetimeFirst": {"utc": "2018-01-01T00:00:00Z"}, "datetimeLast": {"utc": "2021-01-01T00:00:00Z"}}


def test_census_job_goes_on_without_a_country(spark, tmp_path, capsys):
    for country, pages in (("UZ", [[1, 2], [3]]), ("KZ", [[4, 5]])):
        for n, ids in enumerate(pages, 1):
            folder = tmp_path / "api" / "locations" / country / f"page={n}"
            folder.mkdir(parents=True)
            (folder / "x.json").write_text(json.dumps({"results": [location(i, country) for i in ids]}))
    settings = Settings("", True, ("UZ", "KZ", "TM"))
    parts = paged.locations
    try:
        paged.locations = lambda c: {**parts(c), "path": f"locations/{c}"}  # stored pages lie in a folder for each country
        assert cli.main(["census", "--base", f"file://{tmp_path}/api", "--out", f"file://{tmp_path}/out", "--limit", "2"], spark, settings) == 0
        told = json.loads(capsys.readouterr().out.splitlines()[-1])
        assert told["outcomes"] == {"UZ": ["complete", 3], "KZ": ["partial", 2], "TM": ["failed", 0]} and told["fixture"]
        rows = spark.read.parquet(f"file://{tmp_path}/out/census")
        assert {r.location_id for r in rows.collect()} == set("12345") and rows.where("not span_ok_upper_bound or not fixture").count() == 0
        by = {r.country: (r.n, r.n_eligible) for r in spark.read.parquet(f"file://{tmp_path}/out/by-country").collect()}
        assert by == {"UZ": (3, 3), "KZ": (2, 2)}
        assert cli.main(["census", "--base", f"file://{tmp_path}/none", "--out", f"file://{tmp_path}/out2"], spark, settings) == 1
    finally:
        paged.locations = parts


def test_splits_and_benchmark_jobs(spark, tmp_path, capsys):
    hours = spark.range(24 * 31).select(F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 3600).cast("timestamp_ntz").alias("ts"), (20 + F.col("id") % 24).cast("double").alias("value"))
    panel, st = f"file://{tmp_path}/panel", f"file://{tmp_path}/stations"
    hours.withColumn("station_id", F.lit("a")).unionByName(hours.withColumn("station_id", F.lit("b"))).select("station_id", "ts", "value").write.parquet(panel)
    spark.createDataFrame([("a", "A", 41.0, 69.0), ("b", "B", 51.0, 71.0)], "station_id string, city string, latitude double, longitude double").write.parquet(st)
    where = ["--panel", panel, "--stations", st]
    said = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    assert cli.main(["splits", *where, "--out", f"file://{tmp_path}/splits"], spark) == 0
    first = said()
    assert cli.main(["splits", *where, "--out", f"file://{tmp_path}/splits"], spark) == 0 and said() == first
    # A month is under the two years that the rules ask for: both stations go, and nothing is left.
    assert cli.main(["benchmark", *where, "--out", f"file://{tmp_path}/bench"], spark) == 0 and said() == {"written": [], "dropped": [], "unchanged": 0}
    with pytest.raises(FileNotFoundError, match="hourly panel"):
        cli.main(["splits", "--panel", f"{panel}-none", "--stations", st, "--out", "x"], spark)
    with pytest.raises(SystemExit):
        cli.main(["paint"], spark)
