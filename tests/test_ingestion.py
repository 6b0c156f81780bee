import glob
import json
import math
import os
import random
import threading
import urllib.parse
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from quern.operators import job, qc
from quern.sources import paged


class Service(BaseHTTPRequestHandler):
    """Seven locations a country, three a page; AA works, BB fails on its second page, CC is not allowed, DD works at the third attempt."""

    seen: list = []

    def log_message(self, *args):
        pass

    def do_GET(self):
        url = urllib.parse.urlparse(self.path)
        q = {k: v[0] for k, v in urllib.parse.parse_qs(url.query).items()}
        Service.seen.append((url.path, q, self.headers.get("X-API-Key")))
        name, page, limit = q.get("iso", "EE"), int(q["page"]), int(q["limit"])
        tries = sum(1 for s in Service.seen if s[1] == q)
        code = 500 if name == "BB" and page == 2 else 401 if name == "CC" else (429 if tries == 1 else 503) if name == "DD" and tries < 3 else 200
        body = json.dumps({"meta": {"found": ">1000"}, "results": [{"id": i} for i in range((page - 1) * limit, min(page * limit, 7))]}).encode() if code == 200 else b"no"
        self.send_response(code)
        self.end_headers()
        self.wfile.write(body)


@pytest.fixture
def service():
    Service.seen = []
    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def read(spark, base, parts, **options):
    spark.dataSource.register(paged.PagedSource)
    reader = spark.read.format("paged").option("base", base).option("parts", paged.parts_json(parts)).option("limit", "3").option("waitscale", "0")
    return reader.options(**options).load().collect()


def test_countries_over_http_fail_alone(spark, service):
    rows = read(spark, service, [paged.locations(c) for c in ("AA", "BB", "CC", "DD")], key="secret")
    ids = lambda c: [json.loads(r.record)["id"] for r in sorted((r for r in rows if r.part == c and r.record), key=lambda r: r.position)]
    assert ids("AA") == ids("DD") == list(range(7)) and ids("BB") == [0, 1, 2] and ids("CC") == []
    ends = {r.part: r for r in rows if r.status}
    assert {c: r.status for c, r in ends.items()} == {"AA": "complete", "BB": "partial", "CC": "failed", "DD": "complete"}
    assert ends["AA"].position == 7 and "500" in ends["BB"].detail and "401" in ends["CC"].detail
    calls = lambda c: [int(q["page"]) for _, q, _ in Service.seen if q.get("iso") == c]
    assert calls("AA") == [1, 2, 3] and calls("BB") == [1, 2, 2, 2, 2] and calls("CC") == [1]  # a 401 isn't tried again
    assert all(key == "secret" and path == "/locations" for path, _, key in Service.seen)


def test_pages_are_bounded_and_filters_are_known(spark, service):
    part = paged.sensor_hours(5, "2024-01-01T00:00:00Z", "2024-01-01T03:00:00Z", 3, 3)
    assert part["max_pages"] == 2 and part["params"] == {"datetime_from": "2024-01-01T00:00:00Z", "datetime_to": "2024-01-01T03:00:00Z"}
    end = next(r for r in read(spark, service, [part]) if r.status)
    assert (end.status, end.position) == ("partial", 6) and Service.seen[0][0] == "/sensors/5/hours"
    with pytest.raises(ValueError):
        paged.parts_json([{"name": "x", "path": "y", "params": {"date_from": "2024"}}])


def test_waits_grow_between_bounds(monkeypatch):
    waits = []
    with pytest.raises(paged.PageError):
        paged.fetch_http("http://127.0.0.1:9", "x", {}, {}, waits.append)
    assert waits == [2.0, 2.0, 4.0]


def test_stored_pages(spark, tmp_path):
    rows = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(6)] + [("c", 0)], "k string, i int")
    pages = paged.paged(rows, F.col("k"), "i", F.struct("i"), 3)
    paged.store(pages.withColumn("value", F.when((F.col("path") == "b") & (F.col("page") == 2), '{"results": 5}').otherwise(F.col("value"))), f"file://{tmp_path}/p")
    got = read(spark, f"file://{tmp_path}/p", [{"name": k, "path": f"part={k}"} for k in "abcd"])
    assert {r.part: (r.position, r.status) for r in got if r.status} == {"a": (7, "complete"), "b": (3, "partial"), "c": (1, "complete"), "d": (0, "failed")}
    df = spark.createDataFrame(got, paged.SCHEMA)
    assert [r.r.i for r in paged.records(df, "i int").where("part = 'a'").orderBy("position").collect()] == list(range(7))
    assert paged.outcomes(df).count() == 4


def feeds(spark, changed=0.0, only=None):
    draw = random.Random(1)
    rows = []
    for s in "abcde":
        if only and s not in only:
            continue
        for h in range(24 * 12):
            v = 30 + 10 * math.cos((h - 8) * math.pi / 12) + draw.random()
            rows.append((s, h, (v + (changed if s == "e" and h == 50 else 0)) if s != "b" or h % 3 else None))
    df = spark.createDataFrame(rows, "station_id string, h int, value double")
    return df.select("station_id", F.timestamp_seconds(F.lit(1704067200) + F.col("h") * 3600).cast("timestamp_ntz").alias("ts"), "value")


STATIONS = [("a", "A", 41.0, 69.0), ("b", "A", 41.0005, 69.0), ("c", "C", 43.0, 76.0), ("d", "D", 38.0, 58.0), ("e", "E", 51.0, 71.0)]


def test_rerun_writes_nothing_and_a_changed_feed_its_partition(spark, tmp_path):
    out, rules = f"file://{tmp_path}/bench", qc.Rules(0.0, 500.0, F.round("value", 0), 24, 6, 5, 0.5)
    st = spark.createDataFrame(STATIONS, "station_id string, city string, latitude double, longitude double")
    built = job.build(feeds(spark), st, out, "UTC", rules)
    assert built == job.Built(["A", "c", "d", "e"], [], 0)
    files = lambda: {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{tmp_path}/bench/panel/*/*.parquet")}
    was = files()
    assert job.build(feeds(spark).repartition(5), st, out, "UTC", rules) == job.Built([], [], 4) and files() == was
    assert job.build(feeds(spark, 0.5), st, out, "UTC", rules) == job.Built(["e"], [], 3)
    assert {f for f in files() if "station_id=e" not in f} == {f for f in was if "station_id=e" not in f}
    panel = {(r.station_id, str(r.ts)): r for r in job.load(spark, out).collect()}
    plain = {(r.station_id, str(r.ts)): r.value for r in feeds(spark, 0.5).collect()}
    assert len(panel) == 4 * 24 * 12
    for (s, ts), r in panel.items():
        assert (r.value, r.source) == ((plain["a", ts], "a") if s == "A" else (plain[s, ts], s))
    assert job.build(feeds(spark, 0.5, "abcd"), st, out, "UTC", rules) == job.Built([], ["e"], 3)
    assert {r.station_id for r in job.load(spark, out).select("station_id").distinct().collect()} == {"A", "c", "d"}
    other = job.build(feeds(spark, 0.5, "abcd"), st, out, "UTC", qc.Rules(0.0, 39.5, F.round("value", 0), 24, 6, 5, 0.5))
    assert other.written == ["A", "c", "d"]  # the rules count as input
    s = {r.station_id: r for r in job.summary(job.load(spark, out), ("2024-01-01 00:00", "2024-01-02 23:00")).collect()}
    assert s["c"].n_test <= 48 and 0 < s["c"].test_share <= 1


def test_merged_feeds_prefer_more_values_and_never_mix(spark):
    st = spark.createDataFrame(STATIONS, "station_id string, city string, latitude double, longitude double")
    rows = [("a", 1, None), ("a", 2, 2.0), ("a", 3, None), ("b", 1, 10.0), ("b", 2, 20.0), ("b", 3, None), ("c", 1, None)]
    panel = spark.createDataFrame(rows, "station_id string, ts int, value double")
    got = sorted((r.station_id, r.ts, r.value, r.source) for r in job.merged_feeds(panel, st).collect())
    assert got == [("A", 1, 10.0, "b"), ("A", 2, 20.0, "b"), ("A", 3, None, ""), ("c", 1, None, "")]


def test_decisions_are_told_by_station(spark):
    out = qc.run(feeds(spark), "UTC", qc.Rules(0.0, 39.5, F.round("value", 0), 24, 6, 5, 0.7))
    said = qc.decisions_block(out, "Panel", feeds(spark)).splitlines()
    assert said[0] == "# Panel" and "* a: in" in said and "* b: out" in said
    assert any("Q7: reject" in line for line in said) and any("Q1: flag" in line for line in said)


def test_more_stored_pages_than_a_service_may_have(spark, tmp_path):
    from quern.plans.ingestion import census_outcomes

    n = 3 * (paged.MOST_PAGES + 5) + 1
    spark.range(n).select(F.col("id").alias("s_suppkey"), F.lit("x").alias("s_name"), F.lit(0).alias("s_nationkey")).write.parquet(f"file://{tmp_path}/supplier.parquet")
    spark.createDataFrame([(0, "ZERO"), (5, "NONE")], "n_nationkey int, n_name string").write.parquet(f"file://{tmp_path}/nation.parquet")
    assert sorted(tuple(r) for r in census_outcomes(spark, f"file://{tmp_path}").collect()) == [("n0", n, "complete"), ("n5", 0, "failed")]
    few = spark.range(250).select(F.lit("a").alias("path"), (F.col("id") + 1).cast("int").alias("page"), F.lit('{"results": []}').alias("value"))
    paged.store(few, f"file://{tmp_path}/p")
    assert len(list((tmp_path / "p").rglob("part-*"))) == 3  # 100 pages a file
