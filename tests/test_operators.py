import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import geo, text as tx
from quern.operators import features, forecast, grid, ingest, merge, metrics, nowcast, qc, rasters, specs, splits, stats, works
from quern.sources import sinks, tables as src
from quern.streaming import hourly as streams

START = dt.datetime(2024, 1, 1)


def series(spark, values, station="a", start=START):
    rows = [(station, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, value double")


def test_range_flags_no_null(spark):
    df = qc.flag_range(series(spark, [-5.0, 5000.0, None, 10.0]), 0, 1000)
    assert [r.q1 for r in df.orderBy("ts").collect()] == [True, True, False, False]


@pytest.mark.parametrize(("values", "flat", "zeros"), [([7.0] * 30, 30, 0), ([7.0] * 10, 0, 0), ([0.0] * 40, 0, 40), ([None] * 30, 0, 0), ([0.0] * 3 + [1.0], 0, 0)])
def test_runs(spark, values, flat, zeros):
    df = series(spark, values)
    assert qc.flag_flatline(df, F.col("value"), 24).where("q2").count() == flat
    assert qc.flag_zero_run(df, F.col("value"), 6).where("q3").count() == zeros


def test_masks_keep_all_rows(spark):
    df = series(spark, [-1.0] + [5.0 + i for i in range(59)] + [9.0] * 40)
    m = qc.row_masks(df, 0, 1000, F.col("value"), 24, 6)
    assert m.count() == 100 and qc.n_effect(m).first().n_masked == 41


def test_clusters_are_single_link(spark):
    step = 111 / 111_195  # degrees of about 111 m
    places = [(1, 41.0, 69.0), (2, 41.0 + step, 69.0), (3, 41.0 + 2 * step, 69.0), (4, 41.0 + 3 * step, 69.0), (5, 41.06, 69.0), (6, 41.0605, 69.0)]
    df = spark.createDataFrame(places, "id int, latitude double, longitude double")
    assert sorted(tuple(r) for r in qc.colocated_clusters(df).collect()) == [(1, 4, "1,2,3,4"), (5, 2, "5,6")]


def test_clusters_link_copies_of_a_position_once(spark):
    step = 111 / 111_195
    k = F.col("id")
    df = spark.range(900).select("id", (41.0 + k % 3 * step).alias("latitude"), F.when(k == 899, float("nan")).otherwise(69.0 + k.cast("int") % 2).alias("longitude"))
    links = qc.colocated_links(df)
    assert links.count() == 899 - 6 + 4  # six positions, of which two and two are neighbours on each meridian
    got = {r.component: (r.n, r.ids) for r in qc.colocated_clusters(df).collect()}
    assert got == {c: (len(own), ",".join(map(str, own))) for c, own in ((0, range(0, 900, 2)), (1, range(1, 899, 2)))}


def test_moved_ids(spark):
    df = spark.createDataFrame([("x", -12.5, 30.25), ("x", -13.0, 31.0), ("y", 41.0, 69.0)], "location_id string, latitude double, longitude double")
    assert {r.location_id: r.verdict for r in qc.moved_ids(df).collect()} == {"x": "reject", "y": "pass"}


SHAPE = [20 + 10 * math.cos((h - 8) * math.pi / 6) + 5 * math.cos((h - 8) * math.pi / 12) for h in range(24)]


@pytest.mark.parametrize("shift", [0, 1, 3, 12, 23])
def test_best_lag_finds_rotation(spark, shift):
    ref = spark.createDataFrame([(h, SHAPE[h]) for h in range(24)], "hour int, ref double")
    turned = spark.createDataFrame([("a", h, SHAPE[(h - shift) % 24]) for h in range(24)], "station_id string, hour int, z double")
    got = qc.best_lag(qc.lag_correlations(turned, ref, ["station_id"], []), ["station_id"]).first()
    assert got.lag_hours == (shift if shift <= 12 else shift - 24)


def test_composite_fills_gaps_and_needs_bins(spark):
    days = [SHAPE[h] if h != 5 else None for _ in range(8) for h in range(24)]
    z = qc.diurnal_composite(series(spark, days), ["station_id"], "UTC").orderBy("hour").collect()
    assert len(z) == 24 and z[5].z == pytest.approx((z[4].z + z[6].z) / 2)
    assert qc.diurnal_composite(series(spark, days[:72]), ["station_id"], "UTC").where("z is not null").count() == 0


def test_merge_never_averages(spark):
    both = series(spark, [1.0] * 5 + [None] * 5 + [1.0] * 5 + [None]).unionByName(series(spark, [11.0] * 15 + [None], "b"))
    m = merge.merge_feeds(both, "a", "b")
    assert {(r.value, r.source) for r in m.collect()} == {(1.0, "a"), (11.0, "b"), (None, "")}
    rep = merge.merge_report(m, 0.1).first()
    assert (rep.n_filled, rep.n_overlap, rep.pct_agree, rep.median_diff) == (5, 10, 0.0, 10.0)


def test_forecasts_use_time_not_rows(spark):
    values = [float(i) for i in range(24 * 6)]
    values[30] = None
    df = series(spark, values)
    at = lambda d, i: {r.ts: r.pred for r in d.collect()}[START + dt.timedelta(hours=i)]
    assert at(forecast.persistence(df, 24), 54) is None and at(forecast.persistence(df, 24), 55) == 31.0
    assert at(forecast.persistence_asof(df, 24), 54) == 29.0
    assert at(forecast.same_hour(df, 24, 3), 78) == (54 + 6) / 2
    assert at(forecast.same_hour_last(df, 24, 3), 102) == (78 + 54 + 6) / 3
    train = df.where("ts < '2024-01-03'")
    assert at(forecast.climatology(df, train), 100) == (4 + 28) / 2


def test_exceedance_skill_of_a_constant(spark):
    days = spark.createDataFrame([(1, 50.0, 1000.0)] * 7 + [(1, 5.0, 1000.0)] * 3, "k int, value double, pred double")
    s = metrics.skill(metrics.confusion(days, ["k"], 15.0)).first()
    assert (s.recall, s.precision, s.base_rate, s.peirce, s.beats_trivial) == (1.0, 0.7, 0.7, 0.0, False)


def test_regression_of_nothing_and_of_constants(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0), (1, 2.0, 1.0), (2, None, 1.0)], "k int, value double, pred double")
    got = metrics.regression(df, ["k"]).collect()
    assert len(got) == 1 and (got[0].n, got[0].rmse, got[0].bias, got[0].r2) == (2, 1.0, 0.0, None)


def test_kriging_honours_weights_and_falls_back(spark):
    st = src.stations(spark)
    panel = spark.createDataFrame([(s, START, 10.0) for s in ("s0", "s1", "s2", "s5")], "station_id string, ts timestamp_ntz, value double")
    got = nowcast.kriging(panel, st, (0.0, 50.0, 500.0)).collect()
    assert all(abs(r.pred - 10) < 1e-9 and not r.fallback for r in got) and len(got) == 8
    assert all(r.fallback for r in nowcast.kriging(panel, st, None).collect())
    assert nowcast.fit_exponential([(1.0, 2.0)]) is None
    with pytest.raises(ValueError):
        nowcast.idw(nowcast.donors(panel, st), k=0)


def test_t_and_normal_tails(spark):
    assert stats.t_two_sided(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert stats.t_two_sided(0.0, 5) == 1.0
    assert stats.t_two_sided(12.706204736, 1) == pytest.approx(0.05, abs=1e-8)
    df = spark.createDataFrame([(1.959963985, 3.0), (None, 1.0)], "z double, n double")
    assert [r[0] and round(r[0], 6) for r in df.select(stats.normal_pvalue("z")).collect()] == [0.05, None]


def test_diebold_mariano_edges(spark):
    rows = [("tie", i, 1.0, 1.0) for i in range(20)] + [("few", i, 1.0, float(i)) for i in range(5)] + [("ok", i, float(i % 3), 3.0) for i in range(30)]
    got = {r.k: r.dm for r in stats.diebold_mariano(spark.createDataFrame(rows, "k string, ts int, la double, lb double"), ["k"], 1).collect()}
    assert got["tie"] == 0.0 and got["few"] is None and got["ok"] < 0


def test_neighbours_never_hold_the_station_itself(spark):
    df = spark.createDataFrame([("a", "x", "2020-01-01", 1.0), ("b", "x", "2020-01-01", 5.0), ("c", "y", "2020-01-01", 9.0), ("d", "y", "2020-01-02", 3.0)], "station_id string, city string, date string, target double")
    got = {r.station_id: r.nb_mean for r in features.neighbours(df).collect()}
    assert got == {"a": 7.0, "b": 5.0, "c": 3.0, "d": None}
    assert {r.station_id: r.nb_mean for r in features.neighbours(df, "y").collect()} == {"a": 5.0, "b": 1.0, "c": 3.0, "d": None}


def test_blocks_are_closed_with_a_purge_between(spark):
    days = spark.range(4000).select(F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(int(id))").alias("ts"))
    got = {r.b: r.n for r in days.groupBy(splits.block_of(F.col("ts"), splits.DAILY_BLOCKS).alias("b")).agg(F.count("*").alias("n")).collect()}
    assert (got["train"], got["val"], got["test"], got["purge"]) == (1461, 355, 356, 20)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long")
    got = {r.id: r.component for r in grid.components(edges, spark.range(60)).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **{i: i for i in range(51, 60)}}


def test_locations_source(spark, tmp_path):
    record = {
        "id": 7, "name": "City of X", "locality": None, "timezone": "UTC", "country": {"id": 1, "code": "UZ", "name": "U"}, "provider": {"id": 1, "name": "p"}, "isMobile": False, "isMonitor": True,
        "sensors": [{"id": 70, "name": "s", "parameter": {"id": 2, "name": "pm25", "units": "u"}}, {"id": 71, "name": "t", "parameter": {"id": 3, "name": "o3", "units": "u"}}],
        "coordinates": {"latitude": 41.0, "longitude": 69.0}, "datetimeFirst": {"utc": "2019-01-01T00:00:00Z"}, "datetimeLast": {"utc": "2021-01-01T00:00:00Z"}, "extra": 1,
    }
    (tmp_path / "x.json").write_text(json.dumps({"meta": {}, "results": [record]}, indent=1))
    r = src.locations(spark, str(tmp_path / "x.json")).first()
    assert (r.location_id, r.n_pm25_sensors, r.pm25_sensor_ids, r.country, r.span_days) == ("7", 1, "70", "UZ", 731.0)
    assert spark.range(1).select(tx.city_of(F.lit(" "), F.lit("US Embassy: X"))).first()[0] == "X"


def test_csv_has_no_nans(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,NaN\n2,\n3,4.5\n")
    assert [r.b for r in src.csv(spark, str(tmp_path / "x.csv"), "a int, b double").orderBy("a").collect()] == [None, None, 4.5]


def test_haversine(spark):
    d = geo.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0), 1.0)
    assert spark.range(1).select(d).first()[0] == pytest.approx(math.pi)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("a", dt.datetime(2024, 1, 1, h, m), h * 100 + m, float(h)) for h in range(6) for m in (0, 20, 40)] + [("a", dt.datetime(2024, 1, 1, 0, 20), 20, 0.0)]
    schema = "station_id string, ts timestamp, reading_id long, value double"
    for i in range(0, len(rows), 5):
        spark.createDataFrame(rows[i : i + 5], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.hourly_means(stream, "10 hours").writeStream.format("memory").queryName("means").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.ts.hour: (r.value, r.n) for r in spark.table("means").groupBy("ts").agg(F.max_by("value", "n").alias("value"), F.max("n").alias("n")).collect()}
    assert got == {h: (float(h), 3) for h in range(6)}


def test_city_of_literal_cases(spark):
    rows = [("N/A", "US Diplomatic Post: Bishkek", "Bishkek"), (" Osh ", "x", "Osh"), (None, "us embassy  Dushanbe ", "Dushanbe"), ("  ", "StateAir", None), (None, None, None), ("--", "n.a.", None), ("unknown", "US Consulate : Almaty", "Almaty"), (None, "Town", "Town")]
    df = spark.createDataFrame(rows, "loc string, name string, want string")
    assert all(r.got == r.want for r in df.select("want", tx.city_of(F.col("loc"), F.col("name")).alias("got")).collect())


def test_title_words(spark):
    df = spark.createDataFrame([("That was over THE top, via our own using-of 2x",)], "t string")
    assert df.select(tx.title_tokens(F.col("t")).alias("w")).first().w == ["that", "was", "over", "top", "via", "our", "own"]


def test_nearest_on_an_axis_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([(0.5,), (1.2,), (-9.0,)], "x double")
    assert [r.y for r in df.select(rasters.nearest_on([1.0, 0.0, 2.0], F.col("x")).alias("y")).collect()] == [1.0, 1.0, 0.0]


def test_within_city_needs_lag_minimum_and_maximum(spark):
    base = [math.sin(2 * math.pi * h / 24) for h in range(24)]
    moved = list(base)
    moved[6], moved[9] = base[6] - 0.3, 1.2  # the maximum three hours later, the lag as it was
    st = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("d", "y")], "station_id string, city string")
    rows = [(s, c, h, float(z[h])) for s, c, z in (("a", "x", base), ("b", "x", base), ("c", "x", moved), ("d", "y", base[5:] + base[:5])) for h in range(24)]
    out = {r.station_id: (r.lag_hours, r.verdict) for r in qc.within_city(spark.createDataFrame(rows, "station_id string, city string, hour int, z double"), st).collect()}
    assert out == {"a": (0, "pass"), "b": (0, "pass"), "c": (0, "reject"), "d": (0, "pass")}


def test_kriging_weights_on_a_fixed_pattern(spark):
    st = spark.createDataFrame([("t", "x", 0.0, 0.0), ("a", "y", 0.0, 1.0), ("b", "y", 0.0, -1.0)], "station_id string, city string, latitude double, longitude double")
    rows = [(s, START, v) for s, v in (("a", 10.0), ("b", 30.0))]
    panel = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, value double")
    out = {r.station_id: (round(r.pred, 6), r.fallback) for r in nowcast.kriging(panel, st, (0.0, 1.0, 50.0)).collect()}
    assert out["t"] == (20.0, False)  # two donors as far on either side weigh the same


def test_pairwise_uses_the_automatic_bandwidth(spark):
    rows = [("s", START + dt.timedelta(hours=i), m, float(i % 7), float((i * k) % 11)) for i in range(150) for k, m in ((3, "b"), (5, "a"), (7, "c"))]
    df = spark.createDataFrame(rows, "station_id string, ts timestamp_ntz, model string, value double, pred double")
    out = {(r.model_a, r.model_b): r.lags for r in stats.pairwise(df, ["station_id"]).collect()}
    assert out == dict.fromkeys([("a", "b"), ("a", "c"), ("b", "c")], 4)
    assert {r.lags for r in stats.pairwise(df, ["station_id"], 24).collect()} == {24}


def test_records_and_windows(spark):
    rows = [("1", 1, "2020-01-01T00:00:00Z", 5.0, 90.0), ("1", 0, "2020-01-01T00:00:00Z", None, 80.0), ("1", 2, "bad", 1.0, 1.0), ("1", 3, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "sensor string, position int, period_start string, value double, percent_complete double")
    assert [(str(r.ts), r.value, r.percent_complete) for r in ingest.records_to_series(df, ["sensor"]).collect()] == [("2020-01-01 00:00:00", None, 80.0)]
    lo = dt.datetime(2020, 1, 1)
    windows = spark.createDataFrame([("1", lo, lo + dt.timedelta(minutes=30)), ("2", lo, lo)], "sensor string, lo timestamp, hi timestamp")
    found = ingest.impossible_windows(df, windows, ["sensor"])
    assert {r.sensor: r.impossible for r in found.collect()} == {"1": True, "2": False}
    with pytest.raises(ValueError):
        ingest.complete_or_raise(found)


def test_tiers():
    columns = ["aod_055", "aod_055_valid_px", "absorbing_aerosol_index", "absorbing_aerosol_index_valid_px", "cams_pm25_forecast", "elevation", "other"]
    calendar = ["doy_sin", "doy_cos", "month", "dow", "is_heating_season"]
    assert specs.tier_columns(columns, "static_only") == ["elevation", *calendar]
    assert specs.tier_columns(columns, "deployable") == ["absorbing_aerosol_index", "absorbing_aerosol_index_valid_px", "cams_pm25_forecast", "elevation", *calendar]
    assert specs.tier_columns(columns, "retrospective") == ["aod_055", "absorbing_aerosol_index", "aod_055_valid_px", "absorbing_aerosol_index_valid_px", "cams_pm25_forecast", "elevation", *calendar]
    with pytest.raises(ValueError):
        specs.tier_columns(columns, "all")


def test_merging_keeps_different_works_apart(spark):
    rows = [(1, 0, "a", "Fast boosting of trees", "10.1/X", None), (1, 1, "b", "Fast boosting of trees", "10.2/Y", "no"), (1, 2, "c", "FAST boosting trees", None, "yes"), (1, 3, "d", "Other title", "10.1/x", "late"), (1, 4, "e", None, None, "never")]
    df = spark.createDataFrame(rows, "k int, n int, source_api string, title string, doi string, abstract string").withColumns({c: F.lit(None).cast("string") for c in ("year", "venue", "pmcid", "arxiv", "oa_pdf")})
    r = works.merge_records(df, "k", "n").first()
    assert (r.doi, r.abstract, r.apis, r.merge_conflicts) == ("10.1/X", "yes", "a,c,d", "b:Fast boosting of trees; e:?")
    assert works.depth_counts(works.merge_records(df, "k", "n").withColumn("doi", F.col("doi"))).first().depth == "ABSTRACT"


def test_frozen_documents_keep_their_time(spark, tmp_path):
    path = f"file://{tmp_path}/splits.json"
    doc = {"blocks": {"train": {"begin": "2024-01-01 00:00", "end": "2024-01-02 00:00"}}, "é": [1, None]}
    first = sinks.freeze(spark, doc, path, "t1")
    assert sinks.freeze(spark, dict(reversed(doc.items())), path, "t2") == first == sinks.frozen(spark, path) and first["frozen_at"] == "t1"
    assert sinks.freeze(spark, {**doc, "x": 1}, path, "t3")["frozen_at"] == "t3" and sinks.frozen(spark, f"{path}.none") is None
    assert sinks.read_blocks(first) == [("train", "2024-01-01 00:00", "2024-01-02 00:00")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 1.5, None), ("", None, 2)], "s string, x double, n int")
    sinks.write(df, f"file://{tmp_path}/c", "csv")
    assert sorted(map(tuple, src.csv(spark, f"file://{tmp_path}/c", "s string, x double, n int").collect()), key=str) == sorted([("a|b", 1.5, None), (None, None, 2)], key=str)  # the source reads blanks as null
    assert sinks.markdown(df, 1).splitlines() == ["| s | x | n |", "| --- | --- | --- |", "| a\\|b | 1.5 |  |", "|  |  | 2 |"]
    with pytest.raises(ValueError):
        sinks.write(df, "x", "other")
    s = sinks.synthetic_series(spark, ["a", "b"], "2024-01-01", 48)
    assert s.count() == 96 and s.where("value <= 0").count() == 0


def test_components_raise_when_rounds_run_out(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)], "a int, b int")
    nodes = spark.range(31).selectExpr("cast(id as int) as id")
    with pytest.raises(RuntimeError):
        grid.components(edges, nodes, rounds=2)


def test_spearman_of_values_that_differ_when_worked_out_again(spark):
    draw = F.udf(lambda k: random.random() + k, "double").asNondeterministic()
    df = spark.range(200).select((F.col("id") % 2).alias("k"), draw("id").alias("a"), F.col("id").cast("double").alias("b"))
    assert [r.n for r in stats.spearman(df, ["k"], "a", "b").collect()] == [100, 100]
