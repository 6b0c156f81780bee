"""Forms that hold no key in one task, against plain ones; estimators; donors on demand."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from quern.operators import contracts, forecast as fc, grid, nowcast as nc, stats


def test_positions_and_mid_ranks_with_heavy_ties(spark):
    draw = random.Random(1)
    rows = [(draw.choice(["a", "b", None]), draw.choice([None, 1.0, 1.0, 2.0, 3.5]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    key = lambda v: (v is not None, v or 0)
    got = grid.positions(df, ["k"], ["v", "i"]).collect()
    for k in ("a", "b", None):
        want = [r[2] for r in sorted((r for r in rows if r[0] == k), key=lambda r: (key(r[1]), r[2]))]
        assert [r.i for r in sorted((r for r in got if r.k == k), key=lambda r: r.pos)] == want
        assert sorted(r.pos for r in got if r.k == k) == list(range(len(want)))
    for r in grid.mid_ranks(df.where("v is not null"), ["k"], "v").collect():
        own = sorted(x[1] for x in rows if x[0] == r.k and x[1] is not None)
        at = [i + 1 for i, x in enumerate(own) if x == r.v]
        assert r.n == len(at) and r["rank"] == sum(at) / len(at)
    assert grid.positions(df.limit(0), ["k"], ["v"]).count() == 0
    assert [r.pos for r in grid.positions(df, [], ["i"]).orderBy("i").collect()] == list(range(500))


def ranks(xs):
    return [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]


def test_rank_statistics_without_keys_and_with_ties(spark):
    draw = random.Random(2)
    rows = [(draw.randrange(6) * 1.0, draw.randrange(5) * 1.0, draw.random() < 0.4) for _ in range(120)]
    df = spark.createDataFrame([(*r, "k") for r in rows], "v double, w double, g boolean, k string")
    r = ranks([x[0] for x in rows])
    n1 = sum(x[2] for x in rows)
    got = stats.mann_whitney(df, [], "v", "g").first()
    assert (got.n1, got.n2) == (n1, 120 - n1) and got.u == pytest.approx(sum(a for a, x in zip(r, rows, strict=True) if x[2]) - n1 * (n1 + 1) / 2)
    rho = stats.spearman(df, ["k"], "v", "w").first()
    assert rho.n == 120 and rho.rho == pytest.approx(np.corrcoef(r, ranks([x[1] for x in rows]))[0, 1])


def test_chunked_variance_is_the_same(spark):
    draw = random.Random(3)
    df = spark.createDataFrame([("a" if i % 3 else "b", i, draw.gauss(0, 1) if i % 7 else None) for i in range(300)], "k string, ts int, d double")
    for lags in (0, 30):
        want = {r.k: r for r in stats.long_run_variance(df, ["k"], lags).collect()}
        for chunk in (31, 64):
            for r in stats.long_run_variance(df, ["k"], lags, chunk=chunk).collect():
                assert (r.n, r.mean, r.lrv) == (want[r.k].n, pytest.approx(want[r.k].mean), pytest.approx(want[r.k].lrv))


def places(n, seed=4):
    draw = random.Random(seed)
    return [(f"p{i:02}", f"c{i % 4}", draw.uniform(35, 55), draw.uniform(60, 80)) for i in range(n)]


PLACE = "station_id string, city string, latitude double, longitude double"


def test_donors_on_demand_are_the_nearest_usable(spark):
    draw = random.Random(5)
    st = spark.createDataFrame(places(30), PLACE)
    panel = spark.createDataFrame([(f"p{i:02}", h, draw.random() if draw.random() < (0.15 if h < 20 else 0.9) else None) for i in range(30) for h in range(25)], "station_id string, ts int, value double")
    for k, width in ((1, 2), (5, 5), (40, None)):
        want = nc.donors(panel, st).where(F.col("rank") <= k).select("station_id", "ts", "donor", "v", "rank")
        got = nc.nearest_usable(panel, st, st, k, width=width).select("station_id", "ts", "donor", "v", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert nc.nearest_usable(panel.limit(0), st, st, 3).count() == 0


def test_variogram_fit_finds_known_parameters_and_keeps_bounds():
    draw = np.random.default_rng(6)
    for _ in range(40):
        nugget, sill, reach = draw.uniform(0, 4), draw.uniform(1, 20), draw.uniform(60, 400)
        d = draw.uniform(5, 1200, 21)
        got = nc.fit_exponential(list(zip(d, nc.exponential(d, nugget, sill, reach), strict=True)))
        assert got == pytest.approx((nugget, sill, reach), rel=1e-6, abs=1e-6)
    flat = nc.fit_exponential([(10.0 * i, 5.0) for i in range(1, 9)])
    assert nc.exponential(np.array([10.0, 80.0]), *flat) == pytest.approx([5.0, 5.0], rel=1e-3)
    falling = nc.fit_exponential([(100.0 * i, 9.0 - i) for i in range(1, 8)])
    assert 0 <= falling[0] <= 16 + 1e-8 and 1e-9 <= falling[1] <= 80 + 1e-8 and falling[2] >= 1e-3 - 1e-12
    assert nc.fit_exponential([(1.0, 1.0), (2.0, 2.0)]) is None and nc.fit_exponential([(1.0, 1.0), (2.0, math.nan), (3.0, 1.0)]) is None


def hours(spark):
    draw = random.Random(7)
    rows = [(s, f"2024-01-{1 + h // 24:02} {h % 24:02}:00", 10 + 5 * math.sin(h / 4) + draw.random() if draw.random() < 0.8 else None) for s in ("a", "b") for h in range(24 * 12)]
    return spark.createDataFrame(rows, "station_id string, t string, value double").select("station_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")


def told(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def test_forecasters_stand_in_pipelines_and_come_back_the_same(spark, tmp_path):
    panel = hours(spark)
    train = panel.where("ts < '2024-01-08'")
    assert not hasattr(contracts.Forecaster(), "transform")  # nothing to predict with before fit
    for method in contracts.FORECASTERS:
        model = Pipeline(stages=[contracts.Forecaster(method=method, horizons=[24, 48], days=3)]).fit(train)
        path = str(tmp_path / method)
        model.write().save(path)
        out = model.transform(panel)
        assert told(PipelineModel.load(path).transform(panel)) == told(out)
        assert {r.horizon_h for r in out.select("horizon_h").distinct().collect()} == {24, 48}
        cut = model.transform(panel.withColumn("value", F.when(F.col("ts") < "2024-01-10", F.col("value"))))
        early = "ts < '2024-01-11' and horizon_h = 24"  # origins before the cut: later values don't matter
        pick = lambda df: told(df.where(early).select("station_id", "ts", "pred"))
        assert pick(cut) == pick(out)
    ladder = fc.ladder(panel, train, [24, 48], 3).where("model = 'same_hour_mean'").select("station_id", "ts", "horizon_h", "pred")
    own = contracts.Forecaster(method="same_hour_mean", horizons=[24, 48], days=3).fit(train).transform(panel).select("station_id", "ts", "horizon_h", "pred")
    assert told(own) == told(ladder)
    with pytest.raises(ValueError):
        contracts.Forecaster(method="oracle")


def test_nowcasters_use_only_fitted_stations(spark, tmp_path):
    draw = random.Random(8)
    st = spark.createDataFrame(places(9, 9), PLACE)
    values = spark.createDataFrame([(f"p{i:02}", h, draw.gauss(10, 3) if draw.random() < 0.85 else None) for i in range(9) for h in range(40)], "station_id string, ts int, value double")
    rows = values.join(st, "station_id")
    train = rows.where("city <> 'c0' and ts < 30")
    for method in contracts.NOWCASTERS:
        model = contracts.Nowcaster(method=method, k=3).fit(train)
        out = model.transform(rows)
        assert {r.station_id for r in out.select("station_id").distinct().collect()} == {"p00", "p04", "p08"} and out.count() == 3 * 40
        path = str(tmp_path / method)
        model.write().save(path)
        assert told(contracts.NowcasterModel.load(path).transform(rows)) == told(out)
        other = model.transform(rows.withColumn("value", F.when(F.col("city") == "c0", 1e6).otherwise(F.col("value"))))
        assert told(other.select("station_id", "ts", "pred")) == told(out.select("station_id", "ts", "pred"))
    with pytest.raises(ValueError):
        contracts.Nowcaster(k=0)


def test_rings_are_those_of_all_pairs(spark):
    from quern.operators import rasters

    draw = random.Random(11)
    st = spark.createDataFrame([(f"s{i}", draw.uniform(-89, 89), draw.uniform(-180, 180)) for i in range(8)] + [("pole", 89.9, 10.0), ("line", 1.0, 179.99)], "station_id string, latitude double, longitude double")
    spots = [(draw.uniform(-90, 90), draw.uniform(-180, 180), draw.gauss(0, 1)) for _ in range(3000)] + [(89.5, -170.0, 1.0), (1.2, -179.9, 2.0), (1.0, 179.99, None)]
    cells = spark.createDataFrame(spots, "latitude double, longitude double, value double")

    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0088 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    bounds = {"disc": (-1.0, 400.0), "near": (100.0, 900.0), "far": (900.0, 1500.0)}
    got = {r.station_id: r for r in rasters.rings(st, cells, "value", bounds).collect()}
    for s in st.collect():
        for name, (inner, outer) in bounds.items():
            own = [v for lat, lon, v in spots if inner < km(s.latitude, s.longitude, lat, lon) <= outer and v is not None]
            r = got[s.station_id]
            assert r[f"n_{name}"] == len(own) and (r[name] == pytest.approx(sum(own) / len(own)) if own else r[name] is None)


def test_static_features_know_one_epoch_and_the_training_window(spark):
    from quern.operators import rasters

    st = spark.createDataFrame([("a", 10.0, 10.0), ("b", 50.0, 50.0)], "station_id string, latitude double, longitude double")
    ground = spark.createDataFrame([(10.0, 10.0, 100.0), (10.5, 10.0, 300.0), (11.5, 10.0, 500.0)], "latitude double, longitude double, value double")
    people = spark.createDataFrame([(10.0, 10.0, 2.0, 2020), (10.0, 10.0, 90.0, 2030)], "latitude double, longitude double, value double, epoch int")
    lights = spark.createDataFrame([(10.0, 10.0, 5.0, "2020-01-15"), (10.0, 10.0, 99.0, "2024-01-15")], "latitude double, longitude double, value double, date string").withColumn("date", F.col("date").cast("date"))
    r = rasters.static_features(st, ground, people, lights, 2020, ("2020-01-01", "2021-01-01"), 1.0, 5.0, [60.0, 200.0]).collect()
    assert [tuple(x) for x in r] == [("a", 100.0, 300.0, 400.0, -200.0, -300.0, 200.0, 5.0)]
    with pytest.raises(ValueError):
        rasters.static_features(st, ground, people, lights, 2020, ("1990-01-01", "1991-01-01"), 1.0, 5.0, [60.0])


def test_splits_document(spark):
    from quern.operators import splits

    rows = [("s", "2024-01-05 00:00", 1.0), ("s", "2024-01-18 00:00", 2.0), ("t", "2024-01-25 05:00", 3.0), ("t", "2024-01-15 00:00", 9.0)]
    panel = spark.createDataFrame(rows, "station_id string, t string, value double").select("station_id", F.col("t").cast("timestamp_ntz").alias("ts"), "value")
    st = spark.createDataFrame([("s", "x"), ("t", "y"), ("u", "y")], "station_id string, city string")
    d = splits.document(panel, st)
    assert d["blocks"]["test"]["n"] == 1 and d["purge_hours"] == 96 and d["leave_station_out"] == {"ineligible": ["s"]}
    assert d["leave_city_out"] == [{"fold": 0, "held_out_city": "x", "test": ["s"]}, {"fold": 1, "held_out_city": "y", "test": ["t", "u"]}]
    with pytest.raises(ValueError):
        splits.document(panel.where("value < 3"), st)


def test_flatline_policy_and_leads(spark):
    from quern.operators import features, qc

    masks = spark.createDataFrame([(1.0, True), (2.0, False)], "value double, q2 boolean")
    assert [r.value for r in qc.flatline_policy(masks).collect()] == [None, 2.0]
    for policy, error in (("interpolate", NotImplementedError), ("reject_station", NotImplementedError), ("other", ValueError)):
        with pytest.raises(error):
            qc.flatline_policy(masks, policy)
    with pytest.raises(ValueError):
        features.forecast_at(masks, 0)


def test_satellite_tables_and_reductions(spark):
    from quern.operators import specs
    from quern.sources import tables as src

    df = spark.createDataFrame([(7, "2024-01-02 00:00:00", 3, float("nan"), 9.0), (8, "2024-01-03 00:00:00", None, 1.5, 9.0)], "station_id int, ts string, valid_pixels int, aod double, qa double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.station_id, str(r.date), r.value, r.valid_px) for r in src.satellite(df).orderBy("station_id").collect()] == [("7", "2024-01-02", None, 3), ("8", "2024-01-03", 1.5, None)]
    with pytest.raises(ValueError):
        src.satellite(df.select("station_id", "ts"))
    with pytest.raises(ValueError):
        specs.reduced(df, ["station_id"], "qa", ["mode"])


def test_many_lags_as_one_list_are_the_same(spark, monkeypatch):
    draw = random.Random(12)
    df = spark.createDataFrame([("k", i, draw.gauss(0, 1), 20 + i % 2) for i in range(80)], "k string, ts int, d double, own int")
    want = stats.long_run_variance(df, ["k"], 21, own="own").first()
    monkeypatch.setattr(stats, "MANY", 3)
    assert stats.long_run_variance(df, ["k"], 21, own="own").first().lrv == pytest.approx(want.lrv)
    rows = spark.createDataFrame([("a", "b", 50, -3.0, 0.01), ("a", "b", 50, 3.0, 0.01), ("a", "b", 50, 1.0, 0.4), ("a", "b", 3, None, None)], "model_a string, model_b string, n int, dm double, p_value double")
    told = [(r.better, r.said) for r in stats.verdict(rows).collect()]
    assert told == [("a", "a beats b (DM -3.00, p 0.0100, n 50)"), ("b", "b beats a (DM 3.00, p 0.0100, n 50)"), (None, "a and b don't differ (DM 1.00, p 0.4000, n 50)"), (None, "a and b can't be told apart: too few rows")]


def test_recall_pairs_are_those_of_all_pairs(spark):
    from quern.functions import text as tx

    draw = random.Random(13)
    names = [f"w{i}" for i in range(30)]
    sets = [(i, sorted({draw.choice(names[: 6 + i % 25]) for _ in range(draw.randrange(0, 9))})) for i in range(60)]
    df = spark.createDataFrame(sets, "a int, tokens array<string>")
    for share in (0.3, 0.62, 1.0):
        want = {(i, j, len(set(q) & set(d)) / len(d)) for i, q in sets for j, d in sets if d and len(set(q) & set(d)) / len(d) >= share}
        got = {tuple(r) for r in tx.recall_join(df, df.select(F.col("a").alias("b"), "tokens"), "a", "b", share).collect()}
        assert got == want and (want or share == 1.0)


def crowded(spark, monkeypatch):
    """Stations and cells with many copies of few positions, and the sizes of what meets in near_cells."""
    from quern.operators import rasters

    met, plain = [], rasters.near_cells
    monkeypatch.setattr(rasters, "near_cells", lambda at, cells, *how: met.append((at.count(), cells.count())) or plain(at, cells, *how))
    st = spark.range(300).select(F.concat(F.lit("s"), "id").alias("station_id"), (F.col("id") % 3 * 1.0).alias("latitude"), F.lit(10.0).alias("longitude"))
    k = F.col("id")
    cells = spark.range(2000).select((k % 4 * 1.0).alias("latitude"), F.lit(10.0).alias("longitude"), F.when(k % 2 == 0, "a").alias("image"), (1e9 + k % 7).alias("value"))
    return st, cells, met


def test_rings_meet_each_position_once(spark, monkeypatch):
    from quern.operators import rasters

    st, cells, met = crowded(spark, monkeypatch)
    got = {r.station_id: r for r in rasters.rings(st, cells, "value", {"disc": (-1.0, 150.0)}).collect()}
    assert met == [(3, 4)] and len(got) == 300
    for s, near in (("s0", (0, 1)), ("s1", (0, 1, 2)), ("s2", (1, 2, 3)), ("s299", (1, 2, 3))):
        own = [1e9 + k % 7 for k in range(2000) if k % 4 in near]
        assert got[s].n_disc == len(own) and got[s].disc == pytest.approx(sum(own) / len(own), rel=1e-14)


def test_reductions_meet_each_position_once(spark, monkeypatch):
    from quern.operators import reductions

    st, cells, met = crowded(spark, monkeypatch)
    names = ["mean", "count", "max", "min", "stdDev"]
    got = {(r.station_id, r.image): r for r in reductions.reduce_at(st, cells, 150.0, ["image"], "value", names).collect()}
    assert met == [(3, 4), (6, 4)] and len(got) == 600  # an image for each half of the positions, one of them named null
    for (s, image), r in got.items():
        lat = int(s[1:]) % 3
        own = [1e9 + k % 7 for k in range(2000) if abs(k % 4 - lat) <= 1 and (image == "a") == (k % 2 == 0)]
        mean = sum(own) / len(own)
        sd = math.sqrt(sum((v - mean) ** 2 for v in own) / len(own))
        assert (r["count"], r["max"], r["min"]) == (len(own), max(own), min(own)) and r["mean"] == pytest.approx(mean, rel=1e-14) and r["stdDev"] == pytest.approx(sd, rel=1e-6)
    assert reductions.reduce_at(st, cells, 150.0, ["image"], "value", ["median", "mean"]).count() == 600
