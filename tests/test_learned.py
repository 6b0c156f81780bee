import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from quern.operators import attribution, learned
from quern.operators.selection import FixedSplit, FixedSplitModel, at_once


def rows_of(spark, n=400, seed=0, wide=4):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        x = [round(draw.uniform(-2, 2), 2) for _ in range(wide)]
        y = 3 * (x[0] > 0.3) + x[1] * (x[2] > 0) + draw.gauss(0, 0.1)
        out.append((i, *x, y, ["train", "train", "val", "test"][i % 4], f"c{i % 3}"))
    names = [f"f{k}" for k in range(wide)]
    df = spark.createDataFrame(out, f"id long, {', '.join(f'{n} double' for n in names)}, target double, block string, city string")
    return VectorAssembler(inputCols=names, outputCol="x").transform(df).cache()


def boosted(trees=5, depth=3):
    return GBTRegressor(featuresCol="x", labelCol="target", predictionCol="pred", maxIter=trees, maxDepth=depth, subsamplingRate=0.7, seed=1)


def brute_shapley(spark, model, x):
    """By the definition: means over the unknown features follow the trees' row counts, over all sets of known features."""
    trees = {}
    for r in attribution.nodes(spark, model).collect():
        trees.setdefault((r["tree"], r["weight"]), {})[r["id"]] = r

    def value(known):
        def walk(own, i):
            r = own[i]
            if r["left"] < 0:
                return r["prediction"]
            if r["feature"] in known:
                return walk(own, r["left"] if x[r["feature"]] <= r["threshold"] else r["right"])
            a, b = own[r["left"]]["n"], own[r["right"]]["n"]
            return (a * walk(own, r["left"]) + b * walk(own, r["right"])) / (a + b)

        return sum(w * walk(own, 0) for (_, w), own in trees.items())

    d, out = len(x), []
    for j in range(d):
        rest = [k for k in range(d) if k != j]
        out.append(sum(math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) * (value({*c, j}) - value({*c})) for s in range(d) for c in itertools.combinations(rest, s)))
    return out, value(set())


def test_attributions_are_shapley_values_and_add_up(spark):
    rows = rows_of(spark)
    model = boosted().fit(rows.where("block = 'train'"))
    some = rows.where("id < 12")
    got = {r.id: r for r in attribution.explain(model, some, ["id"]).collect()}
    for r in some.collect():
        want, base = brute_shapley(spark, model, list(r.x))
        assert got[r.id].shap == pytest.approx(want, abs=1e-9) and got[r.id].base == pytest.approx(base, abs=1e-9)
    both = attribution.explain(model, rows, ["id"]).join(model.transform(rows).select("id", "pred"), "id").collect()
    assert len(both) == 400 and all(r.base + sum(r.shap) == pytest.approx(r.pred, abs=1e-9) for r in both)


def test_a_feature_that_comes_twice_on_a_path(spark):
    """One feature, deep trees: all of the prediction but the base belongs to it."""
    rows = rows_of(spark, wide=4)
    one = VectorAssembler(inputCols=["f0"], outputCol="x").transform(rows.drop("x"))
    model = boosted(4, 5).fit(one)
    got = attribution.explain(model, one, ["id"]).join(model.transform(one).select("id", "pred"), "id")
    assert got.where(F.abs(F.col("shap")[0] + F.col("base") - F.col("pred")) > 1e-9).count() == 0
    assert attribution.explain(model, one.limit(0), ["id"]).count() == 0


def test_importance_tables(spark):
    e = spark.createDataFrame([("a", [1.0, -2.0]), ("a", [-3.0, 0.0]), ("b", [2.0, 2.0])], "fold string, shap array<double>")
    by = {(r.fold, r.feature): r.mean_abs for r in attribution.by_feature(e, ["aod", "nb_mean"], ["fold"]).collect()}
    assert by == {("a", "aod"): 2.0, ("a", "nb_mean"): 1.0, ("b", "aod"): 2.0, ("b", "nb_mean"): 2.0}
    fam = {r.family: (r.mean_abs, r.share) for r in attribution.by_family(attribution.by_feature(e, ["aod", "nb_mean"], ["fold"]), learned.family).collect()}
    assert fam["satellite"] == (4.0, pytest.approx(400 / 7)) and fam["spatial_neighbour"] == (3.0, pytest.approx(300 / 7))


def test_families(spark):
    names = ["nb_mean", "lag_1", "valid_px", "aod", "forecast", "month", "is_heating_season", "n_suppliers", "delta"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(learned.family(F.col("n"))).collect()]
    assert got == ["spatial_neighbour", "local", "satellite_missingness", "satellite", "cams_forecast", "calendar", "calendar", "static_geography", "local"]


def test_validation_alone_chooses(spark):
    rows = rows_of(spark)
    settings = [{"maxDepth": d, "stepSize": s} for d in (1, 3) for s in (0.01, 0.3)]
    best = FixedSplit(estimator=boosted(12), settings=settings).fit(rows)
    plain = []
    for s in settings:
        own = boosted(12).copy({boosted().getParam(k): v for k, v in s.items()})
        own = GBTRegressor(featuresCol="x", labelCol="target", predictionCol="pred", maxIter=12, subsamplingRate=0.7, seed=1, validationIndicatorCol="v", **s)
        model = own.fit(rows.where("block <> 'test'").withColumn("v", F.col("block") == "val"))
        errors = [(r.pred - r.target) ** 2 for r in model.transform(rows.where("block = 'val'")).collect()]
        plain.append(math.sqrt(sum(errors) / len(errors)))
    assert best.errors == pytest.approx(plain) and {k: best.chosen[k] for k in settings[0]} == settings[int(np.argmin(plain))]
    # Other test rows, the same choice and the same model.
    noise = rows.withColumn("target", F.when(F.col("block") == "test", 1000.0).otherwise(F.col("target")))
    again = FixedSplit(estimator=boosted(12), settings=settings).fit(noise)
    assert again.chosen == best.chosen and again.errors == best.errors
    pick = lambda m: [r.pred for r in m.transform(rows).orderBy("id").collect()]
    assert pick(again) == pick(best)


def test_selection_is_saved_and_loaded(spark, tmp_path):
    rows = rows_of(spark)
    line = LinearRegression(featuresCol="x", labelCol="target", predictionCol="pred")
    model = FixedSplit(estimator=line, settings=[{"regParam": 0.0}, {"regParam": 100.0}], metric="mae").fit(rows)
    assert model.chosen == {"regParam": 0.0}
    model.write().overwrite().save(str(tmp_path / "m"))
    back = FixedSplitModel.load(str(tmp_path / "m"))
    assert back.chosen == model.chosen and back.errors == model.errors
    assert back.transform(rows).select("id", "pred").collect() == model.transform(rows).select("id", "pred").collect()


def test_at_once_keeps_order_and_bounds():
    running, most = [], []

    def task(i):
        running.append(i)
        most.append(len(running))
        time.sleep(0.02)
        running.remove(i)
        return i * i

    assert at_once([lambda i=i: task(i) for i in range(12)], 3) == [i * i for i in range(12)] and max(most) <= 3
    with pytest.raises(ZeroDivisionError):
        at_once([lambda: 1 / 0])
    assert at_once([]) == []


def daily_rows(spark, n_days=200, cities=3):
    draw = random.Random(5)
    out = []
    for c in range(cities):
        for s in range(2):
            for d in range(n_days):
                day = np.datetime64("1998-09-01") + d * 5
                out.append((f"s{c}{s}", f"c{c}", day.astype(object), 20 + 5 * math.sin(d / 9) + c + draw.gauss(0, 1), 5, draw.random() if d % 3 else None, d % 4, 20 + 5 * math.sin(d / 9) + draw.gauss(0, 2)))
    return spark.createDataFrame(out, "station_id string, city string, date date, target double, n int, aod double, valid_px int, forecast double")


def test_folds_and_neighbours_know_nothing_of_the_held_out_city(spark):
    daily = daily_rows(spark)
    rows = learned.design(daily)
    least = {"train": 20, "test": 10}
    assert learned.folds(rows, least) == ["c0", "c1", "c2"] and learned.folds(rows, {"train": 10**6}) == []
    own = learned.without_city(rows, "c1").select("station_id", "city", "date", "nb_mean", "nb_n").collect()
    by = {}
    for r in daily.collect():
        by.setdefault(r.date, []).append(r)
    for r in own:
        others = [x.target for x in by[r.date] if x.city != "c1" and x.station_id != r.station_id]
        assert r.nb_n == len(others) and r.nb_mean == pytest.approx(sum(others) / len(others))
    got = learned.leave_city_out(rows, [], ("static_only", "deployable"), seeds=(0, 1), trees=2, least=least)
    by = got.groupBy("tier", "city", "seed").count().collect()
    assert len(by) == 2 * 3 * 2 and len({r["count"] for r in by}) == 1
    other = learned.design(daily.withColumn("target", F.when(F.col("city") == "c2", F.col("target") * 100).otherwise(F.col("target"))))
    same = lambda df: sorted((r.station_id, r.date, r.pred) for r in df.where("city = 'c2' and seed = 0 and tier = 'deployable'").collect())
    changed = learned.leave_city_out(other, [], ("deployable",), seeds=(0,), trees=2, least=least)
    assert [x[:2] for x in same(changed)] == [x[:2] for x in same(got)]
    assert [x[2] for x in same(changed)] == pytest.approx([x[2] for x in same(got)])  # its own labels don't matter


def test_tuned_study(spark):
    rows = learned.design(daily_rows(spark))
    scored, best, models = learned.tuned_study(rows, ["forecast", *learned.LAGS], F.lit(True), F.lit(True), seeds=(0, 1, 2), settings=learned.GRID[:4], trees=6)
    assert len(best.errors) == 4 and len(models) == 3 and scored.select("seed").distinct().count() == 3
    assert scored.where("block <> 'test'").count() == 0
    mean = learned.ensemble(scored).collect()
    assert all(r.n_seeds == 3 for r in mean)


def test_ridge_is_the_closed_form(spark):
    draw = np.random.default_rng(3)
    n = 120
    x = draw.normal(size=(n, 3)) * [1.0, 5.0, 0.2] + [0.0, 2.0, -1.0]
    y = x @ [2.0, -0.3, 4.0] + draw.normal(size=n)
    data = [(*map(float, r), float(t), "train" if i < 90 else "test", i) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="x").transform(spark.createDataFrame(data, "a double, b double, c double, target double, block string, i int"))
    got = [r.pred for r in learned.ridge(df, 0.7).orderBy("i").collect()]
    # Squares of standardised coefficients, in units of the target's deviation, are added to the mean square.
    a, t = x[:90], y[:90]
    s, sy = a.std(axis=0, ddof=1), t.std(ddof=1)
    centred = a - a.mean(axis=0)
    beta = np.linalg.solve(centred.T @ centred / 90 + np.diag(0.7 / sy * s**2), centred.T @ (t - t.mean()) / 90)
    assert got == pytest.approx(list((x[90:] - a.mean(axis=0)) @ beta + t.mean()), rel=2e-2, abs=2e-2)


def test_design_works_daily_rows_out_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(x):
        made.add(1)
        return x

    seen = F.udf(count, "double")
    k = F.col("id")
    daily = spark.range(900).select(
        F.concat(F.lit("s"), k % 3).alias("station_id"), F.concat(F.lit("c"), k % 3).alias("city"), F.date_add(F.lit("1998-06-01").cast("date"), (k / 3).cast("int")).alias("date"),
        seen(k.cast("double")).alias("target"), (k * 1.0).alias("forecast"), (k * 0.5).alias("aod"), (k % 4).alias("valid_px"),
    )
    assert learned.design(daily).count() == 900 and made.value == 900


def test_design_is_dealt_by_its_rows(spark, monkeypatch):
    """Each fit is many small jobs, so a task gets many rows; how many tasks there are doesn't hang on the session."""
    daily = daily_rows(spark)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        whole = learned.design(daily)
        assert len(whole.inputFiles()) == 1 and whole.count() == 1200
        monkeypatch.setattr(learned, "TASK_ROWS", 300)
        dealt = learned.design(daily)
        assert len(dealt.inputFiles()) == 4
        assert sorted(dealt.select("station_id", "date").collect()) == sorted(whole.select("station_id", "date").collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
