import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quern.functions import report
from quern.operators import reductions
from quern.settings import Settings, tri_state


def test_templates_fail_on_unknown_names(spark):
    numbers = spark.createDataFrame([("a_1", "12.50"), ("b", "$9\\1")], "key string, value string")
    texts = spark.createDataFrame([("x {{a_1}}{{ b }} y",), ("none",), ("",), ("{{b}}",)], "text string")
    assert [r.filled for r in report.fill(texts, numbers).collect()] == ["x 12.50$9\\1 y", "none", "", "$9\\1"]
    with pytest.raises(Exception, match="no value for c, d"):
        report.fill(spark.createDataFrame([("{{c}} {{a_1}} {{d}} {{c}}",)], "text string"), numbers).collect()


def test_numbers_as_text(spark):
    r = spark.range(1).select(report.fixed(F.lit(2.345678), 3), report.signed(F.lit(-0.26)), report.signed(F.lit(3)), report.percent(F.lit(0.1234)), report.thousands(F.lit(1234567))).first()
    assert list(r) == ["2.346", "-0.3", "+3.0", "12.3%", "1,234,567"]
    rows = report.named(spark.createDataFrame([(1, "x", "y")], "k int, n string, m string"), ["k"])
    assert sorted(map(tuple, rows.collect())) == [("m_1", "y"), ("n_1", "x")]


def test_highlights(spark):
    rows = [("a", "Fine one"), ("a", "PM2.5 stays"), ("a", "Maker of MAEs and rmse"), ("b", "The RMSE falls"), ("b", "x" * 86), ("c", "A DM test."), ("c", "of R² so"), ("c", "x" * 85)]
    got = {r.k: (r.n_bullets, r.n_over, r.n_acronyms, r.ok) for r in report.lint(spark.createDataFrame(rows, "k string, text string"), "k").collect()}
    assert got == {"a": (3, 0, 0, True), "b": (2, 1, 1, False), "c": (3, 0, 2, False)}


def test_requests_are_bounded_and_stable(spark):
    st = spark.createDataFrame([(f"s{i}", 1.5 * i, 2.0) for i in range(5)], "station_id string, latitude double, longitude double")
    made = reductions.requests(st, F.lit("aod"), 500, "mean", "2024-01-01", "2024-01-10", limit=25).orderBy("request_no").collect()
    assert [(r.n_stations, r.n_elements) for r in made] == [(2, 20), (2, 20), (1, 10)]
    body = json.loads(made[0].request)
    assert list(body) == sorted(body) and [p["station_id"] for p in body["stations"]] == ["s0", "s1"]
    again = reductions.requests(st.orderBy(F.desc("station_id")), F.lit("aod"), 500, "mean", "2024-01-01", "2024-01-10", limit=25).orderBy("request_no").collect()
    assert [r.fingerprint for r in again] == [r.fingerprint for r in made] and len({r.fingerprint for r in made}) == 3
    for wrong in (("mode", "2024-01-01"), ("mean", "2024-02-01")):
        with pytest.raises(ValueError):
            reductions.requests(st, F.lit("aod"), 500, wrong[0], wrong[1], "2024-01-10")


def test_answers_keep_nulls_and_say_where_they_come_from(spark):
    answer = {"type": "x", "features": [{"properties": {"station_id": "a", "date": "2024-01-01", "value": 1500, "count": 3}}, {"properties": {"station_id": "b", "date": "2024-01-01", "value": None, "count": 0}}]}
    rows = spark.createDataFrame([(json.dumps(answer),)], "json string")
    assert [tuple(r)[:1] + tuple(r)[2:] for r in reductions.tidy(rows, 0.001, True).collect()] == [("a", 1.5, 3, True), ("b", None, 0, True)]
    with pytest.raises(Exception, match="."):
        reductions.tidy(spark.createDataFrame([("<html>",)], "json string")).collect()


def test_archives(spark, tmp_path):
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for name in ("b.nc", "a.nc", "notes.txt"):
            z.writestr(name, name * 3)
    (tmp_path / "x.zip").write_bytes(packed.getvalue())
    (tmp_path / "y.nc").write_bytes(b"plain")
    got = reductions.unzipped(spark.read.format("binaryFile").load(f"file://{tmp_path}"))
    assert sorted((r.member, bytes(r.content)) for r in got.collect()) == [("a.nc", b"a.nc" * 3), ("b.nc", b"b.nc" * 3), ("y.nc", b"plain")]


def test_retries_and_guards(spark, tmp_path):
    waits, calls = [], []

    def task():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("no")
        return 7

    assert reductions.retry(task, pause=waits.append) == 7 and waits == [3.0, 6.0, 12.0]
    with pytest.raises(ZeroDivisionError):
        reductions.retry(lambda: 1 / 0, tries=2, pause=waits.append)
    reductions.require_inputs(spark, {f"file://{tmp_path}": "make it"})
    with pytest.raises(FileNotFoundError, match="run the census first"):
        reductions.require_inputs(spark, {f"file://{tmp_path}": "make it", f"file://{tmp_path}/none": "run the census first"})


def test_settings():
    assert tri_state(" YES ", False) and not tri_state("0", True) and tri_state("auto", True) and not tri_state("", False)
    bare, keyed = Settings.from_env({}), Settings.from_env({"QUERN_API_KEY": "k1", "QUERN_COUNTRIES": " uz, kz "})
    assert bare.recorded and not keyed.recorded and keyed.countries == ("UZ", "KZ") and len(bare.countries) == 5
    assert Settings.from_env({"QUERN_API_KEY": "k1", "QUERN_RECORDED": "true"}).recorded
    assert "k1" not in repr(keyed) and "k1" not in str(keyed.provenance())
