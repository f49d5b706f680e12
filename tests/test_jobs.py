"""Jobs, run states, notifications and translations."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery.operators import jobs, translate
from gleanery.operators.jobs import ImportFailed, Job, RunState
from gleanery.sources.scan import Field


def test_job_round_trip():
    job = Job("J", "li", (Field("t", "h3"), Field("a", "a", "attr", "data-x", None, True)), description="d")
    assert jobs.import_job(jobs.export_job(job)) == job
    got = jobs.import_job(json.dumps({"name": "x" * 200, "columns": [{"name": "ok"}, {"name": "bad", "attribute": "eval"}, 3], "transforms": [{"type": "trim", "column": "ok"}, {"type": "evil", "column": "ok"}]}))
    assert [f.name for f in got.fields] == ["ok"] and [s.type for s in got.steps] == ["trim"]
    for big in ({"name": "x" * 201, "columns": [{"name": "ok"}]}, {"name": "x", "columns": [{"name": "ok"}] * 101}, {"name": "x", "columns": [{"name": "ok"}], "transforms": [{"type": "trim", "column": "ok"}] * 51}):
        with pytest.raises(ImportFailed):
            jobs.import_job(json.dumps(big))


@pytest.mark.parametrize("text", ["{", "[]", '{"columns": [{"name": "a"}]}', '{"name": "a"}', '{"name": "a", "schemaVersion": 2, "columns": [{"name": "a"}]}', '{"name": "a", "schemaVersion": "x", "columns": [{"name": "a"}]}'])
def test_bad_imports(text):
    with pytest.raises(ImportFailed):
        jobs.import_job(text)


def test_store_and_states(tmp_path):
    s = jobs.Store(str(tmp_path / "s.json"))
    s.set("a", 1)
    s.set("b", {"x": []})
    s.remove("a")
    assert s.all() == {"b": {"x": []}} and s.get("a", 7) == 7
    r = RunState("r").to("running")
    assert r.to("odd") == r and r.resume() == r and r.pause().resume().status == "running" and r.to("stopped", "max-rows").resume().stop_reason is None


def test_notifications(spark):
    runs = spark.createDataFrame([("a", True, "success", 1, 0, 2, None), ("b", True, "success", 0, 0, 0, None), ("c", None, "error", None, None, None, "boom"), ("d", False, "error", 0, 0, 0, "x")], "name string, notify boolean, status string, new_count int, removed_count int, changed_count int, error string")
    assert [tuple(r) for r in jobs.notifications(runs).orderBy("name").collect()] == [("a", False, "1 new, 2 changed"), ("c", True, "boom")]
    pages = spark.createDataFrame([("a", "h", "/p"), ("b", "h", "/q")], "name string, hostname string, pathname string")
    assert [r.name for r in jobs.matches_page(pages, "h", "/q").collect()] == ["b"]


def test_translations(spark):
    texts = spark.createDataFrame([("en", "rows_one", "{count} row"), ("en", "rows_other", "{count} rows"), ("de", "rows_other", "{count} Zeilen"), ("en", "hi", "Hi {name} {other}"), ("de", "own", "nur hier")], "lang string, key string, text string")
    asked = spark.createDataFrame([(1, "de", "rows", 1, {"count": "1"}), (2, "de", "rows", 3, {"count": "3"}), (3, "de", "hi", None, {"name": "X"}), (4, "de", "none", None, None)], "i int, lang string, key string, count int, params map<string,string>")
    assert [r.shown for r in translate.translate(asked, texts).orderBy("i").collect()] == ["1 row", "3 Zeilen", "Hi X {other}", "none"]
    assert {r.lang: r.percent for r in translate.coverage(texts).collect()} == {"en": 100.0, "de": 33.3}
    got = spark.createDataFrame([("tr-TR",), ("zh-Hans-CN",), ("xx",), (None,)], "v string").select(translate.normalize_locale(F.col("v"))).collect()
    assert [r[0] for r in got] == ["tr", "zh-CN", "en", "en"] and translate.interpolate("{a} {b}", {"a": 1}) == "1 {b}"
