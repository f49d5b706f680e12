"""Pipelines, relational operators, diffs, quality, assets, snapshots, sinks and streams."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanery.functions.cleaning import StepError
from gleanery.operators import assets, diff, enrich, pipeline, quality, relational, snapshots
from gleanery.operators.pipeline import POS, TransformStep
from gleanery.sinks import lines, workbook
from gleanery.streaming import accumulate


def frame(spark, rows, names):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{POS} long, " + ", ".join(f"`{n}` string" for n in names))


def table(df, *columns):
    return [tuple(r) for r in df.orderBy(POS).select(*columns).collect()]


def test_split_and_combine(spark):
    df = frame(spark, [("a-b-c", "x"), (None, None)], ["A", "B"])
    got = pipeline.apply_transforms(df, [TransformStep("split", "A", {"delimiter": "-", "limit": "first"})])
    assert got.columns == [POS, "Part 1", "Part 2", "B"] and table(got, "Part 1", "Part 2") == [("a", "b-c"), ("", "")]
    got = pipeline.apply_transforms(df, [TransformStep("split", "A", {"delimiter": "-", "outputNames": ["p", "q", "r", "s"], "keepOriginal": True})])
    assert got.columns == [POS, "A", "p", "q", "r", "s", "B"] and table(got, "p", "q", "r", "s")[0] == ("a", "b", "c", "")
    got = pipeline.apply_transforms(df, [TransformStep("combine", None, {"sourceColumns": ["A", "B"], "outputName": "AB"})])
    assert got.columns == [POS, "AB"] and table(got, "AB") == [("a-b-c x",), (" ",)]
    got = pipeline.apply_transforms(df, [TransformStep("changeCase", "A", {"mode": "upper"}, new_column="C"), TransformStep("trim", "B", enabled=False)])
    assert got.columns == [POS, "A", "C", "B"] and table(got, "A", "C")[0] == ("a-b-c", "A-B-C")


def test_step_errors(spark):
    df = frame(spark, [("a", "b")], ["A", "B"])
    for s in (TransformStep("trim", "none"), TransformStep("trim", "A", new_column="B"), TransformStep("trim", "A", new_column=" "), TransformStep("split", "A", {"delimiter": "-", "outputNames": ["B"]}), TransformStep("combine", None, {"sourceColumns": ["A"], "outputName": "x"}), TransformStep("combine", None, {"sourceColumns": ["A", "B"], "outputName": ""}), TransformStep("combine", None, {"sourceColumns": ["A", "z"], "outputName": "x"})):
        with pytest.raises(StepError):
            pipeline.apply_transforms(df, [s])


def test_presets_edits_and_import(spark):
    df = frame(spark, [("  €1.234,50 ",)], ["A"])
    assert table(pipeline.apply_transforms(df, pipeline.preset("normalizePrice", "A")), "A") == [("1234.50",)]
    steps = pipeline.preset("cleanText", "A")
    assert [s.type for s in pipeline.move(steps, 0, 2)] == ["collapseWhitespace", "removeInvisibleChars", "trim", "decodeHtmlEntities"]
    assert not pipeline.toggle(steps, 1)[1].enabled and len(pipeline.remove(steps, 0)) == 3 == len(pipeline.undo(steps))
    raw = json.loads(json.dumps([{"type": "trim", "column": "A", "enabled": False}, {"type": "evil", "column": "A"}, {"type": "trim"}, 7, {"type": "split", "column": "A", "options": {"delimiter": "-" * 300, "deep": {"a": 1}}, "destination": "newColumn", "newColumnName": "N", "rowIndices": [1, "x"]}]))
    got = pipeline.import_steps(raw)
    assert [(s.type, s.enabled, s.new_column, s.row_indices) for s in got] == [("trim", False, None, None), ("split", True, "N", (1,))] and got[1].options == {"delimiter": "-" * 300}
    for big in ([{"type": "trim", "column": "A"}] * 51, [{"type": "split", "column": "A", "options": {"delimiter": "-" * 3000}}], [{"type": "trim", "column": "A", "rowIndices": list(range(100_001))}], [{"type": "split", "column": "A", "options": {"x": [[[[["y"]]]]]}}]):
        with pytest.raises(pipeline.StepError):
            pipeline.import_steps(big)
    assert pipeline.reset(steps) == []
    assert pipeline.import_steps({"x": 1}) == []


def test_fallback_on_error(spark):
    df = frame(spark, [(" a ",)], ["A"])
    good, wrong = pipeline.or_raw(df, [TransformStep("trim", "A")])
    assert table(good, "A") == [("a",)] and wrong is None
    raw, wrong = pipeline.or_raw(df, [TransformStep("trim", "A"), TransformStep("trim", "none")])
    assert table(raw, "A") == [(" a ",)] and "none" in wrong


def test_row_scope_is_opt_in(spark):
    df, step = frame(spark, [("a",), ("b",)], ["A"]), TransformStep("changeCase", "A", {"mode": "upper"}, row_indices=(1,))
    assert table(pipeline.apply_step(df, step), "A") == [("A",), ("B",)]
    assert table(pipeline.apply_step(df, step, {"scopeRows": True}), "A") == [("a",), ("B",)]


def test_preview(spark):
    df = frame(spark, [(f" v{i}" if i else "", "k") for i in range(50)], ["A", "B"])
    got = pipeline.preview(df, [], TransformStep("trim", "A"), 3).collect()
    assert [(r.before, r.after) for r in got] == [(" v1", "v1"), (" v2", "v2"), (" v3", "v3")]
    got = pipeline.preview(df, [], TransformStep("split", "A", {"delimiter": "v"}), 1).collect()
    assert got[0].after == " | ".join(["", "1"])
    assert pipeline.preview(df, [], TransformStep("combine", None, {"sourceColumns": ["A", "B"], "outputName": "C"}), 1).first().before == " + k"


def test_positions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    wide = df.withColumns({"a": F.col("k") % 3, "b": F.repeat(F.lit("x"), 50)})
    assert [(r.k, r[POS]) for r in pipeline.with_pos(wide, ["k"]).orderBy("k").select("k", POS).collect()] == [(i, i) for i in range(1000)]
    assert [(r.k, r[POS]) for r in pipeline.with_pos(df, ["k"]).orderBy("k").collect()] == [(i, i) for i in range(1000)]


def test_filters(spark):
    df = frame(spark, [("$9",), ("$11",), ("n/a",), ("",), (None,), (" ",)], ["A"])
    kept = lambda k, v="": [r[0] for r in table(relational.apply_filter(df, "A", k, v), "A")]
    assert kept("gt", "10") == ["$11"] and kept("lt", "10") == ["$9"] and kept("empty") == ["", None] and len(kept("contains", "")) == 6 and kept("equals", "N/A") == ["n/a"] and kept("not-contains", "$") == ["n/a", "", None, " "]
    assert relational.apply_filter(df, None, None).count() == 6
    with pytest.raises(ValueError):
        kept("gt", "ten")
    with pytest.raises(ValueError):
        kept("like", "x")


def test_duplicates_and_sort(spark):
    df = frame(spark, [("A", "1"), ("B", "1"), ("A", "2"), (None, "3"), ("", "4")], ["k", "n"])
    assert table(relational.remove_duplicates(df, ["k", "n"], "k"), "k", "n") == [("A", "1"), ("B", "1"), (None, "3")]
    assert relational.duplicate_count(df, ["k", "n"], "k").first()["duplicate_rows"] == 2
    prices = frame(spark, [("$2",), ("x",), ("$10",), ("$3",), ("$2",), ("$5",), ("",)], ["p"])
    order = lambda d: [(r["p"], r[POS]) for r in relational.apply_sort(prices, "p", d).collect()]
    assert order(True)[:3] == [("$10", 2), ("$5", 5), ("$3", 3)] and [p for p, _ in order(True)[-2:]] == ["x", ""] and order(False)[:2] == [("$2", 0), ("$2", 4)] and [p for p, _ in order(False)[-2:]] == ["x", ""]
    names = frame(spark, [("item 10",), ("Item 2",), ("Émile",), ("eel",), ("item 2",)], ["t"])
    assert [r["t"] for r in relational.apply_sort(names, "t").collect()] == ["eel", "Émile", "Item 2", "item 2", "item 10"]
    assert relational.default_name("href", ["Link", "Link 2"]) == "Link 3"


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=st.lists(st.tuples(st.sampled_from(["a", "b", "", None]), st.sampled_from(["1", "2", None])), min_size=1, max_size=12))
def test_dedup_is_idempotent_and_diff_adds_up(spark, rows):
    df = frame(spark, rows, ["k", "v"])
    once = relational.remove_duplicates(df, ["k", "v"])
    assert table(relational.remove_duplicates(once, ["k", "v"]), "k", "v") == table(once, "k", "v")
    stats = diff.compare(df, df.filter(F.col(POS) % 2 == 0), {"k": "text", "v": "text"}, "k").stats().first()
    assert stats["new_count"] + stats["changed_count"] + stats["unchanged_count"] == stats["current_count"]


def test_diff(spark):
    old = frame(spark, [("a#1", "$20", "x"), ("b", "$5", "y"), ("b", "$6", "y"), ("d", "", "z")], ["Link", "Price", "T"])
    new = frame(spark, [("a", "$15", "x"), ("c", "1", ""), ("b", "$6", " y "), ("b", "$7.00", "y"), ("d", "$1", "z")], ["Link", "Price", "T"])
    columns = {"Link": "href", "Price": "text", "T": "text"}
    c = diff.compare(old, new, columns, "Link")
    assert sorted((r.change_type, r.row.Link) for r in c.rows.collect()) == [("changed", "a"), ("changed", "b"), ("changed", "d"), ("new", "c"), ("unchanged", "b")]
    assert sorted((r.field, r.old_value, r.new_value, r.direction) for r in c.fields.collect()) == [("Price", "", "$1", None), ("Price", "$20", "$15", "decreased"), ("Price", "$6", "$7.00", "increased")]
    rows = diff.change_rows(c, "Link")
    assert sorted(r.change_type for r in rows.collect()) == ["CHANGED", "NEW", "PRICE DROPPED", "PRICE INCREASED"]
    assert diff.filter_changes(rows, "price").count() == 2 and diff.filter_changes(rows, "all").count() == 4
    assert sorted((r.old_price, r.percent) for r in diff.price_rows(c, "T", "Link").collect()) == [("$20", "-25%"), ("$6", "16.67%")]
    entire = diff.compare(old, new, columns).stats().first()
    assert entire["changed_count"] == 0 and entire["new_count"] == 4


def test_quality(spark):
    rows = [(f"Product number {i:03d} with a name", f"/p/{i}", f"/i/{i}.jpg", f"${i + 10}.00") for i in range(19)]
    df = frame(spark, [*rows, ("Shop", "/shop", None, "free")], ["t", "l", "i", "p"])
    got = quality.classify_rows(df, {"t": "text", "l": "href", "i": "src", "p": "text"}).orderBy(POS).collect()
    assert [r.verdict for r in got] == ["accept"] * 19 + ["exclude"] and got[-1].weight == 6
    assert quality.drop_excluded(quality.classify_rows(df, {"t": "text", "l": "href", "i": "src", "p": "text"})).count() == 19
    assert {r.verdict for r in quality.classify_rows(df.limit(4), {"t": "text"}).collect()} == {"accept"}
    flags = [r[0] for r in table(quality.flag_anomalies(df, ["t", "i"]), "_anomaly")]
    assert flags[-1] == "t unusually short, i missing" and not any(flags[:-1])
    assert not any(r[0] for r in table(quality.flag_anomalies(df.limit(2), ["t", "i"]), "_anomaly"))
    p = {r.column: r for r in quality.profile(df, ["t", "l", "i", "p"]).collect()}
    assert p["p"].field_type == "currency" and p["p"].suggested_name == "Price" and p["i"].coverage == 0.95
    c = [r[0] for r in frame(spark, [("3,498.08 TL Robin..",), ("(8,245) Star..",), ("Title (2020)",), ("$27 smart watch",)], ["v"]).orderBy(POS).select(quality.contaminated(F.col("v"))).collect()]
    assert c == [True, True, False, False]


def test_assets(spark):
    df = frame(spark, [("https://a/x.jpg#1", "n"), ("https://a/x.jpg", "n"), ("https://a/y.jpg", "N"), ("", "n"), ("ftp://a", "n"), ("https://a/z.jpg", "n_2")], ["u", "t"])
    queue = assets.collect_urls(df, "u")
    assert assets.queue_stats(df, "u").first().asDict() == {"total_rows": 6, "empty": 1, "invalid": 1, "duplicates": 1, "type_filter_skipped": 0, "queued": 3}
    named = assets.name_assets(queue, "{t}", "image")
    assert table(named, "filename") == [("n.jpg",), ("N_2.jpg",), ("n_2_2.jpg",)]
    done = named.select("url", "filename").withColumn("status", F.when(F.col("filename") == "n.jpg", "fetched").otherwise("failed"))
    got = table(assets.manifest(df, "u", done), "dataset_id", "asset_filename", "asset_status")
    assert got == [("0001", "n.jpg", "downloaded"), ("0002", "n.jpg", "downloaded"), ("0003", "N_2.jpg", "failed"), ("0004", "", "missing"), ("0005", "", "skipped"), ("0006", "n_2_2.jpg", "failed")]
    assert assets.numbered_names([("name", "jpg")] * 3) == ["name.jpg", "name_2.jpg", "name_3.jpg"]
    assert assets.export_name("{site}/{rows}{x}", {"site": "a.b", "rows": 3}, datetime(2024, 1, 2)) == "a.b3" and assets.export_name(None, {"site": "s"}, datetime(2024, 1, 2)) == "s_2024-01-02" and assets.export_name("{x}", {}, datetime(2024, 1, 2)) == "export"
    assert list(json.loads(assets.dataset_info({"rowCount": 3})))[:6] == ["datasetName", "createdAt", "sourceURL", "hostname", "savedScraperName", "rowCount"]


def test_enrich(spark):
    df = frame(spark, [("u1",), ("u2",), ("u3",)], ["link"])
    tries = spark.createDataFrame([("u1", 1, "failed", None), ("u1", 2, "completed", ["a", "b"]), ("u2", 1, "failed", ["z"])], "url string, attempt int, status string, link array<string>")
    got = enrich.enrich(df, "link", enrich.final_attempts(tries), ["link"])
    assert got.columns == [POS, "link", "link (detail)"] and table(got, "link (detail)") == [("a; b",), ("",), ("",)]
    assert {r.url: r.status for r in enrich.retry_failed(tries.filter("attempt = 1"), tries.filter("attempt = 2")).collect()} == {"u1": "completed", "u2": "failed"}


def test_snapshots(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    for i in range(3):
        snapshots.save(frame(spark, [(str(i),)] * (i + 1), ["v"]), path, "g", f"id{i}", i)
    assert [(r.snapshot_id, r.row_count) for r in snapshots.listed(spark, path, "g").collect()] == [("id2", 3), ("id1", 2), ("id0", 1)]
    assert snapshots.latest(spark, path, "g").count() == 3 and snapshots.retained(snapshots.listed(spark, path), 2).count() == 2
    history = spark.createDataFrame([("j", i, "success") for i in range(50)], "job_id string, at long, status string")
    assert snapshots.add_history(history, spark.createDataFrame([("j", 99, "error")], history.schema)).agg(F.count("at"), F.min("at")).first() == (50, 1)
    cards = spark.createDataFrame([(True, "error", 1), (True, "changed", 5), (True, "changed", 9), (False, "success", 3)], "enabled boolean, status string, last_run_at long")
    assert [r.last_run_at for r in snapshots.ranked(cards).collect()] == [1, 9, 5, 3] and snapshots.summary(cards).first().asDict() == {"active": 3, "success": 0, "changed": 2, "errors": 1}


def test_every_monitor_has_its_place(spark, tmp_path):
    from gleanery.plans import registry

    some = spark.createDataFrame([(4, "never", None), (2, "changed", 9), (3, "changed", 9), (1, "error", 1), (5, "changed", 12), (6, "never", None)], "id long, status string, last_run_at long")
    assert [r.id for r in snapshots.placed(some, "id").orderBy("place").collect()] == [1, 5, 2, 3, 4, 6]
    spark.range(24_000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 24_000).alias("user_id")).write.parquet(f"{tmp_path}/events.parquet")
    got = registry.QUERIES["monitor_cards"](spark, str(tmp_path)).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 12_001)) and [r.status for r in got] == ["error"] * 6000 + ["changed"] * 6000
    runs = [r.user_id * pow(7, -1, 24_000) % 24_000 for r in got]
    assert runs[:6000] == sorted(runs[:6000], reverse=True) and runs[6000:] == sorted(runs[6000:], reverse=True)


def test_sinks(spark, tmp_path):
    df = frame(spark, [("=SUM(A1)", "-5"), ('a,"b"', None)], ["x", "y"]).drop(POS).coalesce(1)
    assert [r[0] for r in df.select(lines.csv_line(["x", "y"])).collect()] == ["'=SUM(A1),'-5", '"a,""b""",']
    lines.write_csv(df, f"file://{tmp_path}/csv")
    assert next((tmp_path / "csv").glob("part-*")).read_bytes() == b"x,y\r\n'=SUM(A1),'-5\r\n\"a,\"\"b\"\"\",\r\n"
    lines.write_tsv(df, f"file://{tmp_path}/tsv")
    lines.write_ndjson(df, f"file://{tmp_path}/nd")
    assert [json.loads(x) for x in next((tmp_path / "nd").glob("part-*")).read_text().splitlines()][1] == {"x": 'a,"b"', "y": ""}
    assert json.loads(lines.json_array(df))[1]["y"] == ""
    data = workbook.workbook(["N", "Z"], [["0501", "12.50"], ["<a>", None]], typed=True)
    sheet = zipfile.ZipFile(io.BytesIO(data)).read("xl/worksheets/sheet1.xml").decode()
    assert "<v>12.50</v>" in sheet and ">0501<" in sheet and "&lt;a&gt;" in sheet and 'ref="A1:B3"' in sheet
    assert workbook.letters(27) == "AB" and {r.column: r.width for r in workbook.column_widths(df).collect()} == {"x": 10, "y": 8}


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, str(i * i % 7), str(i % 3)) for i in range(60)]
    df = spark.createDataFrame(rows, "n long, a string, b string")
    source, sink = tmp_path / "in", f"file://{tmp_path}/sink"
    for k in range(4):
        df.filter(F.col("n").between(15 * k, 15 * k + 14)).coalesce(1).write.parquet(f"file://{source}/b={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{source}/*")
    accumulate.stream_accumulate(stream, ["a", "b"], sink, f"file://{tmp_path}/check", "n", log=f"file://{tmp_path}/log").awaitTermination()
    got = {(r.a, r.b) for r in spark.read.parquet(sink).collect()}
    batch = accumulate.accumulate(df.withColumn("batch", F.expr("n div 15")), ["a", "b"], "batch", "n")
    assert got == {(r.a, r.b) for r in batch.collect()} and spark.read.parquet(sink).count() == len(got)
    log = spark.read.parquet(f"file://{tmp_path}/log").agg(F.sum("read"), F.sum("added")).first()
    assert log == (60, len(got))
    plain = accumulate.stream_distinct(stream, ["a", "b"]).writeStream.format("memory").queryName("seen").option("checkpointLocation", f"file://{tmp_path}/c2").trigger(availableNow=True).start()
    plain.awaitTermination()
    assert {(r.a, r.b) for r in spark.table("seen").collect()} == got


def test_stream_stops_itself(spark, tmp_path):
    df = spark.createDataFrame([(i, str(i)) for i in range(40)], "n long, a string")
    for k in range(8):
        df.filter(F.col("n") % 8 == k).coalesce(1).write.parquet(f"file://{tmp_path}/in/b={k}")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in/*")
    query = accumulate.stream_accumulate(stream, ["a"], f"file://{tmp_path}/sink", f"file://{tmp_path}/check", "n", accumulate.Limits(max_rows=12), processingTime="0 seconds")
    assert not query.isActive and 12 <= spark.read.parquet(f"file://{tmp_path}/sink").count()


def test_loops_and_stops(spark):
    pages = [["a", "b"], ["c"], ["a", "b"], ["d"]]
    df = spark.createDataFrame([(p, 10 * p + i, v) for p, vs in enumerate(pages) for i, v in enumerate(vs)], "page long, n long, v string")
    steps = accumulate.passes(df, ["v"], "page", "n")
    got = [(r.page, r.added, r.total, r.repeated, r.empty_run) for r in steps.orderBy("page").collect()]
    assert got == [(0, 2, 2, False, 0), (1, 1, 3, False, 0), (2, 0, 3, True, 1), (3, 1, 4, False, 0)]
    stops = lambda limits: [(r.page, r.stop) for r in accumulate.stop_rule(steps, "page", limits).orderBy("page").collect()]
    assert stops(accumulate.Limits()) == [(0, None), (1, None), (2, "loop")]
    assert stops(accumulate.Limits(max_rows=2))[-1] == (0, "max-rows") and stops(accumulate.Limits(max_passes=2))[-1] == (1, "max-passes")

    def rolled(s):
        h = 0
        for c in s:
            h = (h * 31 + ord(c)) & 0xFFFFFFFF
        out = ""
        while h:
            out, h = "0123456789abcdefghijklmnopqrstuvwxyz"[h % 36] + out, h // 36
        return out or "0"

    words = ["", "abc", "Überraschung", "x" * 50]
    got = [r[0] for r in frame(spark, [(w,) for w in words], ["v"]).orderBy(POS).select(accumulate.simple_hash(F.col("v"))).collect()]
    assert got == [rolled(w) for w in words]
