"""Exports, records, snapshots, scheduled runs, sessions and pipeline edits, stated as queries."""

from __future__ import annotations

import io
import json
import zipfile
from datetime import datetime

import pandas as pd
from pyspark.sql import functions as F

from gleanery.operators import assets, diff, enrich, jobs, monitor, pipeline, quality, relational, snapshots
from gleanery.operators.jobs import Job, RunState
from gleanery.operators.pipeline import POS, TransformStep
from gleanery.plans.base import query, table
from gleanery.sinks import lines, workbook
from gleanery.sources.scan import Field
from gleanery.streaming import accumulate
from gleanery.streaming.folders import new_folder


def _named(spark, sf_dir):
    """Parts with quotes, markup and blanks in their values; `pos` is their place."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.expr("if(p_partkey % 7 = 0, null, concat(p_name, ' \"', p_brand, '\" <&>'))").alias("Name"), F.col("p_partkey").cast("string").alias("Key"))


# --- exports


@query("json_array_lines", r"""SELECT CAST(p_partkey AS BIGINT) AS part, concat('  {', chr(10), '    "Name": "', CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(p_name, ' \"', p_brand, '\" <&>') END, '",', chr(10), '    "Key": "', CAST(p_partkey AS VARCHAR), '"', chr(10), '  }',
 CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN '' ELSE ',' END) AS line FROM part UNION ALL SELECT min(p_partkey) - 1, '[' FROM part UNION ALL SELECT max(p_partkey) + 1, ']' FROM part""")
def json_array_lines(spark, sf_dir):
    return lines.json_array_lines(_named(spark, sf_dir), "pos")


@query("xlsx_cells", r"""WITH c AS (SELECT p_partkey + 2 AS "row", unnest([0, 1, 2]) AS "column", unnest(['A', 'B', 'C']) AS l, unnest([CASE WHEN p_partkey % 7 = 0 THEN '' ELSE concat(p_name, ' "', p_brand, '" &lt;&amp;&gt;') END, CAST(p_partkey AS VARCHAR), '007']) AS v FROM part
 UNION ALL SELECT 1, unnest([0, 1, 2]), unnest(['A', 'B', 'C']), unnest(['Name', 'Key', 'Code']))
SELECT CAST("row" AS BIGINT) AS "row", CAST("column" AS INTEGER) AS "column", CASE WHEN "row" > 1 AND l = 'B' THEN concat('<c r="', l, "row", '"><v>', v, '</v></c>') ELSE concat('<c r="', l, "row", '" t="inlineStr"><is><t xml:space="preserve">', v, '</t></is></c>') END AS xml FROM c""")
def xlsx_cells(spark, sf_dir):
    """Cells of a typed sheet: numbers only where that loses nothing."""
    return workbook.xlsx_cells(_named(spark, sf_dir).withColumn("Code", F.lit("007")), "pos", typed=True)


@query("xlsx_columns", "SELECT CAST(range AS INTEGER) AS i, concat(CASE WHEN range >= 702 THEN chr(CAST(64 + (range - 702) // 676 + 1 AS INTEGER)) ELSE '' END, CASE WHEN range >= 26 THEN chr(CAST(65 + (range // 26 - 1) % 26 AS INTEGER)) ELSE '' END, chr(CAST(65 + range % 26 AS INTEGER))) AS letters FROM range(2000)")
def xlsx_columns(spark, sf_dir):
    return spark.range(2000).select(F.col("id").cast("int").alias("i"), workbook.letters_of(F.col("id")).alias("letters"))


@query("archive_entries", "SELECT r_name AS region, concat(n_name, '.txt') AS name, concat(n_name, chr(10), CAST(n_nationkey AS VARCHAR)) AS text, 0 AS method FROM nation JOIN region ON r_regionkey = n_regionkey")
def archive_entries(spark, sf_dir):
    """One archive for each region, read back entry by entry."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("region"), "n_name", "n_nationkey")

    def packed(group: pd.DataFrame) -> pd.DataFrame:
        data = workbook.archive({f"{n}.txt": f"{n}\n{k}" for n, k in zip(group["n_name"], group["n_nationkey"], strict=True)})
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return pd.DataFrame([(group["region"].iloc[0], i.filename, z.read(i).decode(), i.compress_type) for i in z.infolist()], columns=["region", "name", "text", "method"])

    return nations.groupBy("region").applyInPandas(packed, "region string, name string, text string, method int")


@query("data_urls", "SELECT p_partkey, concat('data:text/plain;base64,', to_base64(encode(p_name))) AS address, p_name AS back FROM part")
def data_urls(spark, sf_dir):
    shown = table(spark, sf_dir, "part").select("p_partkey", lines.data_url(F.encode("p_name", "UTF-8"), "text/plain").alias("address"))
    return shown.withColumn("back", F.decode(lines.from_data_url("address"), "UTF-8"))


@query("export_names", "SELECT * FROM (VALUES ('{site}-{date}', 'shop.example-2024-03-09'), ('', 'Job_2024-03-09'), ('{scraper} {time} {rows}{none}.', 'Job 14-05-07 12'), ('<{none}>', 'export')) AS t(template, name)")
def export_names(spark, sf_dir):
    context, at = {"site": "shop.example", "scraper": "Job", "rows": 12, "format": "csv"}, datetime(2024, 3, 9, 14, 5, 7)
    return spark.createDataFrame([(t, assets.export_name(t, context, at)) for t in ("{site}-{date}", "", "{scraper} {time} {rows}{none}.", "<{none}>")], "template string, name string")


@query("dataset_facts", """SELECT * FROM (VALUES ('datasetName', '"D"'), ('rowCount', '12'), ('includedFormats', '["csv"]'), ('hostname', 'null'), ('failedAssetCount', '0'), ('collectionMode', '"current-page"')) AS t(field, value)""")
def dataset_facts(spark, sf_dir):
    info = json.loads(assets.dataset_info({"datasetName": "D", "rowCount": 12, "includedFormats": ["csv"]}))
    return spark.createDataFrame([(k, json.dumps(info[k])) for k in ("datasetName", "rowCount", "includedFormats", "hostname", "failedAssetCount", "collectionMode")], "field string, value string")


@query("destinations", "SELECT * FROM (VALUES ('clipboard', true), ('download', true), ('google-sheets', false)) AS t(id, available)")
def destinations(spark, sf_dir):
    return spark.createDataFrame(sorted(workbook.DESTINATIONS.items()), "id string, available boolean")


# --- jobs, stores and states

_JOB = """concat('{"schemaVersion":', if(n_nationkey % 5 = 1, '2', '1'), ',"name":"', if(n_nationkey % 5 = 2, ' ', n_name), '","columns":[{"name":"a","attribute":"', if(n_nationkey % 5 = 3, 'eval', 'href'), '"},7],"transforms":[{"type":"trim","column":"a"},{"type":"evil","column":"a"}]', if(n_nationkey % 5 = 4, '', '}'))"""


@query("imported_jobs", "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN n_name END AS name, CASE WHEN n_nationkey % 5 = 0 THEN 'a:href|trim' END AS parts, n_nationkey % 5 = 0 AS usable FROM nation")
def imported_jobs(spark, sf_dir):
    """Records of jobs, some of them broken, of a later version, nameless or without a usable column."""
    given = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.expr(_JOB).alias("record"))

    def read(batches):
        for batch in batches:
            out = []
            for k, record in zip(batch["n_nationkey"], batch["record"], strict=True):
                try:
                    job = jobs.import_job(record)
                    again = jobs.import_job(jobs.export_job(job))
                    out.append((k, again.name, "|".join([*(f"{f.name}:{f.attribute}" for f in again.fields), *(s.type for s in job.steps)]), True))
                except jobs.ImportFailed:
                    out.append((k, None, None, False))
            yield pd.DataFrame(out, columns=["n_nationkey", "name", "parts", "usable"])

    return given.mapInPandas(read, "n_nationkey long, name string, parts string, usable boolean")


@query("exported_job", """SELECT * FROM (VALUES ('schemaVersion', '1'), ('name', '"J"'), ('description', '""'), ('containerSelector', '"li"'), ('columns', '["t", "a"]')) AS t(field, value)""")
def exported_job(spark, sf_dir):
    """A job as a portable record: its steps stay behind."""
    raw = json.loads(jobs.export_job(Job("J", "li", (Field("t", "h3"), Field("a", "a", "href")), (TransformStep("trim", "t"),))))
    return spark.createDataFrame([(k, json.dumps([c["name"] for c in v] if k == "columns" else v)) for k, v in raw.items()], "field string, value string")


@query("page_jobs", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_custkey % 3 = 1")
def page_jobs(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("hostname"), F.concat(F.lit("/"), (F.col("c_custkey") % 3).cast("string")).alias("pathname"))
    return jobs.matches_page(rows, "MACHINERY", "/1").select("c_custkey")


@query("run_states", "SELECT * FROM (VALUES (1, 'running', NULL), (2, 'paused', 'user'), (3, 'running', NULL), (4, 'running', NULL), (5, 'stopped', 'max-rows'), (6, 'running', NULL), (7, 'error', NULL), (8, 'error', NULL)) AS t(step, status, stop_reason)")
def run_states(spark, sf_dir):
    """A run started, paused, resumed, told an unknown state, stopped, resumed, failed, and not resumed after that."""
    state, seen = RunState("r"), []
    for act in (lambda r: r.to("running"), RunState.pause, RunState.resume, lambda r: r.to("odd"), lambda r: r.to("stopped", "max-rows"), RunState.resume, lambda r: r.to("error", error="x"), RunState.resume):
        state = act(state)
        seen.append((len(seen) + 1, state.status, state.stop_reason))
    return spark.createDataFrame(seen, "step int, status string, stop_reason string")


# --- snapshots and scheduled runs


def _days(spark, sf_dir):
    """Three days of customers by segment: each day some are missing and balances move."""
    path = new_folder(spark, "snapshots")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(POS), F.col("c_custkey").cast("string").alias("id"), "c_mktsegment")
    for day in (1, 2, 3):
        for group in ("MACHINERY", "BUILDING"):
            snapshots.save(rows.filter((F.col("c_mktsegment") == group) & (F.col(POS) % 7 != day)).drop("c_mktsegment"), path, group, f"s{day}", day * 1000)
    return path


_COUNTS = "SELECT g AS group_key, concat('s', CAST(d AS VARCHAR)) AS snapshot_id, CAST(d * 1000 AS BIGINT) AS created_at, (SELECT count(*) FROM customer WHERE c_mktsegment = g AND c_custkey % 7 <> d) AS row_count FROM (SELECT unnest(['MACHINERY', 'BUILDING']) AS g), (SELECT unnest([1, 2, 3]) AS d)"


@query("snapshots_listed", f"{_COUNTS} WHERE NOT (g = 'MACHINERY' AND d = 2)")
def snapshots_listed(spark, sf_dir):
    """What is left after one snapshot was deleted; a second try finds nothing."""
    path = _days(spark, sf_dir)
    assert snapshots.delete(spark, path, "MACHINERY", "s2") and not snapshots.delete(spark, path, "MACHINERY", "s2")
    return snapshots.listed(spark, path).select("group_key", "snapshot_id", "created_at", "row_count")


@query("snapshot_before", "SELECT 'before' AS which, c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 7 <> 2 UNION ALL SELECT 'latest', c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 7 <> 3")
def snapshot_before(spark, sf_dir):
    """The latest snapshot, and the latest before the current one."""
    path = _days(spark, sf_dir)
    sides = [snapshots.latest(spark, path, "BUILDING", at).select(F.lit(n).alias("which"), F.col("id").cast("long").alias("c_custkey")) for n, at in (("before", 3000), ("latest", None))]
    return sides[0].unionByName(sides[1])


@query("snapshots_retained", f"SELECT * FROM ({_COUNTS}) WHERE group_key = 'BUILDING' AND created_at > 1000")
def snapshots_retained(spark, sf_dir):
    path = _days(spark, sf_dir)
    snapshots.retain(spark, path, "BUILDING", 2)
    return snapshots.listed(spark, path, "BUILDING").select("group_key", "snapshot_id", "created_at", "row_count")


_RUN = "SELECT count(*) FILTER (c_custkey % 5 = 0 AND c_custkey % 7 <> 0) AS n_new, count(*) FILTER (c_custkey % 7 = 0 AND c_custkey % 5 <> 0) AS n_removed, count(*) FILTER (c_custkey % 5 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0) AS n_changed, count(*) FILTER (c_custkey % 7 <> 0) AS n FROM customer"


@query("scheduled_run", f"SELECT 'shop' AS job_id, CAST(2000 AS BIGINT) AS at, 'success' AS status, n_new AS new_count, n_removed AS removed_count, n_changed AS changed_count, n AS row_count, concat_ws(', ', concat(n_new, ' new'), concat(n_removed, ' removed'), concat(n_changed, ' changed')) AS message, CAST(3602000 AS BIGINT) AS next_at FROM ({_RUN})")
def scheduled_run(spark, sf_dir):
    """The second run of a job: cleaned, compared with the first, recorded, and worth a message."""
    job, path = Job("shop", steps=(TransformStep("trim", "name"),), compare_key="id", interval_minutes=60), new_folder(spark, "snapshots")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(POS), F.col("c_custkey").cast("string").alias("id"), F.concat(F.lit(" "), "c_name").alias("name"))
    moved = rows.filter(F.col(POS) % 7 != 0).withColumn("name", F.when(F.col(POS) % 3 == 0, F.concat("name", F.lit("!  "))).otherwise(F.col("name")))
    columns = {"id": "text", "name": "text"}
    monitor.scheduled_run(rows.filter(F.col(POS) % 5 != 0), job, path, 1000, columns, prices=[])
    second = monitor.scheduled_run(moved, job, path, 2000, columns, prices=[])
    return second.entry.join(second.messages.select(F.col("name").alias("job_id"), "message"), "job_id").withColumn("next_at", F.lit(second.next_at).cast("long"))


@query("monitor_cards", "SELECT user_id, CASE WHEN user_id % 4 = 0 THEN 'error' ELSE 'changed' END AS status, row_number() OVER (ORDER BY CASE WHEN user_id % 4 = 0 THEN 0 ELSE 1 END, last_run_at DESC) AS place FROM (SELECT user_id, max(event_id) AS last_run_at FROM events WHERE user_id % 4 IN (0, 1) GROUP BY 1)")
def monitor_cards(spark, sf_dir):
    """Monitors with errors or changes, most urgent first."""
    cards = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("last_run_at")).withColumn("status", F.element_at(F.array(*(F.lit(s) for s in ("error", "changed", "success", "never"))), (F.col("user_id") % 4 + 1).cast("int")))
    kept = snapshots.filter_cards(cards, "changed").unionByName(snapshots.filter_cards(cards, "errors"))
    return snapshots.placed(kept, "user_id").select("user_id", "status", "place")


# --- changes


@query("change_categories", "SELECT unnest(['new', 'changed', 'price']) AS category, unnest([count(*) FILTER (k = 0), count(*) FILTER (k IN (2, 3)), count(*) FILTER (k = 3)]) AS n FROM (SELECT p_partkey % 4 AS k FROM part)")
def change_categories(spark, sf_dir):
    kinds = F.element_at(F.array(*(F.lit(k) for k in ("NEW", "REMOVED", "CHANGED", "PRICE DROPPED"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(kinds.alias("change_type"))
    counted = [diff.filter_changes(rows, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(c).alias("category"), "n") for c in ("new", "changed", "price")]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("price_columns", "SELECT * FROM (VALUES ('Total cost'), ('mixed'), ('p_retail')) AS t(name)")
def price_columns(spark, sf_dir):
    """Columns by name, or because half of all values show a currency: here only the later rows do."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey as _pos", "p_name as `Total cost`", "p_name as title", "concat(p_size, ' USD') as p_retail", "if(p_partkey % 2 = 0, '€5', p_name) as mixed", "if(p_partkey % 3 = 0, '$1', p_name) as rarely")
    found = diff.price_columns(rows, rows, ["Total cost", "title", "p_retail", "mixed", "rarely"])
    return spark.createDataFrame([(c,) for c in found], "name string")


@query("diff_repeated_keys", "SELECT a.event_id, CASE WHEN b.v IS NULL THEN 'new' WHEN b.v = a.event_type THEN 'unchanged' ELSE 'changed' END AS change_type FROM events a LEFT JOIN (SELECT user_id, max_by(event_type, event_id) AS v FROM events WHERE event_id % 2 = 0 AND user_id % 5 <> 0 GROUP BY 1) b USING (user_id) WHERE a.event_id % 2 = 1")
def diff_repeated_keys(spark, sf_dir):
    """Several rows of a key: the last one before stands for it, each one now is compared."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias(POS), F.col("user_id").cast("string").alias("user"), F.col("event_type").alias("kind"), "user_id")
    found = diff.compare(rows.filter(f"{POS} % 2 = 0 and user_id % 5 <> 0"), rows.filter(f"{POS} % 2 = 1"), {"user": "text", "kind": "text"}, "user", [])
    return found.rows.filter("change_type <> 'removed'").select(F.col(POS).alias("event_id"), "change_type")


# --- pipelines


@query("presets", r"SELECT p_partkey, concat(p_name, ' & ', p_brand) AS clean, concat('https://x.example/', CAST(p_partkey AS VARCHAR)) AS url, concat(p_name, ' b') AS plain FROM part")
def presets(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("  "), "p_name", F.lit("​   &amp; "), "p_brand").alias("clean"), F.concat(F.lit(" HTTPS://X.example/"), F.col("p_partkey").cast("string"), F.lit("#top ")).alias("url"), F.concat(F.lit("<p>"), "p_name", F.lit(" <b>b</b></p>")).alias("plain"))
    return pipeline.apply_transforms(rows, [*pipeline.preset("cleanText", "clean"), *pipeline.preset("normalizeUrl", "url"), *pipeline.preset("htmlToText", "plain")])


@query("pipeline_fallback", "SELECT c_custkey, c_name, true AS failed FROM customer")
def pipeline_fallback(spark, sf_dir):
    """A pipeline with a step that cannot be applied leaves the rows as they were, and says so."""
    rows, wrong = pipeline.or_raw(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), [TransformStep("changeCase", "c_name", {"mode": "upper"}), TransformStep("trim", "none")])
    return rows.withColumn("failed", F.lit(wrong is not None))


@query("row_scope", "SELECT n_nationkey, CASE WHEN n_nationkey IN (1, 3) THEN lower(n_name) ELSE n_name END AS scoped, lower(n_name) AS everywhere FROM nation")
def row_scope(spark, sf_dir):
    rows, scoped = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias(POS), F.col("n_name").alias("scoped"), F.col("n_name").alias("everywhere")), (1, 3)
    lower = {"mode": "lower"}
    out = pipeline.apply_step(rows, TransformStep("changeCase", "scoped", lower, row_indices=scoped), {"scopeRows": True})
    return pipeline.apply_step(out, TransformStep("changeCase", "everywhere", lower, row_indices=scoped)).withColumnRenamed(POS, "n_nationkey")


@query("edited_pipeline", "SELECT c_custkey, concat('<', upper(c_name), '>') AS name FROM customer")
def edited_pipeline(spark, sf_dir):
    """Steps moved, switched off, removed and undone; what is left is applied."""
    steps = [TransformStep("prefixSuffix", "name", {"prefix": "<", "suffix": ">"}), TransformStep("changeCase", "name", {"mode": "upper"}), TransformStep("changeCase", "name", {"mode": "lower"}), TransformStep("fillEmpty", "name", {"value": "x"}), TransformStep("trim", "name")]
    steps = pipeline.undo(pipeline.remove(pipeline.toggle(pipeline.move(steps, 0, 1), 2), 3))
    assert pipeline.reset(steps) == []
    return pipeline.apply_transforms(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name")), steps)


@query("named_columns", 'SELECT c_custkey, c_name AS "Name", coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END, \'\') AS "Link 2" FROM customer')
def named_columns(spark, sf_dir):
    """Columns by id under shown names, and the name a further link gets."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias(POS), F.col("c_name").alias("f1"), F.expr("if(c_custkey % 2 = 0, c_mktsegment, null)").alias("f2"))
    return relational.to_named(rows, {"f1": "Name", "f2": relational.default_name("href", ["Name", "Link"])}).withColumnRenamed(POS, "c_custkey")


@query("no_filter", "SELECT n_nationkey FROM nation UNION ALL SELECT n_nationkey FROM nation")
def no_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey")
    return relational.apply_filter(rows, None, "contains", "x").unionByName(relational.apply_filter(rows, "n_nationkey", None, "x"))


@query("first_changes", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 300")
def first_changes(spark, sf_dir):
    """The part of a change list that a screen shows."""
    return diff.shown(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey")


@query("kept_rows", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'no_link; few_values' WHEN c_custkey % 4 = 3 THEN 'odd' END AS anomaly FROM customer WHERE c_custkey % 4 <> 1")
def kept_rows(spark, sf_dir):
    """Excluded rows go; reasons fill an empty anomaly and never replace one."""
    rows = table(spark, sf_dir, "customer").selectExpr("c_custkey", "if(c_custkey % 4 = 3, 'odd', null) as anomaly", "case c_custkey % 4 when 1 then 'exclude' when 0 then 'accept' else 'flag' end as verdict", "if(c_custkey % 4 >= 2, array('no_link', 'few_values'), cast(array() as array<string>)) as reasons")
    return quality.drop_excluded(rows, "anomaly").select("c_custkey", "anomaly")


# --- sessions


@query("session_seed", "SELECT min(event_id) AS event_id, 'link' AS by FROM events GROUP BY user_id UNION ALL SELECT min(event_id), 'row' FROM events GROUP BY user_id, event_type")
def session_seed(spark, sf_dir):
    """A session's first rows: by its first link, or by the entire row where there is none."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("link"), F.col("event_type").alias("kind"))
    sides = [accumulate.seed(rows, c, "event_id").select("event_id", F.lit(n).alias("by")) for n, c in (("link", {"kind": "text", "link": "href"}), ("row", {"kind": "text", "link": "text"}))]
    return sides[0].unionByName(sides[1])


_STEPS = "SELECT CAST(range AS BIGINT) AS page, CAST(range + 1 AS BIGINT) AS pass_no, 10 * (range + 1) AS total, false AS repeated, 0 AS empty_run, CASE WHEN range = 6 THEN {0} ELSE 'ok' END AS next, range < {1} AS button FROM range(20)"


def _steps(spark, sf_dir, control, presses):
    return spark.range(20).selectExpr("id as page", "id + 1 as pass_no", "10 * (id + 1) as total", "false as repeated", "0 as empty_run", f"if(id = 6, {control}, 'ok') as next", f"id < {presses} as button")


@query("multi_page_stops", "SELECT * FROM (VALUES ('disabled', 6, 'complete'), ('missing', 6, 'error'), ('elsewhere', 6, 'origin-changed'), ('ok', 3, 'max-passes')) AS t(control, page, stop)")
def multi_page_stops(spark, sf_dir):
    """Where runs over a next control end."""
    limits = {"ok": accumulate.Limits(max_passes=4)}
    found = [accumulate.multi_page_rule(_steps(spark, sf_dir, f"'{c}'", 20), "page", limits.get(c, accumulate.Limits())).filter("stop is not null").select(F.lit(c).alias("control"), F.col("page").cast("int").alias("page"), "stop") for c in ("disabled", "missing", "elsewhere", "ok")]
    return relational.append(found)


@query("load_more_stops", "SELECT * FROM (VALUES (5, 5, 'complete'), (0, 0, 'error'), (20, 19, 'end'), (21, 7, 'max-rows')) AS t(presses, page, stop)")
def load_more_stops(spark, sf_dir):
    """Where runs that press a button for more end."""
    found = [accumulate.load_more_rule(_steps(spark, sf_dir, "'ok'", n), "page", accumulate.Limits(max_rows=80 if n == 21 else None)).filter("stop is not null").select(F.lit(n).alias("presses"), F.col("page").cast("int").alias("page"), "stop") for n in (5, 0, 20, 21)]
    return relational.append(found)


@query("repeated_pages", "SELECT CAST(page AS BIGINT) AS page, page >= 5 AS repeated, CASE WHEN page < 5 THEN 3 ELSE 0 END AS added, greatest(page - 4, 0) AS empty_run FROM (SELECT unnest(range(8)) AS page)")
def repeated_pages(spark, sf_dir):
    """Pages that show what an earlier page showed."""
    rows = spark.range(24).selectExpr("id", "id div 3 as page", "cast(if(id div 3 >= 5, id - 15, id) as string) as k")
    return accumulate.passes(rows, ["k"], "page", "id").select("page", "repeated", "added", "empty_run")


@query("merged_rows", "SELECT min(event_id) AS event_id FROM events WHERE event_id >= 500 AND (user_id, event_type) NOT IN (SELECT (user_id, event_type) FROM events WHERE event_id < 500) GROUP BY user_id, event_type")
def merged_rows(spark, sf_dir):
    """The new rows of a batch, against those seen before it."""
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "event_type")
    return accumulate.merge_new(rows.filter("event_id < 500"), rows.filter("event_id >= 500"), ["user", "event_type"], "event_id").select("event_id")


@query("retried_outcomes", "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'completed' WHEN c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 2 END AS run FROM customer")
def retried_outcomes(spark, sf_dir):
    """Only failed addresses run again, and their second outcomes replace the first."""
    first = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("url"), F.when(F.col("c_custkey") % 3 == 0, "failed").otherwise("completed").alias("status"), F.lit(1).alias("run"))
    again = first.filter("status = 'failed'").select("url", F.when(F.col("url") % 2 == 0, "completed").otherwise("failed").alias("status"), F.lit(2).alias("run"))
    return enrich.retry_failed(first, again).withColumnRenamed("url", "c_custkey")


@query("page_hashes", "SELECT n_regionkey, concat('u', CAST(n_regionkey AS VARCHAR)) AS url, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(s, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, k: (h * 31 + k) % 4294967296) AS BIGINT) AS hash FROM (SELECT n_regionkey, string_agg(n_name, '~' ORDER BY n_name) AS s FROM nation GROUP BY 1)")
def page_hashes(spark, sf_dir):
    """The whole signature of a page: its address and the rolling hash of its rows."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    sign = accumulate.page_signature(F.concat(F.lit("u"), F.col("n_regionkey").cast("string")), F.col("names"))
    return rows.select("n_regionkey", F.substring_index(sign, "::", 1).alias("url"), F.conv(F.substring_index(sign, "::", -1), 36, 10).cast("long").alias("hash"))


@query("stored_records", """SELECT * FROM (VALUES ('a', '{"x": [1]}'), ('c', 'null')) AS t(key, value)""")
def stored_records(spark, sf_dir):
    """Records set, replaced and removed in a store of configuration."""
    import tempfile

    with tempfile.TemporaryDirectory() as folder:  # configuration of one driver, never data
        store = jobs.Store(f"{folder}/records.json")
        for k, v in (("a", 1), ("b", 2), ("a", {"x": [1]}), ("c", None)):
            store.set(k, v)
        store.remove("b")
        return spark.createDataFrame([(k, json.dumps(v)) for k, v in store.all().items()], "key string, value string")
