"""Enrichment, assets, exports and incremental runs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import assets, enrich
from gleanery.operators.pipeline import POS, with_pos
from gleanery.operators.relational import export_columns
from gleanery.plans.base import query, table
from gleanery.sinks import lines, workbook
from gleanery.streaming import accumulate


@query("row_positions", "SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos FROM orders")
def row_positions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", "o_custkey")
    return with_pos(rows, ["o_orderdate", "o_orderkey"]).select("o_orderkey", "o_custkey", F.col(POS).alias("pos"))


@query("detail_enrichment", "SELECT o_orderkey, CASE WHEN o_custkey % 5 < 3 THEN c_name ELSE '' END AS name, CASE WHEN o_custkey % 5 < 3 THEN concat(c_mktsegment, '; ', CAST(c_nationkey AS VARCHAR)) ELSE '' END AS tags FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def detail_enrichment(spark, sf_dir):
    link = lambda c: F.concat(F.lit("https://x.example/"), F.col(c).cast("string"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", link("o_custkey").alias("link"))
    status = F.when(F.col("c_custkey") % 5 == 0, "completed").when(F.col("c_custkey") % 5 < 3, "partial").otherwise("failed")
    results = table(spark, sf_dir, "customer").select(link("c_custkey").alias("url"), status.alias("status"), F.col("c_name").alias("name"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags"))
    return enrich.enrich(rows, "link", results, ["name", "tags"]).select("o_orderkey", "name", "tags")


@query("retry_outcomes", "SELECT o_custkey AS url, least(count(*), 3) AS attempts, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'completed' WHEN bool_or(o_orderstatus = 'P') THEN 'partial' ELSE 'failed' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 3 GROUP BY 1")
def retry_outcomes(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "P", "partial").otherwise("failed")
    tries = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("url"), n.alias("attempt"), status.alias("status"))
    return accumulate.bounded_retries(tries).withColumn("attempts", F.col("attempts").cast("long"))


@query("status_counts", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def status_counts(spark, sf_dir):
    return enrich.status_counts(table(spark, sf_dir, "orders").withColumnRenamed("o_orderstatus", "status"))


@query("detail_url_counts", r"SELECT count(*) AS rows, count(*) FILTER (url LIKE 'http%') AS with_url, count(DISTINCT CASE WHEN url LIKE 'http%' THEN url END) AS unique_urls FROM pages")
def detail_url_counts(spark, sf_dir):
    return enrich.detail_urls(table(spark, sf_dir, "pages"), "url")


@query("http_failures", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'HTTP 404' WHEN 1 THEN 'HTTP 429 (rate limited)' WHEN 2 THEN 'HTTP 503' ELSE 'blocked/permission (HTTP 403)' END AS reason, p_partkey % 4 IN (1, 2) AS retryable, CAST(least(1000 * pow(2, p_partkey % 8), 30000) AS BIGINT) AS wait_ms FROM part")
def http_failures(spark, sf_dir):
    status = F.element_at(F.array(*(F.lit(s) for s in (404, 429, 503, 403))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.http_failure(status).alias("f"), urls.backoff_ms(F.col("p_partkey") % 8 + 1).alias("wait_ms")).select("p_partkey", "f.reason", "f.retryable", "wait_ms")


@query("dataset_ids", "SELECT c_custkey, lpad(CAST(c_custkey AS VARCHAR), CAST(greatest(4, length(CAST((SELECT count(*) FROM customer) AS VARCHAR))) AS INTEGER), '0') AS dataset_id FROM customer")
def dataset_ids(spark, sf_dir):
    return assets.dataset_ids(table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") - 1).alias(POS))).drop(POS)


_ASSETS = "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 14 = 0 THEN 'blob:x' ELSE concat('https://cdn.example/', CAST(page_id % 40 AS VARCHAR), '.jpg', CASE WHEN page_id % 2 = 0 THEN '#a' ELSE '' END) END AS link FROM pages"


@query("asset_manifest", f"SELECT page_id, lpad(CAST(row_number() OVER (ORDER BY page_id) AS VARCHAR), 4, '0') AS dataset_id, CASE WHEN link LIKE 'https:%' AND page_id % 40 < 30 THEN concat('images/', CAST(page_id % 40 AS VARCHAR), '.jpg') ELSE '' END AS asset_filename, CASE WHEN link = '' THEN 'missing' WHEN link LIKE 'blob%' THEN 'skipped' WHEN page_id % 40 >= 30 THEN 'missing' WHEN page_id % 40 % 3 = 0 THEN 'failed' ELSE 'downloaded' END AS asset_status FROM ({_ASSETS})")
def asset_manifest(spark, sf_dir):
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    rows = with_pos(spark.sql(_ASSETS.replace("VARCHAR", "STRING")), ["page_id"])
    n = F.col("id").cast("string")
    fetched = spark.range(30).select(F.concat(F.lit("https://cdn.example/"), n, F.lit(".jpg")).alias("url"), F.concat(F.lit("images/"), n, F.lit(".jpg")).alias("filename"), F.when(F.col("id") % 3 == 0, "failed").otherwise("fetched").alias("status"))
    return assets.manifest(rows, "link", fetched).select("page_id", "dataset_id", "asset_filename", "asset_status")


@query("asset_names", "SELECT p_partkey AS pos, concat(p_name, CASE WHEN n = 1 THEN '' ELSE concat('_', CAST(n AS VARCHAR)) END, '.png') AS filename FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS n FROM part)")
def asset_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_name", F.col("p_partkey").alias(POS), F.concat(F.lit("https://cdn.example/"), F.col("p_partkey").cast("string"), F.lit(".png")).alias("link"))
    return assets.name_assets(assets.collect_urls(rows, "link"), "{p_name}", "image").select(POS, "filename").withColumnRenamed(POS, "pos")


@query("safe_file_names", r"SELECT p_partkey, regexp_replace(concat(p_name, ' ', p_brand), '\.+$', '') AS name FROM part")
def safe_names(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.safe_file_name(F.concat(F.lit(" <"), "p_name", F.lit('>:  "'), "p_brand", F.lit("..."))).alias("name"))


@query("csv_lines", "SELECT concat(CAST(p_partkey AS VARCHAR), ',', chr(34), p_name, ', ', chr(34), chr(34), 'x', chr(34), chr(34), chr(34), ',', chr(39), '=', CAST(p_size AS VARCHAR)) AS line FROM part")
def csv_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.concat("p_name", F.lit(', "x"')).alias("name"), F.concat(F.lit("="), F.col("p_size").cast("string")).alias("f"))
    return rows.select(lines.csv_line(rows.columns).alias("line"))


@query("tsv_lines", "SELECT concat(CAST(p_partkey AS VARCHAR), chr(9), p_name, ' x') AS line FROM part")
def tsv_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("k"), F.concat("p_name", F.lit("\t\r\nx")).alias("name"))
    return rows.select(lines.tsv_line(rows.columns).alias("line"))


@query("ndjson_rows", """SELECT concat('{"key":"', CAST(p_partkey AS VARCHAR), '","name":"', CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, '"}') AS line FROM part""")
def ndjson_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("key"), F.expr("if(p_partkey % 3 = 0, null, p_name)").alias("name"))
    return rows.select(lines.json_line(rows.columns).alias("line"))


@query("export_raw_columns", """SELECT upper(c_name) AS name, c_name AS "Raw name", c_mktsegment AS segment FROM customer""")
def export_raw(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.upper("c_name").alias("name"), F.col("c_name").alias("raw"), F.col("c_mktsegment").alias("segment"))
    return export_columns(rows, ["name", "segment"], {"name": "raw"})


@query("column_widths", """SELECT 'p_name' AS "column", least(60, greatest(8, max(length(p_name)) + 2)) AS width FROM part UNION ALL SELECT 'p_type', least(60, greatest(8, max(length(p_type)) + 2)) FROM part""")
def column_widths(spark, sf_dir):
    return workbook.column_widths(table(spark, sf_dir, "part").select("p_name", "p_type")).withColumn("width", F.col("width").cast("long"))


# --- incremental runs

@query("incremental_accumulate", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def incremental(spark, sf_dir):
    """Ten ordered batches, first-seen rows kept."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.expr("event_id div 1000").alias("batch"), F.col("user_id").cast("string").alias("user"))
    return accumulate.accumulate(rows, ["user", "event_type"], "batch", "event_id").select("user_id", "event_type", "event_id")


_PASSES = "WITH p AS (SELECT event_id // 100 AS page, concat(CAST(user_id AS VARCHAR), event_type) AS k, min(event_id) AS e FROM events GROUP BY 1, 2), f AS (SELECT k, min(page) AS page FROM p GROUP BY k), c AS (SELECT DISTINCT event_id // 100 AS page FROM events), a AS (SELECT c.page, count(f.k) AS added FROM c LEFT JOIN f USING (page) GROUP BY 1), t AS (SELECT page, added, sum(added) OVER (ORDER BY page) AS total, row_number() OVER (ORDER BY page) AS n FROM a)"


@query("run_passes", f"{_PASSES} SELECT CAST(page AS BIGINT) AS page, added, CAST(total AS BIGINT) AS total FROM t")
def run_passes(spark, sf_dir):
    return _passes(spark, sf_dir).select("page", "added", "total")


def _passes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("event_id div 100").alias("page"), F.col("user_id").cast("string").alias("user"), "event_type")
    return accumulate.passes(rows, ["user", "event_type"], "page", "event_id")


@query("run_stop_rule", f"{_PASSES}, g AS (SELECT *, sum(CASE WHEN added > 0 THEN 1 ELSE 0 END) OVER (ORDER BY page) AS g FROM t), r AS (SELECT *, CASE WHEN total >= 400 THEN 'max-rows' WHEN n >= 50 THEN 'max-passes' WHEN sum(CASE WHEN added = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY page) >= 3 THEN 'no-new-data' END AS stop FROM g) SELECT CAST(page AS BIGINT) AS page, CAST(total AS BIGINT) AS total, CASE WHEN stop IS NULL AND lead(page) OVER (ORDER BY page) IS NULL THEN 'end' ELSE stop END AS stop FROM r WHERE n <= coalesce((SELECT min(n) FROM r WHERE stop IS NOT NULL), 1000000000)")
def run_stop_rule(spark, sf_dir):
    return accumulate.stop_rule(_passes(spark, sf_dir), "page", accumulate.Limits(max_rows=400, max_passes=50)).select("page", "total", "stop")


@query("page_signatures", "SELECT o_custkey, concat('u', CAST(o_custkey AS VARCHAR), '::') AS head, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(string_agg(CAST(o_orderkey AS VARCHAR), '~' ORDER BY o_orderkey), ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, k: (h * 31 + k) % 4294967296) AS BIGINT) AS hash FROM orders GROUP BY o_custkey")
def page_signatures(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k.cast("string")).alias("keys"))
    sign = accumulate.page_signature(F.concat(F.lit("u"), F.col("o_custkey").cast("string")), F.col("keys"))
    return rows.select("o_custkey", F.regexp_extract(sign, "^(.*::)[0-9a-z]+$", 1).alias("head"), F.conv(F.substring_index(sign, "::", -1), 36, 10).cast("long").alias("hash"))


@query("rolling_hash", "SELECT n_nationkey, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(string_split(n_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, k: (h * 31 + k) % 4294967296) AS BIGINT) AS h FROM nation")
def rolling_hash(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.conv(accumulate.simple_hash(F.col("n_name")), 36, 10).cast("long").alias("h"))


@query("run_ledger", "SELECT CAST(user_id AS VARCHAR) AS run_id, min(event_id) AS at FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 200")
def run_ledger(spark, sf_dir):
    return accumulate.ledger(table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("at")), 200)


@query("url_page_sequence", "SELECT CAST(range + 1 AS BIGINT) AS page_no, CAST(5 + range * 20 AS BIGINT) AS value FROM range(10)")
def url_page_sequence(spark, sf_dir):
    return accumulate.url_pages(spark, 5, 20, 10)


@query("stream_accumulate", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def stream(spark, sf_dir):
    """The same accumulation as a stream over the table's files, run until all input is read."""
    import uuid

    from gleanery.streaming.folders import shared_folder

    root = shared_folder(spark, f"stream-{uuid.uuid4().hex}")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
    accumulate.stream_accumulate(source, ["user_id", "event_type"], f"{root}/sink", f"{root}/checkpoint", "event_id").awaitTermination()
    return spark.read.parquet(f"{root}/sink").select("user_id", "event_type", "event_id")
