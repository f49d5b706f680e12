"""Filters, duplicates, sorting, diffs, quality and profiles over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions.numeric import normalize_number, price_change, to_double
from gleanery.functions.text import let
from gleanery.operators import diff, quality, relational, snapshots
from gleanery.operators.pipeline import POS, TransformStep, apply_transforms, preset, preview
from gleanery.plans.base import query, table
from gleanery.plans.samples import NOTATION_DUCK, NOTATION_SPARK, PRICE_DUCK, number_sql, price

_FILTERS = {
    "contains": ("p_name", "RED", "contains(lower(coalesce({c}, '')), 'red')"),
    "not-contains": ("p_name", "a", "NOT contains(lower(coalesce({c}, '')), 'a')"),
    "equals": ("p_brand", "brand#12", "lower(coalesce({c}, '')) = 'brand#12'"),
    "not-equals": ("p_brand", "brand#12", "lower(coalesce({c}, '')) <> 'brand#12'"),
    "empty": ("price", "", "coalesce({c}, '') = ''"),
    "not-empty": ("price", "", "coalesce({c}, '') <> ''"),
}
_PARTS = f"SELECT *, {PRICE_DUCK} AS price FROM part"

for _kind, (_column, _value, _where) in _FILTERS.items():

    @query(f"filter_{_kind.replace('-', '_')}", f"SELECT p_partkey, p_name, p_brand, price FROM ({_PARTS}) WHERE {_where.format(c=_column)}")
    def _filter(spark, sf_dir, kind=_kind, column=_column, value=_value):
        return relational.apply_filter(price(table(spark, sf_dir, "part")), column, kind, value).select("p_partkey", "p_name", "p_brand", "price")


for _kind, _op in (("gt", ">"), ("lt", "<")):

    @query(f"filter_{_kind}", f"WITH src AS ({_PARTS}), {number_sql('src', 'price', 'p_partkey, price')} SELECT p_partkey, price FROM numbers WHERE num {_op} 40500.5")
    def _compare(spark, sf_dir, kind=_kind):
        return relational.apply_filter(price(table(spark, sf_dir, "part")), "price", kind, "$40,500.50").select("p_partkey", "price")


@query("parse_numeric", f"WITH src AS (SELECT l_orderkey, l_linenumber, {NOTATION_DUCK} AS v FROM lineitem), {number_sql('src', 'v', 'l_orderkey, l_linenumber, v')} SELECT l_orderkey, l_linenumber, v, str, num, coalesce(neg, false) AS neg FROM numbers")
def parse_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(NOTATION_SPARK).alias("v"))
    read = let(normalize_number("v"), lambda n: F.struct(n["str"].alias("str"), to_double(n).alias("num")))
    return rows.withColumn("n", read).select("l_orderkey", "l_linenumber", "v", "n.str", "n.num", (F.col("v").startswith("-") | F.col("v").startswith("(")).alias("neg"))


@query("dedupe_column", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1")
def dedupe_column(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn(POS, F.col("event_id"))
    return relational.remove_duplicates(rows, ["user_id"], "user_id").select("user_id", "event_id")


@query("dedupe_entire_row", "SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def dedupe_entire_row(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user"), "event_type", "user_id", "event_id", F.col("event_id").alias(POS))
    return relational.remove_duplicates(rows, ["user", "event_type"]).select("user_id", "event_type", "event_id")


@query("dedupe_stats", "SELECT count(*) AS total_rows, count(DISTINCT (user_id, event_type)) AS distinct_keys, count(*) - count(DISTINCT (user_id, event_type)) AS duplicate_rows FROM events")
def dedupe_stats(spark, sf_dir):
    return relational.duplicate_count(table(spark, sf_dir, "events").withColumn("user", F.col("user_id").cast("string")), ["user", "event_type"])


@query("sort_numeric_topk", f"WITH src AS ({_PARTS}), {number_sql('src', 'price', 'p_partkey, price')} SELECT p_partkey, price, row_number() OVER (ORDER BY num DESC NULLS LAST, p_partkey) AS rank FROM numbers QUALIFY rank <= 100")
def sort_numeric(spark, sf_dir):
    rows = price(table(spark, sf_dir, "part")).select("p_partkey", "price", F.col("p_partkey").alias(POS))
    top = relational.apply_sort(rows, "price", descending=True).limit(100)
    from pyspark.sql import Window

    return top.withColumn("rank", F.row_number().over(Window.orderBy(*relational.sort_keys("price", True, True))).cast("long")).drop(POS)


@query("sort_text_topk", "SELECT p_partkey, concat(p_brand, ' ', CAST(p_size AS VARCHAR)) AS label, row_number() OVER (ORDER BY CAST(split_part(p_brand, '#', 2) AS INTEGER), p_size, p_partkey) AS rank FROM part QUALIFY rank <= 200")
def sort_text(spark, sf_dir):
    """Natural order: digits by value, letters without case."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.expr("if(p_partkey % 2 = 0, p_brand, upper(p_brand))"), F.lit(" "), F.col("p_size").cast("string")).alias("label"), F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("shown"), F.col("p_partkey").cast("long").alias(POS))
    from pyspark.sql import Window

    top = relational.apply_sort(rows, "label", numeric=False).limit(200)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*relational.sort_keys("label", False, False))).cast("long")).select("p_partkey", F.col("shown").alias("label"), "rank")


@query("numeric_column_share", f"WITH src AS ({_PARTS}), {number_sql('src', 'price', 'p_partkey, price')} SELECT avg(CASE WHEN coalesce(price, '') <> '' THEN CASE WHEN num IS NOT NULL THEN 1.0 ELSE 0.0 END END) AS share FROM numbers")
def numeric_share(spark, sf_dir):
    return price(table(spark, sf_dir, "part")).agg(relational.numeric_share("price").alias("share"))


@query("append_intersect_except", "SELECT c_custkey, 'kept' AS side FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'missing' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def set_operations(spark, sf_dir):
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return relational.append([relational.keyed_intersect(customers, orders, "c_custkey").withColumn("side", F.lit("kept")), relational.keyed_except(customers, orders, "c_custkey").withColumn("side", F.lit("missing"))])


@query("pipeline_clean_price", f"""WITH src AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(price, '[$€£₺¥₹]', '', 'g'), '(?i)\\b(USD|EUR|GBP|TRY|JPY|INR)\\b', '', 'g'), '^\\s+|\\s+$', '', 'g') AS bare FROM ({_PARTS})),
{number_sql('src', 'bare', 'p_partkey, p_name, bare, price')},
kept AS (SELECT p_partkey, p_name, coalesce(str, bare) AS price, num FROM numbers WHERE num > 100 QUALIFY row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) = 1)
SELECT p_partkey, p_name, price, row_number() OVER (ORDER BY num, p_partkey) AS rank FROM kept QUALIFY rank <= 500""")
def clean_price(spark, sf_dir):
    """Preset, filter, duplicates, numeric sort and limit: the pipeline end to end."""
    from pyspark.sql import Window

    rows = price(table(spark, sf_dir, "part")).select(F.col("p_partkey").alias(POS), "p_partkey", "p_name", "price")
    rows = apply_transforms(rows, preset("normalizePrice", "price"))
    rows = relational.apply_filter(rows, "price", "gt", "100")
    rows = relational.remove_duplicates(rows, ["p_name"], "p_name")
    top = relational.apply_sort(rows, "price", numeric=True).limit(500)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*relational.sort_keys("price", False, True))).cast("long")).select("p_partkey", "p_name", "price", "rank")


@query("preview_step", "SELECT n_name AS before, upper(n_name) AS after FROM nation ORDER BY n_nationkey LIMIT 5")
def preview_step(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_name", F.col("n_nationkey").alias(POS))
    return preview(rows, [TransformStep("trim", "n_name")], TransformStep("changeCase", "n_name", {"mode": "upper"}))


# --- snapshots: the same orders a day later, some gone, some new, some cheaper

_BEFORE = "SELECT o_orderkey, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS link, concat('$', CAST(o_orderkey * 7 % 5000 + 100 AS VARCHAR), '.00') AS price, o_orderstatus AS status FROM orders WHERE o_orderkey % 10 <> 0"
_AFTER = "SELECT o_orderkey, o_orderkey AS pos, CAST(o_orderkey AS VARCHAR) AS link, CASE WHEN o_orderkey % 5 = 0 THEN concat('$', CAST(o_orderkey * 7 % 5000 + 90 AS VARCHAR)) WHEN o_orderkey % 9 = 0 THEN concat('$', CAST(o_orderkey * 7 % 5000 + 100 AS VARCHAR)) ELSE concat('$', CAST(o_orderkey * 7 % 5000 + 100 AS VARCHAR), '.00') END AS price, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE o_orderstatus END AS status FROM orders WHERE o_orderkey % 7 <> 0"
_JOINED = f"b AS ({_BEFORE}), a AS ({_AFTER}), j AS (SELECT a.o_orderkey AS ak, b.o_orderkey AS bk, a.link AS alink, b.link AS blink, a.price AS ap, b.price AS bp, a.status AS ast, b.status AS bst, CAST(replace(a.price, '$', '') AS DOUBLE) AS an, CAST(replace(b.price, '$', '') AS DOUBLE) AS bn FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey)"
_KIND = "CASE WHEN ak IS NULL THEN 'removed' WHEN bk IS NULL THEN 'new' WHEN ap <> bp OR ast <> bst THEN 'changed' ELSE 'unchanged' END"
_FIELDS = "SELECT alink AS link, 'price' AS field, bp AS old_value, ap AS new_value, an - bn AS delta FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND ap <> bp UNION ALL SELECT alink, 'status', bst, ast, 0.0 FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND ast <> bst"


def _compared(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # DuckDB's spelling of a text cast serves Spark too
    orders.createOrReplaceTempView("orders")
    before, after = (spark.sql(s.replace("VARCHAR", "STRING")).withColumnRenamed("pos", POS).select(POS, "link", "price", "status") for s in (_BEFORE, _AFTER))
    return diff.compare(before, after, {"link": "href", "price": "text", "status": "text"}, "link", ["price"])


@query("snapshot_diff", f"WITH {_JOINED} SELECT coalesce(alink, blink) AS link, {_KIND} AS change_type FROM j")
def snapshot_diff(spark, sf_dir):
    return _compared(spark, sf_dir).rows.select(F.col("row.link").alias("link"), "change_type")


@query("diff_stats", f"WITH {_JOINED}, k AS (SELECT {_KIND} AS kind FROM j), f AS ({_FIELDS}) SELECT count(*) FILTER (kind = 'new') AS new_count, count(*) FILTER (kind = 'removed') AS removed_count, count(*) FILTER (kind = 'changed') AS changed_count, count(*) FILTER (kind = 'unchanged') AS unchanged_count, count(*) FILTER (kind <> 'removed') AS current_count, (SELECT count(*) FROM f WHERE delta < 0) AS price_decreased, (SELECT count(*) FROM f WHERE delta > 0) AS price_increased FROM k")
def diff_stats(spark, sf_dir):
    return _compared(spark, sf_dir).stats()


@query("change_export", f"WITH {_JOINED}, f AS ({_FIELDS}) SELECT upper({_KIND}) AS change_type, '' AS field, '' AS old_value, '' AS new_value, coalesce(alink, blink) AS link FROM j WHERE ak IS NULL OR bk IS NULL UNION ALL SELECT CASE WHEN delta < 0 THEN 'PRICE DROPPED' WHEN delta > 0 THEN 'PRICE INCREASED' ELSE 'CHANGED' END, field, old_value, new_value, link FROM f")
def change_export(spark, sf_dir):
    return diff.change_rows(_compared(spark, sf_dir), "link")


@query("price_changes", f"WITH {_JOINED} SELECT bp AS old_price, ap AS new_price, an - bn AS difference, concat(CASE WHEN floor((an - bn) / bn * 10000 + 0.5) % 100 = 0 THEN CAST(CAST(floor((an - bn) / bn * 10000 + 0.5) / 100 AS BIGINT) AS VARCHAR) ELSE CAST(floor((an - bn) / bn * 10000 + 0.5) / 100 AS VARCHAR) END, '%') AS percent, alink AS link FROM j WHERE ak IS NOT NULL AND bk IS NOT NULL AND an <> bn")
def price_changes(spark, sf_dir):
    return diff.price_rows(_compared(spark, sf_dir), None, "link").drop("product")


@query("price_move", "SELECT p_partkey, CAST((p_partkey * 3 % 500) - (p_partkey % 500) AS DOUBLE) AS delta, CASE WHEN p_partkey % 500 = 0 THEN NULL ELSE CAST((p_partkey * 3 % 500) - (p_partkey % 500) AS DOUBLE) / (p_partkey % 500) * 100 END AS percent, CASE WHEN (p_partkey * 3 % 500) < (p_partkey % 500) THEN 'decreased' ELSE 'increased' END AS direction FROM part WHERE p_partkey * 3 % 500 <> p_partkey % 500")
def price_move(spark, sf_dir):
    shown = lambda e: F.concat(F.lit("$"), F.expr(e).cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", price_change(shown("p_partkey % 500"), shown("p_partkey * 3 % 500")).alias("m"))
    return rows.filter("m is not null").select("p_partkey", "m.delta", "m.percent", "m.direction")


@query("snapshot_retention", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 3")
def retention(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.keep_newest(rows, ["o_custkey"], "o_orderdate", 3, "o_orderkey").select("o_custkey", "o_orderkey")


_CARDS = "SELECT user_id, user_id % 7 <> 0 AS enabled, CASE WHEN user_id % 9 = 0 THEN NULL WHEN max_by(event_type, event_id) = 'error' THEN 'error' ELSE 'success' END AS last_status, count(*) FILTER (event_type = 'signup') AS n_new FROM events GROUP BY user_id"


@query("monitor_summary", f"WITH c AS (SELECT *, CASE WHEN last_status IS NULL THEN 'never' WHEN last_status = 'error' THEN 'error' WHEN n_new > 12 THEN 'changed' ELSE 'success' END AS status FROM ({_CARDS})) SELECT count(*) AS active, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'changed') AS changed, count(*) FILTER (status = 'error') AS errors FROM c WHERE enabled")
def monitor_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.count_if(F.col("event_type") == "signup").alias("n_new"))
    last = F.when(F.col("user_id") % 9 == 0, F.lit(None)).when(F.col("t") == "error", "error").otherwise("success")
    cards = e.select((F.col("user_id") % 7 != 0).alias("enabled"), snapshots.status(last, F.when(F.col("n_new") > 12, 1).otherwise(0), F.lit(0), F.lit(0)).alias("status"))
    return snapshots.summary(cards)


# --- quality

_BLANKS_DUCK = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN '' ELSE c_name END AS name, CASE WHEN c_custkey % 50 = 0 THEN left(c_mktsegment, 1) ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 2 = 0 THEN 'x' END AS note FROM customer"


def _blanks(spark, sf_dir):
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return spark.sql(_BLANKS_DUCK.replace("VARCHAR", "STRING"))


def _flag_sql(c: str) -> str:
    return f"CASE WHEN coalesce({c}, '') = '' AND {c}_f / n >= 0.7 THEN '{c} missing' WHEN coalesce({c}, '') <> '' AND {c}_m >= 8 AND length({c}) < 0.15 * {c}_m THEN '{c} unusually short' END"


@query("anomaly_flags", f"""WITH src AS ({_BLANKS_DUCK}), stats AS (SELECT count(*) AS n, {', '.join(f"count(*) FILTER (coalesce({c}, '') <> '') AS {c}_f, list_sort(list(length({c})) FILTER (coalesce({c}, '') <> ''))[(count(*) FILTER (coalesce({c}, '') <> '')) // 2 + 1] AS {c}_m" for c in ('name', 'segment', 'note'))} FROM src)
SELECT c_custkey, nullif(concat_ws(', ', {', '.join(_flag_sql(c) for c in ('name', 'segment', 'note'))}), '') AS anomaly FROM src, stats""")
def anomaly_flags(spark, sf_dir):
    return quality.flag_anomalies(_blanks(spark, sf_dir), ["name", "segment", "note"], "anomaly").select("c_custkey", "anomaly")


@query("column_profile", f"""WITH src AS ({_BLANKS_DUCK}), long AS (SELECT 'name' AS "column", name AS v FROM src UNION ALL SELECT 'segment', segment FROM src UNION ALL SELECT 'note', note FROM src)
SELECT "column", avg(CASE WHEN coalesce(v, '') <> '' THEN 1.0 ELSE 0.0 END) AS coverage, CAST(count(DISTINCT CASE WHEN v <> '' THEN v END) AS DOUBLE) / count(*) FILTER (coalesce(v, '') <> '') AS uniqueness, max(length(coalesce(v, ''))) AS max_length FROM long GROUP BY 1""")
def column_profile(spark, sf_dir):
    return quality.profile(_blanks(spark, sf_dir), ["name", "segment", "note"]).select("column", "coverage", "uniqueness", F.col("max_length").cast("long").alias("max_length"))


_ROWS_DUCK = "SELECT s_suppkey, CASE WHEN s_suppkey % 13 = 0 THEN '' ELSE concat('https://shop.example/p/', CAST(CASE WHEN s_suppkey % 17 = 0 THEN 17 ELSE s_suppkey END AS VARCHAR)) END AS link, CASE WHEN s_suppkey % 13 = 0 THEN NULL ELSE concat('https://img.example/', CAST(s_suppkey AS VARCHAR), '.jpg') END AS img, CASE WHEN s_suppkey % 29 = 0 THEN 'Ad' ELSE concat('Supplier of parts number ', s_name) END AS title, CASE WHEN s_suppkey % 13 = 0 THEN 'free' ELSE concat('$', CAST(s_suppkey % 90 + 10 AS VARCHAR), '.50') END AS price FROM supplier"


@query("classify_rows", f"""WITH src AS ({_ROWS_DUCK}),
s AS (SELECT avg((link <> '')::INT) AS lr, avg((img IS NOT NULL)::INT) AS ir, avg(regexp_matches(price, '[$]\\d[\\d.,]*\\d')::INT) AS pr, median((link <> '')::INT + (img IS NOT NULL)::INT + 2) AS mf, median(length(title)) AS ml, count(DISTINCT nullif(link, '')) * 1.0 / count(nullif(link, '')) AS lu, count(DISTINCT img) * 1.0 / count(img) AS iu FROM src),
w AS (SELECT s_suppkey, CASE WHEN lr >= 0.75 AND link = '' THEN 2 ELSE 0 END + CASE WHEN ir >= 0.75 AND img IS NULL THEN 2 ELSE 0 END + CASE WHEN pr >= 0.75 AND NOT regexp_matches(price, '[$]\\d[\\d.,]*\\d') THEN 2 ELSE 0 END
 + CASE WHEN lu >= 0.85 AND link <> '' AND count(*) OVER (PARTITION BY link) > 1 THEN 2 ELSE 0 END + CASE WHEN iu >= 0.85 AND img IS NOT NULL AND count(*) OVER (PARTITION BY img) > 1 THEN 2 ELSE 0 END
 + CASE WHEN ir >= 0.75 AND pr >= 0.75 AND img IS NULL AND NOT regexp_matches(price, '[$]\\d[\\d.,]*\\d') THEN 1 ELSE 0 END + CASE WHEN mf >= 2 AND (link <> '')::INT + (img IS NOT NULL)::INT + 2 <= 0.5 * mf THEN 1 ELSE 0 END
 + CASE WHEN ml >= 20 AND length(title) > 0 AND length(title) < 0.3 * ml THEN 1 ELSE 0 END AS weight FROM src, s)
SELECT s_suppkey, weight, CASE WHEN weight >= 5 THEN 'exclude' WHEN weight >= 2 THEN 'flag' ELSE 'accept' END AS verdict FROM w""")
def classify_rows(spark, sf_dir):
    table(spark, sf_dir, "supplier").createOrReplaceTempView("supplier")
    rows = spark.sql(_ROWS_DUCK.replace("VARCHAR", "STRING"))
    return quality.classify_rows(rows, {"link": "href", "img": "src", "title": "text", "price": "text"}).select("s_suppkey", "weight", "verdict")


@query("median_and_spread", "SELECT median(l_quantity) AS median, avg(l_quantity) AS mean, stddev_pop(l_quantity) AS deviation FROM lineitem")
def medians(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.agg(F.median("l_quantity").alias("median")).crossJoin(quality.spread(rows, "l_quantity").select("mean", "deviation"))


@query("failure_reasons", "SELECT event_type, count(*) AS count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def failure_reasons(spark, sf_dir):
    return relational.top_counts(table(spark, sf_dir, "events"), "event_type", 3)


