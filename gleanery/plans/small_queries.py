"""Image addresses, price shapes, messages and translations."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.operators import jobs, quality, relational, translate
from gleanery.plans.base import query, table

_SET = "CASE p_partkey % 4 WHEN 0 THEN concat('/a', CAST(p_partkey AS VARCHAR), '.jpg 100w, /b.jpg ', CAST(p_partkey % 700 AS VARCHAR), 'w') WHEN 1 THEN '/c.jpg 1x, /d.jpg 2.5x,' WHEN 2 THEN concat(' /e', CAST(p_partkey AS VARCHAR), '.jpg , /f.jpg') ELSE '' END"


@query("srcset_best", f"SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN CASE WHEN p_partkey % 700 > 100 THEN '/b.jpg' ELSE concat('/a', CAST(p_partkey AS VARCHAR), '.jpg') END WHEN 1 THEN '/d.jpg' WHEN 2 THEN concat('/e', CAST(p_partkey AS VARCHAR), '.jpg') ELSE '' END AS best FROM part")
def srcset(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.best_of_srcset(F.expr(_SET.replace("VARCHAR", "STRING"))).alias("best"))


_IMAGE = "CASE p_partkey % 5 WHEN 0 THEN '/img/blank.gif' WHEN 1 THEN 'data:image/png;base64,AAAA' WHEN 2 THEN '/blanket.jpg' WHEN 3 THEN '' ELSE '/no-photo/x.png' END"


@query("placeholder_images", "SELECT p_partkey, p_partkey % 5 <> 2 AS placeholder FROM part")
def placeholders(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.placeholder(F.expr(_IMAGE)).alias("placeholder"))


_TEXT = "CASE p_partkey % 5 WHEN 0 THEN concat('$', CAST(p_partkey % 90 + 10 AS VARCHAR), '.00') WHEN 1 THEN concat(p_name, ' (2020)') WHEN 2 THEN concat('(', CAST(p_partkey % 9000 + 3000 AS VARCHAR), ') ', p_name) WHEN 3 THEN '( 12 )' ELSE concat(CAST(p_partkey % 90 + 10 AS VARCHAR), ' TL ', p_name) END"


@query("text_shapes", "SELECT p_partkey, p_partkey % 5 IN (0, 4) AS price, p_partkey % 5 IN (2, 3, 4) AS contaminated FROM part")
def text_shapes(spark, sf_dir):
    v = F.expr(_TEXT.replace("VARCHAR", "STRING"))
    return table(spark, sf_dir, "part").select("p_partkey", quality.looks_like_price(v).alias("price"), quality.contaminated(v).alias("contaminated"))


@query("newest_runs", "SELECT event_id, user_id FROM events ORDER BY event_id DESC LIMIT 50")
def newest(spark, sf_dir):
    return relational.newest_first(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id").limit(50)


@query("monitor_notifications", "SELECT CAST(user_id AS VARCHAR) AS name, user_id % 9 = 0 AS is_error, CASE WHEN user_id % 9 = 0 THEN 'run failed' ELSE concat(CAST(n AS VARCHAR), ' new') END AS message FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY 1) WHERE user_id % 7 <> 0 AND (user_id % 9 = 0 OR n > 0)")
def notifications(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("new_count"))
    return jobs.notifications(runs.select(F.col("user_id").cast("string").alias("name"), (F.col("user_id") % 7 != 0).alias("notify"), F.when(F.col("user_id") % 9 == 0, "error").otherwise("success").alias("status"), "new_count", F.lit(0).alias("removed_count"), F.lit(0).alias("changed_count"), F.lit(None).cast("string").alias("error")))


_TEXTS = "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'en' ELSE 'de' END AS lang, concat('k', CAST(n_nationkey // 2 AS VARCHAR)) AS key, concat(n_name, ' {x}') AS text FROM nation"


def _texts(spark, sf_dir):
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql(_TEXTS.replace("//", "div").replace("VARCHAR", "STRING"))


@query("translate_messages", f"WITH t AS ({_TEXTS}) SELECT c_custkey, coalesce(replace(coalesce(o.text, b.text), '{{x}}', c_name), m.key) AS shown FROM (SELECT c_custkey, c_name, CASE WHEN c_custkey % 2 = 0 THEN 'de' ELSE 'en' END AS lang, concat('k', CAST(c_custkey % 15 AS VARCHAR)) AS key FROM customer) m LEFT JOIN t o ON o.lang = m.lang AND o.key = m.key LEFT JOIN t b ON b.lang = 'en' AND b.key = m.key")
def messages(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "de").otherwise("en").alias("lang"), F.concat(F.lit("k"), (F.col("c_custkey") % 15).cast("string")).alias("key"), F.lit(None).cast("int").alias("count"), F.create_map(F.lit("x"), "c_name").alias("params"))
    return translate.translate(asked, _texts(spark, sf_dir)).select("c_custkey", "shown")


@query("translation_coverage", f"WITH t AS ({_TEXTS}), k AS (SELECT DISTINCT key FROM t WHERE lang = 'en') SELECT lang, (SELECT count(*) FROM k) AS total, count(DISTINCT key) AS translated, floor(count(DISTINCT key) * 1000.0 / (SELECT count(*) FROM k) + 0.5) / 10 AS percent FROM t WHERE key IN (SELECT key FROM k) GROUP BY lang")
def coverage(spark, sf_dir):
    return translate.coverage(_texts(spark, sf_dir))
