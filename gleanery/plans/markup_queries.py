"""Field reads, prices, structured answers, tables and detection on markup made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.plans.base import query, table
from gleanery.sources import detect, fetch, scan
from gleanery.sources.scan import Field


def _pages(spark, sf_dir, name: str, key: str, html: str):
    """One page for each row; `html` is SQL."""
    rows = table(spark, sf_dir, name)
    return rows.select(F.col(key).alias("page_id"), F.lit("https://shop.example/list/").alias("url"), F.expr(html).alias("html"))


_ITEM = """concat('<main><div class=item data-id="', cast(p_partkey as string), '"><a href="../p/', cast(p_partkey as string), '"><img ',
 case p_partkey % 5 when 0 then concat('src="/i', cast(p_partkey as string), '.jpg"') when 1 then concat('src="/img/blank.gif" data-src="/lazy', cast(p_partkey as string), '.jpg"')
 when 2 then concat('src="/s.jpg" srcset="/s1.jpg 100w, /w', cast(p_partkey as string), '.jpg 900w"') when 3 then 'src="/placeholder.png"' else 'src=""' end,
 ' alt="', p_name, '"></a><b>', p_name, ' &amp; co</b></div></main>')"""


@query("image_reads", """SELECT p_partkey AS page_id, CASE p_partkey % 5 WHEN 0 THEN concat('https://shop.example/i', CAST(p_partkey AS VARCHAR), '.jpg') WHEN 1 THEN concat('https://shop.example/lazy', CAST(p_partkey AS VARCHAR), '.jpg')
 WHEN 2 THEN concat('https://shop.example/w', CAST(p_partkey AS VARCHAR), '.jpg') ELSE '' END AS image FROM part""")
def image_reads(spark, sf_dir):
    return scan.scan(_pages(spark, sf_dir, "part", "p_partkey", _ITEM), "div.item", [Field("image", "img", "src"), Field("name", "b")]).select("page_id", "image")


@query("field_reads", """SELECT p_partkey AS page_id, p_name AS alt, CAST(p_partkey AS VARCHAR) AS id, concat(p_name, ' &amp; co') AS html, concat('https://shop.example/p/', CAST(p_partkey AS VARCHAR)) AS link, concat(p_name, ' & co') AS name FROM part""")
def field_reads(spark, sf_dir):
    wanted = [Field("alt", "img", "alt"), Field("id", None, "attr", "data-id"), Field("html", "b", "html"), Field("link", "img", "href"), Field("name", "b")]
    return scan.scan(_pages(spark, sf_dir, "part", "p_partkey", _ITEM), "div.item", wanted).drop("row_no")


_PICTURES = """concat('<ul><li class=card><img class="icon" src="/icon.png" width=100 height=100>', case when p_partkey % 3 = 0 then concat('<img src="/big', cast(p_partkey as string), '.jpg" width=400 height=300>') else '' end,
 '<img src="/small', cast(p_partkey as string), '.jpg" width=120 height=90><b>', p_name, '</b></li></ul>')"""


@query("best_images", "SELECT p_partkey AS page_id, concat('https://shop.example/', CASE WHEN p_partkey % 3 = 0 THEN 'big' ELSE 'small' END, CAST(p_partkey AS VARCHAR), '.jpg') AS image FROM part")
def best_images(spark, sf_dir):
    """The named element holds no picture, so the likeliest of its container is read."""
    return scan.scan(_pages(spark, sf_dir, "part", "p_partkey", _PICTURES), "li.card", [Field("image", "b", "src")]).select("page_id", "image")


_HOST = """concat('<x-card><template shadowrootmode=open><x-name><template shadowrootmode="open"><b>', p_name, '</b></template></x-name></template><b>light</b></x-card>',
 '<x-card><template shadowrootmode=closed><x-name><b>hidden</b></x-name></template></x-card>')"""


@query("shadow_hops", "SELECT p_partkey AS page_id, 1 AS row_no, p_name AS name FROM part")
def shadow_hops(spark, sf_dir):
    return scan.scan(_pages(spark, sf_dir, "part", "p_partkey", _HOST), "x-card", [Field("name", (":scope", "x-name", "b"))])


_PRICES = """concat('<ul><li><s>$', cast(p_partkey % 90 + 110 as string), '.00</s><b>$', cast(p_partkey % 90 + 10 as string), '.00</b><li><b>', case when p_partkey % 2 = 0 then 'soon' else '$7.50' end,
 '</b><em>$', cast(p_partkey % 40 + 10 as string), '.25</em><li><b>sold out</b></ul>')"""


@query("price_roles", """SELECT p_partkey AS page_id, unnest([concat('$', CAST(p_partkey % 90 + 10 AS VARCHAR), '.00'), CASE WHEN p_partkey % 2 = 0 THEN concat('$', CAST(p_partkey % 40 + 10 AS VARCHAR), '.25') ELSE '$7.50' END, 'sold out']) AS price,
 unnest([concat('$', CAST(p_partkey % 90 + 110 AS VARCHAR), '.00'), '', '']) AS old FROM part""")
def price_roles(spark, sf_dir):
    """The first row shows which price is current and which struck through; later rows keep to that."""
    return scan.scan(_pages(spark, sf_dir, "part", "p_partkey", _PRICES), "li", [Field("price", "b"), Field("old", "s")]).select("page_id", "price", "old")


_FAQ = """concat('<script type="application/ld+json">{"@type":"FAQPage","mainEntity":[{"@type":"Question","name":"What is ', p_name, '?","acceptedAnswer":{"text":"', p_brand, '"}},{"name":"No answer"},{"other":1}]}</script>')"""


@query("faq_answers", "SELECT p_partkey AS page_id, concat('What is ', p_name, '?: ', p_brand, ' | No answer') AS faq FROM part")
def faq_answers(spark, sf_dir):
    return scan.scan_details(_pages(spark, sf_dir, "part", "p_partkey", _FAQ), [Field("faq", attribute="structured", path="derived.faq.0")]).select("page_id", "faq")


_TABLE = """concat('<table><thead><tr><th>Name<th>Size<th>Size</thead><tbody><tr><td>', p_name, '<td colspan=2>', cast(p_size as string), '<tr><td>', p_brand, '<td colspan=2>x</tbody><tr class=sum><td>one</table><table><tr><td>a<tr><th>b</table>')"""


@query("table_spans", """SELECT p_partkey AS page_id, unnest([1, 1, 1, 2, 2, 2]) AS row_no, unnest(['Name', 'Size', 'Size 2', 'Name', 'Size', 'Size 2']) AS name, unnest([p_name, CAST(p_size AS VARCHAR), CAST(p_size AS VARCHAR), p_brand, 'x', 'x']) AS value FROM part""")
def table_spans(spark, sf_dir):
    """Spans repeat their cell, repeated headers are numbered, and rows alike only to themselves are no group."""
    return scan.scan_tables(_pages(spark, sf_dir, "part", "p_partkey", _TABLE)).select("page_id", "row_no", "name", "value")


# --- detection on pages whose structures are known

_GRID = """concat('<body><nav class=menu><a href="/a">A</a><a href="/b">B</a></nav><main><ul class=grid>', array_join(transform(sequence(1, 4 + c_custkey % 9), i ->
 concat('<li class="card css-1a2b3c"><a href="/p/', cast(i as string), '"><img src="/i/', cast(i as string), '.jpg" alt=x></a><h3>Product number ', cast(i as string), ' of the list</h3><span class=price>$', cast(i + 10 as string), '.50</span></li>')), ''), '</ul></main></body>')"""


def _grids(spark, sf_dir):
    """The keys are dealt out before the pages are made, for a small file of keys makes many pages, and each takes a Python task a while."""
    rows = table(spark, sf_dir, "customer").select("c_custkey")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return rows.repartition(parts, "c_custkey").select(F.col("c_custkey").alias("page_id"), F.lit("https://shop.example/list/").alias("url"), F.expr(_GRID).alias("html"))


@query("detect_cards", """SELECT c_custkey AS page_id, 1 AS rank, 'List Items' AS label, CAST(4 + c_custkey % 9 AS INTEGER) AS item_count, 'li.card' AS selector, 'High' AS confidence, 'Title,Price,Link,Image' AS fields FROM customer""")
def detect_cards(spark, sf_dir):
    """The best structure of a page with one list of products, its selector and its fields."""
    found = detect.structures(_grids(spark, sf_dir)).filter("rank = 1")
    return found.select("page_id", "rank", "label", "item_count", "selector", "confidence", F.array_join("fields", ",").alias("fields"))


@query("detect_viable", "SELECT c_custkey AS page_id, 'li.card' AS selector FROM customer")
def detect_viable(spark, sf_dir):
    """Of all structures, those worth offering: the product list, not the menu."""
    return detect.viable(detect.structures(_grids(spark, sf_dir))).select("page_id", "selector")


@query("detect_report", "SELECT c_custkey AS page_id, unnest(['li.card', 'a']) AS tag, unnest(['kept', 'score below 20']) AS fate FROM customer")
def detect_report(spark, sf_dir):
    """Every candidate with its fate."""
    found = detect.report(_grids(spark, sf_dir))
    return found.select("page_id", F.regexp_extract("selector", r"[^ ]+$", 0).alias("tag"), "fate")


_SIGNALS = [
    # item_count, avg_text, links, images, prices, titles, diversity, consistency, nav, main
    (12, 60.0, 1.0, 1.0, 1.0, 1.0, 1.0, 0.9, "none", True), (3, 5.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.5, "semantic", False), (5, 2.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.2, "none", False),
    (6, 30.0, 0.1, 0.1, 0.0, 0.5, 0.2, 0.8, "keyword", True), (40, 120.0, 0.5, 0.0, 0.2, 1.0, 0.7, 0.4, "none", False),
]


@query("detect_scores", "SELECT * FROM (VALUES (12, 100), (3, 9), (5, 2), (6, 0), (40, 63)) AS t(item_count, score)")
def detect_scores(spark, sf_dir):
    """Scores worked out by hand from their signals."""
    return spark.createDataFrame(_SIGNALS, detect.SIGNALS).select("item_count", detect.score().alias("score"))


_CONTROLS = """case c_custkey % 6 when 0 then '<a rel="nofollow next" href="?p=2">2</a><button>Load more</button>' when 1 then '<button aria-label="Go to next page">x</button>' when 2 then '<a href="/x">Next</a><a href="/y">Back</a>'
 when 3 then '<div><button class=more>Load more</button></div>' when 4 then '<a style="display: none" rel=next href="/h">h</a><b>Next</b>' else '<p>none</p>' end"""


@query("detect_controls", """SELECT c_custkey AS page_id, CASE WHEN c_custkey % 6 < 3 THEN 'pagination' WHEN c_custkey % 6 = 3 THEN 'load-more' END AS detected,
 CASE c_custkey % 6 WHEN 0 THEN 'a' WHEN 1 THEN 'button' WHEN 2 THEN 'a' WHEN 3 THEN 'button.more' END AS selector FROM customer""")
def detect_controls(spark, sf_dir):
    """A rel link before a label, a label before a text, next before more, and nothing hidden."""
    return detect.pagination(_pages(spark, sf_dir, "customer", "c_custkey", _CONTROLS)).select("page_id", "detected", "selector")


@query("selector_scores", "SELECT * FROM (VALUES (':scope', 100, 'Good'), ('div > span', 60, 'Fair'), ('#list > li.card', 95, 'Good'), ('li:nth-of-type(2)', 45, 'Fair'), ('div:nth-of-type(2) > div:nth-of-type(3) > span', 30, 'Fragile'), ('div.css-1x2y', 40, 'Fair'), ('a[rel=\"next\"]', 70, 'Good')) AS t(selector, score, quality)")
def selector_scores(spark, sf_dir):
    asked = (":scope", "div > span", "#list > li.card", "li:nth-of-type(2)", "div:nth-of-type(2) > div:nth-of-type(3) > span", "div.css-1x2y", 'a[rel="next"]')
    return spark.createDataFrame([(s, *detect.selector_quality(s)) for s in asked], "selector string, score int, quality string")


@query("selector_migration", "SELECT * FROM (VALUES ('li:nth-of-type(1)', 'li.card'), ('li.card', 'li.card'), ('section', 'section')) AS t(stored, container)")
def selector_migration(spark, sf_dir):
    page = "<ul>" + "<li class=card><b>x</b></li>" * 5 + "</ul>"
    return spark.createDataFrame([(s, detect.migrated_container(page, s)) for s in ("li:nth-of-type(1)", "li.card", "section")], "stored string, container string")


@query("template_choice", """SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'ecommerce' WHEN 1 THEN 'article' WHEN 2 THEN 'table' WHEN 3 THEN 'realestate' ELSE 'list' END AS template FROM customer""")
def template_choice(spark, sf_dir):
    kinds = F.expr("case c_custkey % 5 when 0 then array('Product') when 1 then array('NewsArticle') else cast(array() as array<string>) end")
    labels = F.expr("if(c_custkey % 5 = 2, array('Table Rows'), array('Cards'))")
    names = F.expr("if(c_custkey % 5 = 3, array('3 bedrooms', 'Title'), array('Title'))")
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(detect.template_suggestions(kinds, labels, names), ",").alias("template"))


@query("template_hints", "SELECT * FROM (VALUES ('Product Name', 'jsonLd.0.name'), ('Price', 'span.price'), ('Image', 'img')) AS t(field, source)")
def template_hints(spark, sf_dir):
    hints = [("Product Name", ["Product name"], ["Title"]), ("Price", ["Product offers.price"], ["Price"]), ("Original Price", ["Product offers.price"], ["Price"]), ("Image", [], ["Image"])]
    return spark.createDataFrame(sorted(detect.match_hints(hints, {"Product name": "jsonLd.0.name"}, {"Title": "h3", "Price": "span.price", "Image": "img"}).items()), "field string, source string")


@query("default_fields", "SELECT p_partkey, p_partkey % 3 AS coverage3 FROM part WHERE p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AND NOT (p_partkey % 5 = 0 AND p_partkey % 7 >= 3)")
def default_fields(spark, sf_dir):
    made = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_partkey % 3 as coverage3", "if(p_partkey % 4 = 0, 'Fragile', 'Good') as quality", "p_partkey % 3 / 2.0 as coverage", "if(p_partkey % 5 = 0, 0.1, 0.9) as uniqueness", "p_partkey % 7 as samples")
    return detect.chosen_fields(made).select("p_partkey", "coverage3")


@query("built_in_templates", "SELECT * FROM (VALUES ('article', 6), ('directory', 7), ('ecommerce', 11), ('jobs', 7), ('list', 0), ('realestate', 9), ('search', 4), ('table', 0)) AS t(id, fields)")
def built_in_templates(spark, sf_dir):
    return spark.createDataFrame([(k, len(v)) for k, v in sorted(detect.TEMPLATES.items())], "id string, fields int")


# --- fetching, with answers by rule instead of a network


def _answer(url: str):
    n = int(url.rsplit("/", 1)[1])
    if n % 5 == 4:
        raise OSError("connection reset")
    code = (200, 404, 503, 200)[n % 5]
    return code, "image/jpeg" if n % 2 else "text/html", b"body %d" % n


@query("fetch_outcomes", """SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 3) AND c_custkey % 2 = 0 THEN 'completed' ELSE 'failed' END AS status,
 CASE WHEN c_custkey % 5 = 4 THEN NULL ELSE CAST([200, 404, 503, 200][c_custkey % 5 + 1] AS INTEGER) END AS http_status, CAST(CASE WHEN c_custkey % 5 IN (2, 4) THEN 2 ELSE 1 END AS INTEGER) AS attempts,
 CASE c_custkey % 5 WHEN 1 THEN 'HTTP 404' WHEN 2 THEN 'HTTP 503' WHEN 4 THEN 'network error: OSError' ELSE CASE WHEN c_custkey % 2 = 1 THEN 'unexpected content (image/jpeg)' END END AS reason,
 CASE WHEN c_custkey % 5 IN (0, 3) AND c_custkey % 2 = 0 THEN concat('body ', CAST(c_custkey AS VARCHAR)) END AS body FROM customer""")
def fetch_outcomes(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://x.example/"), F.col("c_custkey").cast("string")).alias("url"))
    found = fetch.fetch(asked, _answer, attempts=2, pause=0, accepts="text/html")
    return found.select(F.substring_index("url", "/", -1).cast("long").alias("c_custkey"), "status", "http_status", "attempts", "reason", F.col("body").cast("string").alias("body"))


@query("image_keys", "SELECT p_partkey, concat('/i', CAST(p_partkey AS VARCHAR), '.jpg') AS loose, concat('/i', CAST(p_partkey AS VARCHAR), '.jpg?w=', CAST(p_size AS VARCHAR)) AS exact FROM part")
def image_keys(spark, sf_dir):
    shown = F.concat(F.lit("/i"), F.col("p_partkey").cast("string"), F.lit(".jpg?w="), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", urls.image_key(shown, "ignore-query").alias("loose"), urls.image_key(shown).alias("exact"))


_FOLDER = "concat(' a:b /', p_name, '/../', p_brand, '//c.')"


@query("safe_folder_names", "SELECT p_partkey, concat('ab/', p_name, '/', p_brand, '/c') AS folder FROM part")
def safe_folders(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", urls.safe_folder_name(F.expr(_FOLDER)).alias("folder"))


