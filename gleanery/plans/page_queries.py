"""Scans of the driver's pages, their addresses and structured data."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import cleaning, urls
from gleanery.operators import assets
from gleanery.operators.pipeline import POS
from gleanery.plans.base import query, table
from gleanery.sources import detect, scan, structured
from gleanery.sources.scan import Field

_UNESCAPE = "replace(replace({}, '&amp;', '&'), '&quot;', '\"')"


@query("page_title_h1", f"SELECT page_id, trim({_UNESCAPE.format(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)']))}) AS title, regexp_replace(trim({_UNESCAPE.format(chr(39).join(['regexp_extract(html, ', '<h1>([^<]*)</h1>', ', 1)']))}), '\\s+', ' ', 'g') AS h1 FROM pages")
def title_h1(spark, sf_dir):
    rows = scan.scan(table(spark, sf_dir, "pages"), None, [Field("title", attribute="structured", path="meta.title"), Field("h1", "article > h1")])
    return rows.select("page_id", "title", "h1")


_LINKS = "SELECT page_id, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 1)) AS href, unnest(regexp_extract_all(html, '<li><a href=\"([^\"]*)\">([^<]*)</a></li>', 2)) AS label, generate_subscripts(regexp_extract_all(html, '<li><a'), 1) AS n FROM pages"


@query("nav_items", f"SELECT page_id, CAST(n AS INT) AS row_no, CAST(n AS VARCHAR) AS place, label, href FROM ({_LINKS})")
def nav_items(spark, sf_dir):
    rows = scan.scan(table(spark, sf_dir, "pages").withColumn("url", F.lit("")), "nav ul li", [Field("place", attribute="position"), Field("label", "a"), Field("href", "a", "attr", "href")])
    return rows.select("page_id", "row_no", "place", "label", "href")


@query("page_links", f"SELECT page_id, n AS row_no, concat('https://site.example', replace(href, ' ', '%20')) AS link FROM (SELECT page_id, CAST(n AS INT) AS n, href FROM ({_LINKS}))")
def page_links(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").withColumn("url", F.lit("https://site.example/a/b"))
    return scan.scan(pages, "nav ul li", [Field("link", "a", "href")]).select("page_id", "row_no", "link")


@query("page_detail", "SELECT page_id, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, len(regexp_extract_all(html, '<li><a')) AS links FROM pages")
def page_detail(spark, sf_dir):
    rows = scan.scan_details(table(spark, sf_dir, "pages"), [Field("lang", None, "structured", path="meta.author"), Field("links", "nav li a", multiple=True)])
    lang = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"))
    return rows.select("page_id", F.size(F.split("links", "; ")).cast("long").alias("links")).join(lang, "page_id")


_EMPTY = ", ".join(f"'' AS {m.replace('.', '_')}" for m in structured.META[1:])


@query("page_meta", f"SELECT page_id, url, trim({_UNESCAPE.format(chr(39).join(['regexp_extract(html, ', '<title>([^<]*)</title>', ', 1)']))}) AS title, {_EMPTY} FROM pages")
def page_meta(spark, sf_dir):
    return structured.scan_meta(table(spark, sf_dir, "pages"))


# --- addresses

@query("extract_domain_parts", r"SELECT page_id, regexp_replace(regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ':\d+$', ''), '^www\.', '') AS domain, regexp_replace(lower(regexp_extract(url, '^https?://([^/?#]+)', 1)), ':\d+$', '') AS hostname, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) AS origin, CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS path, regexp_extract(url, '\?([^#]*)', 1) AS query FROM pages")
def domain_parts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", *(cleaning.apply("extractDomain", "url", {"part": p}).alias(p) for p in ("domain", "hostname", "origin", "path", "query")))


@query("remove_tracking", r"""SELECT page_id, CASE WHEN regexp_extract(url, '\?([^#]*)', 1) = '' THEN head || tail ELSE head || CASE WHEN q = '' THEN '' ELSE '?' || q END || tail END AS out
FROM (SELECT page_id, url, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END AS head, regexp_extract(url, '(#.*)$', 1) AS tail,
 array_to_string(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: NOT regexp_matches(p, '^(utm_(source|medium|campaign|term|content)|gclid|fbclid|msclkid)=')), '&') AS q FROM pages)""")
def remove_tracking(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.apply("removeTrackingParams", "url").alias("out"))


@query("normalize_url", r"SELECT page_id, lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || CASE WHEN regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) END || regexp_extract(url, '(\?[^#]*)', 1) AS out FROM pages")
def normalize_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", cleaning.apply("normalizeUrl", F.concat(F.lit(" "), "url"), {"removeFragment": True}).alias("out"))


_QUEUE = "SELECT page_id, CASE WHEN page_id % 9 = 0 THEN '' WHEN page_id % 14 = 0 THEN 'ftp://x.example/a.pdf' WHEN page_id % 15 = 0 THEN 'no address' ELSE concat('https://cdn.example/', CAST(page_id % 40 AS VARCHAR), CASE page_id % 40 % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PDF?v=2' WHEN 2 THEN '.csv#top' ELSE '/page' END) END AS link FROM pages"


def _queue(spark, sf_dir):
    table(spark, sf_dir, "pages").createOrReplaceTempView("pages")
    return spark.sql(_QUEUE.replace("VARCHAR", "STRING")).withColumn(POS, F.col("page_id"))


@query("validate_url", f"SELECT page_id, link LIKE 'https:%' AS ok, CASE WHEN link = '' THEN 'empty' WHEN link LIKE 'ftp%' THEN 'disallowed-scheme' WHEN link LIKE 'no%' THEN 'invalid-url' END AS reason FROM ({_QUEUE})")
def validate_url(spark, sf_dir):
    return _queue(spark, sf_dir).select("page_id", urls.validate("link").alias("v")).select("page_id", "v.ok", "v.reason")


@query("url_dedup", f"SELECT page_id, link FROM ({_QUEUE}) WHERE link LIKE 'https:%' QUALIFY row_number() OVER (PARTITION BY split_part(link, '#', 1) ORDER BY page_id) = 1")
def url_dedup(spark, sf_dir):
    return assets.collect_urls(_queue(spark, sf_dir), "link").select("page_id", "link")


@query("url_queue_stats", f"SELECT count(*) AS total_rows, count(*) FILTER (link = '') AS empty, count(*) FILTER (link <> '' AND link NOT LIKE 'https:%') AS invalid, count(*) FILTER (link LIKE 'https:%') - count(DISTINCT CASE WHEN link LIKE 'https:%' THEN split_part(link, '#', 1) END) AS duplicates, count(DISTINCT CASE WHEN link LIKE '%/page' THEN link END) AS type_filter_skipped, count(DISTINCT CASE WHEN link LIKE 'https:%' AND link NOT LIKE '%/page' THEN split_part(link, '#', 1) END) AS queued FROM ({_QUEUE})")
def queue_stats(spark, sf_dir):
    return assets.queue_stats(_queue(spark, sf_dir), "link", ["Images", "PDF", "CSV"])


@query("file_type_counts", f"SELECT CASE WHEN link LIKE '%.jpg' THEN 'Images' WHEN link LIKE '%.PDF?v=2' THEN 'PDF' WHEN link LIKE '%.csv%' THEN 'CSV' ELSE 'Other' END AS type_group, count(DISTINCT split_part(link, '#', 1)) AS n FROM ({_QUEUE}) WHERE link LIKE 'https:%' GROUP BY 1")
def type_counts(spark, sf_dir):
    return assets.type_counts(assets.collect_urls(_queue(spark, sf_dir), "link"))


@query("origin_patterns", r"SELECT DISTINCT lower(regexp_extract(url, '^(https?://[^/?#]+)', 1)) || '/*' AS pattern FROM pages")
def origin_patterns(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(urls.origin_pattern("url").alias("pattern")).filter("pattern is not null").distinct()


@query("url_pagination", r"SELECT page_id, regexp_matches(url, '[?&]page=\d+(&|#|$)') AS found, TRY_CAST(regexp_extract(url, '[?&]page=(\d+)(&|#|$)', 1) AS BIGINT) AS start FROM pages")
def url_pagination(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.pagination("url").alias("p")).select("page_id", "p.found", "p.start")


@query("next_page_url", r"SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=') THEN regexp_replace(url, '([?&]page=)[^&#]*', '\1' || CAST(page_id + 1 AS VARCHAR)) WHEN contains(split_part(url, '#', 1), '?') THEN regexp_replace(url, '^([^#]*)', '\1&page=' || CAST(page_id + 1 AS VARCHAR)) ELSE regexp_replace(url, '^([^#]*)', '\1?page=' || CAST(page_id + 1 AS VARCHAR)) END AS next FROM pages")
def next_page(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.next_page("url", "query", "page", F.col("page_id") + 1).alias("next"))


@query("same_origin", r"SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) = 'www.example.com' AS same FROM pages")
def same_origin(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.same_origin("url", F.lit("www.example.com")).alias("same"))


# --- structured data, made from parts

_LD = """concat('{"@context":"https://schema.org","@graph":[{"@type":"Product","name":"', p_name, '","sku":"', cast(p_partkey as string), '","offers":[{"price":', cast(p_partkey % 900 as string), ',"priceCurrency":"EUR"}],"brand":{"name":"', p_brand, '"}},{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"', p_brand, '"},{"position":1,"item":{"name":"Home"}}]},{"@type":"LocalBusiness","address":{"streetAddress":"', cast(p_size as string), ' Road","addressLocality":"Town","postalCode":"', cast(p_partkey % 100 as string), '"}}]}')"""


def _ld_pages(spark, sf_dir):
    html = F.concat(F.lit("<html><head><script type='application/ld+json'>{broken</script><script type=\"application/ld+json\">"), F.expr(_LD), F.lit("</script></head><body></body></html>"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.lit("https://shop.example/").alias("url"), html.alias("html"))


_BRAND_PARTS = "concat('Home > ', p_brand) AS trail, concat(CAST(p_size AS VARCHAR), ' Road, Town, ', CAST(p_partkey % 100 AS VARCHAR)) AS address"


@query("jsonld_fields", f"SELECT p_partkey AS page_id, p_name AS name, CAST(p_partkey AS VARCHAR) AS sku, CAST(p_partkey % 900 AS VARCHAR) AS price, p_brand AS brand, {_BRAND_PARTS}, '' AS missing FROM part")
def jsonld_fields(spark, sf_dir):
    paths = {"name": "jsonLd.0.name", "sku": "jsonLd.0.sku", "price": "jsonLd.0.offers[0].price", "brand": "jsonLd.0.brand", "trail": "derived.breadcrumb.1", "address": "derived.address.2", "missing": "jsonLd.7.name"}
    rows = scan.scan_details(_ld_pages(spark, sf_dir), [Field(n, attribute="structured", path=p) for n, p in paths.items()])
    return rows.drop("url")


@query("jsonld_entities", "SELECT p_partkey AS page_id, unnest([0, 1, 2]) AS entity_no, unnest(['Product', 'BreadcrumbList', 'LocalBusiness']) AS type FROM part")
def jsonld_entities(spark, sf_dir):
    return structured.scan_entities(_ld_pages(spark, sf_dir)).select("page_id", "entity_no", "type")


@query("structured_catalogue", "SELECT p_partkey AS page_id, unnest(['jsonLd.0.name', 'jsonLd.0.sku', 'jsonLd.0.brand', 'derived.breadcrumb.1', 'derived.address.2']) AS path FROM part")
def structured_catalogue(spark, sf_dir):
    return structured.scan_catalogue(_ld_pages(spark, sf_dir)).select("page_id", "path")


# --- repeating markup, made from orders

_CARDS = "concat('<main><ul class=grid>', array_join(collect_list(concat('<li class=card><a href=\"/o/', cast(o_orderkey as string), '\"><h3>Order ', cast(o_orderkey as string), '</h3></a><b class=price>$', cast(o_orderkey % 900 + 100 as string), '.50</b></li>')), ''), '</ul></main><table><thead><tr><th>Key<th>Status</thead>', array_join(collect_list(concat('<tr><td>', cast(o_orderkey as string), '<td>', o_orderstatus)), ''), '</table>')"


def _card_pages(orders):
    # a stated number of partitions is not coalesced: pages are small, but each takes a Python task a while
    parts = int(orders.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = orders.repartition(parts, "o_custkey").sortWithinPartitions("o_custkey", "o_orderkey")
    return ordered.groupBy(F.col("o_custkey").alias("page_id")).agg(F.expr(_CARDS).alias("html")).withColumn("url", F.lit("https://shop.example/list"))


@query("container_scan", "SELECT o_custkey AS page_id, concat('Order ', CAST(o_orderkey AS VARCHAR)) AS title, concat('$', CAST(o_orderkey % 900 + 100 AS VARCHAR), '.50') AS price, concat('https://shop.example/o/', CAST(o_orderkey AS VARCHAR)) AS link FROM orders")
def container_scan(spark, sf_dir):
    rows = scan.scan(_card_pages(table(spark, sf_dir, "orders")), "li.card", [Field("title", "h3"), Field("price", ".price"), Field("link", "a", "href")])
    return rows.select("page_id", "title", "price", "link")


@query("table_scan", "SELECT o_custkey AS page_id, o_orderkey AS key, o_orderstatus AS status FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) >= 2")
def table_scan(spark, sf_dir):
    cells = scan.scan_tables(_card_pages(table(spark, sf_dir, "orders"))).groupBy("page_id", "row_no").agg(F.max(F.when(F.col("name") == "Key", F.col("value"))).cast("long").alias("key"), F.max(F.when(F.col("name") == "Status", F.col("value"))).alias("status"))
    return cells.drop("row_no")


@query("detect_structures")
def detect_structures(spark, sf_dir):
    return detect.structures(_card_pages(table(spark, sf_dir, "orders")))


@query("detect_pages")
def detect_pages(spark, sf_dir):
    return detect.viable(detect.structures(table(spark, sf_dir, "pages")))


@query("detect_pagination", r"SELECT page_id, CASE WHEN regexp_matches(url, '[?&]page=\d+(&|#|$)') THEN 'pagination' END AS detected FROM pages")
def detect_pagination(spark, sf_dir):
    return detect.pagination(table(spark, sf_dir, "pages")).select("page_id", "detected")
