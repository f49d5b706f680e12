"""Page scans on small hand-written markup."""

import pytest
from pyspark.sql import functions as F

from gleanery.sources import detect, dom, scan, structured
from gleanery.sources.scan import Field

CARDS = '<body><main><ul class="grid">' + "".join(f'<li class="card"><a href="/p{i}"><picture><source srcset="/s{i}.jpg 100w, /b{i}.jpg 800w"><img src="data:image/gif;base64,R0lGODlhAQABxx" data-src="/i{i}.jpg" alt="Pic {i}"></picture><h3>Product number {i}</h3></a><span class="price">${i + 10}.99</span><s>$99.99</s></li>' for i in range(12)) + '</ul></main><nav><a href="/2" rel="next">More</a></nav><table><thead><tr><th>A<th>B</thead><tr><td>1<td>2<tr><td>3<td>4</table></body>'
LD = '<html><head><title> T </title><meta name="description" content="D"><meta property="og:image" content="/o.png"><link rel="canonical" href="/c"><script type="application/ld+json">{bad</script><script type="application/ld+json">{"@graph":[{"@type":"Product","name":"N","offers":[{"price":5}],"image":{"url":"/i.png"}},{"@type":"FAQPage","mainEntity":[{"name":"Q","acceptedAnswer":{"text":"A"}},{"name":"R"}]},{"@type":"BreadcrumbList","itemListElement":[{"position":2,"name":"b"},{"position":1,"item":{"name":"a"}}]},{"@type":"LocalBusiness","address":{"streetAddress":"s","postalCode":"9"}}]}</script></head><body></body></html>'


def test_tree_and_selectors():
    root = dom.parse("<div id=a class='x y'><p>one<p>two <b>bold</b><ul><li>1<li class=k>2<ul><li>3</ul></ul></div><span data-q='v w'>s</span>")
    pick = lambda s: [n.clean_text() for n in dom.select(root, s)]
    assert pick("p") == ["one", "two bold"] and pick("#a > ul > li") == ["1", "23"] and pick("div.x.y b") == ["bold"] and pick("[data-q~=w]") == ["s"] and pick("li:nth-of-type(2)") == ["23"] and pick("b, span") == ["bold", "s"] and pick("li:first-child") == ["1", "3"]
    assert dom.first(root, "ul li ul li").clean_text() == "3" and dom.first(root, "h1") is None
    with pytest.raises(ValueError):
        dom.select(root, "a:hover")
    assert dom.text_content("<p>a</p><script>b</script>") == "ab"


def test_field_reading():
    root = dom.parse(CARDS)
    card = dom.first(root, "li.card")
    assert dom.read(dom.first(card, "img"), "src", card, base="http://x.y/") == "http://x.y/i0.jpg"
    assert dom.best_of_srcset("/a 1x, /b 2x") == "/b" and dom.best_of_srcset("/a, /b") == "/a" and dom.best_of_srcset("") == ""
    assert dom.read(dom.first(card, "h3"), "href", base="http://x.y/z") == "http://x.y/p0" and dom.read(card, "alt") == "Pic 0"
    assert dom.read(dom.parse("<a href='javascript:x'>").elements()[0], "href") == "" and dom.placeholder("/img/blank.gif")
    assert dom.read(dom.first(card, "s"), "html") == "$99.99" and dom.struck_through(dom.first(card, "s"))
    icons = dom.parse('<div><img src="/logo.png" class="icon"><img src="/big.jpg" width=400 height=300></div>')
    assert dom.best_image(icons, "") == "/big.jpg"


def test_scan(spark):
    rows = scan.scan_page(CARDS + "<ul><li class=card></li></ul>", "li.card", [Field("n", attribute="position"), Field("t", "h3"), Field("p", "span"), Field("link", "a", "href"), Field("alt", "img", "attr", "alt")], "http://x.y/")
    assert len(rows) == 12 and rows[1] == {"n": "2", "t": "Product number 1", "p": "$11.99", "link": "http://x.y/p1", "alt": "Pic 1"}
    assert scan.scan_page("<b>x</b>", None, [Field("v", "b")]) == [{"v": "x"}]
    mixed = "<ul><li><i>Blue shirt</i><li><i>Red <u>coat</u> $27.99 (8,245)</i></ul>"
    assert [r["v"] for r in scan.scan_page(mixed, "li", [Field("v", "i")])][1] in ("coat", "")
    prices = "<ul><li><b>$5.00</b><li><b>soon</b><em>$7.00</em><li><s>$9.00</s><b>$8.00</b></ul>"
    assert [r["v"] for r in scan.scan_page(prices, "li", [Field("v", "b")])] == ["$5.00", "$7.00", "$8.00"]
    assert scan.detail_record("<p>a<p>b", [Field("all", "p", multiple=True), Field("one", "p"), Field("n", attribute="position")]) == {"all": ["a", "b"], "one": "a", "n": "1"}
    pages = spark.createDataFrame([(1, "http://x.y/", CARDS), (2, None, None)], "page_id long, url string, html string")
    got = scan.scan(pages, "li.card", [Field("t", "h3")])
    assert got.count() == 12 and got.agg(F.max("row_no")).first()[0] == 12
    assert [(r.name, r.value) for r in scan.scan_tables(pages).orderBy("row_no", "column_no").collect()] == [("A", "1"), ("B", "2"), ("A", "3"), ("B", "4")]
    assert scan.scan_details(pages, [Field("alts", "img", "alt", multiple=True)]).filter("page_id = 1").first()["alts"].startswith("Pic 0; Pic 1")


def test_structured(spark):
    found, bad = structured.entities(LD)
    assert bad == 1 and [e["@type"] for e in found] == ["Product", "FAQPage", "BreadcrumbList", "LocalBusiness"]
    at = lambda p: structured.value_at(LD, p, "http://x.y/")
    assert at("jsonLd.0.offers[0].price") == "5" and at("jsonLd.0.image") == "http://x.y/i.png" and at("meta.og.image") == "http://x.y/o.png" and at("meta.canonical") == "http://x.y/c" and at("meta.title") == "T"
    assert at("derived.faq.1") == "Q: A | R" and at("derived.breadcrumb.2") == "a > b" and at("derived.address.3") == "s, 9" and at("jsonLd.9.x") == at("nothing") == at("meta.none") == ""
    pages = spark.createDataFrame([(1, "http://x.y/", LD), (2, "u", "")], "page_id long, url string, html string")
    assert structured.scan_entities(pages).count() == 4 and {r.description for r in structured.scan_meta(pages).collect()} == {"D", ""}
    assert "jsonLd.0.name" in {r.path for r in structured.scan_catalogue(pages).collect()}


def test_detection(spark):
    pages = spark.createDataFrame([(1, "https://x.y/?page=3", CARDS), (2, "https://x.y/", "<p>none</p>")], "page_id long, url string, html string")
    top = detect.viable(detect.structures(pages)).orderBy("rank").first()
    assert (top.label, top.item_count, top.selector) == ("List Items", 12, "li.card") and top.score >= 70 and set(top.fields) >= {"Title", "Price", "Link", "Image"}
    assert {r.fate for r in detect.report(pages).collect()} <= {"kept", "score below 20", "overlaps a better candidate"} and detect.report(pages).filter("fate = 'kept' and selector = 'li.card'").count() == 1
    got = {r.page_id: r for r in detect.pagination(pages).collect()}
    assert got[1].detected == "pagination" and got[1].reason == 'rel="next" link' and got[1].url_pattern == "query:page:3" and got[2].detected is None
    assert detect.page_pagination("<button>Load more</button>")[0] == "load-more"
    assert detect.dynamic_class("css-1x2y") and detect.dynamic_class("btn--f3a1b2") and not detect.dynamic_class("product-card") and detect.dynamic_id("ember123") and not detect.dynamic_id("main")
    assert detect.selector_quality(":scope") == (100, "Good") and detect.selector_quality("div:nth-of-type(2) > div:nth-of-type(3) > span")[1] == "Fragile"
    assert detect.migrated_container(CARDS, "li:nth-of-type(1)") == "li.card" and detect.migrated_container(CARDS, "li.card") == "li.card"
    suggest = spark.createDataFrame([(["Product"], ["Cards"], ["Bedrooms"]), ([], ["Cards"], []), ([], [], [])], "t array<string>, l array<string>, f array<string>").select(detect.template_suggestions(F.col("t"), F.col("l"), F.col("f")).alias("s")).collect()
    assert [r.s for r in suggest] == [["ecommerce", "realestate"], ["list"], []]
    assert detect.match_hints([("Name", ["Name"], ["Title"]), ("Other", ["Name"], ["Title"])], {"Name": "jsonLd.0.name"}, {"Title": "h3"}) == {"Name": "jsonLd.0.name", "Other": "h3"}
    assert len(detect.TEMPLATES) == 8


def test_structures_of_all_orders(spark, tmp_path):
    from gleanery.plans import registry

    rows = [(first + k, first, "O") for first in (1, 1990, 5000) for k in range(12)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.page_id for r in registry.QUERIES["detect_structures"](spark, str(tmp_path)).collect()]
    assert set(got) == {1, 1990, 5000} and got.count(1) == got.count(1990) == got.count(5000)


def _plan_of_customers(spark, folder, name):
    from gleanery.plans import registry

    spark.range(18).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{folder}/customer.parquet")
    found = registry.QUERIES[name](spark, str(folder))
    return found, found._jdf.queryExecution().optimizedPlan().toString()


def test_customers_are_dealt_out_and_equal_pages_walked_once(spark, tmp_path, monkeypatch):
    found, plan = _plan_of_customers(spark, tmp_path, "detect_cards")
    assert "RepartitionByExpression [c_custkey" in plan
    assert sorted((r.page_id, r.item_count) for r in found.collect()) == [(k, 4 + k % 9) for k in range(18)]
    walked, real = [], detect.page_candidates
    monkeypatch.setattr(detect, "page_candidates", lambda h, b: walked.append(h) or real(h, b))
    got = detect.batch_candidates([CARDS, None, CARDS, "", CARDS + "<p>"])
    assert walked == [CARDS, "", CARDS + "<p>"] and got[0] == got[2] == real(CARDS) and got[1] == got[3] == []


def test_walk_is_page_order():
    root = dom.parse("<p>a<ul><li>1<li><b>2<i>3</b></i><li>4</ul></div><td>x<td>y<p><svg/><span>z")
    below = lambda n: [x for c in n.elements() for x in (c, *below(c))]
    assert all(list(n.walk()) == below(n) for n in (root, *root.walk())) and len(below(root)) == 12


def test_report_walks_each_page_once(spark, tmp_path):
    found, plan = _plan_of_customers(spark, tmp_path, "detect_report")
    assert plan.count("MapInArrow") == 1 and "RepartitionByExpression [c_custkey" in plan
    assert sorted(tuple(r) for r in found.collect()) == sorted((k, *t) for k in range(18) for t in (("li.card", "kept"), ("a", "score below 20")))


def test_viable_customers_are_dealt_out(spark, tmp_path):
    found, plan = _plan_of_customers(spark, tmp_path, "detect_viable")
    assert "RepartitionByExpression [c_custkey" in plan and sorted(tuple(r) for r in found.collect()) == [(k, "li.card") for k in range(18)]
