"""Structure detection: repeating groups of a page, their signals, fields and selectors.

The tree walk is Python, page by page; the score is a Column expression over the signals
it emits, so it can be read, tested and changed without touching the walk.
"""

from __future__ import annotations

import re
import statistics
from dataclasses import dataclass
from functools import lru_cache, reduce
from itertools import chain, islice
from operator import add

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import urls
from gleanery.sources import dom


@dataclass(frozen=True)
class Budget:
    """How much of a page an interactive caller wants looked at. By default there is no bound."""

    elements: int | None = None
    structures: int | None = None
    fields: int | None = None
    rows: int | None = None
    signal_rows: int | None = None


ALL = Budget()
INTERACTIVE = Budget(6000, 8, 10, 30, 12)  # fixed values

# Names of regions, shapes of fields and labels of controls.
NAV_NAMES = re.compile(r"\b(nav|menu|sidebar|breadcrumb|pagination|pager|footer|header|social|share|cookie|banner|advert|promo|sponsor)\b", re.I)
MAIN_NAMES = re.compile(r"\b(main|content|results?|list|grid|items?|cards?|products?|feed|listings?|posts?|search)\b", re.I)
NAV_TAGS, HEADINGS = frozenset(("nav", "aside", "footer", "header")), frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
PRICE = re.compile(r"(?:[$€£₺¥₹]\s?\d[\d.,]*\d|\d[\d.,]*\d\s?[$€£₺¥₹])")
AUTHOR = re.compile(r"^(?:u/|@)[\w.\-]+$")
DATE = re.compile(r"\b(\d+\s?(?:min|hour|hr|day|week|month|year)s?\s?ago|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}|\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2,4})\b", re.I)
RATING = re.compile(r"^\s*\d(?:[.,]\d)?\s*(?:/\s*5|/\s*10|★|stars?)?\s*$", re.I)
COUNT = re.compile(r"^\s*\(?[\d.,]+\s*[kKmMbB]?\+?\s*(comments?|replies|points?|upvotes?|views?|likes?|shares?|reviews?|ratings?)?\)?\s*$")
NEXT_TEXT = re.compile(r"^(next|next page|»|›|>>|>)$", re.I)
MORE_TEXT = re.compile(r"^(load more|show more|more results|view more|see more|load more results)$", re.I)
DWELLING = r"(?i)bed(room)?s?\b|bath(room)?s?\b|sq\.?\s?ft|square\s?feet"
TEMPLATES = {
    "ecommerce": ["Product Name", "Price", "Original Price", "Product URL", "Image", "Rating", "Review Count", "Availability", "Brand", "SKU", "Category"],
    "search": ["Title", "URL", "Description", "Position"],
    "article": ["Headline", "URL", "Author", "Published Date", "Description", "Image"],
    "directory": ["Name", "URL", "Address", "Phone", "Rating", "Review Count", "Category"],
    "realestate": ["Title", "Price", "Location", "Property URL", "Image", "Property Type", "Bedrooms", "Bathrooms", "Area"],
    "jobs": ["Job Title", "Company", "Location", "Job URL", "Salary", "Employment Type", "Published Date"],
    "table": [],
    "list": [],
}


# What marks a class or an id as made by a tool.
MADE_CLASS = tuple(re.compile(p) for p in (r"(?i)(css|sc|jsx|styled|emotion|chakra|MuiBox|ng-)", r"(?i).*--[a-z0-9]{5,}$", r"(?i)[a-z]{1,3}-[0-9a-f]{5,}$", r"(?i)[a-f0-9]{6,}$"))
MADE_ID = tuple(re.compile(p) for p in (r"(?i)(ember|react|radix|mui|vue|headlessui|:r)", r":.*:$"))
LEAST_CLASS, DIGIT_SHARE_CLASS, LEAST_DIGIT_CLASS, LEAST_VOWELLESS = 2, 0.25, 6, 5
DIGIT_SHARE_ID, LEAST_DIGIT_ID = 0.4, 8
# What the signals of a candidate are worth, as (signal, points for its whole share) and (test, points).
SHARES = (("links", 15), ("images", 8), ("prices", 15), ("titles", 7), ("consistency", 7))
BONUSES = (
    ("main", 10), ("nav = 'semantic'", -30), ("nav = 'keyword'", -12), ("avg_text < 3 and images < 0.3", -15),
    ("links < 0.15 and images < 0.15 and consistency > 0.55 and item_count <= 40", -35),
    ("links >= 0.8 and images >= 0.8 and prices >= 0.8 and item_count >= 10", 20),
)
COUNT_POINTS, MOST_COUNT, TEXT_PER_POINT, MOST_TEXT, DIVERSITY, LEAST_LINKS = 6, 25, 10, 20, 8, 0.4


def digit_share(s: str) -> float:
    return sum(x.isdigit() for x in s) / len(s)


@lru_cache(maxsize=65536)
def dynamic_class(c: str) -> bool:
    """Whether a class looks made by a tool: prefixes, hashes, many digits, no vowel."""
    if len(c) < LEAST_CLASS or any(p.match(c) for p in MADE_CLASS):
        return True
    if len(c) >= LEAST_DIGIT_CLASS and re.fullmatch(r"[A-Za-z0-9_-]+", c) and digit_share(c) > DIGIT_SHARE_CLASS:
        return True
    return len(c) >= LEAST_VOWELLESS and c.isascii() and c.isalpha() and c.islower() and not set(c) & set("aeiouy")


def dynamic_id(i: str) -> bool:
    return not i or any(p.match(i) for p in MADE_ID) or len(i) >= LEAST_DIGIT_ID and digit_share(i) > DIGIT_SHARE_ID


def stable_classes(n: dom.Node) -> list[str]:
    return [c for c in n.classes() if not dynamic_class(c)]


def groups(root: dom.Node, elements: int | None = None) -> list[list[dom.Node]]:
    """Children of one parent alike in element and one stable class (or in having none), two at least."""
    out = []
    body = dom.body(root)
    for n in islice(chain([body], body.walk()), elements):
        alike: dict[tuple, list[dom.Node]] = {}
        for c in n.elements():
            for name in stable_classes(c) or [""]:
                alike.setdefault((c.tag, name), []).append(c)
        out += [g for g in alike.values() if len(g) >= 2]
    return out


def region(n: dom.Node) -> tuple[str, bool]:
    """(navigation by element, by name or none; whether inside a main region)."""
    up = [n, *n.ancestors()]
    names = lambda a: f"{a.attrs.get('id', '')} {a.attrs.get('class', '')}"
    nav = "semantic" if any(a.tag in NAV_TAGS or a.attrs.get("role") == "navigation" for a in up) else "keyword" if any(NAV_NAMES.search(names(a)) for a in up) else "none"
    return nav, any(a.tag in ("main", "article") or a.attrs.get("role") == "main" or MAIN_NAMES.search(names(a)) for a in up)


SIGNALS = "item_count int, avg_text double, links double, images double, prices double, titles double, diversity double, consistency double, nav string, main boolean"


def signals(group: list[dom.Node], rows: int | None = None) -> tuple:
    some = group[:rows]
    texts = [n.clean_text() for n in some]
    share = lambda test: sum(map(bool, test)) / len(some)
    anchors = [dom.first(n, "a[href]") for n in some]
    hrefs = [h for a in anchors if a is not None and (h := a.attrs.get("href", "").strip())]
    mean = statistics.fmean(map(len, texts))
    consistency = max(0.0, 1 - min(1.0, statistics.pstdev(map(len, texts)) / mean)) if mean else 0.0
    nav, main = region(group[0])
    return (len(group), mean, share(a is not None for a in anchors), share(any(x.tag == "img" for x in n.walk()) for n in some), share(PRICE.search(t) for t in texts), share(any(x.tag in HEADINGS for x in n.walk()) for n in some), len(set(hrefs)) / len(hrefs) if hrefs else 0.0, consistency, nav, main)


def score() -> Column:
    """0 to 100 of a candidate: points for its size and text, for shares of its items, and for tests that hold."""
    total = F.least(F.lit(float(MOST_COUNT)), F.log2(F.col("item_count") + 1) * COUNT_POINTS) + F.least(F.lit(float(MOST_TEXT)), F.col("avg_text") / TEXT_PER_POINT)
    total = total + F.when(F.col("links") > LEAST_LINKS, F.col("diversity") * DIVERSITY).otherwise(0.0)
    total = reduce(add, (F.col(signal) * points for signal, points in SHARES), total)
    total = reduce(add, (F.when(F.expr(test), float(points)).otherwise(0.0) for test, points in BONUSES), total)
    return F.greatest(F.lit(0), F.least(F.lit(100), F.floor(total + 0.5))).cast("int")


# --- selectors


@lru_cache(maxsize=65536)
def escaped(c: str) -> str:
    return re.sub(r"([^\w-])", r"\\\1", c)


def segment(n: dom.Node) -> str:
    return n.tag + "".join("." + escaped(c) for c in stable_classes(n))


def positioned(n: dom.Node) -> str:
    same = [s for s in n.parent.elements() if s.tag == n.tag] if n.parent else [n]
    return segment(n) if len(same) == 1 else f"{n.tag}:nth-of-type({same.index(n) + 1})"


def relative_selector(scope: dom.Node, n: dom.Node) -> str:
    """The shortest suffix of the path from the scope that finds just this element first."""
    path: list[dom.Node] = []
    at: dom.Node | None = n
    while at is not None and at is not scope:
        path.insert(0, at)
        at = at.parent
    for style in (segment, positioned):
        for k in range(1, len(path) + 1):
            s = " > ".join(style(x) for x in path[-k:])
            if dom.first(scope, s) is n:
                return s
    return ""


def container_selector(group: list[dom.Node], root: dom.Node) -> str:
    """A selector that finds exactly the group, or '' if none does."""
    common = [c for c in stable_classes(group[0]) if all(c in n.classes() for n in group)]
    s = group[0].tag + "".join("." + escaped(c) for c in common)
    at = group[0].parent
    for _ in range(8):
        if len(dom.select(root, s)) == len(group):
            return s
        if at is None or at.tag in ("#document", "html"):
            break
        i = at.attrs.get("id", "")
        s = f"#{i} > {s}" if i and not dynamic_id(i) and re.fullmatch(r"[\w-]+", i) else f"{segment(at)} > {s}"
        at = at.parent
    return s if len(dom.select(root, s)) == len(group) else ""


def migrated_container(html: str, stored: str) -> str:
    """A stored container that now matches one or two elements, derived anew; kept unless the new one matches strictly more."""
    root = dom.parse(html)
    found = dom.select(root, stored)
    if not 1 <= len(found) <= 2:
        return stored
    alike = [n for n in (found[0].parent.elements() if found[0].parent else []) if n.tag == found[0].tag]
    fresh = container_selector(alike, root) if alike else ""
    return fresh if fresh and len(alike) > len(found) else stored


def selector_quality(selector: str) -> tuple[int, str]:
    """(0 to 100, Good, Fair or Fragile) of how well a selector will age."""
    if selector == ":scope":
        return 100, "Good"
    parts = [p.strip() for p in selector.split(">") if p.strip()]
    total = 60 + 25 * bool(re.match(r"#[\w-]", parts[0] if parts else ""))
    total -= min(35, 15 * len(re.findall(r":nth-(?:child|of-type)\(", selector)))
    if classes := re.findall(r"\.([\w-]+)", selector):
        total += -20 if any(map(dynamic_class, classes)) else 10
    total += 10 * bool(re.search(r"\[(?:data-[\w-]+|itemprop|role|type|name|rel)(=\"[^\"]*\")?\]", selector))
    total = max(0, min(100, total - 5 * max(0, len(parts) - 4)))
    return total, "Good" if total >= 70 else "Fair" if total >= 40 else "Fragile"


# --- fields


def semantic_name(samples: list[str]) -> str | None:
    got = [s.strip() for s in samples if s]
    share = lambda p: sum(bool(p.search(s)) for s in got) / len(got)
    if not got:
        return None
    for name, shape, least in (("Price", PRICE, 0.6), ("Author", AUTHOR, 0.6), ("Date", DATE, 0.5), ("Rating", RATING, 0.6)):
        if share(shape) >= least:
            return name
    if share(COUNT) >= 0.6:
        return "Review Count" if share(re.compile("reviews?|ratings?", re.I)) >= 0.5 else "Count"
    return None


def fields(group: list[dom.Node], budget: Budget = ALL) -> list[tuple[str, str, str, float, float, list[str]]]:
    """(name, selector, attribute, coverage, uniqueness, samples): best covered first.

    Candidates are the first instance's texts that no deeper element repeats, its links
    and pictures; of those with equal samples the first stays.
    """
    head, some = group[0], group[: budget.rows]
    wanted: list[tuple[dom.Node, str]] = []
    for n in [head, *head.walk()]:
        kids = n.elements()
        if n.tag == "img":
            wanted.append((n, "src"))
        elif n.tag == "a" and "href" in n.attrs and not any(a == "href" for _, a in wanted):
            wanted.append((n, "href"))
        if n.tag not in ("script", "style") and (t := n.clean_text()) and not any(k.clean_text() for k in kids) and not any(x is not n and x.order < n.order <= x.last and x.clean_text() == t for x, a in wanted if a == "text"):
            wanted.append((n, "text"))
    out, used, seen, texts = [], set(), set(), 0
    for n, attribute in wanted:
        selector = ":scope" if n is head else relative_selector(head, n)
        if not selector:
            continue
        values = [dom.read(c if selector == ":scope" else dom.first(c, selector), attribute) for c in some]
        filled = [v for v in values if v]
        if not filled or (attribute, tuple(values)) in seen:
            continue
        seen.add((attribute, tuple(values)))
        base = semantic_name(filled) if attribute == "text" else {"href": "Link", "src": "Image"}[attribute]
        if base is None:
            texts += 1
            base = "Title" if texts == 1 else "Description" if statistics.fmean(len(v.strip()) for v in filled) >= 60 else "Text"
        name, k = base, 2
        while name in used:
            name, k = f"{base} {k}", k + 1
        used.add(name)
        out.append((name, selector, attribute, len(filled) / len(some), len(set(filled)) / len(filled), filled[:8]))
    order = {"Title": 0, "Price": 1, "Link": 2, "Image": 3}
    return sorted(out, key=lambda f: (order.get(f[0], 9), -f[3]))[: budget.fields]


def label(tag: str, found: list) -> str:
    image, price = any(f[2] == "src" for f in found), any(f[0] == "Price" for f in found)
    return {"tr": "Table Rows", "li": "List Items"}.get(tag) or ("Product Cards" if image and price else "Cards" if image else "Repeating Items")


def page_candidates(html: str, budget: Budget = ALL) -> list[tuple]:
    """(no, label, selector, parents, signals..., fields) of every repeating group of a page."""
    root, out = dom.parse(html), []
    for k, g in enumerate(groups(root, budget.elements)):
        found = fields(g, budget)
        table = g[0].tag != "tr" and any(a.tag == "table" for a in g[0].ancestors())
        if not found or table:
            continue
        lineage = [n.order for n in (g[0], *g[0].ancestors())]
        out.append((k, label(g[0].tag, found), container_selector(g, root), lineage, *signals(g, budget.signal_rows), [f[0] for f in found]))
    return out


def batch_candidates(pages: list[str | None], budget: Budget = ALL) -> list[list[tuple]]:
    """page_candidates() of each page of a batch; pages alike to the last character are walked once."""
    found: dict[str, list[tuple]] = {}
    return [found[h] if (h := html or "") in found else found.setdefault(h, page_candidates(h, budget)) for html in pages]


def candidates(pages: DataFrame, budget: Budget = ALL) -> DataFrame:
    """One row for each repeating group with its signals and score."""
    names = ["page_id", "candidate", "label", "selector", "lineage", *(s.split()[0] for s in SIGNALS.split(", ")), "fields"]
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.int32(), *[pa.float64()] * 7, pa.string(), pa.bool_(), pa.list_(pa.string())]

    def run(batches):
        for batch in batches:
            rows = [(p, *c) for p, found in zip(batch.column(0).to_pylist(), batch_candidates(batch.column(1).to_pylist(), budget), strict=True) for c in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    found = pages.select("page_id", "html").mapInArrow(run, f"page_id long, candidate int, label string, selector string, lineage array<long>, {SIGNALS}, fields array<string>")
    return found.withColumn("score", score())


def _judged(pages: DataFrame, budget: Budget = ALL) -> DataFrame:
    """page_id, `all` its candidates, best first, and `kept` those that no better one stands for.

    A candidate goes if a better one is the same element, or above or below it with nearly
    as many items; the judgement stays inside the page's own few candidates, and each page
    is walked once.
    """
    rest = ["item_count", "score", "fields", *(s.split()[0] for s in SIGNALS.split(", ")[1:])]
    listed = candidates(pages, budget).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("order"), "candidate", "label", "selector", "lineage", *rest))).alias("all"))
    related = lambda a, b: F.array_contains(a["lineage"], F.get(b["lineage"], F.lit(0))) | F.array_contains(b["lineage"], F.get(a["lineage"], F.lit(0)))
    same = lambda a, b: F.get(a["lineage"], F.lit(0)) == F.get(b["lineage"], F.lit(0))
    close = lambda a, b: same(a, b) | (related(a, b) & (F.abs(a["item_count"] - b["item_count"]) <= 2))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda kept, x: F.when(F.exists(kept, lambda k: close(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return listed.withColumn("kept", kept if budget.structures is None else F.slice(kept, 1, budget.structures))


def structures(pages: DataFrame, budget: Budget = ALL) -> DataFrame:
    """The best structures of each page: page_id, rank, label, item_count, selector, score, confidence, fields."""
    top = _judged(pages, budget).select("page_id", F.posexplode("kept").alias("rank", "s"))
    confidence = F.when(F.col("s.score") >= 70, "High").when(F.col("s.score") >= 40, "Medium").otherwise("Low")
    return top.select("page_id", (F.col("rank") + 1).alias("rank"), "s.label", "s.item_count", "s.selector", "s.score", confidence.alias("confidence"), "s.fields")


def report(pages: DataFrame, budget: Budget = ALL) -> DataFrame:
    """Every candidate with its signals, score and fate: kept, or why it was set aside."""
    met = _judged(pages, budget).select("page_id", "kept", F.explode("all").alias("s"))
    stands = F.exists("kept", lambda k: (k["selector"] == F.col("s.selector")) & (k["item_count"] == F.col("s.item_count")))
    fate = F.when(F.col("s.score") < 20, "score below 20").when(~stands, "overlaps a better candidate").otherwise("kept")
    return met.select("page_id", "s.candidate", "s.label", "s.selector", *(f"s.{c.split()[0]}" for c in SIGNALS.split(", ")), "s.fields", "s.score", fate.alias("fate"))


def viable(found: DataFrame) -> DataFrame:
    return found.filter("item_count >= 2 and score >= 20")


def chosen_fields(found: DataFrame) -> DataFrame:
    """Fields checked by default, of (quality, coverage, uniqueness, samples) rows."""
    return found.filter("quality <> 'Fragile' and coverage >= 0.5 and not (uniqueness < 0.2 and samples >= 3)")


def page_pagination(html: str) -> tuple[str | None, str | None, str | None]:
    """(next-button or load-more, why, selector) of the control that leads on."""
    root = dom.parse(html)
    controls = [n for n in root.walk() if n.tag in ("a", "button") and "display:none" not in n.attrs.get("style", "").replace(" ", "")]
    tests = (
        ("next-button", 'rel="next" link', lambda n: n.tag == "a" and "next" in n.attrs.get("rel", "").split()),
        ("next-button", 'aria-label mentions "next"', lambda n: "next" in n.attrs.get("aria-label", "").lower()),
        ("next-button", 'visible text matches a common "Next" label', lambda n: NEXT_TEXT.match(n.clean_text())),
        ("load-more", 'visible text matches a common "Load More" label', lambda n: MORE_TEXT.match(n.clean_text())),
    )
    for kind, why, test in tests:
        for n in controls:
            if test(n) and (s := relative_selector(root, n)):
                return kind, why, s
    return None, None, None


def pagination(pages: DataFrame) -> DataFrame:
    """page_id, detected, reason, selector, url_pattern: controls first, then a sure page number in the URL."""

    def run(batches):
        for batch in batches:
            found = [page_pagination(h or "") for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([f[i] for f in found], pa.string()) for i in range(3))], ["page_id", "url", "kind", "reason", "selector"])

    rows = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, kind string, reason string, selector string").withColumn("p", urls.pagination("url"))
    detected = F.when(F.col("kind") == "next-button", "pagination").when(F.col("kind") == "load-more", "load-more").when(F.col("p.confidence") == "high", "pagination")
    return rows.select("page_id", detected.alias("detected"), "reason", "selector", F.when(F.col("p.found"), F.concat_ws(":", "p.kind", "p.key", "p.start")).alias("url_pattern"))


def template_suggestions(types: Column, labels: Column, field_names: Column) -> Column:
    """Ids of built-in templates that suit a page, from its entity types and detected structures (arrays)."""
    any_of = lambda *names: F.arrays_overlap(types, F.array(*(F.lit(n) for n in names)))
    found = F.array_compact(
        F.array(
            F.when(any_of("Product"), "ecommerce"), F.when(any_of("Article", "NewsArticle"), "article"), F.when(any_of("JobPosting"), "jobs"),
            F.when(any_of("LocalBusiness", "Organization"), "directory"), F.when(F.array_contains(labels, "Table Rows"), "table"), F.when(F.exists(field_names, lambda n: n.rlike(DWELLING)), "realestate"),
        )
    )
    return F.when((F.size(found) == 0) & (F.size(labels) > 0), F.array(F.lit("list"))).otherwise(found)


def match_hints(hints: list[tuple[str, list[str], list[str]]], structured: dict[str, str], detected: dict[str, str]) -> dict[str, str]:
    """Template fields to their sources: in order, structured labels before detected names, each source used once."""
    used, out = set(), {}
    for name, labels, names in hints:
        pick = next((structured[x] for x in labels if x in structured and structured[x] not in used), None) or next((detected[x] for x in names if x in detected and detected[x] not in used), None)
        if pick:
            used.add(pick)
            out[name] = pick
    return out
