"""Structured data that pages carry: JSON-LD entities, meta elements, and values by path."""

from __future__ import annotations

import json
import re
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.sources import dom

# Schema.org types whose plain fields are offered, and the meta fields.
FLAT_TYPES = {
    "Product": ("name", "description", "sku", "brand", "image", "offers.price", "offers.priceCurrency", "offers.availability", "aggregateRating.ratingValue", "aggregateRating.reviewCount"),
    "Article": ("headline", "author", "datePublished", "dateModified", "image", "description"),
    "NewsArticle": ("headline", "author", "datePublished", "dateModified", "image", "description"),
    "BlogPosting": ("headline", "author", "datePublished", "image", "description"),
    "Recipe": ("name", "author", "prepTime", "cookTime", "recipeYield", "image"),
    "Event": ("name", "startDate", "endDate", "location", "image", "offers.price"),
    "JobPosting": ("title", "hiringOrganization", "jobLocation", "datePosted", "employmentType", "baseSalary"),
    "LocalBusiness": ("name", "telephone", "priceRange", "image", "aggregateRating.ratingValue"),
    "Organization": ("name", "url", "logo", "telephone"),
    "Person": ("name", "jobTitle", "image", "url"),
    "VideoObject": ("name", "description", "thumbnailUrl", "uploadDate", "duration"),
}
META = ("title", "description", "canonical", "og.title", "og.description", "og.image", "og.url", "og.siteName", "og.type", "twitter.card", "twitter.title", "twitter.description", "twitter.image", "author", "keywords")


def entities(html: str) -> tuple[list[dict], int]:
    """(entities in page order, blocks that are no JSON): lists and @graph are opened up, however deep."""
    out: list[dict] = []

    def open_up(block) -> None:
        todo = [block]
        while todo:
            v = todo.pop()
            if isinstance(v, list):
                todo += reversed(v)
            elif isinstance(v, dict):
                graph = v.get("@graph")
                if not isinstance(graph, list):
                    out.append(v)
                    continue
                rest = {k: x for k, x in v.items() if k != "@graph"}
                if any(k != "@context" for k in rest):
                    todo.append({**rest, "@graph": tuple(graph)})  # comes after its graph, and is not opened again
                todo.append(graph)

    bad = 0
    for m in re.finditer(r"<script\b[^>]*\btype\s*=\s*[\"']?application/ld\+json[\"']?[^>]*>(.*?)</script", html, re.I | re.S):
        try:
            open_up(json.loads(m[1]))
        except (ValueError, RecursionError):
            bad += 1
    return out, bad


def meta(html: str, base: str = "") -> dict:
    root = dom.parse(html)
    found: dict[str, str] = {}
    for n in root.walk():
        if n.tag == "meta" and (k := n.attrs.get("name") or n.attrs.get("property")):
            found.setdefault(k.lower(), (n.attrs.get("content") or "").strip())
    title = next((n.text().strip() for n in root.walk() if n.tag == "title"), "")
    link = next((n.attrs.get("href", "") for n in root.walk() if n.tag == "link" and "canonical" in n.attrs.get("rel", "").lower().split()), "")
    get = lambda k: found.get(k, "")
    at = lambda u: dom.resolve(u, base)
    return {
        "title": title, "description": get("description"), "canonical": at(link),
        "og": {"title": get("og:title"), "description": get("og:description"), "image": at(get("og:image")), "url": at(get("og:url")), "siteName": get("og:site_name"), "type": get("og:type")},
        "twitter": {"card": get("twitter:card"), "title": get("twitter:title"), "description": get("twitter:description"), "image": at(get("twitter:image"))},
        "author": get("author"), "keywords": get("keywords"),
    }


def walk(value, path: str):
    """What a path like `offers[0].price` leads to, or None."""
    for part in path.split("."):
        m = re.fullmatch(r"([^\[\]]*)((?:\[\d+\])*)", part)
        keys = ([m[1]] if m[1] else []) + [int(i) for i in re.findall(r"\d+", m[2])] if m else [part]
        for k in keys:
            if isinstance(value, dict):
                value = value.get(str(k) if isinstance(k, int) else k)
            elif isinstance(value, list):
                value = value[int(k)] if str(k).isdigit() and int(k) < len(value) else None
            else:
                return None
    return value


def leaf(value) -> str:
    """A plain value out of lists (their first) and objects (url, contentUrl or name)."""
    while isinstance(value, list):
        value = value[0] if value else None
    if isinstance(value, dict):
        return next((value[k] for k in ("url", "contentUrl", "name") if isinstance(value.get(k), str)), "")
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value)


def breadcrumb(entity: dict) -> str:
    items = [i for i in entity.get("itemListElement") or [] if isinstance(i, dict)]
    items.sort(key=lambda i: i.get("position") or 0)
    names = [i["name"] if isinstance(i.get("name"), str) else (i.get("item") or {}).get("name", "") if isinstance(i.get("item"), dict) else "" for i in items]
    return " > ".join(n for n in names if n)


def faq(entity: dict) -> str:
    out = []
    for q in entity.get("mainEntity") or []:
        if isinstance(q, dict) and isinstance(q.get("name"), str):
            answer = (q.get("acceptedAnswer") or {}).get("text")
            out.append(f"{q['name']}: {answer}" if answer else q["name"])
    return " | ".join(out)


def address(entity: dict) -> str:
    a = entity.get("address")
    if isinstance(a, str):
        return a
    a = a if isinstance(a, dict) else {}
    return ", ".join(a[k] for k in ("streetAddress", "addressLocality", "addressRegion", "postalCode") if isinstance(a.get(k), str) and a[k])


DERIVED = {"breadcrumb": breadcrumb, "faq": faq, "address": address}


class Page:
    """The structured data of a page, read once whatever is asked of it."""

    def __init__(self, html: str, base: str = ""):
        self.html, self.base = html, base

    @cached_property
    def entities(self) -> list[dict]:
        return entities(self.html)[0]

    @cached_property
    def meta(self) -> dict:
        return meta(self.html, self.base)

    def value(self, path: str) -> str:
        """The value of meta.*, jsonLd.<i>.<path> or derived.<kind>.<i>; missing is ''."""
        head, _, rest = path.partition(".")
        if head == "meta":
            return leaf(walk(self.meta, rest))
        if head == "jsonLd":
            i, _, inner = rest.partition(".")
            entity = self.entities[int(i)] if i.isdigit() and int(i) < len(self.entities) else None
            value = leaf(walk(entity, inner)) if entity is not None else ""
            return dom.resolve(value, self.base) if re.search(r"(^|\.)(image|logo|url)(\[\d+\])*$", inner) else value
        if head == "derived":
            kind, _, i = rest.partition(".")
            if kind in DERIVED and i.isdigit() and int(i) < len(self.entities):
                return DERIVED[kind](self.entities[int(i)])
        return ""


def value_at(html: str, path: str, base: str = "") -> str:
    return Page(html, base).value(path)


def catalogue(html: str, base: str = "") -> list[tuple[str, str, str]]:
    """(path, label, sample) of every structured field the page has a value for, unique by path."""
    out: dict[str, tuple[str, str, str]] = {}
    page = Page(html, base)
    for i, e in enumerate(page.entities):
        kinds = e.get("@type") if isinstance(e.get("@type"), list) else [e.get("@type")]
        for kind in kinds:
            for p in FLAT_TYPES.get(str(kind), ()):
                path = f"jsonLd.{i}.{p}"
                if v := page.value(path):
                    out.setdefault(path, (path, f"{kind} {p}", v))
            for name, want in (("breadcrumb", "BreadcrumbList"), ("faq", "FAQPage")):
                if kind == want and (v := DERIVED[name](e)):
                    out.setdefault(f"derived.{name}.{i}", (f"derived.{name}.{i}", want, v))
        if v := address(e):
            out.setdefault(f"derived.address.{i}", (f"derived.address.{i}", "Address", v))
    for p in META:
        if v := leaf(walk(page.meta, p)):
            out.setdefault(f"meta.{p}", (f"meta.{p}", f"Meta {p}", v))
    return list(out.values())


def scan_entities(pages: DataFrame) -> DataFrame:
    """page_id, entity_no, type, entity (JSON) of every JSON-LD entity."""

    def run(batches):
        for batch in batches:
            rows = [(p, i, ",".join(map(str, e["@type"] if isinstance(e.get("@type"), list) else [e.get("@type", "")])), json.dumps(e, ensure_ascii=False)) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, e in enumerate(entities(h or "")[0])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["page_id", "entity_no", "type", "entity"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, entity_no int, type string, entity string")


def scan_meta(pages: DataFrame) -> DataFrame:
    """page_id, url and one column for each meta field, dots as underscores."""
    names = [m.replace(".", "_") for m in META]

    def run(batches):
        for batch in batches:
            ids, urls, html = (batch.column(i) for i in range(3))
            found = [meta(h or "", u or "") for h, u in zip(html.to_pylist(), urls.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), urls.cast(pa.string()), *(pa.array([leaf(walk(m, p)) for m in found], pa.string()) for p in META)], ["page_id", "url", *names])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, " + ", ".join(f"{n} string" for n in names))


def scan_catalogue(pages: DataFrame) -> DataFrame:
    """page_id, path, label, sample_value of the structured fields of each page."""

    def run(batches):
        for batch in batches:
            rows = [(p, *c) for p, u, h in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for c in catalogue(h or "", u or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.string()))], ["page_id", "path", "label", "sample_value"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, path string, label string, sample_value string")
