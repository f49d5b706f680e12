"""Scans of pages into rows: repeating containers, single records, and tables.

A page is parsed once inside one Arrow batch step; only the wanted fields are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.functions import shapes
from gleanery.sources import dom
from gleanery.sources.structured import Page


@dataclass(frozen=True)
class Field:
    """One column of a scan: a selector inside the container and what to read there."""

    name: str
    selector: str | tuple[str, ...] | None = None  # several lead through open shadow roots
    attribute: str = "text"
    attribute_name: str | None = None
    path: str | None = None
    multiple: bool = False


def price_like(n: dom.Node) -> bool:
    """A small element whose text looks_like_price()."""
    t = n.clean_text()
    return shapes.is_price(t) and len(n.elements()) <= 3


contaminated = shapes.is_contaminated


def narrowed(n: dom.Node, clean: str) -> str:
    """The first part of an element that holds no foreign fragment and shares the element kind of a clean value."""
    for x in n.walk():
        t = x.clean_text()
        if t and not x.elements() and not contaminated(t) and not price_like(x):
            return t
    return ""


def scan_page(html: str, container: str | None, fields: list[Field], base: str = "") -> list[dict[str, str]]:
    """One row for each container match (or one for the page), with later values held to what the first ones showed.

    A column whose first value is a price keeps to prices, current or struck through like
    the first one; a column whose first value is plain text drops embedded prices and
    counts. Rows without any value but positions are left out; positions count all
    containers, so gaps stay.
    """
    root, page = dom.parse(html), Page(html, base)
    containers = dom.select(root, container) if container else [dom.body(root)]
    struck: dict[str, bool | None] = {}
    clean: dict[str, bool] = {}
    rows = []
    for k, c in enumerate(containers, 1):
        row, real = {}, False
        for f in fields:
            if f.attribute == "position":
                row[f.name] = str(k)
                continue
            if f.attribute == "structured":
                row[f.name] = page.value(f.path or "")
                real = real or bool(row[f.name])
                continue
            n = c if not f.selector else dom.first(c, f.selector) if isinstance(f.selector, str) else dom.hop(c, f.selector)
            value = dom.read(n, f.attribute, c, f.attribute_name, base)
            if f.attribute == "text":
                if n is not None and value and f.name not in struck:
                    struck[f.name] = dom.struck_through(n) if price_like(n) else None
                role = struck.get(f.name)
                if role is not None and (n is None or not value or not price_like(n) or dom.struck_through(n) != role):
                    again = next((x for x in c.walk() if price_like(x) and not x.elements() and dom.struck_through(x) == role), None)
                    value = again.clean_text() if again else "" if n is not None and value and price_like(n) else value
                elif role is None and value:
                    clean.setdefault(f.name, not contaminated(value))
                    if clean[f.name] and contaminated(value):
                        value = narrowed(n, value)
            row[f.name] = value
            real = real or bool(value)
        if real or all(f.attribute == "position" for f in fields):
            rows.append(row)
    return rows


def scan(pages: DataFrame, container: str | None, fields: list[Field]) -> DataFrame:
    """page_id, row_no (1-based among the page's rows) and one string column for each field."""
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            ids, at, columns = [], [], {n: [] for n in names}
            for page, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for i, row in enumerate(scan_page(html or "", container, fields, url or ""), 1):
                    ids.append(page)
                    at.append(i)
                    for n in names:
                        columns[n].append(row[n])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int32()), *(pa.array(columns[n], pa.string()) for n in names)], ["page_id", "row_no", *names])

    schema = "page_id long, row_no int, " + ", ".join(f"`{n}` string" for n in names)
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def detail_record(html: str, fields: list[Field], base: str = "") -> dict:
    """One record of a page; fields with `multiple` give every value that is not empty."""
    page = Page(html, base)
    root = dom.body(dom.parse(html)) if any(f.attribute not in ("position", "structured") for f in fields) else None
    out = {}
    for f in fields:
        if f.attribute == "position":
            out[f.name] = "1"
        elif f.attribute == "structured":
            out[f.name] = page.value(f.path or "")
        elif f.multiple:
            out[f.name] = [v for n in dom.select(root, f.selector) if (v := dom.read(n, f.attribute, None, f.attribute_name, base))]
        else:
            out[f.name] = dom.read(dom.first(root, f.selector), f.attribute, root, f.attribute_name, base)
    return out


def scan_details(pages: DataFrame, fields: list[Field]) -> DataFrame:
    """page_id, url and each field of one record for each page; fields with several values are joined by '; '."""
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            ids, urls, html = (batch.column(i) for i in range(3))
            found = [detail_record(h or "", fields, u or "") for h, u in zip(html.to_pylist(), urls.to_pylist(), strict=True)]
            text = lambda v: "; ".join(v) if isinstance(v, list) else v
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), urls.cast(pa.string()), *(pa.array([text(r[n]) for r in found], pa.string()) for n in names)], ["page_id", "url", *names])

    schema = "page_id long, url string, " + ", ".join(f"`{n}` string" for n in names)
    return pages.select("page_id", "url", "html").mapInArrow(run, schema)


def _flat(row: dom.Node) -> list[dom.Node]:
    out = []
    for cell in row.elements():
        span = int(m[0]) if (m := re.match(r"\d+", cell.attrs.get("colspan", ""))) else 1
        out += [cell] * (span if 0 < span < 100 else 1)
    return out


def table_cells(html: str) -> list[tuple[int, str, int, int, str, str]]:
    """(table, row group, row, column, name, value) of every table's cells.

    Rows of one element and class signature form a group of two at least; a header names
    the columns only where the counts agree; spans over columns repeat the cell.
    """
    root, out = dom.parse(html), []
    for t, table in enumerate(n for n in root.walk() if n.tag == "table"):
        rows = [n for n in table.walk() if n.tag == "tr" and next(a for a in n.ancestors() if a.tag == "table") is table]
        body = [r for r in rows if not any(a.tag == "thead" for a in r.ancestors())]
        heads = [c for r in rows if r not in body for c in r.elements()]
        groups: dict[str, list[dom.Node]] = {}
        for r in body:
            groups.setdefault(".".join([r.tag, *sorted(r.classes())]) + ">" + ",".join(c.tag for c in r.elements()), []).append(r)
        for sign, group in groups.items():
            if len(group) < 2 or len(body) < 2:
                continue
            width, names, used = len(_flat(group[0])), [], set()
            for i in range(width):
                base = (heads[i].clean_text() if len(heads) == width else "") or f"Column {i + 1}"
                name, n = base, 2
                while name in used:
                    name, n = f"{base} {n}", n + 1
                used.add(name)
                names.append(name)
            for k, r in enumerate(group, 1):
                cells = _flat(r)
                out += [(t, sign, k, i + 1, names[i], cells[i].clean_text() if i < len(cells) else "") for i in range(width)]
    return out


def scan_tables(pages: DataFrame) -> DataFrame:
    """page_id, table_no, row_group, row_no, column_no, name, value of all cells of all tables."""
    kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["page_id", "table_no", "row_group", "row_no", "column_no", "name", "value"]

    def run(batches):
        for batch in batches:
            rows = [(p, *c) for p, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for c in table_cells(h or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, table_no int, row_group string, row_no int, column_no int, name string, value string")
