"""Main text of web pages by minimum-cut labelling of their text blocks.

A page is scanned once into blocks. A classifier gives each block the odds of being
content from its elements, names, links and length; the costs of either label become
terminal capacities. Blocks that follow each other and blocks of one container are tied
by smoothness edges that weaken with their distance in the tree. The maximum flow
separates content from the rest. No edge ties a block of a known menu, advert or the
like to one outside it: such neighbours say nothing about each other.

Time and memory are linear in the page, but for the flow: a block whose own costs
outweigh its edges is settled at once, and only what is left is augmented.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm import textkit as tk

_TAG = re.compile(r"<(?:!--|([!?])|(/?)([A-Za-z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(>?))")
_COMMENT_END = re.compile(r"--!?>")
_NAMES = re.compile(r"(?i)(?<![\w-])(class|id|role|aria-label|itemprop)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))")
_HIDDEN = re.compile(r"(?i)(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*(?:display\s*:\s*none|visibility\s*:\s*hidden))")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Elements of HTML by their role here.
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li legend main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul br".split())
OUTSIDE = frozenset("nav footer aside form button select menu dialog head svg math object audio video canvas search fieldset".split())
SHUTS_P = frozenset("button table td th caption object".split())
SHUTS_KIND = frozenset("ul ol dl table select div section".split())
INNER = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote".split())
CLOSES_P = BLOCK - {"br", "body", "html", "head"}
SAME_KIND = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTENT_NAMES = frozenset("article articlebody content main post entry story body text maincontent".split())
BOILER_NAMES = frozenset(
    "ad ads advert adverts advertisement adslot banner sponsor sponsored promo promotion sidebar side aside menu nav navbar navigation breadcrumb breadcrumbs footer foot header masthead comment comments commentlist "
    "reply replies disqus respond cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login register search share sharing social related recommended recommendation "
    "widget toolbar pagination pager skip copyright legal disclaimer form contentinfo complementary".split()
)

MODIFIERS = re.compile(r"(?i)(?<![A-Za-z])(?:has|with|no|without)[-_][\w-]+")  # "has-sidebar" is said of a wrapper, not of a sidebar

PULL, NAMED, FORM, NEAR, SIBLING = 6.0, -5.0, -4.0, 0.8, 0.6


class Block:
    """A run of text between block boundaries; `step` is its distance from the block before it in the tree."""

    __slots__ = ("text", "linked", "container", "step", "tag", "bias")

    def __init__(self, text, linked, container, step, tag, bias):
        self.text, self.linked, self.container, self.step, self.tag, self.bias = text, linked, container, step, tag, bias


class Open:
    """An open element: its number, the container that blocks in it belong to, and where on the stack the nearest p in scope and the nearest element that a list or table item asks for are."""

    __slots__ = ("tag", "bias", "number", "container", "p", "kind")

    def __init__(self, tag, bias, number, container, p, kind):
        self.tag, self.bias, self.number, self.container, self.p, self.kind = tag, bias, number, container, p, kind


def _bias(tag: str, attrs: str, inside: float, in_article: bool) -> float:
    """What an element says of the text in it, as log odds; `inside` is its parent's."""
    if tag == "form":
        return min(inside, FORM)
    if tag in OUTSIDE or tag == "header" and not in_article:
        return -PULL
    bias = inside
    if tag in ("article", "main"):
        # some sites wrap the whole page in a form, or name its wrapper after a part of it
        bias = max(bias, 3.0) if inside >= FORM or tag == "main" and inside >= NAMED else inside
    if attrs and "=" in attrs:
        names = " ".join(a or b or c for _, a, b, c in _NAMES.findall(attrs))
        if names:
            said = set(_WORD.findall(_CAMEL.sub(" ", MODIFIERS.sub(" ", names)).lower()))
            boiler = said & BOILER_NAMES
            if boiler and tag not in ("html", "body") and not (boiler == {"header"} and said & CONTENT_NAMES):
                return min(inside, NAMED)
            if said & CONTENT_NAMES and bias >= 0:
                bias = max(bias, 2.0)
    if attrs and _HIDDEN.search(attrs):
        return -PULL
    return bias


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Unclosed elements end where HTML ends them; an unfinished tag at the end is no text."""
    out: list[Block] = []
    stack = [Open("", 0.0, 0, 0, 0, 0)]
    open_: Counter[str] = Counter()
    parent, depth = [0], [0]
    parts: list[str] = []
    linked, last, in_link, at, size = 0, 0, False, 0, len(page)

    def step(a: int, b: int) -> int:
        """Tree distance. Over a page this walks each element twice at most, as blocks come in the order of the tree."""
        n = 0
        while a != b:
            n += 1
            if depth[a] >= depth[b]:
                a = parent[a]
            else:
                b = parent[b]
        return n

    def flush():
        nonlocal linked, last
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                top = stack[-1]
                out.append(Block(text, linked, top.container, step(last, top.number), top.tag, top.bias))
                last = top.number
            parts.clear()
        linked = 0

    def words(raw: str):
        nonlocal linked
        if raw:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if in_link:
                linked += len(text.strip())

    def close(k: int):
        for e in stack[k:]:
            open_[e.tag] -= 1
        del stack[k:]

    def push(tag: str, bias: float):
        top, k, number = stack[-1], len(stack), len(parent)
        parent.append(top.number)
        depth.append(depth[top.number] + 1)
        p = k if tag == "p" else 0 if tag in SHUTS_P else top.p
        stack.append(Open(tag, bias, number, top.container if tag in INNER else number, p, k if tag in SAME_KIND or tag in SHUTS_KIND else top.kind))
        open_[tag] += 1

    while at < size:
        m = _TAG.search(page, at)
        if not m:
            words(page[at:])
            break
        words(page[at : m.start()])
        at = m.end()
        if m[3] is None:
            end = page.find(">", at - 1) if m[1] else ((e := _COMMENT_END.search(page, at)) and e.start()) or -1
            if not m[1] and page[at : at + 1] == ">":
                at += 1
            else:
                at = size if end < 0 else end + 1 if m[1] else e.end()
            continue
        if not m[5]:
            break
        tag, attrs = m[3].lower(), m[4]
        if m[2]:
            if tag == "a":
                in_link = False
            elif tag in BLOCK or tag in OUTSIDE:
                flush()
                if open_[tag] > 0:
                    k = len(stack) - 1
                    while stack[k].tag != tag:
                        k -= 1
                    close(k)
                    in_link = False
            elif open_[tag] > 0:
                k = len(stack) - 1
                while stack[k].tag != tag and stack[k].tag not in BLOCK:
                    k -= 1
                if stack[k].tag == tag:  # what else was open inside it stays open
                    open_[tag] -= 1
                    del stack[k]
                    for j in range(k, len(stack)):  # places on the stack move down
                        e = stack[j]
                        e.p -= e.p > k
                        e.kind -= e.kind > k
            continue
        if tag in RAW:
            end = re.compile(rf"(?i)</{tag}(?=[\s/>])").search(page, at)
            at = size if not end else page.find(">", end.end()) + 1 or size
            continue
        if tag == "a":
            in_link = True
            continue
        if tag in BLOCK or tag in OUTSIDE:
            flush()
            if tag in ("br", "hr"):
                continue
            if tag in CLOSES_P and stack[-1].p:
                close(stack[-1].p)
            if tag in SAME_KIND:
                k = stack[-1].kind
                while k and stack[k].tag not in SAME_KIND[tag]:
                    k = 0 if stack[k].tag in SHUTS_KIND else stack[k - 1].kind
                if k:
                    close(k)
        elif tag in VOID or attrs.endswith("/") or not attrs:
            continue  # plain inline markup says nothing
        bias = _bias(tag, attrs, stack[-1].bias, open_["article"] > 0)
        if tag in BLOCK or tag in OUTSIDE or bias != stack[-1].bias:
            if tag not in BLOCK and tag not in OUTSIDE:
                flush()
            push(tag, bias)
    flush()
    return out


def odds(b: Block) -> float:
    """Log odds that a block is content: the classifier."""
    n = len(b.text)
    out = b.bias + 0.35 * math.log(n / 40 + 0.5)
    if b.linked > n / 2:
        out -= 2.5 * b.linked / n
    if b.text[-1] in ".!?\"”…":
        out += 0.5
    if b.tag in ("h1", "h2", "h3", "p", "pre", "blockquote"):
        out += 0.5
    return out if b.bias else out - 0.5


def min_cut(pull: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """True for nodes on the source's side of a minimum cut.

    pull[i] > 0 ties node i to the source, < 0 to the sink; edges cost their weight in
    either direction. Costs are rounded to millionths. Nodes that no set of their edges
    can turn are settled first, and what they cost their neighbours is added to those;
    the others go through a maximum flow by blocking flows.
    """
    n = len(pull)
    need = [round(p * 1e6) for p in pull]
    near: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        cost = round(w * 1e6)
        near[a].append((b, cost))
        near[b].append((a, cost))
    weight = [sum(w for _, w in x) for x in near]
    side: list[bool | None] = [None] * n
    sure = [i for i in range(n) if abs(need[i]) >= weight[i]]
    while sure:
        i = sure.pop()
        if side[i] is not None:
            continue
        side[i] = need[i] > 0
        for j, w in near[i]:
            if side[j] is None:
                need[j] += w if side[i] else -w
                weight[j] -= w
                if abs(need[j]) >= weight[j]:
                    sure.append(j)
    open_ = [i for i in range(n) if side[i] is None]
    if open_:
        at = {i: k for k, i in enumerate(open_)}
        inner = [(at[a], at[b], round(w * 1e6)) for a, b, w in edges if side[a] is None and side[b] is None]
        for i, s in zip(open_, _source_side([need[i] for i in open_], inner), strict=True):
            side[i] = s
    return [bool(s) for s in side]


def _source_side(need: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """The nodes that the source still reaches after a maximum flow; whole-number costs."""
    n = len(need)
    source, sink = n, n + 1
    to, cap, out = [], [], [[] for _ in range(n + 2)]

    def tie(a: int, b: int, there: int, back: int) -> None:
        for x, y, c in ((a, b, there), (b, a, back)):
            out[x].append(len(to))
            to.append(y)
            cap.append(c)

    for i, p in enumerate(need):
        if p > 0:
            tie(source, i, p, 0)
        elif p < 0:
            tie(i, sink, -p, 0)
    for a, b, w in edges:
        tie(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            v = queue.popleft()
            for e in out[v]:
                if cap[e] and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried, path, v = [0] * (n + 2), [], source
        while True:
            if v == sink:
                flow = min(cap[e] for e in path)
                short = len(path)
                for k, e in enumerate(path):
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                    if not cap[e] and k < short:
                        short = k
                v = to[path[short] ^ 1]
                del path[short:]
                continue
            while tried[v] < len(out[v]):
                e = out[v][tried[v]]
                if cap[e] and level[to[e]] == level[v] + 1:
                    break
                tried[v] += 1
            else:
                if v == source:
                    break
                v = to[path.pop() ^ 1]
                tried[v] += 1
                continue
            path.append(e)
            v = to[e]


def label(page: list[Block]) -> list[bool]:
    """Whether each block is content."""
    pull = [odds(b) for b in page]
    edges, last = [], {}
    for i, b in enumerate(page):
        known = b.bias <= FORM
        if i and known == (page[i - 1].bias <= FORM):
            edges.append((i - 1, i, NEAR / (1 + b.step)))
        if b.container in last and known == (page[last[b.container]].bias <= FORM):
            edges.append((last[b.container], i, SIBLING))
        last[b.container] = i
    return min_cut(pull, edges)


def main_text(page: str | None) -> str:
    found = blocks(page) if page else []
    return " ".join(b.text for b, keep in zip(found, label(found), strict=True) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Page by page without shuffle. Null or empty html, and pages without content, give an
    empty text; repeated rows are judged each for itself; extra columns are ignored; an
    empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            ids, urls, html = tk.fields(batch, "page_id", "url", "html")
            texts = [main_text(x) for x in html.to_pylist()]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), urls.cast(pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return tk.small_batches(tk.exact(pages, "page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
