"""A small document tree over the standard library's HTML tokenizer, with a CSS subset.

Static markup only: no scripts run, nothing is measured, and of shadow roots only declared ones exist.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urljoin

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
IMPLIED = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"}}
SCOPE = frozenset("html body table ul ol dl select template".split())
MOST_REMEMBERED = 4096  # characters of a text that is kept; longer ones are read anew, so that deep pages stay small
SPACE = re.compile(r"[\s﻿]+")


class Node:
    """An element. What is asked of it again and again is worked out once: a parsed tree never changes."""

    __slots__ = ("tag", "attrs", "parent", "children", "order", "last", "tree", "_elements", "_text", "_classes")

    def __init__(self, tag: str, attrs: dict, parent: Node | None, order: int, tree: list[Node]):
        self.tag, self.attrs, self.parent, self.children, self.order = tag, attrs, parent, [], order
        self.last, self.tree = order, tree  # elements are made in page order, so those below one follow it up to its last
        self._elements = self._text = self._classes = None

    def walk(self) -> list[Node]:
        """All elements below, in page order."""
        return self.tree[self.order + 1 : self.last + 1]

    def elements(self) -> list[Node]:
        if self._elements is None:
            self._elements = [c for c in self.children if isinstance(c, Node)]
        return self._elements

    def text(self) -> str:
        return "".join(c.text() if isinstance(c, Node) else c for c in self.children)

    def clean_text(self) -> str:
        if self._text is not None:
            return self._text
        clean = SPACE.sub(" ", self.text()).strip()
        if len(clean) <= MOST_REMEMBERED:
            self._text = clean
        return clean

    def classes(self) -> list[str]:
        if self._classes is None:
            self._classes = (self.attrs.get("class") or "").split()
        return self._classes

    def ancestors(self):
        n = self.parent
        while n is not None:
            yield n
            n = n.parent

    def inner_html(self) -> str:
        return "".join(c.outer_html() if isinstance(c, Node) else c.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") if self.tag not in ("script", "style") else c for c in self.children)

    def outer_html(self) -> str:
        attrs = "".join(f' {k}="{(v or "").replace("&", "&amp;").replace(chr(34), "&quot;")}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>" + ("" if self.tag in VOID else f"{self.inner_html()}</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tree: list[Node] = []
        self.root = self.at = Node("#document", {}, None, 0, self.tree)
        self.tree.append(self.root)

    def updatepos(self, i, j):
        return j  # nobody asks for line numbers

    def _close(self, tags: set[str] | frozenset[str], stop: frozenset[str]) -> None:
        n, last = self.at, None
        while n is not self.root and n.tag not in stop:
            if n.tag in tags:
                last = n
            n = n.parent
        if last is not None:
            self.at = last.parent

    def handle_starttag(self, tag, attrs):
        if tag in ENDS_P:
            self._close({"p"}, frozenset(("td", "th", "button", "table")))
        if tag in IMPLIED:
            self._close(IMPLIED[tag], SCOPE)
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.at, len(self.tree), self.tree)
        self.tree.append(node)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag and tag in ("svg", "path", "g", "use", "circle", "rect"):
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n is not self.root and n.tag != tag:
            n = n.parent
        if n is not self.root:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    for n in reversed(b.tree[1:]):
        n.parent.last = max(n.parent.last, n.last)
    return b.root


def body(root: Node) -> Node:
    return next((n for n in root.walk() if n.tag == "body"), root)


def text_content(html: str) -> str:
    """The text of a fragment, as its document's body has it."""
    root = parse(html)
    return body(root).text()


# --- selectors

_PART = re.compile(r"(?P<tag>\*|[A-Za-z][\w-]*)|\#(?P<id>[\w-]+)|\.(?P<cls>(?:\\.|[\w-])+)|\[(?P<attr>[\w:-]+)(?:(?P<op>[~^$*|]?=)(?P<q>[\"']?)(?P<val>.*?)(?P=q))?\]|:(?P<pseudo>nth-of-type|nth-child)\((?P<n>\d+)\)|:(?P<first>first-child|last-child)")


@lru_cache(maxsize=512)
def _compiled(selector: str):
    """Alternatives, each a list of (combinator, tests)."""
    out = []
    for alternative in re.split(r",(?![^\[]*\])", selector):
        steps, combinator = [], " "
        for token in re.findall(r"\s*>\s*|\s+|(?:\[[^\]]*\]|\([^)]*\)|[^\s>\[(])+", alternative.strip()):
            if token.strip() in ("", ">"):
                combinator = token.strip() or " "
                continue
            tests, end = [], 0
            for m in _PART.finditer(token):
                if m.start() != end:
                    raise ValueError(f"selector not supported: {selector!r}")
                test = {k: v for k, v in m.groupdict().items() if v is not None}
                tests.append(test | {"tag": test["tag"].lower()} if "tag" in test else test | {"cls": test["cls"].replace("\\", "")} if "cls" in test else test)
                end = m.end()
            if end != len(token):
                raise ValueError(f"selector not supported: {selector!r}")
            steps.append((combinator, tests))
            combinator = " "
        if not steps:
            raise ValueError(f"selector not supported: {selector!r}")
        out.append(steps)
    return out


def _passes(n: Node, tests: list[dict]) -> bool:
    for t in tests:
        if "tag" in t:
            if t["tag"] != "*" and n.tag != t["tag"]:
                return False
        elif "id" in t:
            if n.attrs.get("id") != t["id"]:
                return False
        elif "cls" in t:
            if t["cls"] not in n.classes():
                return False
        elif "attr" in t:
            v = n.attrs.get(t["attr"].lower())
            if v is None:
                return False
            w = t.get("val")
            if w is not None and not {"=": v == w, "~=": w in v.split(), "^=": bool(w) and v.startswith(w), "$=": bool(w) and v.endswith(w), "*=": bool(w) and w in v, "|=": v == w or v.startswith(w + "-")}[t["op"]]:
                return False
        else:
            siblings = n.parent.elements() if n.parent else [n]
            if "pseudo" in t:
                same = [s for s in siblings if s.tag == n.tag] if t["pseudo"] == "nth-of-type" else siblings
                if same.index(n) + 1 != int(t["n"]):
                    return False
            elif siblings[0 if t["first"] == "first-child" else -1] is not n:
                return False
    return True


def _matches(n: Node, steps: list, scope: Node) -> bool:
    if not _passes(n, steps[-1][1]):
        return False
    if len(steps) == 1:
        return True
    up = n.ancestors() if steps[-1][0] == " " else iter([n.parent] if n.parent else [])
    return any(_matches(a, steps[:-1], scope) for a in up)


def _found(scope: Node, selector: str):
    """The elements below the scope that a selector matches; the rare tests come after the kind of element."""
    alternatives = _compiled(selector)
    if len(alternatives) > 1:
        yield from (n for n in scope.walk() if any(_matches(n, s, scope) for s in alternatives))
        return
    steps = alternatives[0]
    tag = next((t["tag"] for t in steps[-1][1] if "tag" in t), "*")
    for n in scope.walk():
        if (tag == "*" or n.tag == tag) and _matches(n, steps, scope):
            yield n


def select(scope: Node, selector: str) -> list[Node]:
    return list(_found(scope, selector))


def first(scope: Node, selector: str) -> Node | None:
    return next(_found(scope, selector), None)


# --- reading fields

LAZY = ("data-src", "data-original", "data-lazy-src", "data-lazy", "data-image")
_ICON = re.compile(r"\b(avatar|icon|logo|sprite|rating|star|badge|flag|spinner|loading|pixel|tracking|swatch|checkbox|radio-btn|arrow|chevron|caret)\b", re.I)


def hop(scope: Node, selectors: list[str]) -> Node | None:
    """The first element along a path of selectors (`:scope` is the start itself), each but the first inside the open shadow root of the element before it.

    Static markup states a shadow root as a template with shadowrootmode.
    """
    n: Node | None = scope
    for k, selector in enumerate(selectors):
        if k:
            n = next((c for c in n.elements() if c.tag == "template" and c.attrs.get("shadowrootmode") == "open"), None)
        n = (n if selector == ":scope" else first(n, selector)) if n is not None else None
        if n is None:
            return None
    return n


def resolve(url: str, base: str) -> str:
    try:
        return urljoin(base, url) if url else ""
    except ValueError:
        return url


def placeholder(url: str) -> bool:
    return not url or bool(re.match(r"data:image/gif;base64,R0lGODlhAQAB", url, re.I)) or (url[:5].lower() == "data:" and len(url) < 100) or bool(re.search(r"\b(blank|placeholder|spacer|1x1|transparent|noimage|no[-_]?photo|dummy)\b", url, re.I))


def srcset(value: str) -> list[tuple[str, int | None, float | None]]:
    out = []
    for entry in value.split(","):
        url, _, rest = entry.strip().partition(" ")
        d = rest.split()[0] if rest.split() else ""
        if url:
            out.append((url, int(d[:-1]) if re.fullmatch(r"\d+[wW]", d) else None, float(d[:-1]) if re.fullmatch(r"\d+(\.\d+)?[xX]", d) else None))
    return out


def best_of_srcset(value: str) -> str:
    """The widest, else the densest, else the first; of equals the first listed."""
    found = srcset(value or "")
    for k in (1, 2):
        if sized := [c for c in found if c[k] is not None]:
            return max(sized, key=lambda c: c[k])[0]
    return found[0][0] if found else ""


def image_url(n: Node | None, base: str) -> str:
    """The best address of an image element, or of the first image in an element."""
    if n is None:
        return ""
    if n.tag != "img":
        return next((u for i in n.walk() if i.tag == "img" and (u := image_url(i, base))), "")
    sources = [best_of_srcset(n.attrs.get("srcset", "")), n.attrs.get("src", ""), *(n.attrs.get(a, "") for a in LAZY), best_of_srcset(n.attrs.get("data-srcset", ""))]
    if n.parent is not None and n.parent.tag == "picture":
        sources += [best_of_srcset(s.attrs.get("srcset") or s.attrs.get("data-srcset", "")) for s in n.parent.elements() if s.tag == "source"]
    return next((resolve(u, base) for u in sources if not placeholder(u)), "")


def best_image(container: Node, base: str) -> str:
    """The likeliest picture of a container: large, early, no icon and not hidden; it never looks outside."""
    best, top = "", -500.0
    for k, n in enumerate(i for i in container.walk() if i.tag == "img"):
        if not (url := image_url(n, base)):
            continue
        size = [int(m[0]) if (m := re.match(r"\d+", n.attrs.get(a, ""))) else 0 for a in ("width", "height")]
        score = min(size[0] * size[1] / 100, 400) - k
        hints = " ".join([n.attrs.get("class", ""), n.attrs.get("alt", ""), url, *(a.attrs.get("class", "") for a in n.ancestors() if a.order > container.order)])
        score -= 200 * bool(_ICON.search(hints)) + 150 * (0 < min(size) < 40)
        score -= 1000 * ("hidden" in n.attrs or "display:none" in n.attrs.get("style", "").replace(" ", ""))
        if score > top:
            best, top = url, score
    return best


def read(n: Node | None, attribute: str, container: Node | None = None, name: str | None = None, base: str = "") -> str:
    """One field of an element: text, html, href, src, alt or a named attribute; missing is ''."""
    if attribute == "href":
        if n is None:
            return ""
        link = n if n.tag in ("a", "area") else next((a for a in n.ancestors() if a.tag == "a" and "href" in a.attrs), None) or first(n, "a[href]")
        raw = (link.attrs.get("href") or "") if link is not None else ""
        return "" if not raw or raw.strip().lower().startswith("javascript:") else resolve(raw.strip(), base)
    if attribute == "src":
        if n is not None and n.tag == "iframe":
            return resolve(n.attrs.get("src", ""), base)
        return image_url(n, base) or (best_image(container, base) if container is not None else "")
    if n is None:
        return ""
    if attribute == "alt":
        return (n if n.tag == "img" else first(n, "img") or n).attrs.get("alt", "")
    if attribute == "attr":
        return n.attrs.get((name or "").lower(), "")
    return n.inner_html() if attribute == "html" else n.clean_text()


def struck_through(n: Node) -> bool:
    return any(x.tag in ("del", "s", "strike") or "line-through" in x.attrs.get("style", "") for x in (n, *n.ancestors()))
