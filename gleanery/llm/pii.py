"""Personal data: pattern detection, and a second look through offset-preserving transducers.

The transducers rewrite disguises (homoglyphs, invisible characters, spelled digits,
"at" and "dot" in words or brackets) into plain characters. Each keeps the ranges it
rewrote, so that any range of its output can be taken back to its input. Identifiers found in the rewritten text are
mapped back to the source. They only add spans: what the patterns find in the text as it
stands is always kept.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm import textkit as tk

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can begin only where a digit run begins: if that fails, so does every later start in the run.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches, found from each @ in linear time."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """Every match of the four patterns, by kind and start."""
    out = emails(text)
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


# Characters that look like Latin ones, and the Latin characters.
_LOOKS = str.maketrans("аеорсухіјѕԁһԛԝАВЕКМНОРСТУХІЈЅαονικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhqwABEKMHOPCTYXIJSaovikptuABEZHIKMNOPTYX")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_HIDDEN = re.compile(f"[{_INVISIBLE}]+")
_NUMERALS = (
    "zero oh zéro null cero", "one un une eins uno", "two deux zwei dos", "three trois drei tres", "four quatre vier cuatro",
    "five cinq fünf cinco", "six sechs seis", "seven sept sieben siete", "eight huit acht ocho", "nine neuf neun nueve",
)
_DIGIT_WORDS = {w: str(d) for d, words in enumerate(_NUMERALS) for w in words.split()}
_ATS, _DOTS = "at|arroba|arobase|ät", "dot|punkt|point|punto"
_SPELT = "|".join(sorted(_DIGIT_WORDS, key=len, reverse=True))
_SPOKEN = re.compile(rf"(?i)(?<![A-Za-z])(?:{_SPELT})(?:[ ,.-]{{1,2}}(?:{_SPELT}|[0-9]))*[ ,.-]{{1,2}}(?:{_SPELT})(?![A-Za-z])")
_PART = rf"(?:{_SPELT}|[0-9]{{1,3}})(?:[ -](?:{_SPELT}|[0-9])){{0,2}}"
_SPOKEN_DOT = re.compile(rf"(?i)[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}}")
_SPOKEN_IP = re.compile(rf"(?i)(?<![A-Za-z0-9])(?:{_PART}{_SPOKEN_DOT.pattern[4:]}){{3}}{_PART}(?![A-Za-z0-9])")
_SPOKEN_ONE = re.compile(rf"(?i){_SPELT}|[0-9]")
_PLUS = re.compile(r"(?i)(?<![A-Za-z])plus[ -]+(?=[0-9])")
_AT = re.compile(rf"(?i)[ \t]{{0,3}}(?:\[[ \t]{{0,3}}(?:{_ATS}|@)[ \t]{{0,3}}\]|\([ \t]{{0,3}}(?:{_ATS}|@)[ \t]{{0,3}}\)|\{{[ \t]{{0,3}}(?:{_ATS}|@)[ \t]{{0,3}}\}}|<[ \t]{{0,3}}(?:{_ATS}|@)[ \t]{{0,3}}>|(?<![-A-Za-z0-9])[_-]at[_-](?![-A-Za-z0-9])|(?<=[ \t])@(?=[ \t]))[ \t]{{0,3}}")
_DOT = re.compile(rf"(?i)[ \t]{{0,3}}(?:\[[ \t]{{0,3}}(?:{_DOTS}|\.)[ \t]{{0,3}}\]|\([ \t]{{0,3}}(?:{_DOTS}|\.)[ \t]{{0,3}}\)|\{{[ \t]{{0,3}}(?:{_DOTS}|\.)[ \t]{{0,3}}\}})[ \t]{{0,3}}")
_WORDY_AT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{_ATS})[ \t]{{1,3}}(?=[A-Za-z0-9-]{{1,63}}(?:[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}}|\.)[A-Za-z0-9-])")
_WORDY_DOT = re.compile(rf"(?i)(?<=[A-Za-z0-9])[ \t]{{1,3}}(?:{_DOTS})[ \t]{{1,3}}(?=[A-Za-z0-9])")
# A spoken address with a plain dot, "john at example.com": what comes after "at", and the words before it.
_SPELLED_HOST = re.compile(rf"(?i)[A-Za-z0-9-]{{1,63}}[ \t]{{1,3}}(?:{_DOTS})[ \t]")
_PLAIN_HOST = re.compile(r"[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}?\.[A-Za-z]{2,24}(?![A-Za-z0-9-])")
_BEFORE = re.compile(r"(?:([^\W_][\w'’-]{0,30})([ \t]{1,3})|([^ \t]?)[ \t]*)(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})\Z")
_CUES = frozenset("mail mails email emails e-mail courriel correo contact contacts contacto kontakt write writes reach ask address adresse dirección to an à a is ist est es via cc bcc from von de i'm am plus and und et y or oder ou dot punkt point punto".split())
_NO_MAILBOX = frozenset(
    "look looks looked looking see seen find found read buy bought order ordered shop shopping sold sell available open hosted live lives living work works worked working meet met arrive arrived stay stayed start started visit visited be is are was were been am "
    "me us him her them you it i we he she they here there online now not only one more all and or but stop stopped click aim aimed point pointed laugh laughed stare stared shout shouted eat ate play played down up out back over mail email e-mail contact write reach".split()
)
# Each finds all that its transducers can change, in lower-cased text; letters that only the expressions take for i, k or s are left to _FOLDED.
_MARKED = re.compile(rf"[\[({{<][ \t]{{0,3}}(?:{_ATS}|{_DOTS}|@|\.)[ \t]{{0,3}}[\])}}>]|[_-]at[_-]|[ \t]@[ \t]")
_SPELT_PAIR = re.compile(rf"[^a-z](?:{_SPELT})[ ,.-]{{1,2}}(?:{_SPELT}|[0-9])(?![a-z])")
_FOLDED = re.compile("[İıſK]")
_RANGES = ((0x00AD, 0x00AD), (0x0370, 0x052F), (0x0660, 0x0669), (0x06F0, 0x06F9), (0x0966, 0x096F), (0x200B, 0x200D), (0x2060, 0x2060), (0x2460, 0x2468), (0xFEFF, 0xFEFF), (0xFF01, 0xFF5E), (0x1D400, 0x1D7FF))
_ODD = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _RANGES) + "]")


def calls(text: str) -> bool:
    """Whether a transducer may change the text; true whenever one does, so that skipping the others loses nothing."""
    if not text.isascii() and (_ODD.search(text) or _FOLDED.search(text)):
        return True
    low = text.lower()
    return (
        bool(_MARKED.search(low))
        or "plus" in low and bool(_PLUS.search(text))
        or any(d in low for d in _DOTS.split("|")) and bool(_WORDY_DOT.search(text))
        or any(a in low for a in _ATS.split("|")) and bool(_WORDY_AT.search(text))
        or bool(_SPELT_PAIR.search(f" {low}"))
    )


def addressed(text: str, at: int, host: int) -> bool:
    """Whether the "at" between `at` and `host` stands in an address, judged by the words beside it alone.

    With a spelled dot it does. With a plain one the host must end in letters, and the word
    before must look like a mailbox: it has a digit or mark in it, or begins its clause or
    follows a word such as "mail", and is none that "at" follows in prose ("looked at home.com").
    """
    if _SPELLED_HOST.match(text, host):
        return True
    if not _PLAIN_HOST.match(text, host):
        return False
    m = _BEFORE.search(text[max(at - 100, 0) : at])
    if not m:
        return False
    name, before = m[4].lower(), (m[1] or "").lower()
    if name in _NO_MAILBOX:
        return False
    return any(c in "0123456789._%+" for c in name) or (before in _CUES if m[1] else True)


class Transducer:
    """What one pass over a text wrote, and the way back.

    `edits` are ranges of the input, in order and without overlap, with what they became;
    all else is copied. Only the edits are kept, in arrays of 8 bytes a number, so a long
    text with few disguises costs little more than itself.
    """

    def __init__(self, text: str, edits: Iterable[tuple[int, int, str]]):
        self.in_start, self.in_end, self.out_start, self.out_end = (array("q") for _ in range(4))
        out, at, size = [], 0, 0
        for a, b, said in edits:
            out += [text[at:a], said]
            size += a - at
            self.in_start.append(a)
            self.in_end.append(b)
            self.out_start.append(size)
            size += len(said)
            self.out_end.append(size)
            at = b
        self.text = "".join([*out, text[at:]]) if at or out else text

    def touched(self, a: int, b: int) -> bool:
        """Whether the output range has anything rewritten in it; a deletion must lie inside."""
        i = max(bisect_right(self.out_start, a) - 1, 0)
        while i < len(self.out_start) and self.out_start[i] < b:
            if self.out_end[i] > a and (self.out_end[i] > self.out_start[i] or self.out_start[i] > a):
                return True
            i += 1
        return False

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The input range of an output range; a rewritten character stands for all it was written for."""

        def place(p: int, inside: array, beyond: int) -> int:
            i = bisect_right(self.out_start, p) - 1
            if i < 0:
                return p + beyond
            return inside[i] if p < self.out_end[i] else p + beyond + self.in_end[i] - self.out_end[i]

        return place(a, self.in_start, 0), place(b - 1, self.in_end, 1)


class Plainer(Transducer):
    """The pass over single characters: one for one, so that no place moves."""

    def __init__(self, text: str):
        self.before, self.text = text, _ODD.sub(lambda m: _PLAIN.get(m[0], m[0]), text)

    def touched(self, a: int, b: int) -> bool:
        return self.text[a:b] != self.before[a:b]

    def source(self, a: int, b: int) -> tuple[int, int]:
        return a, b


def _plain(c: str) -> str:
    if (x := c.translate(_LOOKS)) != c:
        return x
    if unicodedata.category(c) == "Nd":
        return str(unicodedata.digit(c))
    x = unicodedata.normalize("NFKC", c)
    return x if len(x) == 1 and x.isascii() else c


# By rule: every character that _ODD knows and that reads as one ASCII character.
_PLAIN = {c: x for lo, hi in _RANGES for c in map(chr, range(lo, hi + 1)) if c not in _INVISIBLE and (x := _plain(c)) != c}


def _digits(said: str) -> str:
    return "".join(_DIGIT_WORDS.get(w.lower(), w) for w in _SPOKEN_ONE.findall(said))


def _spoken_ip(m: re.Match) -> str:
    return ".".join(_digits(x) for x in _SPOKEN_DOT.split(m[0]))


def _invisible(text: str):
    return ((m.start(), m.end(), "") for m in _HIDDEN.finditer(text))


def _rewrites(pattern: re.Pattern, said, when=None):
    def edits(text: str):
        for m in pattern.finditer(text):
            if when is None or when(text, m.start(), m.end()):
                yield m.start(), m.end(), said if isinstance(said, str) else said(m)

    return edits


_spoken = _rewrites(_SPOKEN_IP, _spoken_ip)
PASSES = (
    _invisible,
    lambda text: _spoken(text) if len(_SPOKEN_DOT.findall(text)) > 2 else (),
    _rewrites(_SPOKEN, lambda m: _digits(m[0])),
    _rewrites(_PLUS, "+"),
    _rewrites(_WORDY_AT, "@", addressed),
    _rewrites(_AT, "@"),
    _rewrites(_DOT, "."),
    _rewrites(_WORDY_DOT, "."),
)


def deobfuscate(text: str) -> list[Transducer]:
    """The transducers in turn: characters, then spelled addresses and digits, plus, at, dot. Those that changed nothing are left out."""
    out = [first] if _ODD.search(text) and (first := Plainer(text)).text != text else []
    for edits in PASSES:
        if (t := Transducer(text := out[-1].text if out else text, edits(text))).in_start:
            out.append(t)
    for t in out[1:-1]:
        t.text = ""
    return out


class Disjoint:
    """The base spans of each kind, which never overlap within it, for looking up what meets a range."""

    def __init__(self, base: list[Span]):
        self.start, self.end = {k: [] for k in KINDS}, {k: [] for k in KINDS}
        for kind, a, b in sorted(base, key=lambda s: s[1]):
            self.start[kind].append(a)
            self.end[kind].append(b)

    def allow(self, kind: str, a: int, b: int) -> bool:
        """Whether the range is clear of all spans, or wider than those of its kind that it meets and holds them whole."""
        for k in KINDS:
            lo, hi = bisect_right(self.end[k], a), bisect_left(self.start[k], b)
            if lo < hi and (k != kind or self.start[k][lo] < a or self.end[k][hi - 1] > b or (self.start[k][lo], self.end[k][lo]) == (a, b)):
                return False
        return True


def added(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, in source offsets: clear of the base spans, or around those of its kind."""
    if not calls(text):
        return []
    passes = deobfuscate(text)
    if not passes:
        return []
    out, known = [], Disjoint(base)
    for kind, a, b in detect(passes[-1].text):
        changed = False
        for t in reversed(passes):
            changed = changed or t.touched(a, b)
            a, b = t.source(a, b)
        if changed and known.allow(kind, a, b):
            out.append((kind, a, b))
    return out


def order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """Each span, or union of overlapping spans, becomes its (first) kind in brackets."""
    out, at = [], 0
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    for kind, a, b in merged:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def find_pii(documents: DataFrame) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end; offsets in code points, end exclusive) of each document.

    `base` has the pattern matches, `spans` those and what the transducers add. Row by
    row without shuffle: null and empty texts have no spans, repeated rows are judged each
    for itself, extra columns are ignored, an empty table gives no rows.
    """
    kind = "array<struct<kind:string,start:long,end:long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, texts = tk.fields(batch, "doc_id", "text")
            base = [order(detect(t)) if t else [] for t in texts.to_pylist()]
            both = [order(b + added(t, b)) if t else b for t, b in zip(texts.to_pylist(), base, strict=True)]
            columns = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in side], arrow) for side in (base, both)]
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *columns], ["doc_id", "base", "spans"])

    return tk.small_batches(tk.exact(documents, "doc_id", "text")).mapInArrow(run, f"doc_id long, base {kind}, spans {kind}")


def redact_documents(documents: DataFrame) -> DataFrame:
    """The same rows and columns with personal data replaced by its kind; n_chars, if present, is the new length. Null texts stay null."""
    names = documents.columns

    def run(batches):
        for batch in batches:
            columns = list(batch.columns)
            at = names.index("text")
            texts = [t and redact(t, (b := detect(t)) + added(t, b)) for t in columns[at].to_pylist()]
            columns[at] = pa.array(texts, columns[at].type)
            if "n_chars" in names:
                k = names.index("n_chars")
                columns[k] = pa.array([n if t is None else len(t) for n, t in zip(columns[k].to_pylist(), texts, strict=True)], columns[k].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return tk.whole_rows(documents, run)
