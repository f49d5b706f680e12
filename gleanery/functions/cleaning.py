"""The 31 cleaning steps as Column expressions: step(value, options, context) for each type."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import numeric, urls
from gleanery.functions.text import W, WIDE, blank, col, collapse, let, number_text, options_list, quoted, strip, text

# What the steps know by name.
INVISIBLE = "​‌‍⁠﻿­"
CURRENCY_SYMBOLS = "$€£₺¥₹"
CURRENCY_CODES = r"(?i)\b(?:USD|EUR|GBP|TRY|JPY|INR)\b"
ENTITIES = dict(amp="&", lt="<", gt=">", quot='"', apos="'", nbsp=" ", copy="©", reg="®", trade="™", hellip="…", mdash="—", ndash="–", lsquo="‘", rsquo="’", ldquo="“", rdquo="”", euro="€", pound="£", yen="¥", cent="¢", deg="°", middot="·", bull="•")
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FULL_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
TRUE_VALUES, FALSE_VALUES = "yes,y,true,1,available,in stock", "no,n,false,0,unavailable,out of stock"

STEPS: dict[str, Callable[[Column, dict, dict], Column]] = {}


class StepError(ValueError):
    """A step's configuration is wrong; raised once, before any row is read."""


def step(name: str):
    def add(build):
        STEPS[name] = build
        return build

    return add


def java_regex(pattern: str, flags: str = "") -> str:
    """A script pattern for Java; raises StepError if it is no expression."""
    if not pattern:
        raise StepError("a pattern is required")
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z]\w*)>", r"(?P<\1>", pattern))
    except re.error as e:
        raise StepError(f"not a regular expression: {e}") from e
    pattern = pattern.replace(r"\s", W if "[" not in pattern else rf"{WIDE}") if r"\s" in pattern and "[" not in pattern else pattern
    on = "".join(f for f in "ims" if f in flags)
    return (f"(?{on})" if on else "") + pattern


def java_replacement(s: str) -> str:
    """$& and $1 of scripts, in Java's terms; other backslashes and dollars are literal."""
    out, i = [], 0
    while i < len(s):
        two = s[i : i + 2]
        if two == "$$":
            out.append("\\$")
        elif two == "$&":
            out.append("$0")
        elif re.fullmatch(r"\$\d", two):
            out.append(two)
        elif s[i] in "\\$":
            out.append("\\" + s[i])
            i -= 1
        else:
            out.append(s[i])
            i -= 1
        i += 2
    return "".join(out)


def replace_first(c: Column, pattern: str, replacement: str) -> Column:
    """Only the first match. The rest of the text is set aside behind a lazy prefix."""
    body, flags = pattern, ""
    if m := re.match(r"\(\?([ims]+)\)", pattern):
        body, flags = pattern[m.end() :], m[1]
    shifted = re.sub(r"(?<!\\)\$(\d)", lambda m: f"${int(m[1]) + 2}" if m[1] != "0" else "$2", replacement)
    back = re.sub(r"\\([1-9])", lambda m: f"\\{int(m[1]) + 2}", body)
    on = "".join(sorted({*flags, "s"})) if "s" in flags else flags
    return F.regexp_replace(c, f"(?{on or 's'})\\A((?s:.*?))({back})" if on else f"\\A((?s:.*?))({back})", f"$1{shifted}")


step("trim")(lambda c, o, x: strip(c))
step("collapseWhitespace")(lambda c, o, x: collapse(c))
step("removeLineBreaks")(lambda c, o, x: F.regexp_replace(c, "\r\n|\r|\n", " "))
step("normalizeLineBreaks")(lambda c, o, x: F.regexp_replace(c, "\r\n|\r", "\n"))
step("removeTabs")(lambda c, o, x: F.translate(c, "\t", " "))
step("removeInvisibleChars")(lambda c, o, x: F.translate(c, INVISIBLE, ""))


@step("normalizeUnicode")
def _unicode(c, o, x):
    form = "NFKC" if o.get("form") == "NFKC" else "NFC"

    @F.pandas_udf("string")
    def composed(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return F.when(c.rlike(r"[^\x00-\x7F]"), composed(c)).otherwise(c)


def decode_entities(s: str) -> str:
    """Numeric references and the known names, once; anything else stays."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name[0] == "#":
            code = int(name[2:], 16) if name[1] in "xX" else int(name[1:])
            return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]
        return ENTITIES.get(name.lower(), m[0])

    return re.sub(r"&(#x[0-9a-fA-F]+|#[0-9]+|[a-zA-Z]+);", one, s)


@step("decodeHtmlEntities")
def _entities(c, o, x):
    @F.pandas_udf("string")
    def decoded(s: pd.Series) -> pd.Series:
        return s.map(decode_entities, na_action="ignore")

    return F.when(c.contains("&"), decoded(c)).otherwise(c)


@step("stripHtml")
def _strip_html(c, o, x):
    from gleanery.sources.dom import text_content

    @F.pandas_udf("string")
    def stripped(s: pd.Series) -> pd.Series:
        return s.map(text_content, na_action="ignore")

    return F.when(c.rlike("[<>]"), collapse(stripped(c))).otherwise(c)


@step("removeCurrency")
def _remove_currency(c, o, x):
    bare = F.regexp_replace(F.translate(c, CURRENCY_SYMBOLS, ""), CURRENCY_CODES, "")
    return strip(F.regexp_replace(bare, f"{W}{{2,}}", " "))


@step("extractNumber")
def _extract_number(c, o, x):
    found = F.regexp_extract(text(c), r"\d[\d.,]*\d|\d", 0)
    return let(found, lambda m: F.when(m == "", "").otherwise(let(numeric.parse_numeric(m), lambda v: F.coalesce(number_text(v), m))))


@step("normalizeNumber")
def _normalize_number(c, o, x):
    mode = o.get("mode") or "auto"
    if mode == "auto":
        return numeric.auto_number(c)
    if mode not in ("us", "eu", "custom"):
        raise StepError(f"normalizeNumber has no mode {mode!r}")
    decimal, thousands = {"us": (".", ","), "eu": (",", ".")}.get(mode, (o.get("decimalSep") or ".", o.get("thousandsSep") or ""))
    return numeric.explicit_number(c, decimal, thousands)


@step("normalizeCurrency")
def _normalize_currency(c, o, x):
    mode = o.get("mode") or "keepText"
    if mode == "keepText":
        return c
    bare = _remove_currency(c, o, x)
    return bare if mode == "removeSymbol" else _normalize_number(bare, {"mode": o.get("numberMode") or "auto", "decimalSep": o.get("decimalSep"), "thousandsSep": o.get("thousandsSep")}, x)


@step("normalizePercentage")
def _percentage(c, o, x):
    divisor = 100.0 if o.get("mode") == "asDecimal" else 1.0
    value = numeric.parse_numeric(strip(F.replace(c, F.lit("%"))))
    return let(value, lambda v: F.coalesce(number_text(v / divisor), c))


@step("normalizeDate")
def _date(c, o, x):
    output, order = o.get("outputFormat") or "YYYY-MM-DD", o.get("dayMonthOrder")
    iso = rf"^(\d{{4}})[-/](\d{{1,2}})[-/](\d{{1,2}})(?:[T{WIDE}]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?)?"
    day_first = rf"^(\d{{1,2}})(?:st|nd|rd|th)?{W}+([A-Za-z]{{3,9}})\.?,?{W}+(\d{{4}})$"
    month_first = rf"^([A-Za-z]{{3,9}})\.?{W}+(\d{{1,2}})(?:st|nd|rd|th)?,?{W}+(\d{{4}})$"
    numbers = rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}})(?:[T{WIDE}]+(\d{{1,2}}):(\d{{2}})(?::(\d{{2}}))?)?$"
    names = {n: i + 1 for group in (MONTHS, FULL_MONTHS) for i, n in enumerate(group)} | {"sept": 9}
    table = F.create_map(*(F.lit(v) for pair in names.items() for v in pair))

    def group(s, pattern, i):
        return F.regexp_extract(s, pattern, i)

    def whole(s, pattern, i):
        return group(s, pattern, i).try_cast("int")

    def parts(year, month, day, s=None, pattern=None):
        clock = [group(s, pattern, i) for i in (4, 5, 6)] if pattern else [F.lit("")] * 3
        return F.struct(year.alias("y"), month.alias("m"), day.alias("d"), *(k.alias(n) for k, n in zip(clock, ("hh", "mi", "ss"), strict=True)))

    def read(s):
        named = lambda p, i: F.try_element_at(table, F.lower(group(s, p, i)))
        a, b = whole(s, numbers, 1), whole(s, numbers, 2)
        swap = F.when((a > 12) & (b > 12), None).when(a > 12, False).when(b > 12, True).otherwise(F.lit({"dayFirst": False, "monthFirst": True}.get(order)))
        return (
            F.when(s.rlike(iso) & whole(s, iso, 2).between(1, 12) & whole(s, iso, 3).between(1, 31), parts(whole(s, iso, 1), whole(s, iso, 2), whole(s, iso, 3), s, iso))
            .when(s.rlike(day_first) & named(day_first, 2).isNotNull(), parts(whole(s, day_first, 3), named(day_first, 2), whole(s, day_first, 1)))
            .when(s.rlike(month_first) & named(month_first, 1).isNotNull(), parts(whole(s, month_first, 3), named(month_first, 1), whole(s, month_first, 2)))
            .when(s.rlike(numbers) & swap.isNotNull(), parts(whole(s, numbers, 3), F.when(swap, a).otherwise(b), F.when(swap, b).otherwise(a), s, numbers))
        )

    def write(p):
        two = lambda v: F.lpad(v.cast("string"), 2, "0")
        date = F.concat_ws("-", F.lpad(p["y"].cast("string"), 4, "0"), two(p["m"]), two(p["d"]))
        minutes = F.concat(two(p["hh"]), F.lit(":"), p["mi"])
        if output == "YYYY-MM-DD HH:mm":
            date = F.when(p["hh"] != "", F.concat(date, F.lit(" "), minutes)).otherwise(date)
        elif output == "iso":
            date = F.when(p["hh"] != "", F.concat(date, F.lit("T"), minutes, F.lit(":"), F.when(p["ss"] != "", p["ss"]).otherwise("00"))).otherwise(date)
        return F.when(p.isNull(), c).otherwise(date)

    return let(let(strip(c), read), write)


@step("normalizeBoolean")
def _boolean(c, o, x):
    yes, no = options_list(o.get("trueValues") or TRUE_VALUES), options_list(o.get("falseValues") or FALSE_VALUES)
    rest = {"empty": F.lit(""), "custom": F.lit(o.get("unmatchedValue") or "")}.get(o.get("unmatchedMode"), c)
    return let(F.lower(strip(c)), lambda s: F.when(c.isNull() | (s == ""), c).when(s.isin(yes), o.get("outputTrue") or "true").when(s.isin(no), o.get("outputFalse") or "false").otherwise(rest))


@step("changeCase")
def _case(c, o, x):
    mode = o.get("mode")
    if mode == "upper":
        return F.upper(c)
    if mode == "lower":
        return F.lower(c)
    if mode != "title":
        return c
    # runs between title words stay as they are; a title word starts at an ASCII word character and runs to white space
    pieces = F.regexp_extract_all(c, F.lit(rf"([A-Za-z0-9_][^{WIDE}]*|[^A-Za-z0-9_]+)"), F.lit(1))
    word = lambda p: F.when(p.rlike("^[A-Za-z0-9_]"), F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))).otherwise(p)
    return F.array_join(F.transform(pieces, word), "")


@step("capitalizeFirst")
def _capitalize(c, o, x):
    letter = r"[A-Za-z\x{00C0}-\x{024F}\x{0400}-\x{04FF}]"
    at = F.regexp_instr(c, F.lit(letter))
    return F.when(at > 0, F.concat(F.substr(c, F.lit(1), at - 1), F.upper(F.substr(c, at, F.lit(1))), F.substr(c, at + 1))).otherwise(c)


step("prefixSuffix")(lambda c, o, x: F.concat(F.lit(o.get("prefix") or ""), text(c), F.lit(o.get("suffix") or "")))


@step("removePrefix")
def _remove_prefix(c, o, x):
    p = o.get("prefix") or ""
    hit = c.startswith(p) if o.get("caseSensitive") else F.lower(F.substring(c, 1, len(p))) == p.lower()
    return F.when(hit, F.substr(c, F.lit(len(p) + 1))).otherwise(c) if p else c


@step("removeSuffix")
def _remove_suffix(c, o, x):
    p = o.get("suffix") or ""
    hit = c.endswith(p) if o.get("caseSensitive") else F.lower(F.right(c, F.lit(len(p)))) == p.lower()
    return F.when(hit, F.substr(c, F.lit(1), F.length(c) - len(p))).otherwise(c) if p else c


@step("fillEmpty")
def _fill(c, o, x):
    fill = "" if o.get("mode") == "toEmpty" else o.get("value") or ""
    listed = F.lower(strip(text(c))).isin(options_list(o.get("matchValues"))) if options_list(o.get("matchValues")) else F.lit(False)
    return F.when(blank(c) | listed, fill).otherwise(c)


@step("findReplace")
def _find_replace(c, o, x):
    find, put, first = o.get("find") or "", o.get("replace") or "", o.get("occurrence") == "first"
    if not find:
        return c
    if not o.get("caseSensitive"):
        pattern, put = f"(?i){quoted(find)}", java_replacement(put)
        return replace_first(c, pattern, put) if first else F.regexp_replace(c, pattern, put)
    if first:
        return F.when(c.contains(find), F.overlay(c, F.lit(put), F.instr(c, find), F.lit(len(find)))).otherwise(c)
    return F.replace(c, F.lit(find), F.lit(put))


@step("regexReplace")
def _regex_replace(c, o, x):
    flags = o.get("flags") or ""
    pattern, put = java_regex(o.get("pattern"), flags), java_replacement(o.get("replacement") or "")
    return F.regexp_replace(c, pattern, put) if "g" in flags else replace_first(c, pattern, put)


@step("regexExtract")
def _regex_extract(c, o, x):
    pattern, group = java_regex(o.get("pattern"), o.get("flags") or ""), int(o.get("group") or 0)
    fallback = c if o.get("fallback") == "original" else F.lit("")
    if o.get("all"):
        joined = ", " if o.get("joinWith") is None else o["joinWith"]
        found = let(F.regexp_extract_all(c, F.lit(pattern), F.lit(group)), lambda a: F.when(F.size(a) > 0, F.array_join(a, joined)).otherwise(fallback))
    else:
        found = F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group)).otherwise(fallback)
    return F.when(c.isNull(), fallback).otherwise(found)


step("normalizeUrl")(lambda c, o, x: urls.normalize(c, x.get("baseUrl"), bool(o.get("removeFragment"))))
step("removeTrackingParams")(lambda c, o, x: urls.remove_tracking(c, x.get("baseUrl")))
step("extractDomain")(lambda c, o, x: urls.part(c, o.get("part") or "domain"))


@step("substring")
def _substring(c, o, x):
    mode, n = o.get("mode"), int(o.get("n") or 0)
    if mode == "firstN":
        return F.substring(c, 1, max(n, 0))
    if mode == "lastN":
        return F.right(c, F.lit(n)) if n > 0 else F.when(c.isNotNull(), "" if n == 0 else F.substr(c, F.lit(1 - n)))
    size = F.length(c)
    place = lambda v: F.lit(v) if v >= 0 else F.greatest(size + v, F.lit(0))
    start = place(int(o.get("start") or 0))
    end = size if o.get("end") is None else F.least(place(int(o["end"])), size)
    return F.substr(c, start + 1, F.greatest(end - start, F.lit(0)))


def split_parts(c: Column, o: dict) -> Column:
    """The parts of a value as an array, null as ''."""
    mode, s = o.get("mode") or "delimiter", text(c)
    if mode == "regex":
        return F.split(s, java_regex(o.get("pattern"), o.get("flags") or ""), -1)
    if mode == "whitespace":
        return F.split(strip(s), f"{W}+", -1)
    if not o.get("delimiter"):
        raise StepError("split needs a delimiter")
    return F.split(s, quoted(o["delimiter"]), 2 if o.get("limit") == "first" else -1)


@step("split")
def _split_value(c, o, x):
    """The value-style outputs of split; its columns are made by the pipeline."""
    mode = o.get("outputMode")
    parts = F.transform(split_parts(c, o), strip)
    if mode == "lastPart":
        return F.element_at(parts, -1)
    if mode == "partByIndex":
        return F.coalesce(F.get(parts, F.lit(int(o.get("partIndex") or 0))), F.lit(""))
    if mode == "joinParts":
        return F.array_join(parts, " " if o.get("joinWith") is None else o["joinWith"])
    return F.element_at(parts, 1)


KNOWN = (*STEPS, "combine")


def apply(kind: str, c, options: dict | None = None, context: dict | None = None) -> Column:
    if kind not in STEPS:
        raise StepError(f"there is no step {kind!r}")
    return STEPS[kind](col(c), options or {}, context or {})
