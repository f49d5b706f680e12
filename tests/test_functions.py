"""Golden vectors of numbers, cleaning steps and URLs."""

import pytest
from pyspark.sql import functions as F

from gleanery.functions import cleaning, numeric, urls
from gleanery.functions.cleaning import StepError
from gleanery.functions.text import number_text


def values(spark, rows, column, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


NUMBERS = [
    ("$1,234.56", 1234.56), ("1.234,56 TL", 1234.56), ("25,50", 25.5), ("1,234", 1234.0), ("1,234,567", 1234567.0), ("1.234.567", 1234567.0), ("19.99", 19.99), ("4.5", 4.5),
    ("1.234", None), ("0.125", None), ("1.2345", None), ("2.2k", 2200.0), ("2,2 B", 2200.0), ("1.5M", 1500000.0), ("(56)", -56.0), ("-$5", -5.0), ("$-5", 5.0), ("12.5%", 12.5),
    ("3 items", 3e6), ("20 cm", 2e7), ("12 lb", 12000.0), ("1 234", 1.0), ("1 234,5", 1.0), ("5 km", 5.0), ("10 members", 10.0), ("abc", None), ("", None), (None, None), ("   ", None), (" 7 ", 7.0),
]


def test_parse_numeric(spark):
    got = values(spark, [v for v, _ in NUMBERS], numeric.parse_numeric("v"))
    assert [(v, round(g, 6) if g is not None else None) for (v, _), g in zip(NUMBERS, got, strict=True)] == NUMBERS


def test_number_text(spark):
    got = values(spark, [2200.0, 0.185, 12345678.0, 12345678.5, -3.25, 0.0, 1e-7, 1e15 + 2, 0.1], number_text(F.col("v")), "v double")
    assert got == ["2200", "0.185", "12345678", "12345678.5", "-3.25", "0", "1e-7", "1000000000000002", "0.1"]


STEPS = [
    ("trim", {}, "  a\tb ﻿", "a\tb"), ("trim", {}, None, None),
    ("collapseWhitespace", {}, " a \n b  ", "a b"), ("removeLineBreaks", {}, "a\r\nb\rc\nd", "a b c d"), ("normalizeLineBreaks", {}, "a\r\nb\rc", "a\nb\nc"), ("removeTabs", {}, "a\tb", "a b"),
    ("removeInvisibleChars", {}, "a​b­c", "abc"), ("normalizeUnicode", {}, "é", "é"), ("normalizeUnicode", {"form": "NFKC"}, "ﬁ", "fi"),
    ("decodeHtmlEntities", {}, "a &amp;lt; &unknown; &#39; &#x27; &EURO;", "a &lt; &unknown; ' ' €"),
    ("removeCurrency", {}, "USD 20  $", "20"), ("extractNumber", {}, "about 1,234 items", "1234"), ("extractNumber", {}, "1.234", "1.234"), ("extractNumber", {}, "none", ""), ("extractNumber", {}, None, ""),
    ("normalizeNumber", {}, "25,50", "25.50"), ("normalizeNumber", {"mode": "us"}, "1,234.50", "1234.5"), ("normalizeNumber", {"mode": "eu"}, "1.234,50", "1234.5"), ("normalizeNumber", {"mode": "us"}, "x1", "1"), ("normalizeNumber", {"mode": "us"}, "1.2.3", "1.2.3"),
    ("normalizeNumber", {"mode": "custom", "decimalSep": ",", "thousandsSep": ""}, "1 234,5", "1234.5"),
    ("normalizeCurrency", {"mode": "normalizeValue"}, " €1.234,50 ", "1234.50"), ("normalizeCurrency", {"mode": "removeSymbol"}, "$5 USD", "5"), ("normalizeCurrency", {}, "$5", "$5"),
    ("normalizePercentage", {}, "18.5 %", "18.5"), ("normalizePercentage", {"mode": "asDecimal"}, "18.5 %", "0.185"), ("normalizePercentage", {}, "12.345%", "12.345%"),
    ("normalizeDate", {}, "2024-1-5", "2024-01-05"), ("normalizeDate", {}, "25/12/2024", "2024-12-25"), ("normalizeDate", {}, "12/25/2024", "2024-12-25"), ("normalizeDate", {}, "03/04/2024", "03/04/2024"),
    ("normalizeDate", {"dayMonthOrder": "dayFirst"}, "03/04/2024", "2024-04-03"), ("normalizeDate", {"dayMonthOrder": "monthFirst"}, "03/04/2024", "2024-03-04"), ("normalizeDate", {}, "5th March 2024", "2024-03-05"),
    ("normalizeDate", {}, "Mar 5, 2024", "2024-03-05"), ("normalizeDate", {}, "2024-02-31", "2024-02-31"), ("normalizeDate", {"outputFormat": "iso"}, "2024-01-05T10:30:00Z", "2024-01-05T10:30:00"), ("normalizeDate", {"outputFormat": "YYYY-MM-DD HH:mm"}, "2024-01-05 9:30", "2024-01-05 09:30"), ("normalizeDate", {}, "13/13/2024", "13/13/2024"),
    ("normalizeBoolean", {}, "In Stock", "true"), ("normalizeBoolean", {}, "no", "false"), ("normalizeBoolean", {}, "maybe", "maybe"), ("normalizeBoolean", {"unmatchedMode": "custom", "unmatchedValue": "?"}, "maybe", "?"),
    ("changeCase", {"mode": "title"}, "hello wORLD foo-bar", "Hello World Foo-bar"), ("changeCase", {"mode": "title"}, "(hello x", "(Hello X"), ("changeCase", {"mode": "upper"}, "straße", "STRASSE"),
    ("capitalizeFirst", {}, "123 abc dEF", "123 Abc dEF"), ("capitalizeFirst", {}, "12", "12"), ("prefixSuffix", {"prefix": "<", "suffix": ">"}, None, "<>"),
    ("removePrefix", {"prefix": "AB"}, "abc", "c"), ("removePrefix", {"prefix": "AB", "caseSensitive": True}, "abc", "abc"), ("removeSuffix", {"suffix": "C"}, "abc", "ab"),
    ("fillEmpty", {"value": "x", "matchValues": "-, N/A"}, "", "x"), ("fillEmpty", {"value": "x", "matchValues": "-, N/A"}, " ", "x"), ("fillEmpty", {"value": "x", "matchValues": "-, N/A"}, "n/a", "x"), ("fillEmpty", {"value": "x", "matchValues": "-, N/A"}, "ok", "ok"), ("fillEmpty", {"value": "x"}, None, "x"),
    ("findReplace", {"find": "A.", "replace": "$&!"}, "a.b A.", "a.!b A.!"), ("findReplace", {"find": "a", "replace": "$1", "caseSensitive": True}, "aba", "$1b$1"), ("findReplace", {"find": "a", "replace": "X", "occurrence": "first"}, "bAa", "bXa"), ("findReplace", {"find": "a", "replace": "X", "occurrence": "first", "caseSensitive": True}, "baa", "bXa"),
    ("regexReplace", {"pattern": "a", "replacement": "X"}, "aa", "Xa"), ("regexReplace", {"pattern": "(a)(b)", "flags": "gi", "replacement": "$2$1"}, "abAB", "baBA"), ("regexReplace", {"pattern": "(.)\\n", "replacement": "[$1]"}, "ab\nc\n", "a[b]c\n"),
    ("regexExtract", {"pattern": r"\d+", "all": True}, "a1b22", "1, 22"), ("regexExtract", {"pattern": "x"}, "abc", ""), ("regexExtract", {"pattern": "x", "fallback": "original"}, "abc", "abc"), ("regexExtract", {"pattern": r"(\w)(\d)", "group": 2}, "a1", "1"), ("regexExtract", {"pattern": "x"}, None, ""),
    ("normalizeUrl", {"removeFragment": True}, " HTTPS://Ex.com:443#a", "https://ex.com/"), ("normalizeUrl", {}, "not a url", "not a url"),
    ("removeTrackingParams", {}, "https://a.com/p?utm_source=f&q=1", "https://a.com/p?q=1"), ("extractDomain", {}, "https://www.example.com/a", "example.com"), ("extractDomain", {"part": "path"}, "http://h", "/"), ("extractDomain", {"part": "origin"}, "https://H.x:8080/a", "https://h.x:8080"), ("extractDomain", {"part": "query"}, "https://h.x/?a=1#b", "a=1"), ("extractDomain", {}, "nothing", "nothing"),
    ("substring", {"mode": "lastN", "n": 2}, "abcd", "cd"), ("substring", {"mode": "range", "start": -2}, "abcd", "cd"), ("substring", {"mode": "firstN", "n": 2}, "abcd", "ab"), ("substring", {"mode": "range", "start": 1, "end": -1}, "abcd", "bc"), ("substring", {"mode": "lastN"}, "abcd", ""),
    ("stripHtml", {}, "<p>a &amp; <b>b</b>\n c</p>", "a & b c"), ("stripHtml", {}, "plain & text", "plain & text"),
    ("split", {"delimiter": "-", "outputMode": "lastPart"}, "a- b", "b"), ("split", {"delimiter": "-", "outputMode": "partByIndex", "partIndex": 5}, "a-b", ""), ("split", {"mode": "whitespace", "outputMode": "joinParts", "joinWith": "|"}, " a  b ", "a|b"),
]


def test_steps(spark):
    """All vectors in one frame: one row for each, the step's own column in it."""
    frame = spark.createDataFrame([(0,)], "i int").select(*(cleaning.apply(k, F.lit(v).cast("string"), o).alias(f"c{n}") for n, (k, o, v, _) in enumerate(STEPS)))
    got = frame.first()
    wrong = [(k, o, v, want, g) for (k, o, v, want), g in zip(STEPS, got, strict=True) if g != want]
    assert not wrong


def test_every_step_is_covered():
    assert {k for k, *_ in STEPS} == set(cleaning.STEPS) and len(cleaning.KNOWN) == 31


def test_bad_steps_fail_at_once(spark):
    c = F.lit("x")
    for kind, options in (("none", {}), ("split", {}), ("regexReplace", {"pattern": "("}), ("regexExtract", {}), ("normalizeNumber", {"mode": "odd"})):
        with pytest.raises(StepError):
            cleaning.apply(kind, c, options)


def test_long_values_go_through_regex(spark):
    long = F.concat(F.repeat(F.lit("a"), 6000), F.lit("7"))
    got = spark.range(1).select(cleaning.apply("regexReplace", long, {"pattern": "a", "flags": "g", "replacement": ""}).alias("v"), cleaning.apply("regexExtract", long, {"pattern": r"\d"}).alias("x")).first()
    assert (got["v"], got["x"]) == ("7", "7")


URLS = [("", "empty"), ("blob:x", "unsupported-blob"), ("data:text/plain,x", "unsupported-data-url"), ("data:image/png;base64,AAAA", None), ("ftp://x.y/z", "disallowed-scheme"), ("nonsense", "invalid-url"), ("https://a.b/c", None), ("http://", "invalid-url")]


def test_validation(spark):
    got = values(spark, [u for u, _ in URLS], urls.validate("v"))
    assert [g["reason"] for g in got] == [r for _, r in URLS] and [g["ok"] for g in got] == [r is None for _, r in URLS]


def test_url_parts(spark):
    rows = ["https://A.b/x.JPG?v=1#t", "https://a.b", "data:image/jpeg;base64,AA", "x#y"]
    assert values(spark, rows, urls.dedup_key("v")) == ["https://a.b/x.JPG?v=1", "https://a.b/", "data:image/jpeg;base64,AA", "x"]
    assert values(spark, rows, urls.extension("v")) == ["jpg", None, "jpg", None]
    assert values(spark, rows, urls.type_group("v")) == ["Images", "Other", "Images", "Other"]
    pages = ["https://a.b/l?x=1&page=7", "https://a.b/page/3/", "https://a.b/?offset=20", "https://a.b/?page=x", "none", "https://a.b/?pg=4&page=y"]
    got = values(spark, pages, urls.pagination("v"))
    assert [(g["found"], g["key"], g["start"], g["step"], g["confidence"]) for g in got] == [(True, "page", 7, 1, "high"), (True, "page", 3, 1, "high"), (True, "offset", 20, 0, "medium"), (False, None, None, None, None), (False, None, None, None, None), (True, "pg", 4, 1, "high")]
    assert values(spark, pages[:3], urls.next_page("v", "query", "page", 8)) == ["https://a.b/l?x=1&page=8", "https://a.b/page/3/?page=8", "https://a.b/?offset=20&page=8"]
    assert values(spark, pages[:3], urls.next_page("v", "path", "page", 4)) == [None, "https://a.b/page/4/", None]
    assert values(spark, ['a/b:c*  d..', None], urls.safe_file_name("v")) == ["abc d", ""]
    assert values(spark, ["a/../b /c.", ""], urls.safe_folder_name("v")) == ["a/b/c", ""]


def test_price_change(spark):
    got = values(spark, [("$20.00", "$20"), ("$20", "$15"), ("x", "1"), ("0", "5")], numeric.price_change("a", "b"), "a string, b string")
    assert got[0] is None and (got[1]["delta"], got[1]["percent"], got[1]["direction"]) == (-5, -25, "decreased") and got[2] is None and got[3]["percent"] is None
    assert values(spark, ["0501234567", "12.50", "-3", "1234567890123456"], numeric.safe_numeric("v")) == [False, True, True, False]
