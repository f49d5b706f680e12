"""The cleaning steps over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.functions import cleaning
from gleanery.operators.pipeline import POS, TransformStep, apply_transforms
from gleanery.plans.base import query, table
from gleanery.plans.samples import NOTATION_DUCK, NOTATION_SPARK, number_sql, number_text_sql

_DIRTY = "SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL WHEN p_partkey % 19 = 0 THEN '   ' ELSE concat('  ', p_name, '{tab}', p_brand, '{cr}{lf}', p_type, '{nbsp} x', '{zw}', 'y {nbsp}') END AS v, p_name, p_brand, p_type FROM part"
_CHARS = {"tab": "chr(9)", "cr": "chr(13)", "lf": "chr(10)", "nbsp": "chr(160)", "zw": "chr(8203)"}


def _dirty_duck() -> str:
    out = _DIRTY
    for k, v in _CHARS.items():
        out = out.replace("'{" + k + "}", f"{v}, '").replace("{" + k + "}", f"', {v}, '")
    return out


_DUCK = _dirty_duck()


def _dirty(spark, sf_dir):
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    literal = {"tab": "\\t", "cr": "\\r", "lf": "\\n", "nbsp": "\\u00A0", "zw": "\\u200B"}
    out = _DIRTY
    for k, v in literal.items():
        out = out.replace("{" + k + "}", v)
    return spark.sql(out)


def step(name: str, kind: str, sql: str, column: str = "v", options: dict | None = None):
    """A query that applies one step to the dirty parts; `sql` states the result over src."""

    @query(name, f"WITH src AS ({_DUCK}) SELECT p_partkey, {sql} AS out FROM src")
    def _apply(spark, sf_dir):
        return _dirty(spark, sf_dir).select("p_partkey", cleaning.apply(kind, column, options).alias("out"))


_W = r"[\s\x{00A0}\x{000B}]"
step("clean_trim", "trim", rf"regexp_replace(v, '^{_W}+|{_W}+$', '', 'g')")
step("clean_whitespace", "collapseWhitespace", rf"regexp_replace(regexp_replace(v, '{_W}+', ' ', 'g'), '^ | $', '', 'g')")
step("clean_breaks", "removeLineBreaks", "replace(v, chr(13) || chr(10), ' ')")
step("clean_line_ends", "normalizeLineBreaks", "replace(v, chr(13) || chr(10), chr(10))")
step("clean_tabs", "removeTabs", "replace(v, chr(9), ' ')")
step("clean_invisible", "removeInvisibleChars", "replace(v, chr(8203), '')")
step("change_case_upper", "changeCase", "upper(v)", options={"mode": "upper"})
step("change_case_lower", "changeCase", "lower(p_type)", "p_type", {"mode": "lower"})
step("title_case", "changeCase", "array_to_string(list_transform(string_split(lower(p_name), ' '), lambda w: concat(upper(w[1]), w[2:])), ' ')", "p_name", {"mode": "title"})
step("prefix_suffix", "prefixSuffix", "concat('<', coalesce(v, ''), '>')", options={"prefix": "<", "suffix": ">"})
step("fill_empty", "fillEmpty", rf"CASE WHEN v IS NULL OR regexp_full_match(v, '{_W}*') THEN 'none' ELSE v END", options={"value": "none"})
step("fill_listed", "fillEmpty", "CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN '' ELSE p_brand END", "p_brand", {"matchValues": "brand#11, BRAND#12", "mode": "toEmpty"})
step("remove_prefix", "removePrefix", "CASE WHEN starts_with(p_brand, 'Brand#') THEN substr(p_brand, 7) ELSE p_brand END", "p_brand", {"prefix": "BRAND#"})
step("remove_suffix", "removeSuffix", "CASE WHEN ends_with(p_brand, '3') THEN left(p_brand, -1) ELSE p_brand END", "p_brand", {"suffix": "3", "caseSensitive": True})
step("find_replace", "findReplace", "regexp_replace(p_type, 'e', '_', 'gi')", "p_type", {"find": "E", "replace": "_"})
step("find_replace_first", "findReplace", "regexp_replace(p_name, 'a', 'AA')", "p_name", {"find": "a", "replace": "AA", "occurrence": "first", "caseSensitive": True})
step("regex_replace", "regexReplace", r"regexp_replace(p_name, '([aeiou])(.)', '\2\1', 'g')", "p_name", {"pattern": "([aeiou])(.)", "flags": "g", "replacement": "$2$1"})
step("regex_replace_first", "regexReplace", r"regexp_replace(p_name, '([aeiou])(.)', '\2-\1')", "p_name", {"pattern": "([aeiou])(.)", "replacement": "$2-$1"})
step("regex_extract", "regexExtract", r"regexp_extract(p_brand, '(\w+)#(\d)', 2)", "p_brand", {"pattern": r"(\w+)#(\d)", "group": 2})
step("regex_extract_all", "regexExtract", r"CASE WHEN len(regexp_extract_all(p_name, '[aeiou]\w')) = 0 THEN '' ELSE array_to_string(regexp_extract_all(p_name, '[aeiou]\w'), ', ') END", "p_name", {"pattern": r"[aeiou]\w", "all": True})
step("substring_first", "substring", "left(p_name, 4)", "p_name", {"mode": "firstN", "n": 4})
step("substring_last", "substring", "right(p_name, 3)", "p_name", {"mode": "lastN", "n": 3})
step("substring_range", "substring", "substr(p_type, 3, greatest(length(p_type) - 2 - 2, 0))", "p_type", {"mode": "range", "start": 2, "end": -2})
step("split_first_part", "split", "split_part(p_name, ' ', 1)", "p_name", {"delimiter": " ", "outputMode": "firstPart"})
step("split_last_part", "split", "string_split(p_name, ' ')[-1]", "p_name", {"mode": "whitespace", "outputMode": "lastPart"})
step("split_by_index", "split", "coalesce(string_split(p_type, 'E')[2], '')", "p_type", {"delimiter": "E", "outputMode": "partByIndex", "partIndex": 1})
step("split_join", "split", "array_to_string(regexp_split_to_array(p_brand, '#'), '/')", "p_brand", {"mode": "regex", "pattern": "#", "outputMode": "joinParts", "joinWith": "/"})


@query("capitalize_first", f"WITH src AS ({_DUCK}) SELECT p_partkey, concat('12 ', upper(substr(p_name, 1, 1)), substr(p_name, 2)) AS out FROM src")
def capitalize(spark, sf_dir):
    return _dirty(spark, sf_dir).select("p_partkey", cleaning.apply("capitalizeFirst", F.concat(F.lit("12 "), F.col("p_name"))).alias("out"))


# --- numbers

_SRC = f"SELECT l_orderkey, l_linenumber, {NOTATION_DUCK} AS v FROM lineitem"
_KEYS = "l_orderkey, l_linenumber"


def _notation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr(NOTATION_SPARK).alias("v"))


@query("normalize_number_auto", f"WITH src AS ({_SRC}), {number_sql('src', 'v', _KEYS + ', v')} SELECT {_KEYS}, CASE WHEN str IS NULL THEN v WHEN mult = 1 AND NOT neg THEN str ELSE {number_text_sql('num')} END AS out FROM numbers")
def normalize_auto(spark, sf_dir):
    return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", cleaning.apply("normalizeNumber", "v", {"mode": "auto"}).alias("out"))


def _explicit(thousands: str, decimal: str) -> str:
    digits = f"replace(replace(regexp_replace(regexp_replace(regexp_replace(v, '^\\((.*)\\)$', '\\1'), '^[-+]', ''), '[^0-9.,\\s]', '', 'g'), '{thousands}', ''), '{decimal}', '.')"
    value = f"(TRY_CAST({digits} AS DOUBLE) * CASE WHEN v LIKE '-%' OR v LIKE '(%)' THEN -1 ELSE 1 END)"
    return f"WITH src AS ({_SRC}) SELECT {_KEYS}, CASE WHEN regexp_matches({digits}, '^\\d*\\.?\\d*$') AND regexp_matches({digits}, '\\d') THEN {number_text_sql(value)} ELSE v END AS out FROM src"


for _mode, _thousands, _decimal in (("us", ",", "."), ("eu", ".", ",")):

    @query(f"normalize_number_{_mode}", _explicit(_thousands, _decimal))
    def _by_mode(spark, sf_dir, mode=_mode):
        return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", cleaning.apply("normalizeNumber", "v", {"mode": mode}).alias("out"))


@query("normalize_percentage", f"WITH src AS (SELECT {_KEYS}, v, replace(v, '%', '') AS u FROM ({_SRC})), {number_sql('src', 'u', _KEYS + ', v')} SELECT {_KEYS}, coalesce({number_text_sql('num')}, v) AS out FROM numbers")
def percentage(spark, sf_dir):
    return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", cleaning.apply("normalizePercentage", "v", {"mode": "asNumber"}).alias("out"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(v, '[$€£₺¥₹]', '', 'g'), '(?i)\b(USD|EUR|GBP|TRY|JPY|INR)\b', '', 'g'), '^\s+|\s+$', '', 'g')"


@query("remove_currency", f"WITH src AS ({_SRC}) SELECT {_KEYS}, {_BARE} AS out FROM src")
def remove_currency(spark, sf_dir):
    return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", cleaning.apply("removeCurrency", "v").alias("out"))


@query("normalize_currency", f"WITH src AS (SELECT {_KEYS}, {_BARE} AS v FROM ({_SRC})), {number_sql('src', 'v', _KEYS + ', v')} SELECT {_KEYS}, CASE WHEN str IS NULL THEN v WHEN mult = 1 AND NOT neg THEN str ELSE {number_text_sql('num')} END AS out FROM numbers")
def normalize_currency(spark, sf_dir):
    return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", cleaning.apply("normalizeCurrency", "v", {"mode": "normalizeValue"}).alias("out"))


@query("extract_number", f"WITH src AS (SELECT {_KEYS}, regexp_extract(v, '\\d[\\d.,]*\\d|\\d', 0) AS m FROM ({_SRC})), {number_sql('src', 'm', _KEYS + ', m')} SELECT {_KEYS}, CASE WHEN m = '' THEN '' ELSE coalesce({number_text_sql('num')}, m) END AS out FROM numbers")
def extract_number(spark, sf_dir):
    return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", cleaning.apply("extractNumber", "v").alias("out"))


@query("safe_numeric", f"SELECT {_KEYS}, regexp_full_match(v, '-?(0|[1-9]\\d*)(\\.\\d+)?') AND length(regexp_replace(v, '\\D', '', 'g')) <= 15 AS safe FROM (SELECT {_KEYS}, replace(v, '%', '') AS v FROM ({_SRC}))")
def safe(spark, sf_dir):
    from gleanery.functions.numeric import safe_numeric

    return _notation(spark, sf_dir).select("l_orderkey", "l_linenumber", safe_numeric(F.replace("v", F.lit("%"))).alias("safe"))


# --- dates and booleans

_DATE = """CASE o_orderkey % 5
 WHEN 0 THEN concat(CAST(1990 + o_orderkey % 30 AS VARCHAR), '-', CAST(o_orderkey % 12 + 1 AS VARCHAR), '-', CAST(o_orderkey % 31 + 1 AS VARCHAR), CASE WHEN o_orderkey % 2 = 0 THEN 'T10:30:15Z' ELSE '' END)
 WHEN 1 THEN concat(CAST(o_orderkey % 28 + 1 AS VARCHAR), 'th March ', CAST(1990 + o_orderkey % 30 AS VARCHAR))
 WHEN 2 THEN concat('Sept ', CAST(o_orderkey % 28 + 1 AS VARCHAR), ', ', CAST(1990 + o_orderkey % 30 AS VARCHAR))
 WHEN 3 THEN concat(CAST(o_orderkey % 28 + 1 AS VARCHAR), '/', CAST(o_orderkey % 12 + 1 AS VARCHAR), '/', CAST(1990 + o_orderkey % 30 AS VARCHAR)) ELSE 'soon' END"""
_YEAR, _MONTH, _DAY31, _DAY28 = "CAST(1990 + o_orderkey % 30 AS VARCHAR)", "lpad(CAST(o_orderkey % 12 + 1 AS VARCHAR), 2, '0')", "lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0')", "lpad(CAST(o_orderkey % 28 + 1 AS VARCHAR), 2, '0')"


@query("normalize_date", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY31}, CASE WHEN o_orderkey % 2 = 0 THEN 'T10:30:15' ELSE '' END)
 WHEN 1 THEN concat({_YEAR}, '-03-', {_DAY28}) WHEN 2 THEN concat({_YEAR}, '-09-', {_DAY28})
 WHEN 3 THEN CASE WHEN o_orderkey % 28 + 1 > 12 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY28}) ELSE {_DATE} END ELSE 'soon' END AS out FROM orders""")
def normalize_date(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATE.replace("VARCHAR", "STRING")).alias("v"))
    return rows.select("o_orderkey", cleaning.apply("normalizeDate", "v", {"outputFormat": "iso"}).alias("out"))


@query("normalize_date_hint", f"""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY31}) WHEN 1 THEN concat({_YEAR}, '-03-', {_DAY28}) WHEN 2 THEN concat({_YEAR}, '-09-', {_DAY28})
 WHEN 3 THEN concat({_YEAR}, '-', {_MONTH}, '-', {_DAY28}) ELSE 'soon' END AS out FROM orders""")
def normalize_date_hint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_DATE.replace("VARCHAR", "STRING")).alias("v"))
    return rows.select("o_orderkey", cleaning.apply("normalizeDate", "v", {"dayMonthOrder": "dayFirst"}).alias("out"))


@query("normalize_boolean", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'no' ELSE '' END AS out FROM orders")
def normalize_boolean(spark, sf_dir):
    o = {"trueValues": " f , done", "falseValues": "o", "outputFalse": "no", "unmatchedMode": "empty"}
    return table(spark, sf_dir, "orders").select("o_orderkey", cleaning.apply("normalizeBoolean", "o_orderstatus", o).alias("out"))


# --- structure

@query("split_columns", """SELECT p_partkey, p_name, split_part(p_name, ' ', 1) AS "Part 1", CASE WHEN contains(p_name, ' ') THEN trim(substr(p_name, strpos(p_name, ' ') + 1)) ELSE '' END AS "Part 2", p_brand FROM part""")
def split_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return apply_transforms(rows, [TransformStep("split", "p_name", {"delimiter": " ", "limit": "first", "keepOriginal": True})])


@query("combine_template", """SELECT concat(CAST(c_custkey + 1 AS VARCHAR), ': ', c_name, ' (', c_mktsegment, ')') AS label, c_nationkey FROM customer""")
def combine(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_name", "c_mktsegment", "c_nationkey", F.col("c_custkey").alias(POS))
    return apply_transforms(rows, [TransformStep("combine", None, {"sourceColumns": ["c_name", "c_mktsegment"], "outputName": "label", "template": "{index}: {c_name} ({c_mktsegment}){none}"})]).drop(POS)


@query("derived_column", "SELECT c_custkey, c_name, upper(c_name) AS shout FROM customer")
def derived(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return apply_transforms(rows, [TransformStep("changeCase", "c_name", {"mode": "upper"}, new_column="shout"), TransformStep("trim", "c_name", enabled=False)])


# --- the steps that need Python

@query("unicode_nfc", "SELECT doc_id, nfc_normalize(text) AS out FROM documents")
def unicode_nfc(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.apply("normalizeUnicode", "text").alias("out"))


_ONCE = r"""SELECT doc_id, CASE WHEN text IS NOT NULL THEN concat('<a> & "', chr(233), '€ &unknown; &lt; ', regexp_replace(text, ' the ', ' ' || chr(169) || ' &amp ', 'g')) END AS out FROM documents"""


@query("decode_entities", _ONCE)
def decode_entities(spark, sf_dir):
    """Whole texts with references before and throughout them: each is decoded once, unfinished and unknown ones stay."""
    v = F.concat(F.lit("&lt;a&gt; &amp; &quot;&#233;&euro; &unknown; &amp;lt; "), F.regexp_replace("text", " the ", " &copy; &amp;amp "))
    return table(spark, sf_dir, "documents").select("doc_id", cleaning.apply("decodeHtmlEntities", v).alias("out"))


@query("strip_html", "SELECT p_partkey, concat(p_name, ' & ', p_brand, ' end') AS out FROM part")
def strip_html(spark, sf_dir):
    v = F.concat(F.lit("<p>"), "p_name", F.lit(" &amp; <b>"), "p_brand", F.lit("</b>\n  end"))
    return table(spark, sf_dir, "part").select("p_partkey", cleaning.apply("stripHtml", v).alias("out"))
