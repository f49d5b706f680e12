"""Reading numbers from web text: signs, currency, separators, and k, m and b suffixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions.text import W, WIDE, col, let, number_text, strip, strip_right

_FLOAT = r"^\s*(\d+\.?\d*|\.\d+)"


def _bracketed(s: Column) -> Column:
    return s.startswith("(") & s.endswith(")") & (F.length(s) > 1) & ~s.contains("\n")


def _unsigned(s: Column) -> Column:
    """Without outer parentheses and one leading sign."""
    bare = lambda t: F.when(t.startswith("-") | t.startswith("+"), F.substr(t, F.lit(2))).otherwise(t)
    return F.when(_bracketed(s), let(F.substr(s, F.lit(2), F.length(s) - 2), bare)).otherwise(bare(s))


def negative(s: Column) -> Column:
    return s.startswith("-") | _bracketed(s)


def _separators(s: Column) -> Column:
    """The digits with a dot as decimal separator; null for one dot before more than two digits, which could be either."""
    after = lambda c: F.length(F.substring_index(s, c, -1))
    plain = F.replace(s, F.lit(","))

    def judge(n: Column) -> Column:
        comma, dot = n["comma"], n["dot"]
        return (
            F.when((comma == 0) & (dot == 0), s)
            .when(comma == 0, F.when(dot > 1, F.replace(s, F.lit("."))).when(after(".") <= 2, s))
            .when(dot > 0, F.when(after(",") < after("."), let(F.replace(s, F.lit(".")), lambda t: F.overlay(t, F.lit("."), F.instr(t, ","), F.lit(1)))).otherwise(plain))
            .when((comma == 1) & (after(",") <= 2), F.replace(s, F.lit(","), F.lit(".")))
            .otherwise(plain)
        )

    size = F.length(s)
    return let(F.struct((size - F.length(plain)).alias("comma"), (size - F.length(F.replace(s, F.lit(".")))).alias("dot")), judge)


def _read(c) -> Column:
    """struct(str, multiplier, negative) of any text; str may hold no number, or be null.

    A suffix is read from the last characters, not by a pattern: this runs for every
    value. What is used more than once is computed once, and only where it is needed.
    """
    kept = lambda s: strip(F.regexp_replace(_unsigned(s), rf"[^0-9.,kKmMbB{WIDE}]", ""))
    digit_last = lambda t: F.right(t, F.lit(1)).between("0", "9")

    def parts(k: Column) -> Column:
        last, rest = F.right(k, F.lit(1)), F.substr(k, F.lit(1), F.length(k) - 1)
        scaled = lambda b: F.when(digit_last(b) & (~last.isin("b", "B") | (F.length(b) < F.length(rest))), b)
        return F.struct(k.alias("k"), F.when(last.isin("k", "K", "m", "M", "b", "B"), let(strip_right(rest), scaled)).alias("body"))

    def read(s: Column) -> Column:
        def done(p: Column) -> Column:
            factor = F.when(p["body"].isNull(), 1.0).when(F.right(p["k"], F.lit(1)).isin("m", "M"), 1e6).otherwise(1000.0)
            return F.struct(let(F.coalesce(p["body"], p["k"]), _separators).alias("str"), factor.alias("multiplier"), negative(s).alias("negative"))

        return let(let(kept(s), parts), done)

    return let(strip(col(c)), read)


def normalize_number(c) -> Column:
    """struct(str, multiplier, negative) of a number in text; null if there is none that is clear."""
    return let(_read(c), lambda n: F.when(n["str"].rlike(_FLOAT), n))


def to_double(n: Column) -> Column:
    """The value of a struct(str, multiplier, negative); null if str does not begin with a number."""
    value = lambda m: F.when(m != "", m.cast("double") * n["multiplier"] * F.when(n["negative"], -1.0).otherwise(1.0))
    return let(F.regexp_extract(n["str"], _FLOAT, 1), value)


def parse_numeric(c) -> Column:
    """The number in the text as a double, or null."""
    return let(_read(c), to_double)


def price_change(old, new) -> Column:
    """struct(old, new, delta, percent, direction); null if a side is no number or nothing moved; percent is null when old is 0."""

    def change(p: Column) -> Column:
        delta = p["new"] - p["old"]
        return F.when(delta != 0, F.struct(p["old"].alias("old"), p["new"].alias("new"), delta.alias("delta"), F.when(p["old"] != 0, delta / F.abs(p["old"]) * 100).alias("percent"), F.when(delta < 0, "decreased").otherwise("increased").alias("direction")))

    return let(F.struct(parse_numeric(old).alias("old"), parse_numeric(new).alias("new")), change)


def explicit_number(c, decimal: str, thousands: str) -> Column:
    """A number under stated separators as text; the value unchanged if it is not one."""
    c = col(c)

    def read(s: Column) -> Column:
        digits = F.regexp_replace(_unsigned(s), rf"[^0-9.,{WIDE}]", "")
        digits = F.replace(digits, F.lit(thousands)) if thousands else F.regexp_replace(digits, f"{W}+", "")
        digits = F.replace(digits, F.lit(decimal), F.lit(".")) if decimal and decimal != "." else digits

        def done(d: Column) -> Column:
            value = d.try_cast("double")
            return F.when(d.rlike(r"^\d*\.?\d*$") & d.rlike(r"\d"), number_text(F.when(negative(s), -value).otherwise(value))).otherwise(c)

        return let(digits, done)

    return F.when(c.isNotNull(), let(strip(c), read))


def auto_number(c) -> Column:
    """The number in canonical form with its precision kept; unchanged if there is none that is clear."""
    c = col(c)
    plain = lambda n: (n["multiplier"] == 1) & ~n["negative"]
    return let(normalize_number(c), lambda n: F.when(n.isNull(), c).when(plain(n), n["str"]).otherwise(number_text(to_double(n))))


def safe_numeric(c) -> Column:
    """Whether a spreadsheet may hold the value as a number without loss."""
    return col(c).rlike(r"^-?(0|[1-9]\d*)(\.\d+)?$") & (F.length(F.regexp_replace(col(c), r"\D", "")) <= 15)
