"""String semantics of the row model, as Column expressions.

Values are strings. White space is the wide class of web text, not the ASCII one, and
null and '' are one thing wherever a value is tested for presence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space of web text beyond ASCII, for a Java or RE2 character class.
WIDE = r"\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
W = f"[{WIDE}]"
WIDE_CHARACTERS = " \t\n\u000b\f\r\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, so that nested use does not multiply the expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def text(c) -> Column:
    """The value, with null as ''."""
    return F.coalesce(col(c), F.lit(""))


def present(c) -> Column:
    return text(c) != ""


def strip(c) -> Column:
    return F.btrim(col(c), F.lit(WIDE_CHARACTERS))


def strip_right(c) -> Column:
    return F.rtrim(col(c), F.lit(WIDE_CHARACTERS))


def collapse(c) -> Column:
    return strip(F.regexp_replace(col(c), f"{W}+", " "))


def blank(c) -> Column:
    return strip(text(c)) == ""


def number_text(x: Column) -> Column:
    """A double as script engines print it: 2200, 0.185, 1e-7."""
    exact = F.regexp_replace(F.regexp_replace(x.cast("decimal(38,12)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    tiny = F.lower(F.regexp_replace(x.cast("string"), r"\.0E", "E"))
    return F.when(x == 0, "0").when((x == F.floor(x)) & (F.abs(x) < 1e15), F.format_string("%.0f", x)).when(F.abs(x) < 1e-6, tiny).when(F.abs(x) < 1e21, exact).otherwise(F.regexp_replace(F.lower(F.regexp_replace(x.cast("string"), r"\.0E", "E")), "e", "e+"))


def quoted(s: str) -> str:
    """A literal for a Java regular expression."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|&~#/" else c for c in s)


def options_list(s: str | None) -> list[str]:
    return [x for x in (p.strip().lower() for p in (s or "").split(",")) if x]
