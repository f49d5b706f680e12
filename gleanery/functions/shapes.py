"""What a price and a text mixed with prices or counts look like: one definition, as columns and for page scans."""

from __future__ import annotations

import re

from pyspark.sql import Column

from gleanery.functions.text import W, strip

# Currency symbols and codes, and the shapes around them. `{w}` is white space.
SYMBOLS = "[$€£₺¥₹₩₪₫₴₦₱฿]"
CODE = r"\b[A-Z]{2,3}\b"
BRACKETED = r"^\(\s*[\d.,]+\+?\s*\)$"
YEAR = r"\(\s*(?:1\d{3}|2\d{3})\s*\)"
COUNT = r"(?i)\({w}*[\d,]+(?:\.\d+)?{w}*%?(?:{w}+off)?{w}*\)"
AMOUNT = rf"\d[\d.,]*\d\s?(?:{SYMBOLS}|(?:TL|USD|EUR|GBP|TRY|JPY|INR)\b)"


def looks_like_price(c: Column) -> Column:
    """A digit and a currency symbol or capital code, and not a count in brackets."""
    s = strip(c)
    return s.rlike(r"\d") & (s.rlike(SYMBOLS) | s.rlike(CODE)) & ~s.rlike(BRACKETED)


def contaminated(c: Column) -> Column:
    """Text with a price or a count in brackets in it; a bare year in brackets is none."""
    from pyspark.sql import functions as F

    s = strip(c)
    return F.regexp_replace(s, YEAR, "").rlike(COUNT.replace("{w}", W)) | s.rlike(AMOUNT)


_DIGIT, _SYMBOL, _BRACKETED, _YEAR, _COUNT, _AMOUNT = (re.compile(p, re.A) for p in (r"\d", f"{SYMBOLS}|{CODE}", BRACKETED, YEAR, COUNT.replace("{w}", r"[\s\u00a0]"), AMOUNT))


def is_price(t: str) -> bool:
    """looks_like_price() of one stripped string."""
    return bool(_DIGIT.search(t) and _SYMBOL.search(t)) and not _BRACKETED.search(t)


def is_contaminated(t: str) -> bool:
    """contaminated() of one stripped string."""
    return bool(_COUNT.search(_YEAR.sub("", t)) or _AMOUNT.search(t))
