"""Keyed comparison of two snapshots: new, removed, changed and unchanged rows, and price moves."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.numeric import price_change
from gleanery.functions.text import col, number_text, strip, text
from gleanery.functions.urls import image_key
from gleanery.operators.pipeline import POS
from gleanery.operators.relational import ENTIRE_ROW

# What names and contents suggest a price.
PRICE_NAME = re.compile(r"\b(price|cost|fiyat|fiyatı|tutar|amount)\b", re.I)
CURRENCY_HINT = r"(?i)[$€£₺¥₹]|\b(usd|eur|try|gbp|jpy|inr)\b"


def compared(column: str, attribute: str = "text", image_mode: str = "exact") -> Column:
    """What two values are compared by: line breaks alike, ends stripped, links without fragment."""
    value = F.regexp_replace(strip(text(f"`{column}`")), "\r\n|\r", "\n")
    if attribute == "href":
        return F.regexp_replace(value, "#.*$", "")
    return image_key(value, image_mode) if attribute == "src" else value


def diff_key(columns: dict[str, str], mode: str) -> Column:
    names = list(columns) if mode == ENTIRE_ROW else [mode]
    return F.struct(*(compared(n, columns[n]).alias(f"k{i}") for i, n in enumerate(names)))


def price_columns(previous: DataFrame, current: DataFrame, columns: list[str]) -> list[str]:
    """Columns named like a price, or where half of the values of both sides show a currency: one aggregate over all rows."""
    named = [c for c in columns if PRICE_NAME.search(c)]
    rest = [c for c in columns if c not in named]
    if rest:
        sides = [f.select(*(text(f"`{c}`").alias(f"c{i}") for i, c in enumerate(rest))) for f in (previous, current)]
        shares = sides[0].unionByName(sides[1]).agg(*(F.avg(F.when(F.col(f"c{i}") != "", F.col(f"c{i}").rlike(CURRENCY_HINT).cast("double"))).alias(f"c{i}") for i in range(len(rest)))).first()
        named += [c for i, c in enumerate(rest) if shares[i] is not None and shares[i] >= 0.5]
    return [c for c in columns if c in named]


@dataclass
class Comparison:
    """rows: each row of either side with change_type; fields: one row for each changed field of a changed row."""

    rows: DataFrame
    fields: DataFrame

    def stats(self) -> DataFrame:
        """previous_count, current_count, new, removed, changed, unchanged rows, and price moves by field."""
        is_ = lambda k: F.col("change_type") == k
        counts = self.rows.agg(*(F.count_if(is_(k)).alias(f"{k}_count") for k in ("new", "removed", "changed", "unchanged")), F.count_if(~is_("removed")).alias("current_count"))
        moves = self.fields.agg(*(F.count_if(F.col("direction") == k).alias(f"price_{k}") for k in ("decreased", "increased")))
        return counts.crossJoin(moves)


def compare(previous: DataFrame, current: DataFrame, columns: dict[str, str], mode: str = ENTIRE_ROW, prices: list[str] | None = None) -> Comparison:
    """Both frames hold the columns and a row position. `columns` gives each one's attribute.

    Rows meet by key: all columns, or one. Of several rows with a key the last stands for
    it on the side looked up, while repeated current rows are each compared. Aggregating
    to the last row comes before the join, so repeated keys do not multiply.
    """
    names = list(columns)
    if prices is None:
        prices = price_columns(previous, current, names)
    struct = lambda: F.struct(*(text(f"`{n}`").alias(n) for n in names))
    side = lambda df: df.select(diff_key(columns, mode).alias("_key"), F.col(POS), struct().alias("row"))
    old, new = side(previous), side(current)
    last = old.groupBy("_key").agg(F.max_by("row", POS).alias("before"))
    met = new.join(last, "_key", "left")

    was, now = (lambda n: F.col("before").getField(n)), (lambda n: F.col("row").getField(n))
    differs = {n: _norm(was(n), columns[n]) != _norm(now(n), columns[n]) for n in names}
    some = reduce(lambda a, b: a | b, differs.values())
    kind = F.when(F.col("before").isNull(), "new").when(some, "changed").otherwise("unchanged")
    gone = old.join(new.select("_key").distinct(), "_key", "left_anti").select(POS, F.lit("removed").alias("change_type"), "row")
    rows = met.select(POS, kind.alias("change_type"), "row").unionByName(gone)

    changed = F.array_compact(F.array(*(F.when(d, F.struct(F.lit(n).alias("field"), was(n).alias("old_value"), now(n).alias("new_value"))) for n, d in differs.items())))
    fields = met.filter(F.col("before").isNotNull() & some).select(POS, "row", F.inline(changed))
    # prices are read after the values are known to differ, at one place of the plan
    move = F.when(F.col("field").isin(prices), price_change("old_value", "new_value")) if prices else F.lit(None).cast("struct<delta:double,percent:double,direction:string>")
    fields = fields.withColumn("move", move).select(POS, "row", "field", "old_value", "new_value", *(F.col(f"move.{x}") for x in ("delta", "percent", "direction")))
    return Comparison(rows, fields)


def _norm(value: Column, attribute: str) -> Column:
    v = F.regexp_replace(strip(value), "\r\n|\r", "\n")
    return F.regexp_replace(v, "#.*$", "") if attribute == "href" else v


def change_rows(result: Comparison, link: str | None = None) -> DataFrame:
    """One row for each new row, removed row and changed field."""
    shown = F.col("row").getField(link) if link else F.lit("")
    kind = F.when(F.col("direction") == "decreased", "PRICE DROPPED").when(F.col("direction") == "increased", "PRICE INCREASED").otherwise("CHANGED")
    whole = result.rows.filter(F.col("change_type").isin("new", "removed")).select(F.upper("change_type").alias("change_type"), F.lit("").alias("field"), F.lit("").alias("old_value"), F.lit("").alias("new_value"), shown.alias("link"))
    return whole.unionByName(result.fields.select(kind.alias("change_type"), "field", "old_value", "new_value", shown.alias("link")))


def price_rows(result: Comparison, product: str | None = None, link: str | None = None) -> DataFrame:
    """One row for each price move; the percentage has two decimals, halves rounded up."""
    shown = lambda n: F.col("row").getField(n) if n else F.lit("")
    percent = F.when(F.col("percent").isNull(), "").otherwise(F.concat(number_text(F.floor(F.col("percent") * 100 + 0.5) / 100.0), F.lit("%")))
    return result.fields.filter("direction is not null").select(shown(product).alias("product"), F.col("old_value").alias("old_price"), F.col("new_value").alias("new_price"), F.col("delta").alias("difference"), percent.alias("percent"), shown(link).alias("link"))


def filter_changes(rows: DataFrame, category: str) -> DataFrame:
    """all, new, removed, changed (any field), or price moves only, of change_rows()."""
    kinds = {"new": ["NEW"], "removed": ["REMOVED"], "changed": ["CHANGED", "PRICE DROPPED", "PRICE INCREASED"], "price": ["PRICE DROPPED", "PRICE INCREASED"]}
    return rows if category == "all" else rows.filter(col("change_type").isin(kinds[category]))


def shown(rows: DataFrame, order: str, most: int = 300) -> DataFrame:
    """The part of a change list that a screen shows; exports have all of it."""
    return rows.orderBy(order).limit(most)
