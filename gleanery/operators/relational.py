"""Filter, duplicate removal, numeric-aware sorting and export projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.numeric import parse_numeric
from gleanery.functions.text import col, let, present, text
from gleanery.operators.pipeline import POS

ENTIRE_ROW = "entire-row"


def condition(column, kind: str, value: str = "") -> Column:
    c, v = F.lower(text(column)), (value or "").lower()
    if kind in ("gt", "lt"):
        limit = literal_number(value)
        n = parse_numeric(column)
        return F.coalesce(n > limit if kind == "gt" else n < limit, F.lit(False))
    made = {"contains": lambda: c.contains(v), "not-contains": lambda: ~c.contains(v), "equals": lambda: c == v, "not-equals": lambda: c != v, "empty": lambda: text(column) == "", "not-empty": lambda: present(column)}
    if kind not in made:
        raise ValueError(f"there is no condition {kind!r}")
    return made[kind]()


def literal_number(value: str) -> float:
    """The number of a filter's operand, read in the JVM by the rules for values; ValueError if it is none."""
    from pyspark.sql import SparkSession

    found = SparkSession.active().sql("SELECT 1").select(parse_numeric(F.lit(value)).alias("n")).first()["n"]  # folded to a constant: no job runs
    if found is None:
        raise ValueError(f"{value!r} is not a number")
    return found


def apply_filter(df: DataFrame, column: str | None, kind: str | None, value: str = "") -> DataFrame:
    """Rows that meet the condition; all of them if no column or condition is given."""
    return df.filter(condition(column, kind, value)) if column and kind else df


def row_key(columns: list[str]) -> Column:
    return F.struct(*(text(c).alias(f"k{i}") for i, c in enumerate(columns)))


def shown_key(columns: list[str]) -> Column:
    """The row key as one string, for display."""
    return F.concat_ws("␟", *(text(c) for c in columns))


def remove_duplicates(df: DataFrame, columns: list[str], mode: str = ENTIRE_ROW) -> DataFrame:
    """The first row of each key in position order. Case and white space count; null and '' are one.

    The least position of each key is aggregated before the shuffle, so a key that many
    rows share costs one row for each task; only the survivors meet their rows again.
    """
    key = F.struct(*(text(c).alias(f"k{i}") for i, c in enumerate(columns if mode == ENTIRE_ROW else [mode])))
    first = df.groupBy(key.alias("_k")).agg(F.min(POS).alias(POS)).select(POS)
    return df.join(first, POS, "left_semi")


def duplicate_count(df: DataFrame, columns: list[str], mode: str = ENTIRE_ROW) -> DataFrame:
    """total_rows, distinct_keys, duplicate_rows."""
    counts = df.groupBy(row_key(columns if mode == ENTIRE_ROW else [mode]).alias("_k")).count()
    return counts.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total_rows"), F.count(F.lit(1)).alias("distinct_keys")).withColumn("duplicate_rows", F.col("total_rows") - F.col("distinct_keys"))


def numeric_share(column) -> Column:
    """Aggregate: the share of values present that are numbers; null if none is present."""
    return F.avg(F.when(present(column), parse_numeric(column).isNotNull().cast("double")))


def is_numeric_column(df: DataFrame, column: str, threshold: float = 0.8) -> bool:
    share = df.agg(numeric_share(column).alias("s")).first()["s"]
    return share is not None and share >= threshold


def natural_key(column) -> Column:
    """Digits by value, letters without case and accents."""
    pieces = F.regexp_extract_all(text(column), F.lit(r"(\d+|\D+)"), F.lit(1))
    padded = F.transform(pieces, lambda p: F.when(p.rlike(r"^\d"), let(F.regexp_replace(p, "^0+(?=.)", ""), lambda d: F.when(F.length(d) < 20, F.lpad(d, 20, "0")).otherwise(d))).otherwise(p))
    return F.collate(F.array_join(padded, ""), "UNICODE_CI_AI")


def sort_keys(column: str, descending: bool, numeric: bool) -> list[Column]:
    """Numbers: those that cannot be read come last in both directions. Equal values keep their order."""
    key = parse_numeric(column) if numeric else natural_key(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col(POS).asc()]


def apply_sort(df: DataFrame, column: str, descending: bool = False, numeric: bool | None = None) -> DataFrame:
    """Sorted by the column; whether it is numeric is decided on the rows themselves unless given."""
    if numeric is None:
        numeric = is_numeric_column(df, column)
    return df.orderBy(*sort_keys(column, descending, numeric))


def keyed_except(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of `left` whose key `right` does not have; repeated rows stay."""
    return left.join(right.select(key).distinct(), key, "left_anti")


def keyed_intersect(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key).distinct(), key, "left_semi")


def append(frames: list[DataFrame]) -> DataFrame:
    """All rows, in columns of any frame."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def export_columns(df: DataFrame, selected: list[str], raw: dict[str, str] | None = None) -> DataFrame:
    """The selected columns in order; `raw` names, for columns cleaned in place, the column that holds the raw value, shown as "Raw <name>" behind it."""
    out = []
    for c in selected:
        out.append(text(F.col(f"`{c}`")).alias(c))
        if raw and c in raw:
            out.append(text(F.col(f"`{raw[c]}`")).alias(f"Raw {c}"))
    return df.select(*out)


def to_named(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns by id renamed to their shown names, null as ''."""
    if len(set(names.values())) < len(names):
        raise ValueError("two columns have one name")
    return df.select(*(text(F.col(f"`{i}`")).alias(n) for i, n in names.items()), *([POS] if POS in df.columns else []))


def default_name(attribute: str, taken: list[str]) -> str:
    base = {"href": "Link", "src": "Image", "alt": "Alt Text"}.get(attribute, "Column")
    return next(n for n in (base if k == 1 else f"{base} {k}" for k in range(1, len(taken) + 2)) if n not in taken)


def newest_first(df: DataFrame, at: str) -> DataFrame:
    return df.orderBy(F.desc(at))


def keep_newest(df: DataFrame, group: list[str], at: str, n: int = 10, tie: str | None = None) -> DataFrame:
    """The n newest rows of each group."""
    w = Window.partitionBy(*group).orderBy(F.desc(at), *([F.desc(tie)] if tie else []))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def top_counts(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    return df.filter(present(column)).groupBy(col(column).alias(column)).count().orderBy(F.desc("count"), column).limit(k)
