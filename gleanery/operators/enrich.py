"""Detail enrichment: outcomes of detail pages joined to rows by address, with retries as data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import text


def final_attempts(attempts: DataFrame) -> DataFrame:
    """The last attempt of each url out of (url, attempt, status, ...)."""
    rest = [c for c in attempts.columns if c != "url"]
    return attempts.groupBy("url").agg(F.max_by(F.struct(*rest), "attempt").alias("_a")).select("url", "_a.*")


def free_name(name: str, taken: list[str], kind: str = "detail") -> str:
    """The name, or with (detail), (detail 2) and so on if it is taken."""
    out, n = name, 1
    while out in taken:
        out, n = f"{name} ({kind})" if n == 1 else f"{name} ({kind} {n})", n + 1
    return out


def enrich(df: DataFrame, column: str, results: DataFrame, fields: list[str]) -> DataFrame:
    """Rows with the fields of their detail page; only completed and partial ones count, others give ''. Lists are joined by '; '."""
    good = results.filter(F.col("status").isin("completed", "partial"))
    kinds = dict(good.dtypes)
    shown = [(F.array_join(f, "; ") if kinds[f].startswith("array") else F.col(f)).alias(f"_{i}") for i, f in enumerate(fields)]
    joined = df.join(good.select(F.col("url").alias("_url"), *shown).dropDuplicates(["_url"]), F.col(f"`{column}`") == F.col("_url"), "left")
    taken, names = list(df.columns), []
    for f in fields:
        names.append(free_name(f, taken))
        taken.append(names[-1])
    return joined.select(*(F.col(f"`{c}`") for c in df.columns), *(text(f"_{i}").alias(n) for i, n in enumerate(names)))


def retry_failed(done: DataFrame, again: DataFrame) -> DataFrame:
    """Outcomes with those of a second run in place of the first ones."""
    return done.join(again.select("url"), "url", "left_anti").unionByName(again, allowMissingColumns=True)


def status_counts(df: DataFrame, column: str = "status") -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def detail_urls(df: DataFrame, column: str) -> DataFrame:
    """rows, with_url, unique_urls: web addresses only."""
    web = text(f"`{column}`").rlike("(?i)^https?://")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(web).alias("with_url"), F.count_distinct(F.when(web, F.col(f"`{column}`"))).alias("unique_urls"))
