"""Delimited text, JSON and NDJSON lines as Column expressions, and their writers."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions.text import col, text

DELIMITERS = (",", ";", "\t")


def guarded(c: Column) -> Column:
    """A value that a spreadsheet would read as a formula, behind an apostrophe."""
    return F.when(c.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_cell(c, delimiter: str = ",", guard: bool = True) -> Column:
    v = guarded(text(c)) if guard else text(c)
    return F.when(v.rlike(f'["\r\n{delimiter}]'), F.concat(F.lit('"'), F.replace(v, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(v)


def csv_line(columns: list[str], delimiter: str = ",", guard: bool = True) -> Column:
    if delimiter not in DELIMITERS:
        raise ValueError(f"a delimiter is one of {DELIMITERS}")
    return F.concat_ws(delimiter, *(csv_cell(f"`{c}`", delimiter, guard) for c in columns))


def tsv_line(columns: list[str]) -> Column:
    return F.concat_ws("\t", *(F.regexp_replace(text(f"`{c}`"), r"[\t\r\n]+", " ") for c in columns))


def json_line(columns: list[str]) -> Column:
    return F.to_json(F.struct(*(text(f"`{c}`").alias(c) for c in columns)))


def pretty_json(columns: list[str]) -> Column:
    """A row as an entry of a pretty JSON array: two blanks a level, null as ''."""
    entries = F.array(*(F.concat(F.lit(f"    {json.dumps(c, ensure_ascii=False)}: "), _json_text(text(f"`{c}`"))) for c in columns))
    return F.concat(F.lit("  {\n"), F.array_join(entries, ",\n"), F.lit("\n  }"))


def _json_text(c: Column) -> Column:
    """A JSON string literal."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)


def json_array_lines(df: DataFrame, order: str) -> DataFrame:
    """part, line: the pieces of a pretty JSON array in order, all but the last entry followed by a comma; nothing is gathered on the driver."""
    columns = [c for c in df.columns if c != order]
    last = F.broadcast(df.agg(F.max(order).alias("_last")))
    body = df.crossJoin(last).select(F.col(order).cast("long").alias("part"), F.concat(pretty_json(columns), F.when(F.col(order) == F.col("_last"), "").otherwise(",")).alias("line"))
    ends = df.agg(F.min(order).cast("long").alias("a"), F.max(order).cast("long").alias("b")).select(F.inline(F.array(F.struct((F.coalesce("a", F.lit(0)) - 1).alias("part"), F.lit("[").alias("line")), F.struct((F.coalesce("b", F.lit(0)) + 1).alias("part"), F.lit("]").alias("line")))))
    return body.unionByName(ends)


def write_json_array(df: DataFrame, path: str, order: str) -> None:
    """One pretty JSON array over part files that follow each other in `order`."""
    json_array_lines(df, order).repartitionByRange("part").sortWithinPartitions("part").select("line").write.text(path)


def data_url(c, mime: str = "application/octet-stream") -> Column:
    """Bytes or text as a base64 address."""
    return F.concat(F.lit(f"data:{mime};base64,"), F.base64(col(c)))


def from_data_url(c) -> Column:
    """The bytes of a base64 address; null for any other text."""
    return F.when(col(c).rlike(r"^data:[^,]*;base64,[A-Za-z0-9+/=\s]*$"), F.unbase64(F.regexp_replace(F.substring_index(col(c), ",", -1), r"\s+", "")))


def header(columns: list[str], delimiter: str = ",", guard: bool = True) -> str:
    """The header line of delimited text, escaped like any cell."""

    def cell(c: str) -> str:
        c = f"'{c}" if guard and c[:1] in "=+-@\t\r" and c else c
        return '"' + c.replace('"', '""') + '"' if any(x in c for x in f'"{delimiter}\r\n') else c

    return delimiter.join(map(cell, columns))


def _with_head(df: DataFrame, head: str, path: str) -> None:
    def lines(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([head, *own] if first else own, pa.string())], ["value"])
            first = False

    df.mapInArrow(lines, "value string").write.option("lineSep", "\r\n").text(path)


def write_csv(df: DataFrame, path: str, delimiter: str = ",", guard: bool = True) -> None:
    """Part files of lines ended by CR LF, each with the header; values quoted only where they need it."""
    _with_head(df.select(csv_line(df.columns, delimiter, guard).alias("value")), header(df.columns, delimiter, guard), path)


def write_tsv(df: DataFrame, path: str) -> None:
    """Part files of lines ended by CR LF, each with the header."""
    import re

    _with_head(df.select(tsv_line(df.columns).alias("value")), "\t".join(re.sub(r"[\t\r\n]+", " ", c) for c in df.columns), path)


def write_ndjson(df: DataFrame, path: str) -> None:
    df.select(json_line(df.columns).alias("value")).write.text(path)


def json_array(df: DataFrame) -> str:
    """A pretty array for an export that the caller knows to be small; write_json_array() has no such bound."""
    return json.dumps([{c: r[c] or "" for c in df.columns} for r in df.toLocalIterator()], indent=2, ensure_ascii=False)
