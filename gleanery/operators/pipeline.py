"""Ordered, non-destructive cleaning pipelines over a DataFrame of string columns.

A pipeline is a list of steps folded over the frame. Each step adds one projection, and
Catalyst collapses them; nothing runs until an action. Columns are addressed by name, and
their order is part of the result.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import cleaning
from gleanery.functions.cleaning import StepError
from gleanery.functions.text import strip, text
from gleanery.streaming.folders import shared_folder

POS = "_pos"
MAX_STEPS, MAX_TEXT, MAX_DEPTH, MAX_ROWS = 50, 2000, 3, 100_000  # of a pipeline from outside


@dataclass(frozen=True)
class TransformStep:
    type: str
    column: str | None = None
    options: dict[str, Any] = field(default_factory=dict)
    enabled: bool = True
    new_column: str | None = None
    row_indices: tuple[int, ...] | None = None


# The presets and what they do.
PRESETS = {
    "cleanText": ("trim", "collapseWhitespace", "removeInvisibleChars", "decodeHtmlEntities"),
    "normalizePrice": ("trim", ("normalizeCurrency", {"mode": "normalizeValue"})),
    "normalizeUrl": ("trim", ("normalizeUrl", {"removeFragment": True})),
    "htmlToText": ("stripHtml", "decodeHtmlEntities", "collapseWhitespace"),
}


def preset(name: str, column: str) -> list[TransformStep]:
    return [TransformStep(s, column) if isinstance(s, str) else TransformStep(s[0], column, s[1]) for s in PRESETS[name]]


def with_pos(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds the row position: 0-based ranks of source keys that name a row and are never null.

    Only the keys are sorted, over ranges of them; they are written once to the shared
    folder, because ranges are sampled anew each time a plan runs, and counts and ranks
    must be of the same ones. Each range starts after the counts of those before it, so
    no task sorts the whole table.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = shared_folder(spark, f"positions-{uuid.uuid4().hex}")
    df.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(path)
    keys = spark.read.parquet(path).withColumn("_range", F.shiftright("_id", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = keys.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_ahead"))
    placed = keys.join(F.broadcast(ahead), "_range").select(*order, (F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_ahead")).alias(POS))
    return df.join(placed, order).select(*df.columns, POS)


def fill_template(template: str, columns: list[str], pos: Column | None = None) -> Column:
    """{Name} is the column's text, {index} and {row} the 1-based position, anything unknown empty."""
    parts = []
    for i, token in enumerate(re.split(r"\{([^{}]+)\}", template)):
        if i % 2 == 0:
            parts.append(F.lit(token))
        elif token.strip() in ("index", "row"):
            parts.append((pos + 1).cast("string") if pos is not None else F.lit(""))
        elif token.strip() in columns:
            parts.append(text(F.col(f"`{token.strip()}`")))
    return F.concat(*parts)


def _visible(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != POS]


def _insert(columns: list[str], after: str, new: list[str]) -> list[str]:
    at = columns.index(after) + 1
    return [*columns[:at], *new, *columns[at:]]


def _split(df: DataFrame, step: TransformStep) -> DataFrame:
    o = step.options
    names = o.get("outputNames") or ["Part 1", "Part 2"]
    if taken := [n for n in names if n in df.columns and n != step.column]:
        raise StepError(f"a column named {taken[0]!r} already exists")
    parts = F.transform(cleaning.split_parts(F.col(f"`{step.column}`"), o), strip)
    made = {n: F.coalesce(F.get(F.col("_parts"), F.lit(i)), F.lit("")) for i, n in enumerate(names)}
    out = df.withColumn("_parts", parts)
    order = _insert(df.columns, step.column, names)
    keep = o.get("keepOriginal") and step.column not in names
    if not keep:
        order.remove(step.column)
    return out.select(*(made[c].alias(c) if c in made else F.col(f"`{c}`") for c in order))


def _combine(df: DataFrame, step: TransformStep) -> DataFrame:
    o = step.options
    sources, name = o.get("sourceColumns") or [], (o.get("outputName") or "").strip()
    if len(sources) < 2:
        raise StepError("combine needs at least two columns")
    if missing := [c for c in sources if c not in df.columns]:
        raise StepError(f"combine: no column {missing[0]!r}")
    if not name:
        raise StepError("combine needs a name for its column")
    if name in df.columns and name not in sources:
        raise StepError(f"a column named {name!r} already exists")
    template = o.get("template") or " ".join(f"{{{c}}}" for c in sources)
    value = fill_template(template, _visible(df), F.col(POS) if POS in df.columns else None).alias(name)
    last = max(df.columns.index(c) for c in sources)
    kept = lambda cs: [F.col(f"`{c}`") for c in cs if (o.get("keepOriginal") or c not in sources) and c != name]
    return df.select(*kept(df.columns[: last + 1]), value, *kept(df.columns[last + 1 :]))


def apply_step(df: DataFrame, step: TransformStep, context: dict | None = None) -> DataFrame:
    """One step. A row-scoped step changes the rows whose position it lists, and only if the context asks for that."""
    if step.type == "combine":
        return _combine(df, step)
    if step.column not in df.columns:
        raise StepError(f"no column {step.column!r}")
    if step.type == "split" and step.options.get("outputMode") in (None, "", "columns"):
        return _split(df, step)
    source = F.col(f"`{step.column}`")
    value = cleaning.apply(step.type, source, step.options, context)
    if step.row_indices is not None and (context or {}).get("scopeRows"):
        value = F.when(F.col(POS).isin(list(step.row_indices)), value).otherwise(source)
    if step.new_column is None:
        return df.withColumn(step.column, value)
    name = step.new_column.strip()
    if not name:
        raise StepError("the new column needs a name")
    if name in df.columns:
        raise StepError(f"a column named {name!r} already exists")
    return df.select(*(value.alias(c) if c == name else F.col(f"`{c}`") for c in _insert(df.columns, step.column, [name])))


def apply_transforms(df: DataFrame, steps: list[TransformStep], context: dict | None = None) -> DataFrame:
    """The steps in order; disabled ones do nothing, the first bad one raises StepError."""
    return reduce(lambda d, s: apply_step(d, s, context), (s for s in steps if s.enabled), df)


def preview(df: DataFrame, before: list[TransformStep], candidate: TransformStep, sample: int = 5, context: dict | None = None) -> DataFrame:
    """before, after of up to `sample` rows with a value, out of the first max(6 * sample, 30)."""
    head = df.orderBy(POS).limit(max(6 * sample, 30))
    base = apply_transforms(head, before, context)
    tagged = apply_step(base, candidate, context)
    if candidate.type == "combine":
        sources, name = candidate.options["sourceColumns"], candidate.options["outputName"].strip()
        pairs = base.select(POS, F.concat_ws(" + ", *(text(F.col(f"`{c}`")) for c in sources)).alias("before")).join(tagged.select(POS, F.col(f"`{name}`").alias("after")), POS)
    else:
        new = [c for c in tagged.columns if c not in base.columns]
        shown = F.concat_ws(" | ", *(F.col(f"`{c}`") for c in new)) if new else F.col(f"`{candidate.column}`")
        pairs = base.select(POS, F.col(f"`{candidate.column}`").alias("before")).filter(text("before") != "").join(tagged.select(POS, shown.alias("after")), POS)
    return pairs.orderBy(POS).limit(sample).select("before", "after")


# --- editing and importing pipelines


def toggle(steps: list[TransformStep], i: int) -> list[TransformStep]:
    return [replace(s, enabled=not s.enabled) if k == i else s for k, s in enumerate(steps)]


def move(steps: list[TransformStep], i: int, by: int) -> list[TransformStep]:
    j = min(max(i + by, 0), len(steps) - 1)
    rest = [s for k, s in enumerate(steps) if k != i]
    return [*rest[:j], steps[i], *rest[j:]]


def remove(steps: list[TransformStep], i: int) -> list[TransformStep]:
    return [s for k, s in enumerate(steps) if k != i]


def undo(steps: list[TransformStep]) -> list[TransformStep]:
    return steps[:-1]


def _option(v, depth: int = 0):
    if depth > MAX_DEPTH:
        raise StepError(f"options are nested more than {MAX_DEPTH} deep")
    if isinstance(v, str):
        return bounded(v, MAX_TEXT, "an option")
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return v if v == v and abs(v) != float("inf") else 0
    if isinstance(v, list):
        return [x for x in (_option(e, depth + 1) for e in bounded(v, MAX_STEPS, "a list of options")) if x is not None]
    return None


def bounded(v, most: int, what: str):
    """The value; StepError if it is longer than a record from outside may be. Nothing is cut off."""
    if len(v) > most:
        raise StepError(f"{what} has {len(v)} entries or characters, more than {most}")
    return v


def import_steps(raw: Any) -> list[TransformStep]:
    """Steps out of untrusted JSON: unknown types and malformed steps are dropped, oversized ones raise StepError."""
    out = []
    for r in bounded(raw, MAX_STEPS, "the pipeline") if isinstance(raw, list) else []:
        if not isinstance(r, dict) or r.get("type") not in cleaning.KNOWN:
            continue
        column = bounded(r["column"], MAX_TEXT, "a column name") if isinstance(r.get("column"), str) and r["column"] else None
        if r["type"] != "combine" and not column:
            continue
        given = r.get("options") if isinstance(r.get("options"), dict) else {}
        options = {bounded(k, MAX_TEXT, "an option's name"): _option(v) for k, v in bounded(given, MAX_STEPS, "the options").items() if isinstance(k, str) and not isinstance(v, dict)}
        name = r.get("newColumnName")
        new = bounded(name, MAX_TEXT, "a column name") if r.get("destination") == "newColumn" and isinstance(name, str) and name.strip() else None
        rows = tuple(n for n in bounded(r["rowIndices"], MAX_ROWS, "the list of rows") if isinstance(n, int) and not isinstance(n, bool)) if isinstance(r.get("rowIndices"), list) else None
        out.append(TransformStep(r["type"], None if r["type"] == "combine" else column, options, r.get("enabled") is not False, new, rows))
    return out


def or_raw(df: DataFrame, steps: list[TransformStep], context: dict | None = None) -> tuple[DataFrame, str | None]:
    """(the cleaned frame, None), or (the frame as it was, what is wrong) if a step cannot be applied."""
    try:
        return apply_transforms(df, steps, context), None
    except StepError as e:
        return df, str(e)


def reset(steps: list[TransformStep]) -> list[TransformStep]:
    """No steps: the source is shown as it is."""
    return []
