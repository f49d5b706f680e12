"""Incremental accumulation: first-seen rows by key, stop rules, loop detection, run ledgers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gleanery.functions.text import let, text
from gleanery.operators.relational import row_key
from gleanery.streaming.folders import new_folder


@dataclass(frozen=True)
class Limits:
    """When a run ends; None means no limit."""

    max_rows: int | None = None
    max_passes: int | None = None
    empty_passes: int = 3


def merge_new(seen: DataFrame, batch: DataFrame, columns: list[str], order: str) -> DataFrame:
    """The batch's rows whose key was not seen before, the first of each."""
    keyed = batch.withColumn("_key", row_key(columns))
    first = keyed.groupBy("_key").agg(F.min(order).alias(order))
    fresh = keyed.join(first, ["_key", order], "left_semi")
    return fresh.join(seen.select(row_key(columns).alias("_key")).distinct(), "_key", "left_anti").drop("_key")


def accumulate(df: DataFrame, columns: list[str], batch: str, order: str) -> DataFrame:
    """What a run over ordered batches keeps: of each key the first row. One aggregate, whatever the number of batches."""
    keyed = df.withColumn("_key", row_key(columns))
    first = keyed.groupBy("_key").agg(F.min(F.struct(batch, order)).alias("_f"))
    kept = first.select("_key", F.col(f"_f.{batch}").alias(batch), F.col(f"_f.{order}").alias(order))
    return keyed.join(kept, ["_key", batch, order], "left_semi").drop("_key")


def simple_hash(c: Column) -> Column:
    """The 32-bit rolling hash h * 31 + code, in base 36."""
    codes = F.transform(F.split(c, ""), lambda ch: F.when(ch == "", 0).otherwise(F.ascii(ch)).cast("long"))
    rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, k: (h * 31 + k).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(c == "", "0").otherwise(F.lower(F.conv(rolled.cast("string"), 10, 36)))


def page_signature(url: Column, rows: Column) -> Column:
    """url::hash of a page's rows; `rows` is an array of the rows' texts in order."""
    return F.concat(text(url), F.lit("::"), simple_hash(F.array_join(rows, "~")))


def running(df: DataFrame, order: str, sums: dict[str, Column], greatest: dict[str, Column]) -> DataFrame:
    """Adds running totals and maxima in `order`, this row included.

    Rows are dealt to ranges of `order` and written once; each range starts from the totals
    of those before it, so no task has more than a range, and only one row for each range
    is summed up in one place.
    """
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    path = new_folder(spark, "running")
    columns = df.columns
    df.select(*columns, *(v.alias(f"_{k}") for k, v in {**sums, **greatest}.items())).repartitionByRange(n, order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    ahead, here = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.groupBy("_range").agg(*(F.sum(f"_{k}").alias(k) for k in sums), *(F.max(f"_{k}").alias(k) for k in greatest))
    before = parts.select("_range", *(F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"_{k}_before") for k in sums), *(F.max(k).over(ahead).alias(f"_{k}_before") for k in greatest))
    out = rows.join(F.broadcast(before), "_range")
    totals = [(F.sum(f"_{k}").over(here) + F.col(f"_{k}_before")).alias(k) for k in sums]
    tops = [F.greatest(F.max(f"_{k}").over(here), F.col(f"_{k}_before")).alias(k) for k in greatest]
    return out.select(*columns, *totals, *tops)


def passes(df: DataFrame, columns: list[str], page: str, order: str) -> DataFrame:
    """page, pass_no (1-based), added (new keys), total, repeated (its rows stood on an earlier page), empty_run of each page in order."""
    keyed = df.withColumn("_key", row_key(columns))
    firsts = keyed.groupBy("_key").agg(F.min(page).alias(page)).groupBy(page).agg(F.count(F.lit(1)).alias("added"))
    line = F.concat_ws("|", *(text(c) for c in columns))
    signed = df.groupBy(page).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), line.alias("l")))), lambda x: x["l"]), "~"), 256).alias("signature"))
    earliest = signed.groupBy("signature").agg(F.min(page).alias("_first"))
    steps = signed.join(firsts, page, "left").join(earliest, "signature").select(page, F.coalesce("added", F.lit(0)).alias("added"), (F.col(page) > F.col("_first")).alias("repeated"))
    counted = running(steps, page, {"pass_no": F.lit(1).cast("long"), "total": F.col("added")}, {})
    lately = running(counted, page, {}, {"_fruitful": F.when(F.col("added") > 0, F.col("pass_no")).otherwise(F.lit(0).cast("long"))})
    return lately.withColumn("empty_run", F.col("pass_no") - F.col("_fruitful")).drop("_fruitful")


def cut(steps: DataFrame, page: str, reason: Column) -> DataFrame:
    """The pages up to the first with a reason, with `stop` on the last: the reason, or end."""
    marked = steps.withColumn("stop", reason)
    first = F.broadcast(marked.agg(F.coalesce(F.min(F.when(F.col("stop").isNotNull(), F.col(page))), F.max(page)).alias("_last")))
    kept = marked.crossJoin(first).filter(F.col(page) <= F.col("_last"))
    return kept.withColumn("stop", F.when(F.col(page) == F.col("_last"), F.coalesce("stop", F.lit("end")))).drop("_last")


def _limits(limits: Limits, reason: Column) -> Column:
    if limits.max_rows is not None:
        reason = reason.when(F.col("total") >= limits.max_rows, "max-rows")
    return reason if limits.max_passes is None else reason.when(F.col("pass_no") >= limits.max_passes, "max-passes")


def stop_rule(steps: DataFrame, page: str, limits: Limits) -> DataFrame:
    """The pages a scrolling run reads: it ends on a loop, a limit, or after passes without new rows.

    A page is merged before the rules look at it, so a run may exceed max_rows by one page.
    """
    return cut(steps, page, _limits(limits, F.when(F.col("repeated"), "loop")).when(F.col("empty_run") >= limits.empty_passes, "no-new-data"))


def multi_page_rule(steps: DataFrame, page: str, limits: Limits, control: str = "next") -> DataFrame:
    """The pages a run over a next control reads. `control` says how each page's was: ok, disabled, missing or elsewhere (another origin)."""
    reason = _limits(limits, F.when(F.col("repeated"), "loop"))
    return cut(steps, page, reason.when(F.col(control) == "disabled", "complete").when(F.col(control) == "missing", "error").when(F.col(control) == "elsewhere", "origin-changed"))


def load_more_rule(steps: DataFrame, page: str, limits: Limits, button: str = "button") -> DataFrame:
    """The passes of a run that presses a button for more: a button that is gone after a press means all was read, one that never was is an error."""
    reason = _limits(limits, F.when(~F.col(button) & (F.col("pass_no") > 1), "complete").when(~F.col(button), "error"))
    return cut(steps, page, reason.when(F.col("empty_run") >= limits.empty_passes, "no-new-data"))


def session_key(columns: dict[str, str]) -> list[str]:
    """What tells the rows of a session apart, by the columns' attributes: the first link, else the entire row."""
    links = [c for c, attribute in columns.items() if attribute == "href"]
    return links[:1] or list(columns)


def seed(rows: DataFrame, columns: dict[str, str], order: str) -> DataFrame:
    """The rows a session starts with: the first of each key."""
    return merge_new(rows.limit(0), rows, session_key(columns), order)


def stream_accumulate(stream: DataFrame, columns: list[str], sink: str, checkpoint: str, order: str, limits: Limits | None = None, log: str | None = None, **trigger) -> StreamingQuery:
    """A streaming run: each micro-batch appends its unseen rows to the Parquet sink, first in `order`.

    Batches and their counts are written under their number, so a replayed batch replaces
    its own and nothing is added or logged twice, and a restarted run knows its passes.
    With limits the query stops itself by the same rules as stop_rule(). The counts, one
    row (batch, read, added) for each batch, lie in `log`, by default beside the sink.
    """
    spark, log = stream.sparkSession, log or f"{sink.rstrip('/')}.batches"
    state: dict = {}

    def merge(batch: DataFrame, number: int) -> None:
        seen = _read(spark, sink, batch.schema).filter(F.col("_batch") != number).drop("_batch")
        merge_new(seen, batch, columns, order).write.mode("overwrite").parquet(f"{sink}/_batch={number}")
        added = spark.read.schema(batch.schema).parquet(f"{sink}/_batch={number}").count()
        counts = spark.createDataFrame([(number, batch.count(), added)], "batch long, read long, added long")
        counts.coalesce(1).write.mode("overwrite").parquet(f"{log}/_batch={number}")
        state["stop"] = limits is not None and stop_reason(spark, log, limits)

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if limits:
        while query.isActive and not state.get("stop"):
            query.awaitTermination(1)
        if query.isActive:
            query.stop()
    return query


def stop_reason(spark: SparkSession, log: str, limits: Limits) -> str | None:
    """Why a streaming run ends after the batches in its log, or None: from one aggregate over one row a batch."""
    fruitful = F.max(F.when(F.col("added") > 0, F.col("batch")))
    rows = spark.read.schema("batch long, read long, added long").parquet(log)
    one = rows.agg(F.sum("added").alias("total"), F.count(F.lit(1)).alias("passes"), fruitful.alias("last")).first()
    empty = rows.filter(F.col("batch") > (-1 if one["last"] is None else one["last"])).count()
    if limits.max_rows is not None and (one["total"] or 0) >= limits.max_rows:
        return "max-rows"
    if limits.max_passes is not None and one["passes"] >= limits.max_passes:
        return "max-passes"
    return "no-new-data" if empty >= limits.empty_passes else None


def _read(spark: SparkSession, path: str, schema) -> DataFrame:
    """The sink with its batch numbers; empty only if there is none yet."""
    from pyspark.sql.types import LongType, StructType

    full = StructType(list(schema.fields)).add("_batch", LongType())
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], full)
    return spark.read.schema(full).parquet(path)


def stream_distinct(stream: DataFrame, columns: list[str], watermark: tuple[str, str] | None = None) -> DataFrame:
    """Rows of unseen keys inside the streaming plan: state grows with the keys, or is bounded by a watermark (then late repeats may pass)."""
    if watermark:
        return stream.withWatermark(*watermark).dropDuplicatesWithinWatermark(columns)
    return stream.dropDuplicates(columns)


def ledger(runs: DataFrame, keep: int | None = None) -> DataFrame:
    """Each run once, newest first; `keep` of them if given."""
    once = runs.groupBy("run_id").agg(F.min("at").alias("at")).orderBy(F.desc("at"), "run_id")
    return once if keep is None else once.limit(keep)


def url_pages(spark: SparkSession, first: int, step: int, count: int) -> DataFrame:
    """page_no, value of a numbered page sequence."""
    return spark.range(count).select((F.col("id") + 1).alias("page_no"), (F.lit(first) + F.col("id") * step).alias("value"))


def bounded_retries(attempts: DataFrame, most: int = 3) -> DataFrame:
    """url, attempts, status: completed if an attempt within the limit was, partial likewise, else failed."""
    tried = attempts.filter(F.col("attempt") <= most)
    best = let(F.collect_set("status"), lambda s: F.when(F.array_contains(s, "completed"), "completed").when(F.array_contains(s, "partial"), "partial").when(F.array_contains(s, "skipped"), "skipped").otherwise("failed"))
    return tried.groupBy("url").agg(F.max("attempt").alias("attempts"), best.alias("status"))
