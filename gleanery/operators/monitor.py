"""A scheduled run as one operator: clean, compare with the snapshot before, keep, record, notify."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.operators import diff, snapshots
from gleanery.operators.jobs import Job, notifications
from gleanery.operators.pipeline import POS, apply_transforms


@dataclass
class Run:
    """What a run leaves: its comparison (none for the first), the history entry, and what is worth a message."""

    comparison: diff.Comparison | None
    entry: DataFrame
    messages: DataFrame
    deleted: list[str]
    next_at: int | None


def scheduled_run(extracted: DataFrame, job: Job, path: str, at: int, columns: dict[str, str], keep: int = snapshots.KEEP_SNAPSHOTS, prices: list[str] | None = None) -> Run:
    """`extracted` has the columns and a row position; `columns` gives each one's attribute. Times are milliseconds.

    The snapshot is written before it is compared, so a run that fails later can be
    repeated under the same time without a second copy; retention comes last.
    """
    spark, group, snapshot_id = extracted.sparkSession, job.name, f"{job.name}-{at}"
    snapshots.delete(spark, path, group, snapshot_id)
    snapshots.save(apply_transforms(extracted, list(job.steps)), path, group, snapshot_id, at)
    current = snapshots.latest(spark, path, group, at + 1).select(POS, *columns)
    before = snapshots.latest(spark, path, group, at)
    comparison = None if before.isEmpty() else diff.compare(before.select(POS, *columns), current, columns, job.compare_key, prices)
    if comparison:
        counts = comparison.stats().select("new_count", "removed_count", "changed_count", F.col("current_count").alias("row_count"))
    else:
        counts = current.agg(F.lit(0).alias("new_count"), F.lit(0).alias("removed_count"), F.lit(0).alias("changed_count"), F.count(F.lit(1)).alias("row_count"))
    entry = counts.select(F.lit(job.name).alias("job_id"), F.lit(at).cast("long").alias("at"), F.lit("success").alias("status"), *(F.col(c).cast("long").alias(c) for c in counts.columns))
    said = notifications(entry.select(F.col("job_id").alias("name"), F.lit(job.notify).alias("notify"), "status", "new_count", "removed_count", "changed_count", F.lit(None).cast("string").alias("error")))
    entry, said = (spark.createDataFrame(x.collect(), x.schema) for x in (entry, said))  # one row each, before old snapshots go
    return Run(comparison, entry, said, snapshots.retain(spark, path, group, keep), at + job.interval_minutes * 60_000 if job.interval_minutes else None)
