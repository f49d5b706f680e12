"""Snapshots of a dataset over time, retention, run history and monitor summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.pipeline import POS, with_pos
from gleanery.operators.relational import keep_newest

KEEP_SNAPSHOTS, KEEP_HISTORY = 10, 50
#: Minutes between scheduled runs.
INTERVALS = (60, 360, 720, 1440)
PRIORITY = {"error": 0, "changed": 1, "success": 2, "never": 3}


def save(df: DataFrame, path: str, group: str, snapshot_id: str, created_at: int) -> None:
    """Appends one snapshot: a row for each row of the dataset, partitioned by group."""
    df.withColumns({"snapshot_id": F.lit(snapshot_id), "created_at": F.lit(created_at).cast("long"), "group_key": F.lit(group)}).write.mode("append").partitionBy("group_key", "snapshot_id").parquet(path)


def listed(spark: SparkSession, path: str, group: str | None = None) -> DataFrame:
    """group_key, snapshot_id, created_at, row_count, newest first."""
    df = spark.read.parquet(path)
    df = df.filter(F.col("group_key") == group) if group else df
    return df.groupBy("group_key", "snapshot_id").agg(F.first("created_at").alias("created_at"), F.count(F.lit(1)).alias("row_count")).orderBy(F.desc("created_at"), F.desc("snapshot_id"))


def latest(spark: SparkSession, path: str, group: str, before: int | None = None) -> DataFrame:
    """The rows of the newest snapshot of a group, or of the newest made before `before`: what a run is compared with."""
    df = spark.read.parquet(path).filter(F.col("group_key") == group)
    df = df if before is None else df.filter(F.col("created_at") < before)
    newest = df.agg(F.max(F.struct("created_at", "snapshot_id")).alias("s")).select("s.snapshot_id")
    return df.join(F.broadcast(newest), "snapshot_id", "left_semi")


def delete(spark: SparkSession, path: str, group: str, snapshot_id: str) -> bool:
    """Removes one snapshot, which is a folder of its own; False if there is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/group_key={_partition(spark, group)}/snapshot_id={_partition(spark, snapshot_id)}")
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _partition(spark: SparkSession, value: str) -> str:
    """A partition value as its folder spells it."""
    return spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def retain(spark: SparkSession, path: str, group: str, keep: int = KEEP_SNAPSHOTS) -> list[str]:
    """Deletes all but the newest snapshots of a group; their ids. A group has few of them, so the list is read on the driver."""
    old = [r["snapshot_id"] for r in listed(spark, path, group).collect()[keep:]]
    for snapshot_id in old:
        delete(spark, path, group, snapshot_id)
    return old


def retained(snapshots: DataFrame, keep: int = KEEP_SNAPSHOTS) -> DataFrame:
    """Of a list of snapshots, the newest of each group."""
    return keep_newest(snapshots, ["group_key"], "created_at", keep, "snapshot_id")


def add_history(history: DataFrame, entry: DataFrame, keep: int = KEEP_HISTORY) -> DataFrame:
    """The run history with a new entry; only the newest of each job stay."""
    return keep_newest(history.unionByName(entry, allowMissingColumns=True), ["job_id"], "at", keep)


def next_run(at: Column, minutes: int) -> Column:
    if minutes not in INTERVALS:
        raise ValueError(f"runs are {INTERVALS} minutes apart")
    return at + F.lit(minutes * 60_000)


def status(last_status: Column, new: Column, removed: Column, changed: Column) -> Column:
    """never, error, changed or success."""
    return F.when(last_status.isNull(), "never").when(last_status == "error", "error").when(F.coalesce(new, F.lit(0)) + F.coalesce(removed, F.lit(0)) + F.coalesce(changed, F.lit(0)) > 0, "changed").otherwise("success")


def urgency() -> Column:
    return F.create_map(*(F.lit(v) for pair in PRIORITY.items() for v in pair))[F.col("status")]


def ranked(cards: DataFrame) -> DataFrame:
    """Monitors by urgency, then the last run first."""
    return cards.orderBy(urgency(), F.desc_nulls_last("last_run_at"))


def placed(cards: DataFrame, key: str) -> DataFrame:
    """Adds the 1-based `place` of each monitor in the order of ranked(), however many there are; `key` names a monitor and settles ties."""
    order = {"_urgency": urgency(), "_never": F.col("last_run_at").isNull(), "_newest": F.coalesce(-F.col("last_run_at"), F.lit(0))}
    return with_pos(cards.withColumns(order), [*order, key]).withColumn("place", F.col(POS) + 1).drop(POS, *order)


def filter_cards(cards: DataFrame, which: str) -> DataFrame:
    return cards.filter(F.col("status") == {"changed": "changed", "errors": "error"}[which]) if which != "all" else cards


def summary(cards: DataFrame) -> DataFrame:
    """active, success, changed, errors over enabled monitors."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return cards.filter("enabled").agg(F.count(F.lit(1)).alias("active"), is_("success").alias("success"), is_("changed").alias("changed"), is_("error").alias("errors"))
