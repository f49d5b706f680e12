"""Asset queues, file names without collisions, dataset ids and manifests."""

from __future__ import annotations

import json
import re
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gleanery.functions import urls
from gleanery.functions.text import present, text
from gleanery.operators.pipeline import POS, fill_template
from gleanery.streaming import accumulate


def collect_urls(df: DataFrame, column: str, skip_duplicates: bool = True) -> DataFrame:
    """The rows with an address that can be fetched, the first of each (fragment aside), with `url` and `key`."""
    found = df.filter(present(f"`{column}`")).withColumn("url", F.col(f"`{column}`")).filter(urls.validate("url")["ok"]).withColumn("key", urls.dedup_key("url"))
    if not skip_duplicates:
        return found
    first = found.groupBy("key").agg(F.min(POS).alias(POS)).select(POS)
    return found.join(first, POS, "left_semi")


def queue_stats(df: DataFrame, column: str, types: list[str] | None = None) -> DataFrame:
    """total_rows, empty, invalid, duplicates, type_filter_skipped, queued: counted in that order."""
    c = f"`{column}`"
    valid = present(c) & urls.validate(text(c))["ok"]
    by_key = df.select(present(c).alias("p"), valid.alias("v"), F.when(valid, urls.dedup_key(c)).alias("k")).groupBy("p", "v", "k").count()
    kept = F.col("v") & (urls.type_group("k").isin(types) if types else F.lit(True))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    return by_key.agg(
        total(F.lit(True)).alias("total_rows"), total(~F.col("p")).alias("empty"), total(F.col("p") & ~F.col("v")).alias("invalid"),
        (total(F.col("v")) - F.count_if("v")).alias("duplicates"), F.count_if(F.col("v") & ~kept).alias("type_filter_skipped"), F.count_if(kept).alias("queued"),
    )


def filter_types(df: DataFrame, types: list[str] | None) -> DataFrame:
    return df.filter(urls.type_group("url").isin(types)) if types else df


def type_counts(df: DataFrame) -> DataFrame:
    return df.groupBy(urls.type_group("url").alias("type_group")).agg(F.count(F.lit(1)).alias("n"))


def numbered_names(names: list[tuple[str, str | None]]) -> list[str]:
    """Final names in order: a name taken before (case aside) gets _2, _3 and so on before its ending."""
    used, out = set(), []
    for base, ext in names:
        n, name = 2, f"{base}.{ext}" if ext else base
        while name.lower() in used:
            name, n = (f"{base}_{n}.{ext}" if ext else f"{base}_{n}"), n + 1
        used.add(name.lower())
        out.append(name)
    return out


def name_assets(queue: DataFrame, template: str, kind: str = "file") -> DataFrame:
    """Adds `filename`. Names that meet are numbered in row order.

    A name that no other row has stays as it is, and copies of one name are numbered by
    their rank. Only where a family of names alike up to a trailing number holds a
    repeated name next to others can a number meet a name that stands already; such a
    family is numbered row by row. A nameless asset is named by its place in the queue.
    """
    columns = [c for c in queue.columns if c not in (POS, "url", "key")]
    base = urls.safe_file_name(fill_template(template, columns, F.col(POS)))
    ext = urls.extension("url")
    ext = F.coalesce(ext, F.lit("jpg")) if kind == "image" else ext
    named = queue.withColumn("_base", base).withColumn("_ext", ext)
    blank = F.col("_base") == ""
    place = F.when(F.col("_i") < 1000, F.lpad(F.col("_i").cast("string"), 3, "0")).otherwise(F.col("_i").cast("string"))
    if not named.filter(blank).isEmpty():
        named = accumulate.running(named, POS, {"_i": F.lit(1).cast("long")}, {})
        named = named.withColumn("_base", F.when(blank, F.concat(F.lit("image_" if kind == "image" else "file_"), place)).otherwise(F.col("_base"))).drop("_i")
    named = named.withColumn("_name", F.concat_ws(".", "_base", "_ext")).withColumn("_lower", F.lower("_name"))
    named = named.withColumn("_family", F.regexp_replace("_lower", r"(_\d+)+(?=\.[^.]*$|$)", ""))
    names = named.groupBy("_family", "_lower").count()
    families = names.groupBy("_family").agg(F.count(F.lit(1)).alias("_kinds"), F.max("count").alias("_most"))
    judged = named.join(families, "_family")
    numbered = F.concat("_base", F.when(F.col("_n") > 1, F.concat(F.lit("_"), F.col("_n").cast("string"))).otherwise(""), F.when(F.col("_ext").isNotNull(), F.concat(F.lit("."), "_ext")).otherwise(""))
    out = [*queue.columns, "filename"]
    single = judged.filter("_most = 1").withColumn("filename", F.col("_name")).select(out)
    alike = judged.filter("_most > 1 and _kinds = 1").withColumn("_n", F.row_number().over(Window.partitionBy("_lower").orderBy(POS))).withColumn("filename", numbered).select(out)
    mixed = judged.filter("_most > 1 and _kinds > 1").select(*queue.columns, "_base", "_ext", "_family")

    def number(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(POS)
        final = numbered_names([(b, None if pd.isna(e) else e) for b, e in zip(group["_base"], group["_ext"], strict=True)])
        return group.drop(columns=["_base", "_ext", "_family"]).assign(filename=final)

    schema = StructType([*queue.schema.fields, StructField("filename", StringType())])
    return single.unionByName(alike).unionByName(mixed.groupBy("_family").applyInPandas(number, schema))


def dataset_ids(df: DataFrame, name: str = "dataset_id") -> DataFrame:
    """1-based ids by position, padded to 4 digits or as many as the count has."""
    total = F.broadcast(df.agg(F.greatest(F.lit(4), F.length(F.count(F.lit(1)).cast("string"))).alias("_width")))
    return df.crossJoin(total).withColumn(name, F.lpad((F.col(POS) + 1).cast("string"), F.col("_width"), "0")).drop("_width")


def asset_status(url: Column, outcome: Column, included: bool = True) -> Column:
    """skipped, missing, downloaded or failed."""
    if not included:
        return F.lit("skipped")
    return F.when(text(url) == "", "missing").when(~urls.validate(url)["ok"], "skipped").when(outcome.isin("completed", "fetched"), "downloaded").when(outcome.isin("failed", "cancelled"), "failed").otherwise("missing")


def manifest(df: DataFrame, column: str, assets: DataFrame) -> DataFrame:
    """Every row with its dataset id, asset file name and status; `assets` has url, filename, status, one row for each address."""
    by_key = assets.groupBy(urls.dedup_key("url").alias("_key")).agg(F.first("filename").alias("_file"), F.last("status").alias("_status"))
    c = F.col(f"`{column}`")
    valid = urls.validate(c)["ok"]
    rows = dataset_ids(df).withColumn("_key", F.when(valid, urls.dedup_key(c)))
    out = rows.join(by_key, "_key", "left")
    return out.withColumns({"asset_filename": F.coalesce("_file", F.lit("")), "asset_status": asset_status(c, F.col("_status"))}).drop("_key", "_file", "_status")


def dataset_info(meta: dict) -> str:
    """dataset-info.json: every field present, in a fixed order."""
    empty = {"datasetName": "", "createdAt": 0, "sourceURL": None, "hostname": None, "savedScraperName": None, "rowCount": 0, "includedFormats": [], "assetCount": 0, "failedAssetCount": 0, "scraperVersion": None, "columns": [], "collectionMode": "current-page", "deepScrapeEnabled": False, "pagesVisited": None, "transformStepCount": 0, "exportedAt": 0}
    return json.dumps({k: meta.get(k) or v for k, v in empty.items()}, ensure_ascii=False)


def export_name(template: str | None, context: dict, at: datetime) -> str:
    """The base name of an export file from {site} {scraper} {date} {time} {rows} {format}; unknown tokens are empty."""
    site = context.get("site") or ""
    tokens = {"site": site, "scraper": context.get("scraper") or site, "date": at.strftime("%Y-%m-%d"), "time": at.strftime("%H-%M-%S"), "rows": "" if context.get("rows") is None else str(context["rows"]), "format": context.get("format") or ""}
    raw = re.sub(r"\{([^{}]+)\}", lambda m: tokens.get(m[1].strip(), ""), template or "{scraper}_{date}")
    name = re.sub(r"\.+$", "", re.sub(r"\s+", " ", re.sub(r'[<>:"/\\|?*\x00-\x1f]', "", raw)).strip())
    return name[:150].strip() or "export"
