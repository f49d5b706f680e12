"""Translated messages: keys looked up in a language, then in the fallback, then shown as they are."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUPPORTED, FALLBACK = ("en", "tr", "de", "fr", "es", "zh-CN"), "en"


def plural_key(key: Column, count: Column) -> Column:
    return F.concat(key, F.when(F.abs(count) == 1, "_one").otherwise("_other"))


def normalize_locale(raw: Column) -> Column:
    """A locale's supported language, or the fallback; every Chinese locale is zh-CN."""
    base = F.split(F.lower(raw), "-")[0]
    table = F.create_map(*(F.lit(v) for s in SUPPORTED for v in (s.lower().split("-")[0], s)))
    return F.when(F.lower(raw).startswith("zh"), "zh-CN").otherwise(F.coalesce(F.try_element_at(table, base), F.lit(FALLBACK)))


def translate(messages: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds `shown` to (lang, key, count, params map) rows; `texts` is (lang, key, text), a table of the interface's strings.

    With a count the plural form is used if either language has it. {name} is replaced by
    the parameter of that name, and stays if there is none.
    """
    own = texts.select(F.col("lang").alias("_l"), F.col("key").alias("_k"), F.col("text").alias("_own"))  # broadcast only if its size allows
    base = texts.filter(F.col("lang") == FALLBACK).select(F.col("key").alias("_bk"), F.col("text").alias("_base"))
    forms = messages.withColumn("_plural", F.when(F.col("count").isNotNull(), plural_key(F.col("key"), F.col("count"))))

    def looked_up(df: DataFrame, key: str, name: str) -> DataFrame:
        met = df.join(own, (F.col("_l") == F.col("lang")) & (F.col("_k") == F.col(key)), "left").join(base, F.col("_bk") == F.col(key), "left")
        return met.withColumn(name, F.coalesce("_own", "_base")).drop("_l", "_k", "_own", "_bk", "_base")

    found = looked_up(looked_up(forms, "_plural", "_p"), "key", "_s")
    text = F.coalesce("_p", "_s")
    filled = F.aggregate(F.map_entries(F.coalesce("params", F.create_map().cast("map<string,string>"))), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return found.withColumn("shown", F.coalesce(filled, F.col("key"))).drop("_plural", "_p", "_s")


def coverage(texts: DataFrame) -> DataFrame:
    """lang, total, translated, percent (one decimal) of the fallback's keys in each language."""
    keys = texts.filter(F.col("lang") == FALLBACK).select("key").distinct()
    have = texts.join(keys, "key").groupBy("lang").agg(F.count_distinct("key").alias("translated"))
    total = keys.agg(F.count(F.lit(1)).alias("total"))
    return have.crossJoin(F.broadcast(total)).select("lang", "total", "translated", (F.floor(F.col("translated") / F.col("total") * 1000 + 0.5) / 10).alias("percent"))


def interpolate(text: str, params: dict) -> str:
    return re.sub(r"\{(\w+)\}", lambda m: str(params.get(m[1], m[0])), text)
