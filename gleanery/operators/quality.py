"""Row quality: anomaly flags, verdicts on odd rows, and column profiles."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions.shapes import contaminated, looks_like_price  # noqa: F401
from gleanery.functions.text import present, strip, text

# Shapes of prices, links, dates, numbers and other fields.
PRICE = r"(?:[$€£₺¥₹]\s?\d[\d.,]*\d|\d[\d.,]*\d\s?[$€£₺¥₹])"
CURRENCY = r"(?:[$€£₺¥₹]\s?\d[\d.,]*\d?|\d[\d.,]*\d\s?[$€£₺¥₹])"
NUMBER = r"^\s*-?[\d,]+(?:\.\d+)?\s*[%kKmMbB]?\s*$"
URL = r"(?i)^(https?:)?//"
AGO = r"\d+\s?(?:min|hour|hr|day|week|month|year)s?\s?ago|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}"
DATE = rf"(?i)\b({AGO}|\d{{4}}-\d{{2}}-\d{{2}}|\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}})\b"
DATETIME = rf"(?i)\b({AGO}|\d{{1,2}}[/.\-]\d{{1,2}}[/.\-]\d{{2,4}})\b"
AUTHOR = r"^(?:u/|@)[\w.\-]+$"
RATING = r"(?i)^\s*\d(?:[.,]\d)?\s*(?:/\s*5|/\s*10|★|stars?)?\s*$"
COUNT = r"^\s*\(?[\d.,]+\s*[kKmMbB]?\+?\s*(comments?|replies|points?|upvotes?|views?|likes?|shares?|reviews?|ratings?)?\)?\s*$"
REVIEW = r"(?i)reviews?|ratings?"

# Codes of what speaks against a row, in the order they are judged, with what each weighs.
WEIGHTS = {"no_link": 2, "no_image": 2, "no_price": 2, "repeated_link": 2, "repeated_image": 2, "no_image_nor_price": 1, "few_values": 1, "short_title": 1}


def flag_anomalies(df: DataFrame, columns: list[str], name: str = "_anomaly") -> DataFrame:
    """Adds why a row is odd: a value missing where 7 of 10 rows have one, or far shorter than the upper median.

    One pass gathers counts by length of each column, which is small whatever the table,
    and one row of statistics joins the rows.
    """
    n = len(columns)
    lengths = df.select(F.posexplode(F.array(*(F.length(text(f"`{c}`")) for c in columns))).alias("i", "length")).groupBy("i", "length").count()
    w = Window.partitionBy("i").orderBy("length")
    filled = lengths.filter("length > 0").withColumn("upto", F.sum("count").over(w)).withColumn("all", F.sum("count").over(Window.partitionBy("i")))
    median = filled.filter("upto > floor(all / 2)").groupBy("i").agg(F.min("length").alias("median"), F.first("all").alias("filled"))
    total = lengths.filter("i = 0").agg(F.sum("count").alias("rows"))
    stats = F.broadcast(median.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct("median", "filled")))).alias("_s")).crossJoin(total.withColumnRenamed("rows", "_rows")))
    out = df.crossJoin(stats)

    def reason(i: int) -> Column:
        s, size = F.try_element_at(F.col("_s"), F.lit(i)), F.length(text(f"`{columns[i]}`"))
        missing = (size == 0) & (s["filled"] / F.col("_rows") >= 0.7)
        short = (size > 0) & (s["median"] >= 8) & (size < s["median"] * 0.15)
        return F.when(missing, f"{columns[i]} missing").when(short, f"{columns[i]} unusually short")

    said = F.concat_ws(", ", *(reason(i) for i in range(n)))
    return out.withColumn(name, F.when((F.col("_rows") >= 3) & (said != ""), said)).drop("_s", "_rows")


def classify_rows(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Adds verdict (accept, flag, exclude), weight and reasons (codes of WEIGHTS), from what most rows of the table are like.

    `columns` gives each column's attribute (href, src, text, ...). Two aggregates describe
    the table; values that several rows share are found by key, and only joined if the
    column is otherwise nearly unique.
    """
    names = list(columns)
    links, images, texts = ([n for n in names if columns[n] in kinds] for kinds in (("href",), ("src", "structured-image"), ("text", "structured")))
    has = lambda n: present(f"`{n}`")
    some = lambda ns: F.greatest(*(has(n) for n in ns)) if len(ns) > 1 else has(ns[0])
    price = lambda n: text(f"`{n}`").rlike(PRICE)
    filled = sum((has(n).cast("int") for n in names[1:]), has(names[0]).cast("int"))
    share = lambda c: F.avg(c.cast("double"))

    wanted = [F.count(F.lit(1)).alias("n"), F.median(filled).alias("fields")]
    wanted += [share(some(links)).alias("links")] if links else []
    wanted += [share(some(images)).alias("images")] if images else []
    for i, n in enumerate(texts):
        wanted += [share(has(n)).alias(f"has{i}"), F.avg(F.when(has(n), price(n).cast("double"))).alias(f"like{i}"), share(price(n)).alias(f"price{i}"), F.median(F.length(text(f"`{n}`"))).alias(f"len{i}")]
    for k, ns in (("link", links), ("image", images)):
        if ns:
            wanted += [F.count_distinct(F.when(has(ns[0]), F.col(f"`{ns[0]}`"))).alias(f"{k}_kinds"), F.count_if(has(ns[0])).alias(f"{k}_all")]
    s = df.agg(*wanted).first()
    if s["n"] < 5:
        return df.withColumns({"verdict": F.lit("accept"), "weight": F.lit(0), "reasons": F.array().cast("array<string>")})

    priced = next((i for i in range(len(texts)) if s[f"has{i}"] >= 0.4 and (s[f"like{i}"] or 0) >= 0.6), None)
    titled = max(range(len(texts)), key=lambda i: (s[f"len{i}"], -i)) if texts else None
    off = F.lit(False)
    no_link = ~some(links) if links and s["links"] >= 0.75 else off
    no_image = ~some(images) if images and s["images"] >= 0.75 else off
    no_price = ~price(texts[priced]) if priced is not None and s[f"price{priced}"] >= 0.75 else off
    few = filled <= s["fields"] * 0.5 if s["fields"] >= 2 else off
    size = F.length(text(f"`{texts[titled]}`")) if texts else None
    short = (size > 0) & (size < s[f"len{titled}"] * 0.3) if texts and s[f"len{titled}"] >= 20 else off
    shared = {}
    for k, ns in (("link", links), ("image", images)):
        shared[k] = off
        if ns and s[f"{k}_all"] and s[f"{k}_kinds"] / s[f"{k}_all"] >= 0.85:
            often = df.filter(has(ns[0])).groupBy(F.col(f"`{ns[0]}`").alias(f"_{k}")).count().filter("count > 1").select(f"_{k}", F.lit(True).alias(f"_{k}_shared"))
            df = df.join(often, F.col(f"`{ns[0]}`") == F.col(f"_{k}"), "left").drop(f"_{k}")
            shared[k] = F.coalesce(F.col(f"_{k}_shared"), off)
    tests = dict(zip(WEIGHTS, (no_link, no_image, no_price, shared["link"], shared["image"], no_image & no_price, few, short), strict=True))
    weight = reduce(add, (F.when(test, WEIGHTS[k]).otherwise(0) for k, test in tests.items()))
    reasons = F.array_compact(F.array(*(F.when(test, k) for k, test in tests.items())))
    out = df.withColumns({"weight": weight, "reasons": reasons})
    out = out.withColumn("verdict", F.when(F.col("weight") >= 5, "exclude").when(F.col("weight") >= 2, "flag").otherwise("accept"))
    return out.drop("_link_shared", "_image_shared")


def drop_excluded(df: DataFrame, anomaly: str = "_anomaly") -> DataFrame:
    """Without excluded rows; reasons become the anomaly of rows that have none."""
    said = F.nullif(F.array_join("reasons", "; "), F.lit(""))
    out = df.filter("verdict <> 'exclude'")
    return out.withColumn(anomaly, F.coalesce(F.col(anomaly), said) if anomaly in df.columns else said)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, coverage, uniqueness (of values present), field_type, suggested_name, avg_length, max_length of each column: one pass."""
    long = df.select(F.posexplode(F.array(*(text(f"`{c}`") for c in columns))).alias("i", "v"))
    v = F.col("v")
    shown, s = v != "", strip(v)
    like = lambda p, of=None: F.avg(F.when(shown if of is None else of, s.rlike(p).cast("double")))
    filled = s != ""
    agg = long.groupBy("i").agg(
        F.avg(shown.cast("double")).alias("coverage"), F.count_distinct(F.when(shown, v)).alias("kinds"), F.count_if(shown).alias("filled"),
        *(like(p, filled).alias(k) for k, p in (("currency", CURRENCY), ("url", URL), ("date", DATE), ("number", NUMBER))),
        *(like(p).alias(k) for k, p in (("n_price", PRICE), ("n_author", AUTHOR), ("n_date", DATETIME), ("n_rating", RATING), ("n_count", COUNT), ("n_review", REVIEW))),
        F.avg(F.when(shown, F.length(s))).alias("avg_length"), F.max(F.length(v)).alias("max_length"),
    )
    kind = F.when(F.col("currency").isNull(), "empty")
    for k in ("currency", "url", "date", "number"):
        kind = kind.when(F.col(k) >= 0.6, k)
    name = F.when(F.col("n_price") >= 0.6, "Price").when(F.col("n_author") >= 0.6, "Author").when(F.col("n_date") >= 0.5, "Date").when(F.col("n_rating") >= 0.6, "Rating")
    name = name.when((F.col("n_count") >= 0.6) & (F.col("n_review") >= 0.5), "Review Count").when(F.col("n_count") >= 0.6, "Count").when(F.col("avg_length") >= 60, "Description")
    return agg.select(F.element_at(F.array(*(F.lit(c) for c in columns)), F.col("i") + 1).alias("column"), "coverage", F.when(F.col("filled") > 0, F.col("kinds") / F.col("filled")).alias("uniqueness"), kind.otherwise("text").alias("field_type"), name.alias("suggested_name"), "avg_length", "max_length")


def spread(df: DataFrame, column: str) -> DataFrame:
    """mean, population deviation, and consistency of a numeric column: 1 less deviation over mean, from 0 up."""
    s = df.agg(F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"), F.var_pop(column).alias("variance"))
    return s.withColumn("consistency", F.when(F.col("mean") > 0, F.greatest(F.lit(0.0), 1 - F.col("deviation") / F.col("mean"))).otherwise(0.0))
