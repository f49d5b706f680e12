"""Value columns made from integer keys, stated for Spark and for DuckDB alike."""

from __future__ import annotations

from pyspark.sql import functions as F

#: Price text of a part: $1,234.56, with blanks among them.
PRICE_SPARK = """case when p_partkey % 13 = 0 then null when p_partkey % 11 = 0 then '' else
 concat(case p_partkey % 4 when 0 then '$' when 1 then 'USD ' when 2 then '€' else '' end,
 case when p_partkey * 37 % 90000 >= 1000 then concat(cast(p_partkey * 37 % 90000 div 1000 as string), ',', lpad(cast(p_partkey * 37 % 1000 as string), 3, '0')) else cast(p_partkey * 37 % 90000 as string) end,
 '.', lpad(cast(p_partkey % 100 as string), 2, '0'), case when p_partkey % 5 = 0 then '  ' else '' end) end"""
PRICE_DUCK = PRICE_SPARK.replace(" div ", " // ").replace("as string", "as varchar")

#: Numbers in many notations, by line of an order.
NOTATION_SPARK = """case l_linenumber % 10
 when 0 then concat('$', cast(l_orderkey % 900 + 1 as string), ',', lpad(cast(l_partkey % 1000 as string), 3, '0'), '.', lpad(cast(l_orderkey % 100 as string), 2, '0'))
 when 1 then concat(cast(l_orderkey % 900 + 1 as string), '.', lpad(cast(l_partkey % 1000 as string), 3, '0'), ',', lpad(cast(l_orderkey % 100 as string), 2, '0'), ' TL')
 when 2 then concat(cast(l_orderkey % 1000 as string), ',', cast(l_partkey % 10 as string))
 when 3 then concat(cast(l_orderkey % 99 + 1 as string), '.', cast(l_partkey % 10 as string), 'k')
 when 4 then concat('(', cast(l_orderkey % 5000 as string), ')')
 when 5 then concat(cast(l_orderkey % 9 + 1 as string), '.', lpad(cast(l_partkey % 1000 as string), 3, '0'))
 when 6 then concat('-', cast(l_orderkey % 100 as string), '.', cast(l_partkey % 10 as string), '%')
 when 7 then concat(cast(l_orderkey % 90 as string), ' items') else 'n/a' end"""
NOTATION_DUCK = NOTATION_SPARK.replace("as string", "as varchar")


def price(df):
    return df.withColumn("price", F.expr(PRICE_SPARK))


def number_sql(source: str, value: str, keep: str) -> str:
    """CTEs of the number reading of `value` in `source`; the last, `numbers`, has `keep`, str, mult, neg and num."""
    return rf"""
n1 AS (SELECT {keep}, regexp_replace({value}, '^\s+|\s+$', '', 'g') AS s FROM {source}),
n2 AS (SELECT *, (s LIKE '-%' OR regexp_matches(s, '^\(.*\)$')) AS neg,
       regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, '^\((.*)\)$', '\1'), '^[-+]', ''), '[^0-9.,kKmMbB\s]', '', 'g'), '^\s+|\s+$', '', 'g') AS k FROM n1),
n3 AS (SELECT *, CASE WHEN regexp_matches(k, '^.*\d\s+[bB]$') OR regexp_matches(k, '^.*\d\s*[kK]$') THEN 1000.0 WHEN regexp_matches(k, '^.*\d\s*[mM]$') THEN 1000000.0 ELSE 1.0 END AS mult,
       CASE WHEN regexp_matches(k, '^.*\d\s+[bB]$') THEN regexp_extract(k, '^(.*\d)\s+[bB]$', 1) WHEN regexp_matches(k, '^.*\d\s*[kKmM]$') THEN regexp_extract(k, '^(.*\d)\s*[kKmM]$', 1) ELSE k END AS b FROM n2),
n4 AS (SELECT *, length(b) - length(replace(b, ',', '')) AS nc, length(b) - length(replace(b, '.', '')) AS nd, length(b) - strpos(reverse(b), ',') AS lc, length(b) - strpos(reverse(b), '.') AS ld FROM n3),
n5 AS (SELECT *, CASE WHEN s IS NULL OR NOT regexp_matches(k, '\d') THEN NULL
       WHEN nc > 0 AND nd > 0 AND lc > ld THEN regexp_replace(replace(b, '.', ''), ',', '.') WHEN nc > 0 AND nd > 0 THEN replace(b, ',', '')
       WHEN nc = 1 AND length(split_part(b, ',', 2)) <= 2 THEN replace(b, ',', '.') WHEN nc > 0 THEN replace(b, ',', '')
       WHEN nd > 1 THEN replace(b, '.', '') WHEN nd = 1 AND length(split_part(b, '.', 2)) > 2 THEN NULL ELSE b END AS str0 FROM n4),
numbers AS (SELECT {keep}, neg, mult, CASE WHEN regexp_matches(str0, '^\s*(\d+\.?\d*|\.\d+)') THEN str0 END AS str,
       TRY_CAST(regexp_extract(str0, '^\s*(\d+\.?\d*|\.\d+)', 1) AS DOUBLE) * mult * CASE WHEN neg THEN -1 ELSE 1 END AS num FROM n5)"""


def number_text_sql(x: str) -> str:
    """Numbers of the test data as the engine prints them."""
    return f"CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN '0' WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
