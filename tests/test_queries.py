"""Every query that has SQL, against DuckDB at the smallest size."""

import math
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from gleanery.plans import registry

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    for t in TABLES:
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SMALL)
    got = df.collect()
    if name not in registry.ORACLES:
        assert df.columns and got is not None
        return
    want = duckdb.sql(registry.ORACLES[name])
    names = sorted(want.columns)
    assert sorted(df.columns) == names
    rows = want.select(*(f'"{n}"' for n in names)).fetchall()
    assert sorted([plain(r[n]) for n in names] for r in got) == sorted([plain(v) for v in r] for r in rows)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(__spark_entry__.queries()) and set(registry.ORACLES) <= set(__spark_entry__.oracle_sql())
