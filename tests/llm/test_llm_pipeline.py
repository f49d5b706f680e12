"""The pipeline against a plain version of its stages, and the registered queries against their SQL."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__
import corpus_pipeline
from gleanery.llm import decontaminate, packing, pii, toxicity
from gleanery.llm.queries import ORACLES
from test_llm_operators import brute_components, plain_best_fit

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    for t in ("documents", "benchmark", "pages"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = __spark_entry__.queries()[name](spark, SMALL)
    want = duckdb.sql(__spark_entry__.oracle_sql()[name])
    names = sorted(want.columns)
    assert sorted(got.columns) == names
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(want.select(*names).fetchall())


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    rows = sorted(docs.collect())
    clean = stages["toxicity"](spark, docs, SMALL)
    assert clean.columns == docs.columns
    weights = toxicity.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    score = toxicity.scores([r.text.encode() for r in rows], toxicity.dense(weights, toxicity.BITS))
    rows = [r for r, s in zip(rows, score, strict=True) if s < 0.5]
    assert sorted(clean.collect()) == rows

    one = stages["ngram_jaccard"](spark, clean, SMALL)
    root = brute_components([r.text for r in rows], 5, 80)[1]
    rows = [r for i, r in enumerate(rows) if root[i] == i]
    assert one.columns == docs.columns and sorted(one.collect()) == rows

    pure = stages["decontamination"](spark, one, SMALL)
    patterns = set()
    for b in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect():
        w = decontaminate.words(b.text.encode())
        patterns |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))}
    rows = [r for r in rows if not any(tuple(w[k : k + 10]) in patterns for w in [decontaminate.words(r.text.encode())] for k in range(len(w)))]
    assert pure.columns == docs.columns and sorted(pure.collect()) == rows

    red = sorted(stages["pii"](spark, pure, SMALL).collect())
    assert [r.doc_id for r in red] == [r.doc_id for r in rows]
    assert [r.text for r in red] == [pii.redact(r.text, (b := pii.detect(r.text)) + pii.added(r.text, b)) for r in rows]
    assert [r.n_chars for r in red] == [len(r.text) for r in red]

    packed = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in rows}
    cut = packing.cut([r.text.encode() for r in red], packing.tokens.default_path(), 4096)
    assert len({r.sequence_id for r in packed}) == plain_best_fit([p[3] for p in cut], 4096)


def test_stages_on_odd_rows(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None, 3), (2, "", 0), (None, "mail bob@example.com now or never again", 39), (3, " \n", 2), (4, long, len(long)), (5, long, len(long)), (6, "one two three four five six seven", 33), (6, "one two three four five six seven", 33), (None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").selectExpr("*", "7 as node", "8 as label", "'x' as Text", "9 as _gleanery_row")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "six seven"), (2, None), (None, "bob")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    stages, sf = dict(corpus_pipeline.STAGES), f"file://{tmp_path}"
    columns = docs.columns
    clean = stages["toxicity"](spark, docs, sf)
    assert clean.columns == columns and clean.count() == 9
    one = stages["ngram_jaccard"](spark, clean, sf)
    assert one.columns == columns and sorted((r[0] or 0, (r[1] or "")[:3]) for r in one.collect()) == [(0, ""), (0, "mai"), (1, ""), (2, ""), (3, " \n"), (4, "w0 "), (6, "one")]
    pure = stages["decontamination"](spark, one, sf)
    assert pure.columns == columns and sorted(r[0] or 0 for r in pure.collect()) == [0, 0, 1, 2, 3, 4]
    red = stages["pii"](spark, pure, sf)
    assert red.columns == columns and {(r[1], r[2]) for r in red.collect() if r[0] is None} == {("mail [EMAIL] now or never again", 31), (None, None)}
    assert {r.doc_id for r in stages["packing"](spark, red, sf).collect()} == {None, 1, 2, 3, 4}
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0, name
