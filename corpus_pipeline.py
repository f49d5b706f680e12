"""The corpus pipeline: each stage takes and returns documents, the last one packs them.

run() writes each stage's result to the shared folder, so that a lost executor costs the
tasks of one stage at most and no text is judged twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gleanery.llm import decontaminate, jaccard_join, packing, pii, textkit, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score 0.5 or more, by weights learnt from the labelled ones outside the test fold.

    Null and empty texts score the intercept alone and stay; repeated rows are judged
    alike; without labels, or on an empty table, the score is one half and all would go,
    so nothing is dropped then.
    """
    weights = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.drop_toxic(docs, weights) if len(weights[0]) > 1 else docs


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group linked by 80 of 100 five-word shingles.

    Rows without words (null, empty, blank) are nobody's copies and all stay; of rows that
    repeat id and text one stays; null ids come last in their group.
    """
    return jaccard_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a 10-word window of a benchmark item, or with the whole of a shorter item. Null and empty texts stay; without a benchmark all do."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind in brackets; n_chars follows the text. Null texts stay null, with their n_chars."""
    return pii.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 4096 tokens. Null and empty texts are a separator alone; every row is packed."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("pii", redact),
    ("packing", pack),
]

ORACLE_SQL = None  # a learnt score and a tokenizer are beyond SQL; tests/llm/test_llm_pipeline.py has the brute-force version


# Every stage keeps extra columns, whatever they are called, up to the last one, whose rows are pieces.


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = textkit.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
