"""Document fingerprints: one-permutation MinHash with optimal densification and packed low-order bits.

Each five-word shingle is hashed once; the hash's first bits choose one of `BINS` bins
and the rest compete for its minimum. An empty bin borrows from the first full bin that
its own sequence of hashed bins meets. Of each minimum, hashed with its bin, only `KEEP`
low-order bits are stored, and the likeness takes chance agreement of those bits into account.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk

BINS, KEEP, SHINGLE = 512, 4, 5
_BIN_BITS = BINS.bit_length() - 1
_OWN = tk.mix64(np.arange(BINS, dtype=np.uint64))


def shingle_hashes(texts: list[bytes], n: int = SHINGLE):
    """(hash, text number) of every n-word shingle; a shorter text is one shingle, an empty one none."""
    hashes, owners = [], []
    for lo, hi in tk.runs(texts):
        buf, starts, ends, bounds = tk.find_words(texts[lo:hi], tk.SPACED)
        h = tk.hash_words(buf, starts, ends, lower=True)
        words = np.diff(bounds)
        owner = np.repeat(np.arange(lo, hi), words)
        grams = tk.hash_grams(h, n)
        whole = owner[: len(grams)] == owner[n - 1 :][: len(grams)]
        hashes.append(grams[whole])
        owners.append(owner[: len(grams)][whole])
        for i in np.flatnonzero((words > 0) & (words < n)):
            hashes.append(tk.hash_grams(h[bounds[i] : bounds[i + 1]], int(words[i])))
            owners.append(np.array([lo + i]))
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(owners)


def bins_of(hashes: np.ndarray, owners: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(low-order bits of each text's densified bins, whether the text has a shingle)."""
    none = np.uint64(0xFFFFFFFFFFFFFFFF)
    low = np.full(count * BINS, none)
    at = owners * BINS + (hashes >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
    np.minimum.at(low, at, hashes & np.uint64((1 << (64 - _BIN_BITS)) - 1))
    full = low != none
    some = full.reshape(count, BINS).any(axis=1)
    empty = np.flatnonzero(~full & np.repeat(some, BINS))
    row, attempt = empty // BINS * BINS, 0
    while len(empty):
        attempt += 1
        pick = row + (tk.mix64((empty % BINS + BINS * attempt).astype(np.uint64)) >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        found = full[pick]
        low[empty[found]] = low[pick[found]]
        empty, row = empty[~found], row[~found]
    low = tk.mix64(low.reshape(count, BINS) + _OWN)  # a value that many bins borrow must not agree by chance in all of them
    return (low & np.uint64((1 << KEEP) - 1)).astype(np.uint8), some


def fingerprints(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return bins_of(*shingle_hashes(texts), len(texts))


def packed(bins: np.ndarray, some: np.ndarray) -> list[str]:
    """Two bins in a byte, in hexadecimal; empty for a text without words."""
    return [x.tobytes().hex() if s else "" for x, s in zip(bins[:, 0::2] << 4 | bins[:, 1::2], some, strict=True)]


def likeness(a: np.ndarray, a_some: np.ndarray, b: np.ndarray, b_some: np.ndarray) -> np.ndarray:
    """Estimated Jaccard likeness row by row: agreement of stored bits, less what chance gives. Two texts without words are alike."""
    chance = 1 / (1 << KEEP)
    out = np.clip(((a == b).mean(axis=1) - chance) / (1 - chance), 0, 1)
    return np.where(a_some & b_some, out, (a_some == b_some).astype(float))


def fingerprint_documents(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document. Row by row: null and empty texts have an empty fingerprint, repeated rows are judged each."""

    def run(batches):
        for batch in batches:
            ids, texts = tk.fields(batch, "doc_id", "text")
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(packed(*fingerprints(tk.as_bytes(texts))), pa.string())], ["doc_id", "fingerprint"])

    return tk.small_batches(tk.exact(documents, "doc_id", "text")).mapInArrow(run, "doc_id long, fingerprint string")


def with_successors(documents: DataFrame, per_partition: int = 16, most: int = 1 << 15) -> DataFrame:
    """doc_id, text in buckets of consecutive ids, each followed by a guest: the next bucket's first document.

    Texts are shuffled once. The driver sees quantiles and least ids of at most `most`
    buckets, a number bound by the partitions, never by the rows. Partitions come sorted
    by bucket, guest, doc_id and text; the last bucket's guest is the very first document.
    """
    from pyspark.ml.feature import Bucketizer

    spark = documents.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    count = min(parts * per_partition, most)
    rows = documents.select("doc_id", "text").withColumn("_id", F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))))
    cuts = rows.filter("doc_id is not null").approxQuantile("_id", [i / count for i in range(1, count)], 1 / (8 * count)) if count > 1 else []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    rows = Bucketizer(splits=edges, inputCol="_id", outputCol="_b").transform(rows).withColumn("_b", F.col("_b").cast("int"))
    firsts = sorted((r["_b"], r["first"]) for r in rows.groupBy("_b").agg(F.min("_id").alias("first")).collect())
    guests = spark.createDataFrame([(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)], "_id double, _to int")
    rows = rows.join(F.broadcast(guests), "_id", "left")
    place = F.explode(F.array_compact(F.array(F.struct(F.col("_b").alias("b"), F.lit(False).alias("guest")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("b"), F.lit(True).alias("guest"))))))
    rows = rows.select("doc_id", "text", place.alias("_p")).select("doc_id", "text", F.col("_p.b").alias("bucket"), F.col("_p.guest").alias("guest"))
    return rows.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", F.asc_nulls_first("doc_id"), F.xxhash64("text"))


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def edit_likeness(documents: DataFrame) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next document's.

    The next document follows in doc_id order (null ids first, ties by a hash of the
    text), the first follows the last; a lone document follows itself. Null texts count
    as empty. Extra columns are ignored; an empty table gives no rows.
    """
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def judge(rows):
        """Of rows in order, all but guests and the last; each has its next right behind it."""
        texts = [r[1] or "" for r in rows]
        new = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
        new = [x.encode() for x in new]
        own, some = fingerprints([t.encode() for t in texts])
        changed, changed_some = fingerprints(new)
        near_edited = likeness(own[:-1], some[:-1], changed, changed_some)
        near_next = likeness(own[:-1], some[:-1], own[1:], some[1:])
        keep = [i for i in range(len(rows) - 1) if not rows[i][3]]
        prints, changed_prints = packed(own, some), packed(changed, changed_some)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][0] for i in keep], pa.int64()),
                pa.array([len(texts[i]) for i in keep], pa.int64()),
                pa.array([hashlib.sha256(new[i]).hexdigest() for i in keep], pa.string()),
                pa.array([prints[i] for i in keep], pa.string()),
                pa.array([changed_prints[i] for i in keep], pa.string()),
                pa.array(near_edited[keep], pa.float64()),
                pa.array(near_next[keep], pa.float64()),
            ],
            names,
        )

    def run(batches):
        last = []
        for batch in batches:
            rows = last + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            if len(rows) > 1:
                yield judge(rows)
            last = rows[-1:]

    kinds = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    documents = tk.exact(documents, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if documents.isEmpty():
        return documents.sparkSession.createDataFrame([], kinds)
    return with_successors(tk.small_batches(documents)).mapInArrow(run, kinds)
