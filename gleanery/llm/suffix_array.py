"""Duplicate passages by a sparse suffix array.

Only suffixes at minimiser positions are retained, and of those only where the anchor
gram occurs in several documents. Suffixes that are alike over a whole segment are one
entry. The entries are sorted over the cluster; each is compared with its neighbours,
and a match is extended to the right along the suffixes and to the left in the text
before them. Neighbours alone miss copies whose smaller id stands further off in a run
of alike suffixes, or agrees more to the left than to the right, so the windows of those
segments are also looked up one by one. Matches of at least `window` words are reported,
overlapping ones joined.
"""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import anchors
from gleanery.llm import textkit as tk
from gleanery.llm.anchors import GRAM, LAST_ID, WINDOW
from gleanery.llm.relative_lz import answers, lists

ENTRY = "key binary, left binary, id long, version long, at int"


def context(h: np.ndarray, at: np.ndarray, anchor: np.ndarray, size: int, gram: int) -> tuple[list[bytes], list[bytes]]:
    """Sort keys (anchor, then `size` words after its gram) and the `size` words before it, nearest first; 4 bytes a word."""
    w = (h >> np.uint64(32)).astype(">u4")
    w[w == 0] = 1
    first = anchor.view(np.uint64).astype(">u8")
    back = w[::-1]
    return (
        [first[i].tobytes() + w[a + gram : a + gram + size].tobytes() for i, a in enumerate(at.tolist())],
        [back[len(w) - a : len(w) - a + size].tobytes() for a in at.tolist()],
    )


def agreement(parts: list[bytes], skip: int, size: int) -> np.ndarray:
    """How many words each part has in common with the next one, from the start."""
    m = np.frombuffer(b"".join(p[skip:].ljust(4 * size, b"\0") for p in parts), np.uint32).reshape(len(parts), size)
    same = (m[:-1] == m[1:]) & (m[1:] != 0)
    return np.where(same.all(axis=1), size, same.argmin(axis=1))


def sorted_entries(entries: DataFrame, per_partition: int = 4) -> DataFrame:
    """Entries in buckets of consecutive keys, each bucket followed by the next one's first entry as a guest.

    Split keys come from a sample of at most some 50 for each bucket; the least key of
    each bucket is exact. So hot anchors are cut like any others, and no pair of
    neighbours is lost where they are.
    """
    spark = entries.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    count, total = parts * per_partition, entries.count()
    entries = entries.withColumn("rank", F.concat(F.col("key"), F.encode(F.concat_ws(":", "id", "version", "at"), "UTF-8")))
    every = max(1, total // (50 * count))
    sample = sorted(bytes(r[0]) for r in entries.filter(F.pmod(F.xxhash64("rank"), F.lit(every)) == 0).select("rank").collect())
    cuts = sorted({sample[len(sample) * i // count] for i in range(1, count)}) if sample else []
    sent = spark.sparkContext.broadcast(cuts)

    def place(batches):
        for batch in batches:
            at = batch.schema.names.index("rank")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([bisect_right(sent.value, x) for x in batch.column(at).to_pylist()], pa.int32())], [*batch.schema.names, "bucket"])

    placed = entries.mapInArrow(place, f"{ENTRY}, rank binary, bucket int")
    firsts = sorted((r["bucket"], bytes(r["first"])) for r in placed.groupBy("bucket").agg(F.min("rank").alias("first")).collect())
    guests = spark.createDataFrame([(bytearray(first), firsts[i][0]) for i, (_, first) in enumerate(firsts[1:])], "rank binary, _to int")
    both = placed.withColumn("guest", F.lit(False)).unionByName(placed.join(F.broadcast(guests), "rank").withColumn("bucket", F.col("_to")).drop("_to").withColumn("guest", F.lit(True)))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket", "guest", "rank").select("bucket", "guest", "key", "left", "id", "version", "at")


def neighbour_matches(entries: DataFrame, window: int, gram: int) -> DataFrame:
    """id, version, start, length, other, place for neighbours of different documents that agree in at least `window` words; the greater id is the copy."""
    size = window - gram
    names = ["id", "version", "start", "length", "other", "place"]

    def run(batches):
        last: list[tuple] = []
        for batch in batches:
            rows = last + list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            last = rows[-1:]
            if len(rows) < 2:
                continue
            bucket, guest, key, left, ids, versions, at = zip(*rows, strict=True)
            bucket, guest, ids, versions, at = (np.array(x) for x in (bucket, guest, ids, versions, at))
            head = np.frombuffer(b"".join(k[:8] for k in key), np.uint64)
            l, r = agreement(list(left), 0, size), agreement(list(key), 8, size)
            pair = np.flatnonzero((bucket[1:] == bucket[:-1]) & ~guest[:-1] & (head[1:] == head[:-1]) & (ids[1:] != ids[:-1]) & (l + r + gram >= window))
            copy = np.where(ids[pair] > ids[pair + 1], pair, pair + 1)
            other = 2 * pair + 1 - copy
            yield pa.RecordBatch.from_arrays([pa.array(ids[copy]), pa.array(versions[copy]), pa.array(at[copy] - l[pair]), pa.array(l[pair] + r[pair] + gram), pa.array(ids[other]), pa.array(at[other] - l[pair])], names)

    return sorted_entries(entries).mapInArrow(run, "id long, version long, start long, length long, other long, place long")


def join_overlaps(start: np.ndarray, length: np.ndarray, place: np.ndarray) -> list[tuple[int, int, int]]:
    """Spans of one document in another, overlapping ones on the same diagonal joined."""
    out: list[list[int]] = []
    for shift, a, n in sorted(zip((place - start).tolist(), start.tolist(), length.tolist(), strict=True)):
        if out and out[-1][2] == shift and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n, shift])
    return [(a, b - a, a + shift) for a, b, shift in out]


def matches(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, version, start, length, other, place: words of a document that also stand, at `place`, in the document `other` of smaller id."""
    rows = anchors.keyed(documents)
    shared = anchors.shared_segments(rows, window, gram)
    firsts = anchors.representatives(shared)
    contested = anchors.contested(firsts)
    looked_up = answers(rows, shared, firsts, contested, window).select("id", "version", F.col("first").cast("long").alias("start"), (F.col("windows") + window - 1).cast("long").alias("length"), F.col("doc").alias("other"), F.col("place").cast("long").alias("place"))

    wanted = contested.groupBy("id", "version").agg(F.collect_list(F.struct("anchor", "at")).alias("wanted"))
    texts = rows.join(wanted.hint("shuffle_hash"), ["id", "version"])

    def cut_out(batches):
        for batch in batches:
            ids, versions, texts, wanted = (batch.column(i) for i in range(4))
            own, (anchor, at) = lists(wanted)
            keys, lefts = [], []
            for k, h in enumerate(anchors.word_hashes(tk.as_bytes(texts))):
                key, left = context(h, at[own[k] : own[k + 1]], anchor[own[k] : own[k + 1]], window - gram, gram)
                keys += key
                lefts += left
            n = np.diff(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(lefts, pa.binary()), pa.array(np.repeat(ids.to_numpy(), n)), pa.array(np.repeat(versions.to_numpy(), n)), pa.array(at.astype(np.int32))], ["key", "left", "id", "version", "at"])

    entries = tk.written(texts.mapInArrow(cut_out, ENTRY))
    return looked_up.unionByName(neighbour_matches(entries, window, gram))


def _given(rows: DataFrame) -> DataFrame:
    return rows.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST_ID)))


def find_repeats(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, start, n_words, other_doc_id, other_start: passages of at least `window` words that also stand in a document of smaller id.

    Every word of such a passage is in a row of its document, and each document that
    shares one is in some row, as the copy or as the other.
    Offsets count words between white space. Documents of equal id are one for this
    purpose, null ids come last and are given as null, null, empty and shorter texts have
    no passages, extra columns are ignored, an empty table gives no rows.
    """
    found = matches(documents, window, gram).groupBy("id", "version", "other").agg(F.collect_set(F.struct("start", "length", "place")).alias("spans"))

    def joined(batches):
        for batch in batches:
            own, (start, length, place) = lists(batch.column(3))
            spans = [join_overlaps(*(x[a:b] for x in (start, length, place))) for a, b in zip(own, own[1:], strict=False)]
            at = np.repeat(np.arange(len(spans)), [len(s) for s in spans])
            s, n, o = (pa.array([x[i] for y in spans for x in y], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), s, n, batch.column(2).take(pa.array(at)), o], ["doc_id", "start", "n_words", "other_doc_id", "other_start"])

    return _given(tk.small_batches(found).mapInArrow(joined, "doc_id long, start long, n_words long, other_doc_id long, other_start long"))


def copied_passages(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, start, n_words: the runs of words of each document that find_repeats() covers, whichever documents they stand in.

    Passages that touch or overlap are one run. Cases as in find_repeats(); rows of one id
    with different texts have their runs each, rows with the same text once.
    """
    found = matches(documents, window, gram).groupBy("id", "version").agg(F.collect_set(F.struct("start", "length")).alias("spans"))

    def united(batches):
        for batch in batches:
            own, (start, length) = lists(batch.column(2))
            runs = [join_overlaps(*(x[a:b] for x in (start, length, start))) for a, b in zip(own, own[1:], strict=False)]
            at = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            s, n = (pa.array([x[i] for y in runs for x in y], pa.int64()) for i in range(2))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), s, n], ["doc_id", "start", "n_words"])

    return _given(tk.small_batches(found).mapInArrow(united, "doc_id long, start long, n_words long"))
