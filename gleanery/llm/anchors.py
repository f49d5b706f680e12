"""Content-chosen anchors: for every window of words, the position of its least gram.

Equal windows choose the same position in themselves, so two texts that share a window
share an anchor. Consecutive windows with one anchor form a segment; there is about one
for every 22 words at the usual sizes. A segment is known by a hash of all its words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk

WINDOW, GRAM = 50, 8
_STEP = 1 << 15  # windows worked on at a time
_POSITION = np.uint64((1 << 24) - 1)
LAST_ID = (1 << 63) - 1


def least_positions(grams: np.ndarray, width: int) -> np.ndarray:
    """For each `width` consecutive grams, the position of the least (leftmost of equals)."""
    key = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        key = np.minimum(key[:-step], key[step:])
        have += step
    return (key & _POSITION).astype(np.int64)


def segments(h: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """Of one text's word hashes: (anchor gram's hash, segment's hash, first window, windows, anchor) arrays."""
    parts, total = [], len(h) - window + 1
    for a in range(0, max(total, 0), _STEP):
        own = h[a : min(a + _STEP, total) + window - 1]
        grams = tk.hash_grams(own, gram)
        at = least_positions(grams, window - gram + 1)
        lo = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        hi = np.append(lo[1:], len(at))
        acc = np.zeros(len(own) + 1, np.uint64)
        np.multiply(own, tk._G_UP[: len(own)], out=acc[1:])
        np.cumsum(acc, out=acc)
        size = (hi - lo + window - 1).astype(np.uint64)
        seg = tk.mix64((acc[hi + window - 1] - acc[lo]) * tk._G_DOWN[lo] + tk.mix64(size))
        parts.append((grams[at[lo]], seg, lo + a, hi - lo, at[lo] + a))
    if not parts:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def word_hashes(texts: list[bytes]):
    """(hashes of each text's words) for texts in turn."""
    for lo, hi in tk.runs(texts):
        buf, starts, ends, bounds = tk.find_words(texts[lo:hi], tk.SPACED)
        h = tk.hash_words(buf, starts, ends)
        for i in range(hi - lo):
            yield h[bounds[i] : bounds[i + 1]]


def keyed(documents: DataFrame) -> DataFrame:
    """id (null ids come last), version (tells rows of one id with different texts apart), text."""
    documents = tk.exact(documents, "doc_id", "text")
    return documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), F.xxhash64("text").alias("version"), "text")


def anchor_rows(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """anchor, segment, id, version, first, windows, at: every segment of every text."""
    names = ["anchor", "segment", "id", "version", "first", "windows", "at"]

    def run(batches):
        for batch in batches:
            ids, versions, texts = (batch.column(i) for i in range(3))
            ids, versions = ids.to_numpy(), versions.to_numpy()
            found = [segments(h, window, gram) for h in word_hashes(tk.as_bytes(texts))]
            count = [len(f[0]) for f in found]
            a, s, first, n, at = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(s.view(np.int64)), pa.array(np.repeat(ids, count)), pa.array(np.repeat(versions, count)), pa.array(first.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names)

    return tk.small_batches(rows).mapInArrow(run, "anchor long, segment long, id long, version long, first int, windows int, at int")


def in_several(found: DataFrame) -> DataFrame:
    """Anchors in documents of different id; written, so that a join can split the rows of a hot one."""
    return tk.written(found.groupBy("anchor").agg(F.min("id").alias("_least"), F.max("id").alias("_most")).filter("_least < _most").select("anchor"))


def shared_segments(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The anchor rows whose anchor occurs in documents of different id, written to the shared folder. All are written first: they are read twice, and texts shall be hashed once."""
    found = tk.written(anchor_rows(rows, window, gram))
    many = in_several(found)
    # dealt out by document again, so that rows of a hot anchor come from many tasks and later joins can split them
    shared = tk.written(found.join(many.hint("merge"), "anchor").repartition("id", "first"))
    tk.discard(found, many)
    return shared


def representatives(shared: DataFrame) -> DataFrame:
    """For each segment that occurs: its least (id, version, first), with windows and at; written, as in_several()."""
    return tk.written(shared.groupBy("anchor", "segment").agg(F.min(F.struct("id", "version", "first", "windows", "at")).alias("_r")).select("anchor", "segment", "_r.*"))


def contested(firsts: DataFrame) -> DataFrame:
    """Representatives whose anchor has other segments in documents of other ids: those that only a closer look can tell apart."""
    many = in_several(firsts)
    return firsts.join(many.hint("merge"), "anchor")
