"""Substring deduplication by relative Lempel-Ziv parsing.

The reference is every document of smaller id, indexed in blocks by content: an entry
says where a segment, or a window of `window` words, first occurs. Parsing a document
against all blocks gives each window the place of its first occurrence; a factor starts
at the leftmost window that has one and is extended greedily while the following windows
continue at the same place of the same document. At a factor's end the next windows,
which still overlap it, are looked up anew, so that no copy across the boundary is lost.
Factors have at least `window` words, and their words are the duplicate ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import anchors
from gleanery.llm import textkit as tk
from gleanery.llm.anchors import GRAM, LAST_ID, WINDOW


def factorise(first: np.ndarray, count: np.ndarray, doc: np.ndarray, place: np.ndarray, window: int):
    """Greedy factors (start, length, reference document, start there) from index answers: windows first .. first + count - 1 lie at place .. in doc."""
    order = np.argsort(first, kind="stable")
    first, count, doc, place = first[order], count[order], doc[order], place[order]
    if not len(first):
        return first, count, doc, place
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1] + count[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] != first[1:] - first[:-1])
    at = np.flatnonzero(new)
    end = np.append(at[1:], len(first)) - 1
    return first[at], first[end] + count[end] - first[at] + window - 1, doc[at], place[at]


def lists(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(bounds of each row's list, the fields of all entries as arrays); null counts as empty."""
    bounds = np.zeros(len(column) + 1, np.int64)
    np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=bounds[1:])
    return bounds, [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in column.flatten().flatten()]


def spread(count: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n in turn."""
    return np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)


def answers(rows: DataFrame, shared: DataFrame, firsts: DataFrame, contested: DataFrame, window: int = WINDOW) -> DataFrame:
    """id, version, first, windows, doc, place: where windows of a document first occur in one of smaller id.

    A whole segment that an earlier document has is answered at once. Where the first
    document with a segment has it, at any place and in any row of its id, it goes on
    only if another document has the anchor in other surroundings. Its windows are then
    looked up one by one. Both steps aggregate before they shuffle, so large groups of
    copies stay small.
    """
    known = firsts.select("anchor", "segment", F.col("id").alias("doc"), F.col("first").alias("place"))
    whole = shared.join(known.hint("merge"), ["anchor", "segment"]).filter("doc < id").select("id", "version", "first", "windows", "doc", "place")

    own = shared.join(contested.select("anchor", "segment", F.col("id").alias("doc")).hint("merge"), ["anchor", "segment"]).filter("doc = id")
    wanted = own.groupBy("id", "version").agg(F.collect_set(F.struct("anchor", "first", "windows")).alias("wanted"))
    texts = rows.repartition("id", "version").join(wanted.hint("shuffle_hash"), ["id", "version"])

    def windows(batches):
        for batch in batches:
            ids, versions, texts, asked = (batch.column(i) for i in range(4))
            own, (anchor, first, count) = lists(asked)
            parts = []
            for k, h in enumerate(anchors.word_hashes(tk.as_bytes(texts))):
                w = tk.hash_grams(h, window)
                f, n = first[own[k] : own[k + 1]], count[own[k] : own[k + 1]]
                at = np.repeat(f, n) + spread(n)
                parts.append((np.repeat(anchor[own[k] : own[k + 1]], n), w[at].view(np.int64), at.astype(np.int32), len(at)))
            rows = [p[3] for p in parts]
            a, w, at = (np.concatenate([p[i] for p in parts]) for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(w), pa.array(np.repeat(ids.to_numpy(), rows)), pa.array(np.repeat(versions.to_numpy(), rows)), pa.array(at)], ["anchor", "hash", "id", "version", "at"])

    single = texts.mapInArrow(windows, "anchor long, hash long, id long, version long, at int")
    where = single.groupBy("anchor", "hash").agg(F.min(F.struct("id", "at")).alias("_r"), F.max("id").alias("_most")).filter("_r.id < _most").select("anchor", "hash", F.col("_r.id").alias("doc"), F.col("_r.at").alias("place"))
    single = single.join(where.hint("merge"), ["anchor", "hash"]).filter("doc < id").select("id", "version", F.col("at").alias("first"), F.lit(1).alias("windows"), "doc", "place")
    return whole.unionByName(single)


def index_answers(rows: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """id, version and an array `found` of (first, windows, doc, place): the answers for each document."""
    shared = anchors.shared_segments(rows, window, gram)
    firsts = anchors.representatives(shared)
    found = answers(rows, shared, firsts, anchors.contested(firsts), window)
    return found.groupBy("id", "version").agg(F.collect_list(F.struct("first", "windows", "doc", "place")).alias("found"))


def remove_copies(documents: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the text left) and factors of every document.

    A word goes if a window of `window` words of its document covers it that also starts
    in a document of smaller id. Documents of equal id never remove from each other, null
    ids come after all others, null and empty texts have no words, shorter texts than a
    window stay whole. Extra columns are ignored; an empty table gives no rows.
    """
    rows = anchors.keyed(documents)
    joined = rows.repartition("id", "version").join(index_answers(rows, window, gram).hint("shuffle_hash"), ["id", "version"], "left")
    factor = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts, counts, removed, kept, factors = tk.as_bytes(batch.column(2)), [], [], [], []
            own, found = lists(batch.column(3))
            for k, text in enumerate(texts):
                _, starts, ends, _ = tk.find_words([text], tk.SPACED)
                gone = np.zeros(len(starts), bool)
                f = factorise(*(x[own[k] : own[k + 1]] for x in found), window)
                for a, n in zip(f[0], f[1], strict=True):
                    gone[a : a + n] = True
                counts.append(len(starts))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([text[a:b] for a, b in zip(starts[~gone].tolist(), ends[~gone].tolist(), strict=True)]))
                factors.append([dict(zip(("start", "length", "doc_id", "place"), x, strict=True)) for x in zip(*(y.tolist() for y in f), strict=True)])
            ids = [None if x == LAST_ID else x for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(factors, factor)], ["doc_id", "n_words", "n_removed", "kept", "factors"])

    return joined.select("id", "version", "text", "found").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long,doc_id:long,place:long>>")
