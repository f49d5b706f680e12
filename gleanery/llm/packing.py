"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Best fit looks only at lengths. So the exact decisions for the whole corpus are taken
over the histogram of piece lengths, at most `capacity` rows: bins of equal remaining
room form a class, a segment tree over the remaining capacities finds the tightest class
that is open in logarithmic time, and a run of equal pieces is placed at once just as
best fit would place them one by one. The result is a short list of runs; each piece
finds its sequence and offset from its length and its rank among pieces of that length.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk
from gleanery.llm import tokens

SEPARATOR = 1


class OpenBins:
    """A segment tree over remaining capacities; a leaf is set while its class has bins."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.tree = bytearray(2 * self.size)
        self.bins: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, r: int) -> None:
        i = r + self.size
        self.tree[i] = bool(self.bins[r])
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] | self.tree[2 * i + 1]

    def add(self, r: int, start: int, count: int) -> None:
        if count and r:
            self.bins[r].append((start, count))
            if len(self.bins[r]) == 1:
                self._mark(r)

    def take(self, r: int, most: int) -> tuple[int, int]:
        """A run of at most `most` bins with room r."""
        start, count = self.bins[r].pop()
        if count > most:
            self.bins[r].append((start + most, count - most))
            count = most
        if not self.bins[r]:
            self._mark(r)
        return start, count

    def tightest(self, need: int) -> int:
        """The least room >= need that some bin has, or -1."""
        i, tree = need + self.size, self.tree
        if tree[i]:
            return need
        while i > 1:
            if i % 2 == 0 and tree[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if tree[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return -1


def most_runs(capacity: int) -> int:
    """The bound on the runs of best_fit() that pack() states."""
    return 4 * capacity * math.isqrt(2 * capacity)


def best_fit(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Runs (length, rank, count, bin, bins, offset), and the number of bins.

    Piece j of a run (its rank less the run's) lies in bin + j % bins, at offset + j // bins * length.
    """
    open_, runs, made = OpenBins(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = open_.tightest(length)
            each = (capacity if room < 0 else room) // length
            if room < 0:
                start, bins, room = made, -(-left // each), capacity
                if bins > 1 and left % each:
                    bins -= 1
                made += bins
            else:
                start, bins = open_.take(room, max(1, left // each))
            n = min(left, bins * each)
            runs.append((length, rank, n, start, bins, capacity - room))
            open_.add(room - n // bins * length if n == bins * each else room - n * length, start, bins)
            rank, left = rank + n, left - n
    return np.array(runs, np.int64).reshape(-1, 6), made


def cut(texts: list[bytes], path: str, capacity: int):
    """(text, piece, start, length, crc32 of its ids) of every piece; the ids are the text's and a separator."""
    encode, out = tokens.encoder(path).encode, []
    for lo, hi in tk.runs(texts):
        ids, bounds = encode(texts[lo:hi])
        for i in range(lo, hi):
            own = np.append(ids[bounds[i - lo] : bounds[i - lo + 1]], np.uint32(SEPARATOR)).astype("<u4")
            out += [(i, k // capacity, k, len(x := own[k : k + capacity]), zlib.crc32(x.tobytes())) for k in range(0, len(own), capacity)]
    return out


def pieces(documents: DataFrame, capacity: int, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def run(batches):
        for batch in batches:
            ids, texts = tk.fields(batch, "doc_id", "text")
            at, *rest = np.array(cut(tk.as_bytes(texts), path, capacity), np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()).take(pa.array(at)), pa.array(rest[0].astype(np.int32)), *(pa.array(np.ascontiguousarray(x)) for x in rest[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])
        tk.give_back()

    return tk.small_batches(tk.exact(documents, "doc_id", "text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(documents: DataFrame, capacity: int = 4096, path: str | None = None) -> DataFrame:
    """Every piece with its sequence_id and offset.

    To the driver go the counts of at most `capacity` distinct lengths; back goes the
    broadcast list of runs. Its length does not grow with the documents: a length opens at
    most two groups of bins and splits at most two, and a group takes less than
    sqrt(2 * capacity) different lengths, so 4096 tokens allow 1.5 million runs of 48 bytes
    (some ten thousand in practice). Ranks are counted in salted groups of a length, so that a length that
    many documents share is spread over tasks. The pieces' numbers (not their ids) are
    written once to the shared folder, so texts are encoded once. Null and empty texts
    are the separator alone; repeated rows are packed each; an empty table gives no rows.
    """
    spark = documents.sparkSession
    cut_up = tk.written(pieces(documents, capacity, path or tokens.default_path()))
    counts = {r["length"]: r["count"] for r in cut_up.groupBy("length").count().collect()}
    runs, _ = best_fit(counts, capacity)
    if len(runs) > most_runs(capacity):
        raise AssertionError(f"{len(runs)} runs are beyond the bound")

    salts = min(max(sum(counts.values()) // 50_000, 256), 1 << 16)
    salted = cut_up.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    ahead = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(inside)).join(ahead, ["length", "salt"]).select(*cut_up.columns, (F.col("n") - 1 + F.col("ahead")).alias("rank"))

    plan = spark.sparkContext.broadcast(runs[np.lexsort((runs[:, 1], runs[:, 0]))])

    def run(batches):
        length, first, _, bin_, bins, at = plan.value.T
        key = (length << 44) + first
        for batch in batches:
            own, rank = (batch.column(batch.schema.names.index(x)).to_numpy() for x in ("length", "rank"))
            k = np.searchsorted(key, (own << 44) + rank, "right") - 1
            j = rank - first[k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bin_[k] + j % bins[k]), pa.array(at[k] + j // bins[k] * own)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
