"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of consecutive benchmark words. For each pattern length the
scanner has a shift table over blocks of two words (one, for patterns of one word):
it looks at the block that ends the present alignment, skips as far as no pattern
can end, and only at shift 0 goes to the bucket of that block, whose candidates are
then compared word by word.

All tables are arrays: about 15 bytes for each byte of benchmark text. A benchmark of
more than a stated size is searched in several passes over the documents, so that
neither the driver nor a worker ever holds more than one part of it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
PART_BYTES = 16 << 20


def words(text: bytes) -> list[bytes]:
    return WORD.findall(text.translate(tk.A_Z))


class Vocabulary:
    """The distinct words of all patterns, numbered from 1."""

    def __init__(self, known: list[bytes]):
        self.joined = b" ".join(known) + b" "
        self.ends = np.cumsum([len(w) + 1 for w in known], dtype=np.int64) - 1
        self.starts = self.ends - np.array([len(w) for w in known], np.int64)
        h = tk.hash_words(np.frombuffer(self.joined, np.uint8), self.starts, self.ends)
        order = np.argsort(h)
        self.hashes, self.order = h[order], (order + 1).astype(np.int32)

    def __len__(self) -> int:
        return len(self.starts)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word hash; 0 if no pattern has the word."""
        if not len(self.hashes):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where(self.hashes[at] == h, self.order[at], 0).astype(np.int64)

    def word(self, number: int) -> bytes:
        return self.joined[self.starts[number - 1] : self.ends[number - 1]]


class WuManber:
    """All patterns of one length: rows of word numbers in the order of their buckets, and the items of each."""

    def __init__(self, rows: np.ndarray, items: np.ndarray, vocabulary: Vocabulary):
        self.m = m = rows.shape[1]
        self.block = b = min(2, m)
        self.size = len(vocabulary) + 1
        rows, which = np.unique(rows, axis=0, return_inverse=True)
        last = self.keys_of(rows[:, m - b :]).reshape(-1)
        order = np.argsort(last, kind="stable")
        self.rows, self.last = rows[order], last[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        owned = np.unique(np.stack([place[which.reshape(-1)], items]), axis=1)
        self.items, self.bounds = owned[1].astype(np.int32), np.searchsorted(owned[0], np.arange(len(rows) + 1))
        ends = np.arange(m - b, -1, -1)  # how far each block is from the end of its pattern
        keys, shift = self.keys_of(rows).reshape(-1), np.tile(ends, len(rows))
        by = np.lexsort((shift, keys))
        keys, shift = keys[by], shift[by]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        self.keys, self.shifts = keys[new], shift[new].astype(np.int32)

    def keys_of(self, ids: np.ndarray) -> np.ndarray:
        """The key of each block of consecutive words along the last axis."""
        ids = ids.astype(np.int64)
        return ids if self.block == 1 else ids[..., :-1] * self.size + ids[..., 1:]

    def find(self, ids: np.ndarray, equal) -> list[tuple[int, int]]:
        """(start, row) of every occurrence; equal(start, row's numbers) compares the words themselves."""
        n, m, b = len(ids), self.m, self.block
        if n < m:
            return []
        key = self.keys_of(ids)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        shift = np.where(self.keys[at] == key, self.shifts[at], m - b + 1).tolist()
        found, end, last = [], m - b, len(shift)
        while end < last:
            if s := shift[end]:
                end += s
                continue
            start = end + b - m
            lo, hi = np.searchsorted(self.last, key[end], "left"), np.searchsorted(self.last, key[end], "right")
            for r in (lo + np.flatnonzero((self.rows[lo:hi] == ids[start : start + m]).all(axis=1))).tolist():
                if equal(start, self.rows[r].tolist()):
                    found.append((start, r))
            end += 1
        return found


class Matcher:
    """Scanners of a part of the benchmark, one for each pattern length."""

    def __init__(self, items: list[tuple], window: int):
        split = [(str(item), words(text)) for item, text in items]
        numbers = {w: i for i, w in enumerate(sorted({w for _, ws in split for w in ws}), 1)}
        self.vocabulary, self.names = Vocabulary(list(numbers)), sorted({name for name, _ in split})
        at = {name: i for i, name in enumerate(self.names)}
        by: dict[int, list[tuple]] = {}
        for name, ws in split:
            if ws:
                ids = np.array([numbers[w] for w in ws], np.int32)
                own = np.lib.stride_tricks.sliding_window_view(ids, min(window, len(ids)))
                by.setdefault(own.shape[1], []).append((own, np.full(len(own), at[name], np.int32)))
        self.scanners = [WuManber(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), self.vocabulary) for parts in by.values()]


def parts(benchmark: DataFrame, window: int, most_bytes: int) -> Iterator[Matcher]:
    """The benchmark in parts of about `most_bytes` of text (or one item), each read when it is asked for."""
    rows = tk.exact(benchmark, "item_id", "text").dropna()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // most_bytes))
    for k in range(n):
        part = rows if n == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Matcher([(r["item_id"], r["text"].encode()) for r in part.toLocalIterator()], window)


def scan(texts: list[bytes], matcher: Matcher, hits: list[dict], items: list[set]) -> list[int]:
    """Adds each text's hit words (start -> end) and items; returns the word counts."""
    counts = []
    for lo, hi in tk.runs(texts):
        buf, starts, ends, bounds = tk.find_words(texts[lo:hi], tk.PLAIN)
        ids = matcher.vocabulary.numbers(tk.hash_words(buf, starts, ends, lower=True))
        for i in range(lo, hi):
            a, b = bounds[i - lo], bounds[i - lo + 1]
            counts.append(int(b - a))

            def equal(start: int, numbers: list[int], a=a) -> bool:
                return all(buf[starts[a + start + k] : ends[a + start + k]].tobytes().translate(tk.A_Z) == matcher.vocabulary.word(x) for k, x in enumerate(numbers))

            for s in matcher.scanners:
                for at, r in s.find(ids[a:b], equal):
                    hits[i][at] = max(hits[i].get(at, 0), at + s.m)
                    items[i].update(matcher.names[k] for k in s.items[s.bounds[r] : s.bounds[r + 1]])
    return counts


def covered(spans: dict[int, int]) -> int:
    """Words inside the union of the spans."""
    total, reach = 0, 0
    for a in sorted(spans):
        total += max(0, spans[a] - max(a, reach))
        reach = max(reach, spans[a])
    return total


def find_contamination(documents: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids) of each document.

    No shuffle: the benchmark is broadcast, and each batch of documents is searched. If
    it has more than `part_bytes` of text, its parts are searched one after the other;
    between them the documents and what was found so far are written to the shared folder.
    Null or empty texts have no words; null items or ids are no items; an item that is
    repeated counts once; items of fewer than `window` words are one pattern; repeated
    documents are judged row by row; extra columns are ignored; an empty table gives no
    rows, an empty benchmark no hits.
    """
    sc = documents.sparkSession.sparkContext
    state = tk.small_batches(tk.exact(documents, "doc_id", "text")).select(F.col("doc_id").cast("long"), "text", F.lit(None).cast("binary").alias("spans"), F.lit(None).cast("array<string>").alias("items"), F.lit(0).cast("long").alias("n_words"))

    def search(rows: DataFrame, matcher: Matcher) -> DataFrame:
        sent = sc.broadcast(matcher)

        def run(batches):
            for batch in batches:
                texts = tk.as_bytes(batch.column(1))
                hits = [dict(np.frombuffer(x or b"", np.int64).reshape(-1, 2).tolist()) for x in batch.column(2).to_pylist()]
                items = [set(x or ()) for x in batch.column(3).to_pylist()]
                n = scan(texts, sent.value, hits, items)
                spans = [np.array(sorted(h.items()), np.int64).tobytes() if h else None for h in hits]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(n, pa.int64())], batch.schema.names)

        return rows.mapInArrow(run, state.schema)

    def finish(batches):
        for batch in batches:
            n = [covered(dict(np.frombuffer(x or b"", np.int64).reshape(-1, 2).tolist())) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), pa.array(n, pa.int64()), batch.column(3)], ["doc_id", "n_words", "n_hit", "items"])

    return in_passes(state, parts(benchmark, window, part_bytes), search).mapInArrow(finish, "doc_id long, n_words long, n_hit long, items array<string>")


def in_passes(rows: DataFrame, matchers: Iterator[Matcher], search) -> DataFrame:
    """search(rows, matcher) for each part in turn; the result of all but the last is written."""
    before, found = None, search(rows, next(matchers))
    for matcher in matchers:
        written = tk.written(found)
        if before is not None:
            tk.discard(before)
        before, found = written, search(written, matcher)
    return found


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10, part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows without any window of the benchmark, all columns as they are. Cases as in find_contamination."""
    sc, at, names = documents.sparkSession.sparkContext, documents.columns.index("text"), documents.columns

    def search(rows: DataFrame, matcher: Matcher) -> DataFrame:
        sent = sc.broadcast(matcher)

        def run(batches):
            for batch in batches:
                texts = tk.as_bytes(batch.column(at))
                hits, items = [{} for _ in texts], [set() for _ in texts]
                scan(texts, sent.value, hits, items)
                yield batch.filter(pa.array([not x for x in hits], pa.bool_()))

        return rows.mapInArrow(run, rows.schema)

    return in_passes(tk.by_place(tk.small_batches(documents)), parts(benchmark, window, part_bytes), search).toDF(*names)
