"""Token ids of many texts by a public word BPE, and the exact histogram of encoded lengths.

The vocabulary never joins characters across white space, nor across a change between
ASCII letters or digits and ASCII punctuation other than the apostrophe. So a text is cut
there, each distinct part of a block is encoded once, and the ids are put together again;
the result is the tokenizer's own.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk

MOST_BYTES = 16 << 20  # of words that are held for comparison
LONGEST_KEPT = 256  # bytes of a part whose ids outlast the next forgetting
STRING = 4096  # bytes of the strings in which unknown parts are given to the tokenizer
_LABEL = np.full(256, 3, np.int8)  # apostrophe and all beyond ASCII: never a cut
_LABEL[:128] = 2
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    _LABEL[_a:_b] = 1
_LABEL[[0x20, 9, 10, 11, 12, 13]] = 0
_LABEL[0x27] = 3


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def eights(data: np.ndarray, padded: bool = False) -> np.ndarray:
    """At each place the 8 bytes from there on, as one number; past the end they are zero, unless the last 8 bytes are `padded` already."""
    if not padded:
        data = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


def same_bytes(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, size: np.ndarray) -> bool:
    """Whether all words of these sizes are the same bytes in two tables of eights()."""
    k = 0
    while len(size):
        left = np.minimum(size - k, 8).astype(np.uint64)
        mask = np.uint64((1 << 64) - 1) >> (np.uint64(64) - left * np.uint64(8))
        if ((a[a_at + k] ^ b[b_at + k]) & mask).any():
            return False
        k += 8
        more = np.flatnonzero(size > k)
        a_at, b_at, size = a_at[more], b_at[more], size[more]
    return True


class Encoder:
    """Encodes blocks of texts; keeps the ids of about `keep` parts between blocks, those that were met again before the rest."""

    def __init__(self, path: str, keep: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.folds, self.zero = self._folds(), self._zero()
        self.clear()

    def _folds(self) -> bool:
        """Whether the vocabulary reads A-Z as a-z, so that ASCII parts in either case are one."""
        letters, normalizer = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", self.tokenizer.normalizer
        special = all(t.special for t in self.tokenizer.get_added_tokens_decoder().values())
        return normalizer is not None and special and all(normalizer.normalize_str(x) == normalizer.normalize_str(x.lower()) for x in (*letters, letters))

    def _zero(self) -> int:
        """The id of "0" if that digit parts its neighbours as white space does, or -1."""
        odd = ["a", "'", "'s", "\u00e9", "!", "\u0301", "ab", "\u3000", "\u0338", "...", "A"]
        *own, zero, whole = [e.ids for e in self.tokenizer.encode_batch_fast([*odd, "0", "0".join(odd)], add_special_tokens=False)]
        return zero[0] if len(zero) == 1 and whole == [i for x in own for i in [*zero, *x]][1:] else -1

    def clear(self) -> None:
        self.known, self.hash, self.met = 0, np.zeros(1024, np.uint64), np.zeros(1024, bool)
        self.at, self.text = np.zeros(1024, np.int64), np.zeros(8192, np.uint8)  # part i is text[at[i] : at[i + 1]]
        self.first, self.ids = np.zeros(1024, np.int64), np.zeros(4096, np.uint32)  # and has ids[first[i] : first[i + 1]]
        self.table = np.full(4096, -1, np.int32)  # parts at the first free place from their hash on

    def _room(self, name: str, need: int) -> None:
        if need > len(old := getattr(self, name)):
            setattr(self, name, np.concatenate([old, np.zeros(max(need, len(old) + len(old) // 2) - len(old), old.dtype)]))

    def _whole(self, strings: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in strings], add_special_tokens=False)]

    def _parted(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """_ids() of parts without the digit 0, many in a string with that digit between them; None if the zeros don't come out even."""
        end, joined, between = np.cumsum(size + 1), np.full(len(text) + len(size), 0x30, np.uint8), np.zeros(len(text) + len(size), bool)
        between[end - 1] = True
        joined[~between] = text
        last = np.flatnonzero(np.diff(end // STRING, append=-1))
        data, stops = joined.tobytes(), end[last].tolist()
        got = self._whole([data[a : b - 1] for a, b in zip([0, *stops], stops, strict=False)])
        flat = np.concatenate([np.array([*x, self.zero], np.uint32) for x in got])
        zeros = np.flatnonzero(flat == self.zero)
        if len(zeros) != len(size):
            return None
        return np.diff(zeros, prepend=-1) - 1, flat[flat != self.zero]

    def _ids(self, text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many ids each part has, all ids) of parts whose bytes follow one another; none is empty."""
        at, count, found = np.cumsum(size) - size, np.zeros(len(size), np.int64), []
        single = np.logical_or.reduceat(text == 0x30, at) if self.zero >= 0 else np.ones(len(size), bool)
        if len(some := np.flatnonzero(~single)):
            if (got := self._parted(text[np.repeat(~single, size)], size[some])) is None:
                single[:] = True
            else:
                count[some] = got[0]
                found.append(got[1])
        if len(some := np.flatnonzero(single)):
            data = text.tobytes()
            got = self._whole([data[a : a + n] for a, n in zip(at[some].tolist(), size[some].tolist(), strict=True)])
            count[some] = np.fromiter(map(len, got), np.int64, len(got))
            found.append(np.fromiter((i for x in got for i in x), np.uint32, int(count[some].sum())))
        if len(found) == 1:
            return count, found[0]
        flat, alone = np.zeros(int(count.sum()), np.uint32), np.repeat(single, count)
        flat[~alone], flat[alone] = found[0], found[1]
        return count, flat

    def _add(self, hashes: np.ndarray, text: np.ndarray, size: np.ndarray, count: np.ndarray, ids: np.ndarray) -> None:
        """Parts with hashes of their own that the table doesn't have."""
        lo, hi = self.known, self.known + len(hashes)
        used, filled = int(self.first[lo]), int(self.at[lo])
        for name, need in (("hash", hi), ("met", hi), ("at", hi + 1), ("first", hi + 1), ("ids", used + len(ids)), ("text", filled + len(text) + 8)):
            self._room(name, need)
        self.hash[lo:hi], self.met[lo:hi], self.ids[used : used + len(ids)], self.text[filled : filled + len(text)] = hashes, False, ids, text
        self.at[lo + 1 : hi + 1], self.first[lo + 1 : hi + 1], self.known = filled + np.cumsum(size), used + np.cumsum(count), hi
        if 2 * hi > len(self.table):
            self.table = np.full(1 << (2 * hi).bit_length(), -1, np.int32)
            lo = 0
        mask, parts = len(self.table) - 1, np.arange(lo, hi, dtype=np.int32)
        place = (self.hash[lo:hi] & np.uint64(mask)).astype(np.int64)
        while len(parts):
            free = self.table[place] < 0
            self.table[place[free]] = parts[free]
            out = np.flatnonzero(self.table[place] != parts)
            parts, place = parts[out], (place[out] + 1) & mask

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The part with each hash, or -1."""
        mask = len(self.table) - 1
        place = (hashes & np.uint64(mask)).astype(np.int64)
        out = self.table[place]
        left = np.flatnonzero((out >= 0) & (self.hash[out] != hashes))
        while len(left):
            place[left] = (place[left] + 1) & mask
            out[left] = now = self.table[place[left]]
            left = left[(now >= 0) & (self.hash[now] != hashes[left])]
        return out

    def _forget(self) -> None:
        """Only parts that were met again since the last time stay, those kept longest first, in half of the room."""
        size, count = np.diff(self.at[: self.known + 1]), np.diff(self.first[: self.known + 1])
        stay = np.flatnonzero(self.met[: self.known] & (size <= LONGEST_KEPT))[: self.keep // 2]
        stay = stay[np.cumsum(size[stay]) <= MOST_BYTES // 2]
        stays = np.zeros(self.known, bool)
        stays[stay] = True
        text, ids = self.text[: self.at[self.known]][np.repeat(stays, size)], self.ids[: self.first[self.known]][np.repeat(stays, count)]
        kept = self.hash[stay], text, size[stay], count[stay], ids
        self.clear()
        self._add(*kept)

    def _slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray | None:
        """Which known part each is; None if two parts share a hash, whose bytes are then looked at one by one."""
        if self.known > self.keep or self.at[self.known] > MOST_BYTES:
            self._forget()
        hashes, here = tk.hash_words(buf, starts, ends), eights(buf)
        slots = self._find(hashes).astype(np.int64)
        size = ends - starts
        old, new = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        own = slots[old]
        if (size[old] != self.at[own + 1] - self.at[own]).any() or not same_bytes(here, starts[old], eights(self.text, True), self.at[own], size[old]):
            return None
        self.met[own] = True
        if len(new):
            fresh, at, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            at, back = new[at], back.reshape(-1)
            if (size[new] != size[at[back]]).any() or not same_bytes(here, starts[new], here, starts[at[back]], size[new]):
                return None
            slots[new] = self.known + back
            data = buf.tobytes()
            text = np.frombuffer(b"".join([data[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]), np.uint8)
            self._add(fresh, text, size[at], *self._ids(text, size[at]))
        return slots

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds): text i has ids[bounds[i] : bounds[i + 1]]."""
        joined = b" ".join(texts) + b" "
        buf = np.frombuffer(joined, np.uint8)
        label = np.zeros(len(buf) + 1, np.int8)
        label[1:] = _LABEL[buf]
        now, before = label[1:], label[:-1]
        cut = (now != before) & ((now == 0) | (before == 0) | (now + before == 3))
        edge = np.flatnonzero(cut)
        starts = edge[now[edge] != 0]
        ends = edge[np.searchsorted(edge, starts, "right")] if len(starts) else starts
        del label, now, before, cut, edge  # of one giant text they are large
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(x) + 1 for x in texts], out=first[1:])
        bounds = np.searchsorted(starts, first)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        if self.folds:
            capital = (buf >= 0x41) & (buf <= 0x5A)
            ascii_ = np.maximum.reduceat(buf, starts) < 0x80  # between parts there is white space alone
            capital[starts[0] :] &= np.repeat(ascii_, np.diff(starts, append=len(buf)))
            buf = buf | (capital.view(np.uint8) << 5)
        slots = self._slots(buf, starts, ends)
        if slots is None:
            places: dict[bytes, int] = {}
            slots = np.array([places.setdefault(joined[a:b], len(places)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
            many, known = self._ids(np.frombuffer(b"".join(places), np.uint8), np.fromiter(map(len, places), np.int64, len(places)))
            where = np.cumsum(many) - many
            where, count = where[slots], many[slots]
        else:
            where, known = self.first[slots], self.ids
            count = self.first[slots + 1] - where
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        ids = known[np.repeat(where - total[:-1], count) + np.arange(total[-1])]
        return ids, total[bounds]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encoded_lengths(texts: list[bytes], path: str) -> np.ndarray:
    out = [np.diff(encoder(path).encode(texts[lo:hi])[1]) for lo, hi in tk.runs(texts)]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def length_histogram(documents: DataFrame, path: str | None = None) -> DataFrame:
    """n_tokens, n_docs: how many documents encode to each length. Null and empty texts have length 0.

    Each batch is counted before the shuffle, so what moves is a few lengths for each
    batch, never the documents. Repeated rows count each; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches):
        for batch in batches:
            lengths, docs = np.unique(encoded_lengths(tk.as_bytes(batch.column(0)), path), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(lengths.astype(np.int64)), pa.array(docs.astype(np.int64))], ["n_tokens", "n_docs"])

    counted = tk.small_batches(tk.exact(documents, "text"), 1024).mapInArrow(run, "n_tokens long, n_docs long")
    return counted.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(histogram: DataFrame, span: int = 512) -> DataFrame:
    """For every distinct length as a context limit: documents and tokens from it on, and the truncated total.

    Sums run inside spans of `span` lengths, and over the spans' totals, so that no task
    holds more than the lengths of one span or one row for each span. The histogram is
    written first, as it is read twice and texts shall be encoded once. An empty histogram
    gives no rows; lengths are never null.
    """
    h = tk.written(histogram).withColumn("span", F.expr(f"n_tokens div {span}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    spans = h.groupBy("span").agg(F.sum("n_docs").alias("d"), F.sum(tokens).alias("t"))
    above, everything = Window.orderBy(F.desc("span")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    spans = spans.select("span", *(F.coalesce(F.sum(x).over(above), F.lit(0)).alias(f"{x}_above") for x in "dt"), *(F.sum(x).over(everything).alias(f"{x}_all") for x in "dt"))
    here = Window.partitionBy("span").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    inside = h.select("span", "n_tokens", "n_docs", F.sum("n_docs").over(here).alias("d_here"), F.sum(tokens).over(here).alias("t_here"))
    from_docs, from_tokens = F.col("d_here") + F.col("d_above"), F.col("t_here") + F.col("t_above")
    return inside.join(spans, "span").select(
        F.col("n_tokens"), F.col("n_docs"),
        from_docs.alias("docs_from"), from_tokens.alias("tokens_from"),
        F.col("d_all").alias("docs_total"), F.col("t_all").alias("tokens_total"),
        (F.col("t_all") - from_tokens + F.col("n_tokens") * from_docs).alias("truncated_total"),
        ((F.col("d_all") - from_docs + F.col("n_docs")) / F.col("d_all")).alias("quantile"),
    )


def quantiles(sums: DataFrame, levels: list[float]) -> DataFrame:
    """level, n_tokens: the least length that at least this share of the documents does not exceed.

    One aggregate over the suffix sums answers all levels. No documents give null lengths, no levels no rows.
    """
    return _answers(sums, "level double, n_tokens long", [(float(x), F.min(F.when(F.col("quantile") >= x, F.col("n_tokens")))) for x in levels])


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """context_limit, tokens kept if every document is cut to it: for any limits, also between the lengths that occur.

    The suffix sums at the least length from a limit on say how many documents are cut
    there and how many tokens the shorter ones have. A limit beyond all lengths cuts
    nothing, no documents have 0 tokens, no limits give no rows.
    """

    def kept(limit: int):
        cut = F.min(F.when(F.col("n_tokens") >= limit, F.struct("n_tokens", "tokens_from", "docs_from")))
        return F.coalesce(F.max("tokens_total") - F.coalesce(cut["tokens_from"] - cut["docs_from"] * limit, F.lit(0)), F.lit(0))

    return _answers(sums, "context_limit long, tokens long", [(int(x), kept(int(x))) for x in limits])


def _answers(sums: DataFrame, schema: str, asked: list[tuple]) -> DataFrame:
    """One row (question, answer) for each question, from one aggregate."""
    if not asked:
        return sums.sparkSession.createDataFrame([], schema)
    (question, kind), (name, answer) = (x.split() for x in schema.split(", "))
    one = sums.agg(*(a.alias(f"a{i}") for i, (_, a) in enumerate(asked)))
    pairs = F.array(*(F.struct(F.lit(q).cast(kind).alias(question), F.col(f"a{i}").cast(answer).alias(name)) for i, (q, _) in enumerate(asked)))
    return one.select(F.inline(pairs))
