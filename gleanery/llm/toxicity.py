"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Each text is the set of its words, pairs of neighbours and pairs with one or two words
between, hashed into 2**bits coordinates. FTRL-proximal gives every coordinate its own
rate, and its L1 term leaves only coordinates with a proven effect, so the weights that
are broadcast for scoring are few.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField

from gleanery.llm import textkit as tk

BITS = 22
_GAP = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB))


def features(texts: list[bytes], bits: int = BITS):
    """(coordinates, bounds): text i has the distinct sorted coordinates[bounds[i] : bounds[i + 1]]."""
    out, bounds = [], [0]
    for lo, hi in tk.runs(texts):
        buf, starts, ends, first = tk.find_words(texts[lo:hi], tk.PLAIN)
        h = tk.hash_words(buf, starts, ends, lower=True)
        grams = [(h, 1)] + [(tk.mix64(h[: -1 - g] * _GAP[g] + h[1 + g :]), 2 + g) for g in range(3) if len(h) > 1 + g]
        for i in range(hi - lo):
            a, b = first[i], first[i + 1]
            own = np.unique(np.concatenate([g[a : max(a, b - n + 1)] for g, n in grams]) >> np.uint64(64 - bits))
            out.append(own.astype(np.int32))
            bounds.append(bounds[-1] + len(own))
    return (np.concatenate(out) if out else np.zeros(0, np.int32)), np.array(bounds, np.int64)


class Ftrl:
    """FTRL-proximal with per-coordinate rates; the last coordinate is the intercept, without L1."""

    def __init__(self, bits: int = BITS, alpha: float = 1.0, beta: float = 1.0, l1: float = 12.0, l2: float = 0.01):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == len(self.z) - 1, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g

    def sparse(self) -> tuple[np.ndarray, np.ndarray]:
        """Coordinates and weights that are not zero, the intercept last."""
        at = np.append(np.flatnonzero(np.abs(self.z[:-1]) > self.l1), len(self.z) - 1)
        return at.astype(np.int32), self.weights(at).astype(np.float32)


def _learnt(coordinates: list[np.ndarray], labels: list[int], rows: list[int], epochs: int, seed: int, options: dict) -> Ftrl:
    model, rng = Ftrl(**options), np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(rows):
            model.learn(coordinates[i], labels[i])
    return model


def best_cut(margins: np.ndarray, labels: np.ndarray) -> float:
    """The margin with the fewest errors; of a range of such, nearer to the side of label 1."""
    order = np.argsort(margins, kind="stable")
    m, y = margins[order], labels[order]
    errors = (y == 0).sum() - np.concatenate([[0], np.cumsum(y == 0)]) + np.concatenate([[0], np.cumsum(y == 1)])
    best = np.flatnonzero(errors == errors.min())
    edges = np.concatenate([m[:1] - 1, m, m[-1:] + 1])
    lo, hi = edges[best[0]], edges[best[-1] + 1]
    return float(lo + (hi - lo) * 2 / 3)


def fit(coordinates: list[np.ndarray], labels: list[int], epochs: int = 4, seed: int = 7, least: int = 5, **options) -> tuple[np.ndarray, np.ndarray]:
    """Weights of all rows; the intercept is set so that score one half is the best cut on every fourth row, judged by a model of the others."""
    rows, cut = list(range(len(labels))), 0.0
    kept = rows[::4]
    if min(sum(labels[i] == k for i in kept) for k in (0, 1)) >= least:
        at, w = _learnt(coordinates, labels, [i for i in rows if i % 4], epochs, seed, options).sparse()
        table = np.zeros(int(at[-1]) + 1, np.float32)
        table[at] = w
        cut = best_cut(np.array([table[coordinates[i]].sum() + table[-1] for i in kept]), np.array([labels[i] for i in kept]))
    at, w = _learnt(coordinates, labels, rows, epochs, seed, options).sparse()
    w[-1] -= cut
    return at, w


def in_test_fold(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string")) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, most: int = 16_000, bits: int = BITS, epochs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Weights learnt from about `most` labelled documents at most, none of the test fold.

    The sample is the labelled rows whose hashed id falls below a threshold, so it is the
    same on every run. Only its ids are broadcast; one task learns from the sample's
    coordinates and only the sparse weights reach the driver. Null labels and ids are
    left out, a document labelled twice counts as toxic if one label says so; without
    labelled rows the score is one half everywhere.
    """
    known = tk.exact(labels, "doc_id", "toxic").select("doc_id", F.col("toxic").cast("int").alias("_label")).dropna().filter(~in_test_fold())
    n = known.count()
    if n > most:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)
    known = known.groupBy("doc_id").agg(F.max("_label").alias("_label"))

    def reduce_texts(batches):
        for batch in batches:
            texts, label = batch.columns
            at, bounds = features(tk.as_bytes(texts), bits)
            yield pa.RecordBatch.from_arrays([pa.array([at[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()), label.cast(pa.int32())], ["at", "label"])

    def learn(batches):
        at, label = [], []
        for batch in batches:
            at += [np.frombuffer(x, np.int32) for x in batch.column(0).to_pylist()]
            label += batch.column(1).to_pylist()
        # rows come in any order: the sets themselves decide the order of learning
        order = sorted(range(len(at)), key=lambda i: (at[i].tobytes()[:64], len(at[i]), label[i]))
        where, w = fit([at[i] for i in order], [label[i] for i in order], epochs, bits=bits)
        at.clear()
        tk.give_back()
        yield pa.RecordBatch.from_arrays([pa.array([where.tobytes()], pa.binary()), pa.array([w.tobytes()], pa.binary())], ["at", "w"])

    sample = tk.small_batches(tk.exact(documents, "doc_id", "text")).join(F.broadcast(known), "doc_id").select("text", "_label")
    rows = sample.mapInArrow(reduce_texts, "at binary, label int").repartition(1).mapInArrow(learn, "at binary, w binary").collect()
    if not rows:
        return np.array([1 << bits], np.int32), np.zeros(1, np.float32)
    return np.frombuffer(rows[0]["at"], np.int32), np.frombuffer(rows[0]["w"], np.float32)


def dense(weights: tuple[np.ndarray, np.ndarray], bits: int) -> np.ndarray:
    out = np.zeros((1 << bits) + 1, np.float32)
    out[weights[0]] = weights[1]
    return out


def scores(texts: list[bytes], weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    at, bounds = features(texts, bits)
    total = np.zeros(len(at) + 1)
    np.cumsum(weights[at], out=total[1:])
    return 1 / (1 + np.exp(-np.clip(total[bounds[1:]] - total[bounds[:-1]] + weights[-1], -35, 35)))


def score(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray], bits: int = BITS, name: str = "toxicity") -> DataFrame:
    """The same rows and columns, and the score (0 to 1) under `name` at the end.

    Row by row without shuffle; the broadcast weights are at most 8 bytes for each of
    2**bits coordinates. Null and empty texts get the score of the intercept. A column
    that already has the name is replaced.
    """
    if name in documents.columns:
        kept = [c for c in documents.columns if c != name]
        documents = tk.exact(documents, *kept)
    at = documents.columns.index("text")
    sent = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = dense(sent.value, bits)
        for batch in batches:
            found = pa.array(scores(tk.as_bytes(batch.column(at)), w, bits), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, name])

    return tk.whole_rows(documents, run, StructField(name, DoubleType()))


def drop_toxic(documents: DataFrame, weights: tuple[np.ndarray, np.ndarray], threshold: float = 0.5, bits: int = BITS) -> DataFrame:
    """The rows that score below the threshold, all columns as they are.

    Row by row without shuffle. Null and empty texts get the score of the intercept alone,
    repeated rows are judged alike, an empty table gives no rows.
    """
    at, sent = documents.columns.index("text"), documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        w = dense(sent.value, bits)
        for batch in batches:
            yield batch.filter(pa.array(scores(tk.as_bytes(batch.column(at)), w, bits) < threshold, pa.bool_()))

    return tk.whole_rows(documents, run)
