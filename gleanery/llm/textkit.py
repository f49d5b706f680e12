"""Words of many texts at once: numpy over the UTF-8 bytes of an Arrow batch.

Every separator used by the operators is a single ASCII byte, so words are found
bytewise without decoding. Hashes are 64 bits wide: a random value for each byte,
a polynomial over the word, and a finaliser. A polynomial modulo 2**64 has known
collisions between long periodic words, so words of more than LONG bytes get a
cryptographic hash instead. Equal bytes always give equal hashes.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql.types import StructType

from gleanery.streaming.folders import new_folder

BLOCK = 1 << 20
LONG = 32  # bytes; a change of hash function, not of meaning
_U = np.uint64
_BASE, _GRAM = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


_BYTE = mix64(np.arange(1, 257, dtype=_U) * _U(_BASE)) | _U(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
_UP, _DOWN = _powers(_BASE, BLOCK + 1), _powers(pow(_BASE, -1, 1 << 64), BLOCK + 1)
_G_UP, _G_DOWN = _powers(_GRAM, 1 << 16), _powers(pow(_GRAM, -1, 1 << 64), 1 << 16)

#: True for bytes inside a word. SPACED: split at space and 0x09-0x0D. PLAIN: digits, letters and all beyond ASCII.
SPACED = np.ones(256, bool)
SPACED[[0x20, 9, 10, 11, 12, 13]] = False
PLAIN = np.zeros(256, bool)
PLAIN[0x30:0x3A] = PLAIN[0x61:0x7B] = PLAIN[0x41:0x5B] = PLAIN[0x80:] = True


def small_batches(df, rows: int = 256):
    """Let Python get few rows at a time, as texts may be long; a smaller setting of the session stays."""
    key, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(key)) <= rows:
        conf.set(key, str(rows))
    return df


def by_place(df):
    """The same columns named c0, c1 and so on: names that differ in case alone cannot be told apart otherwise."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def exact(df, *names: str):
    """Columns of exactly these names, the first of each."""
    placed = by_place(df)
    return placed.select(*(placed[f"c{df.columns.index(n)}"].alias(n) for n in names))


def whole_rows(df, run, *added):
    """mapInArrow over whole rows, whatever their columns are called; `added` fields come last. Columns are known by place inside run()."""
    placed = by_place(small_batches(df))
    schema = StructType(list(placed.schema.fields))
    for f in added:
        schema = schema.add(f)
    return placed.mapInArrow(run, schema).toDF(*df.columns, *(f.name for f in added))


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def runs(texts: list[bytes], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about `limit` bytes, one text at least."""
    lo, size = 0, 0
    for i, x in enumerate(texts):
        if i > lo and size + len(x) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(x) + 1
    if lo < len(texts):
        yield lo, len(texts)


def find_words(texts: list[bytes], inside: np.ndarray):
    """(buffer, word starts, word ends, bounds): text i has the words bounds[i] to bounds[i + 1]."""
    joined = b" ".join(texts) + b" "
    buf = np.frombuffer(joined, np.uint8)
    mask = np.zeros(len(buf) + 1, np.int8)
    mask[1:] = inside[buf]
    change = np.diff(mask)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in texts], out=first[1:])
    return buf, starts, ends, np.searchsorted(starts, first)


A_Z = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def hash_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word, with A-Z read as a-z if `lower`."""
    table, out, i = _LOWER if lower else _BYTE, np.zeros(len(starts), _U), 0
    while i < len(starts):
        at = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, at + BLOCK, "right")))
        size = int(ends[j - 1]) - at
        if size <= BLOCK:  # else one giant word
            acc = np.zeros(size + 1, _U)
            np.multiply(table[buf[at : at + size]], _UP[:size], out=acc[1:])
            np.cumsum(acc, out=acc)
            s, e = starts[i:j] - at, ends[i:j] - at
            out[i:j] = (acc[e] - acc[s]) * _DOWN[s]
        i = j
    out = mix64(out + (ends - starts).astype(_U))
    for k in np.flatnonzero(ends - starts > LONG).tolist():
        word = buf[starts[k] : ends[k]].tobytes()
        out[k] = int.from_bytes(hashlib.blake2b(word.translate(A_Z) if lower else word, digest_size=8).digest(), "little")
    return out


def hash_grams(h: np.ndarray, n: int) -> np.ndarray:
    """64-bit hash of each n consecutive words; grams that cross texts are the caller's to drop."""
    count = len(h) - n + 1
    if count <= 0:
        return np.empty(0, _U)
    if n <= 12:
        out = h[:count] * _G_UP[0]
        for j in range(1, n):
            out = out + h[j : j + count] * _G_UP[j]
        return mix64(out)
    out, step = np.empty(count, _U), len(_G_UP) - n
    for i in range(0, count, step):
        part = h[i : i + step + n - 1]
        acc = np.zeros(len(part) + 1, _U)
        np.multiply(part, _G_UP[: len(part)], out=acc[1:])
        np.cumsum(acc, out=acc)
        m = len(part) - n + 1
        out[i : i + m] = (acc[n : n + m] - acc[:m]) * _G_DOWN[:m]
    return mix64(out)


def give_back() -> None:
    """Return freed memory to the system: a worker that has held a large sample stays alive for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def fields(batch: pa.RecordBatch, *names: str) -> list[pa.Array]:
    """Columns by exact name, the first of each if a name clashes."""
    where = batch.schema.names
    return [batch.column(where.index(x)) for x in names]


def written(df):
    """The same rows, written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables) -> None:
    """Remove written() tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
