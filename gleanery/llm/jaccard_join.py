"""Jaccard links between shingle sets by a size-aware heavy-light join.

Documents with the same set are one node. Light (small) sets enumerate their subsets of
every size that a link leaves in common: two small sets link just if they share such a
subset, so the subset's hash decides. Heavy (large) sets go through inverted lists: the
rarest shingles of a set, as many as a link cannot miss, are its entries; a list is
scanned pairwise with exact bounds (set sizes, and the parity bitmap of each set, whose
differing bits never exceed the differing shingles). The boundary is where enumeration
comes to cost more than list entries. What passes the bounds is verified on whole sets.
Pairs that are already connected need no verification: first a forest of the surviving
pairs is verified, then every surviving pair that still lies between two components.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm import textkit as tk
from gleanery.llm.anchors import LAST_ID
from gleanery.llm.components import components

BITS, MOST_BITS = 1024, 1 << 16
BLOCK = 256  # members of a list that are scanned at a time
SAMPLE, FREQUENT = 8_000, 100_000  # documents, shingles: these only order the shingles, and so never change a result
LARGEST_LIGHT = 1 << 14  # shingles; where 100 of 100 are asked for, no size would be heavy
LIST_COST = 8  # what an entry of an inverted list costs, in hashes of subsets
_SALT = np.uint64(0x8CB92BA72F3D8DD7)


def entries(n: int, percent: int) -> int:
    """How many shingles of a set of n no link can all miss."""
    return n - -(-percent * n // 100) + 1


def boundary(percent: int) -> int:
    """The largest size whose subsets cost no more than its list entries."""
    n = 1
    while n < LARGEST_LIGHT and sum(comb(n + 1, d) for d in range(entries(n + 1, percent))) <= LIST_COST * entries(n + 1, percent):
        n += 1
    return n


class Order:
    """A fixed order of shingles, rare ones first: by how common their words are and, far after all others, passages that repeat.

    Two tables of fixed size, so the order can be broadcast whatever the corpus. It is
    learnt from a sample and never changes a result: any order that all sets follow is right.
    """

    WORD_BITS, SHINGLE_BITS = 20, 22

    def __init__(self, words: list[tuple[int, int]], shingles: list[tuple[int, int]]):
        self.words = np.zeros(1 << self.WORD_BITS, np.uint8)
        for at, count in words:
            self.words[at] = min(15, count.bit_length())
        self.shingles = np.zeros(1 << self.SHINGLE_BITS, np.uint8)
        for token, count in shingles:
            self.shingles[(token & (1 << 64) - 1) >> 64 - self.SHINGLE_BITS] = min(63, 4 * count.bit_length())

    @staticmethod
    def word_places(h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - Order.WORD_BITS)).astype(np.int64)

    def ranks(self, tokens: np.ndarray, level: np.ndarray) -> np.ndarray:
        return level + 128 * self.shingles[(tokens >> np.uint64(64 - self.SHINGLE_BITS)).astype(np.int64)].astype(np.int16)


class Sets:
    """The shingle sets of some texts: distinct tokens in ascending order, text by text; with an order, also the level of each token's words."""

    def __init__(self, texts: list[bytes], shingle: int, order: Order | None = None):
        tokens, levels = [], []
        for lo, hi in tk.runs(texts):
            buf, starts, ends, bounds = tk.find_words(texts[lo:hi], tk.SPACED)
            h = tk.hash_words(buf, starts, ends, lower=True)
            grams = tk.hash_grams(h, shingle)
            if order:
                total = np.zeros(len(h) + 1, np.int64)
                np.cumsum(order.words[order.word_places(h)], out=total[1:])
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                n = min(shingle, b - a)
                own = grams[a : b - n + 1] if n == shingle else tk.hash_grams(h[a:b], n) if n else grams[:0]
                if order:
                    own, at = np.unique(own, return_index=True)
                    levels.append(((total[a + n : b + 1] - total[a : b - n + 1])[at]).astype(np.int16))
                else:
                    own = np.sort(own)
                    own = own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
                tokens.append(own)
        self.count, self.order = len(texts), order
        self.sizes = np.array([len(x) for x in tokens], np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
        self.levels = np.concatenate(levels) if levels else np.zeros(0, np.int16)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(self.count), self.sizes)

    def nodes(self) -> np.ndarray:
        """A 64-bit name of each set."""
        total = np.zeros(len(self.tokens) + 1, np.uint64)
        np.cumsum(tk.mix64(self.tokens ^ _SALT), out=total[1:])
        return tk.mix64(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.sizes.astype(np.uint64)).view(np.int64)

    def bitmaps(self) -> list[bytes]:
        """Of each class of tokens, whether the set has an odd number: at least BITS classes, twice as many for each doubling of large sets."""
        out = []
        for a, n in zip(self.bounds[:-1].tolist(), self.sizes.tolist(), strict=True):
            bits = min(max(BITS, 1 << (n - 1).bit_length()), MOST_BITS) if n else BITS
            odd = np.bincount((self.tokens[a : a + n] & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
            out.append(np.packbits(odd.reshape(bits // BITS, BITS), axis=1).tobytes())
        return out

    def rarest(self, percent: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(places of the entries of all sets of at least `least`, how many each has): the first in the order, ties by hash."""
        rank = self.order.ranks(self.tokens, self.levels)
        want = np.where(self.sizes >= max(least, 1), self.sizes - -(-percent * self.sizes // 100) + 1, 0)
        out = [a + np.argsort(rank[a : a + n], kind="stable")[:k] for a, n, k in zip(self.bounds[:-1].tolist(), self.sizes.tolist(), want.tolist(), strict=True) if k]
        return (np.concatenate(out) if out else np.zeros(0, np.int64)), want

    def subsets(self, i: int, percent: int) -> list[tuple[int, int]]:
        """(hash, size) of the subsets of set i that a link can leave in common."""
        own = tk.mix64(self.tokens[self.bounds[i] : self.bounds[i + 1]] ^ _SALT).tolist()
        n, total, out = len(own), sum(own), []
        for d in range(entries(n, percent)):
            out += [((total - sum(c)) & ((1 << 64) - 1), n - d) for c in combinations(own, d)]
        return out


def mapped(rows: DataFrame, build, schema: str) -> DataFrame:
    """mapInArrow over (id, text) rows; build(ids, sets) gives columns."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in build(batch.column(0).to_numpy(), tk.as_bytes(batch.column(1)))], names)

    return tk.small_batches(rows).mapInArrow(run, schema)


def learn_order(rows: DataFrame, n: int, shingle: int) -> Order:
    """The order, from a sample of about SAMPLE of n documents."""
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n)) < SAMPLE) if n > SAMPLE else rows

    def words(ids, texts):
        out = []
        for lo, hi in tk.runs(texts):
            buf, starts, ends, _ = tk.find_words(texts[lo:hi], tk.SPACED)
            out.append(Order.word_places(tk.hash_words(buf, starts, ends, lower=True)))
        place, count = np.unique(np.concatenate(out), return_counts=True)
        return place, count

    places = mapped(sample, words, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).filter("n > 3").collect()
    tokens = mapped(sample, lambda ids, texts: [Sets(texts, shingle).tokens.view(np.int64)], "token long")
    top = tokens.groupBy("token").count().filter("count > 2").orderBy(F.desc("count"), "token").limit(FREQUENT).collect()
    return Order([(r["place"], r["n"]) for r in places], [(r["token"], r["count"]) for r in top])


def list_pairs(lists: DataFrame, percent: int, forest: bool) -> DataFrame:
    """a, b: pairs of list members within the bounds. forest: one path between members that such pairs connect; else all pairs of different label."""

    def passes(n, m, bits):
        return (100 * np.minimum(n, m) >= percent * np.maximum(n, m)) & ((100 + percent) * bits <= (100 - percent) * (n + m))

    def differing(members: list[bytes], i: int, others: np.ndarray) -> np.ndarray:
        """How many classes differ between member i and each other; the longer bitmap is folded to the shorter."""
        out = np.empty(len(others), np.int64)
        mine, sizes = np.frombuffer(members[i], np.uint64), np.array([len(members[k]) for k in others])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            theirs = np.frombuffer(b"".join(members[k] for k in others[at]), np.uint64).reshape(len(at), -1)
            short = min(len(mine), theirs.shape[1])
            fold = lambda m, short=short: np.bitwise_xor.reduce(m.reshape(len(m), -1, short), axis=1)
            out[at] = np.bitwise_count(fold(theirs) ^ fold(mine[None, :])).sum(axis=1, dtype=np.int64)
        return out

    def of_group(node, n, side, label, bitmap, crossing):
        m = len(node)
        ok = np.zeros((m, m), bool)
        for i in range(m - 1):
            near = (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])) & (label[i + 1 :] != label[i]) & (not crossing or side[i + 1 :] != side[i])
            at = i + 1 + np.flatnonzero(near)
            if len(at):
                ok[i, at] = passes(n[at], n[i], differing(bitmap, i, at))
        if not forest:
            a, b = np.nonzero(ok)
            return node[a], node[b]
        ok |= ok.T
        part, left, right = np.arange(m), [], []
        for hub in np.argsort(-ok.sum(axis=1), kind="stable"):
            near = np.flatnonzero(ok[hub])
            near = near[part[near] != part[hub]]
            _, pick = np.unique(part[near], return_index=True)
            near = near[pick]
            left.append(np.full(len(near), node[hub]))
            right.append(node[near])
            part[np.isin(part, part[near])] = part[hub]
        return np.concatenate(left), np.concatenate(right)

    def run(batches):
        rest = None
        for batch in with_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not len(table):
                continue
            token, i, j, side, node, n, label = (table.column(k).to_numpy() for k in range(7))
            start = np.flatnonzero(np.concatenate([[True], (token[1:] != token[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            end = np.append(start[1:], len(token))
            if batch is not None:
                rest, start, end = table.slice(start[-1]), start[:-1], end[:-1]
            if not len(start):
                continue
            bitmap = table.column(7).to_pylist()
            left, right = [node[:0]], [node[:0]]
            for s, e in zip(start, end, strict=True):
                if e - s > 1:
                    x, y = of_group(node[s:e], n[s:e], side[s:e], label[s:e], bitmap[s:e], i[s] != j[s])
                    left.append(x)
                    right.append(y)
            left, right = np.concatenate(left), np.concatenate(right)
            pair = np.unique(np.stack([np.minimum(left, right), np.maximum(left, right)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])
        tk.give_back()

    return lists.mapInArrow(run, "a long, b long").distinct()


def with_end(batches):
    yield from batches
    yield None


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs of nodes whose whole sets link."""
    right = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("right")).hint("merge"), "b")
    both = right.join(texts.select(F.col("node").alias("a"), F.col("text").alias("left")).hint("merge"), "a").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 32):  # both texts of a pair can be long
                part = batch.slice(lo, 32)
                a, b = Sets(tk.as_bytes(part.column(2)), shingle), Sets(tk.as_bytes(part.column(3)), shingle)
                keep = []
                for i in range(len(part)):
                    common = len(np.intersect1d(a.tokens[a.bounds[i] : a.bounds[i + 1]], b.tokens[b.bounds[i] : b.bounds[i + 1]], assume_unique=True))
                    keep.append(100 * common >= percent * (int(a.sizes[i]) + int(b.sizes[i]) - common))
                yield pa.RecordBatch.from_arrays([part.column(k).filter(pa.array(keep, pa.bool_())) for k in (0, 1)], ["a", "b"])
        tk.give_back()

    return tk.small_batches(both).mapInArrow(run, "a long, b long")


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `documents`, one for each component of near-duplicates: that of the smallest doc_id.

    Components are those of link(). Rows without words are no duplicates and all stay;
    of others that repeat an id with the same text one stays; rows without an id come last
    in their component. All columns are kept as they are.
    """
    names, documents = documents.columns, tk.by_place(documents)
    at = [f"c{names.index(n)}" for n in ("doc_id", "text")]
    key = [F.coalesce(F.col(at[0]).cast("long"), F.lit(LAST_ID)).alias("_gleanery_id"), F.coalesce(F.xxhash64(at[1]), F.lit(0)).alias("_gleanery_text")]
    found = grouped(documents.select(key[0].alias("id"), F.col(at[1]).alias("text"), key[1].alias("version")), shingle, percent)
    stay = found.filter("group is not null").groupBy("group").agg(F.min(F.struct("id", "version")).alias("_k")).select(F.col("_k.id").alias("_gleanery_id"), F.col("_k.version").alias("_gleanery_text"))
    has_words = F.coalesce(F.col(at[1]), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    rows = documents.filter(has_words).select("*", *key).join(stay.hint("merge"), ["_gleanery_id", "_gleanery_text"], "left_semi")
    kept = rows.dropDuplicates(["_gleanery_id", "_gleanery_text"]).select(documents.columns)
    return kept.unionByName(documents.filter(~has_words)).toDF(*names)


def link(documents: DataFrame, shingle: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Words lie between white space, A-Z lower-cased; a set holds the distinct runs of
    `shingle` words, or the whole of a shorter text. Two documents link if their common
    shingles are at least `percent` of all they have; a component is named by its
    smallest doc_id. Null and empty texts have no shingles and link with nothing; null
    ids come after all others; rows of equal id are judged each by its text. Extra
    columns are ignored; an empty table gives no rows.
    """
    documents = tk.exact(documents, "doc_id", "text")
    found = grouped(documents.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"), "text", F.lit(0).alias("version")), shingle, percent)
    return found.select(F.nullif("id", F.lit(LAST_ID)).alias("doc_id"), F.col("n").alias("n_shingles"), F.nullif(F.coalesce("component", "id"), F.lit(LAST_ID)).alias("component_id"))


def grouped(rows: DataFrame, shingle: int, percent: int) -> DataFrame:
    """id, version, n, group, component (its smallest id) of (id, text, version) rows; both are null for a row without words."""
    spark = rows.sparkSession

    limit = boundary(percent)
    mixed = -(-percent * (limit + 1) // 100)
    sent = spark.sparkContext.broadcast(learn_order(rows, max(rows.count(), 1), shingle))

    def name(batches):
        for batch in batches:
            sets = Sets(tk.as_bytes(batch.column(1)), shingle, sent.value)
            at, want = sets.rarest(percent, mixed)
            light = [sets.subsets(i, percent) if 0 < n <= limit else [] for i, n in enumerate(sets.sizes.tolist())]
            token = np.array([h + s & (1 << 64) - 1 for x in light for h, s in x], np.uint64)
            ends = [pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)) for n in (want, [len(x) for x in light])]
            heavy = pa.ListArray.from_arrays(ends[0], pa.array(sets.tokens[at].view(np.int64)))
            small = pa.ListArray.from_arrays(ends[1], pa.StructArray.from_arrays([pa.array(tk.mix64(token).view(np.int64)), pa.array([s for x in light for _, s in x], pa.int16())], ["token", "size"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sets.sizes.astype(np.int64)), pa.array(sets.nodes()), pa.array(sets.bitmaps()), heavy, small], ["id", "version", "n", "node", "bitmap", "heavy", "light"])
        tk.give_back()  # workers live on through later stages

    # each text is hashed once; its names and entries are written, as they are read several times
    schema = "id long, version long, n long, node long, bitmap binary, heavy array<long>, light array<struct<token:long,size:smallint>>"
    named = tk.written(tk.small_batches(rows.select("id", "text", F.col("version").cast("long").alias("version"))).mapInArrow(name, schema))
    rows = rows.select("id", "text")
    nodes = tk.written(named.filter("n > 0").groupBy("node").agg(F.min("id").alias("first"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap")))

    entered = named.select(F.explode("heavy").alias("token"), "node", F.lit(0).cast("short").alias("size")).unionByName(named.select("node", F.inline("light")))
    shared = tk.written(entered.groupBy("token", "size").agg(F.min("node").alias("_a"), F.max("node").alias("_b")).filter("_a < _b").select("token", "size"))
    # on the executors' own disks, and made again from `shared` where one is lost: no file of the shared folder is opened while the largest join runs
    entered = entered.join(shared.hint("merge"), ["token", "size"]).distinct().persist(StorageLevel.DISK_ONLY)

    light = entered.filter("size > 0").join(nodes.select("node", "n").hint("merge"), "node")
    least = tk.written(light.groupBy("token", "size").agg(F.min(F.struct("n", "node")).alias("_c")))
    light = light.join(least.hint("merge"), ["token", "size"]).filter(f"node <> _c.node and 100 * size >= {percent} * (n + _c.n - size)").select(F.col("_c.node").alias("a"), F.col("node").alias("b"))

    heavy = entered.filter("size = 0").select("token", "node")
    # lists with the same members give the same pairs: one of them is enough
    members = heavy.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % F.lit(1 << 50)).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    kept = tk.written(members.groupBy("n", "s", "x").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    heavy = tk.written(heavy.join(kept.hint("merge"), "token"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = heavy.withColumn("side", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("token", F.least("side", "_o").alias("i"), F.greatest("side", "_o").alias("j"), "side", "node")

    def lists(labels):
        full = placed.join(nodes.join(labels, "node", "left").select("node", "n", F.coalesce("label", "node").alias("label"), "bitmap").hint("merge"), "node").select("token", "i", "j", "side", "node", "n", "label", "bitmap")
        return full.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "node")

    none = spark.createDataFrame([], "node long, label long")
    tree = tk.written(list_pairs(lists(none), percent, True))
    wanted = tree.select(F.col("a").alias("node")).unionByName(tree.select(F.col("b").alias("node"))).distinct().join(nodes, "node").select("node", F.col("first").alias("id"))

    def confirm(batches):  # rows of one id can have different texts
        for batch in batches:
            same = pa.array(Sets(tk.as_bytes(batch.column(1)), shingle).nodes() == batch.column(0).to_numpy())
            yield batch.filter(same)

    texts = rows.join(wanted.hint("shuffle_hash"), "id").select("node", "text").mapInArrow(confirm, "node long, text string").dropDuplicates(["node"])
    texts = tk.written(texts)
    first = tk.written(verified(tree, texts, shingle, percent).unionByName(light))
    entered.unpersist()
    tk.discard(shared)
    labels = tk.written(components(first).select("node", F.col("component").alias("label")))
    rest = list_pairs(lists(labels), percent, False).join(tree.hint("merge"), ["a", "b"], "left_anti")
    links = labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(verified(rest, texts, shingle, percent))

    ids = tk.written(nodes.select("node", "first").join(components(links).hint("merge"), "node", "left").select("node", "first", F.coalesce("component", "node").alias("group")))
    names = tk.written(ids.groupBy("group").agg(F.min("first").alias("component")))  # written, so that the join can split a large group
    classes = ids.join(names.hint("merge"), "group").select("node", "group", "component")
    known = named.select("id", "version", "n", F.when(F.col("n") > 0, F.col("node")).alias("node")).join(classes.hint("merge"), "node", "left")
    return known.select("id", "version", "n", "group", "component")
