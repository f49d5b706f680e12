"""The training-data operators against brute force, and on nulls, empties, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanery.llm import decontaminate, fingerprint, htmltext, jaccard_join, packing, pii, relative_lz, suffix_array, tokens, toxicity
from gleanery.llm import textkit as tk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def make_texts(seed=3, count=60):
    """Texts over a small vocabulary with exact and near copies, shared passages, and odd ones."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "ß", "naïve,", "x-y", "12"]
    texts = []
    for _ in range(count):
        kind = rng.random()
        if texts and kind < 0.2:
            t = rng.choice(texts)
        elif texts and kind < 0.45:
            w = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            t = " ".join(w)
        elif texts and kind < 0.65:
            w = rng.choice(texts).split(" ")
            a = rng.randrange(len(w))
            t = " ".join([*rng.choices(words, k=rng.randint(0, 20)), *w[a : a + 25], *rng.choices(words, k=rng.randint(0, 20))])
        else:
            t = " ".join(rng.choices(words, k=rng.choice([1, 2, 5, 9, 30, 60, 90])))
        texts.append(t or "w0")
    return [*texts, None, "", " \t\n ", "one", "long " + " ".join(rng.choices(words, k=30_000)), texts[0] + "\n" + texts[1], " ".join(f"u{i}" for i in range(8)), " ".join(f"u{i}" for i in range(9))]


def frame(spark, texts, **extra):
    rows = [(i * 3, t, None, "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def clash(df):
    """Extra columns whose names the operators use inside."""
    names = ["id", "version", "node", "label", "_label", "rank", "bucket", "score", "n", "found", "key", "length", "salt", "_id", "_b", "hash", "toxicity", "component", "anchor", "at"]
    return df.select("*", *(F.lit(7).alias(n) for n in names), F.lit("other").alias("Text"), F.lit("x").alias("DOC_ID"))


@pytest.fixture(scope="module")
def texts():
    return make_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return SPLIT.findall(text or "")


def rows(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# --- words and hashes


def test_hashes_follow_the_bytes():
    parts = [b"abc", b"ABC", b"", b"ab c", "é".encode(), b"x" * (3 << 20), b"y" * (3 << 20)]
    buf, starts, ends, bounds = tk.find_words(parts, tk.SPACED)
    assert [buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] == [w for p in parts for w in p.split()]
    assert list(np.diff(bounds)) == [len(p.split()) for p in parts]
    h, low = tk.hash_words(buf, starts, ends), tk.hash_words(buf, starts, ends, lower=True)
    assert len(set(h.tolist())) == len(h) and low[0] == low[1] != low[2]
    many = np.arange(200_000, dtype=np.uint64) % np.uint64(977)
    for n in (1, 5, 50):
        g = tk.hash_grams(tk.mix64(many), n)
        assert len(g) == len(many) - n + 1 and len(np.unique(g)) == 977 and g[0] == g[977]


# --- 1 and 5: copies of passages


def covered_by_copies(texts, window):
    first = {}
    for i, t in enumerate(texts):
        w = split(t)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), i)
    out = []
    for i, t in enumerate(texts):
        w, gone = split(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append(gone)
    return out


@pytest.mark.parametrize("window, gram", [(10, 4), (6, 2)])
def test_relative_lz_equals_brute_force(docs, texts, window, gram):
    got = rows(relative_lz.remove_copies(clash(docs), window, gram))
    for i, (t, gone) in enumerate(zip(texts, covered_by_copies(texts, window), strict=True)):
        w, r = split(t), got[i * 3]
        assert (r.n_words, r.n_removed, r.kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
        for f in r.factors:
            assert f.length >= window and f.doc_id < i * 3
            assert split(texts[f.doc_id // 3])[f.place : f.place + f.length] == w[f.start : f.start + f.length]


def test_relative_lz_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows_ = [(1, text), (1, text), (1, text + " z"), (None, text), (2, text), (None, None)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in relative_lz.remove_copies(spark.createDataFrame(rows_, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (1, 0), (2, 60), (99, 0), (99, 60)]


def repeated_passages():
    """(id, text) rows: a passage from a smaller id stands twice, in the same surroundings, in the copying document or in rows of one id."""
    rng = random.Random(8)
    new = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    out = []
    for k in range(12):
        p, around = new(24), (new(30), new(30))
        inner = [*around[0], *p, *around[1]]
        out += [(100 + k, [*new(20), *p, *new(20)]), (200 + k, [*inner, *new(15), *inner, *new(5)]), (300 + k, [*new(20), *p[4:], *new(20)])]
        q = new(24)
        inner = [*around[1], *q, *around[0]]
        out += [(100 + k, [*new(20), *q, *new(20)]), (400 + k, [*inner, "a"]), (400 + k, [*inner, "b"]), (None, [*inner, *new(3)])]
    return [(i, " ".join(w)) for i, w in out]


def copied_words(data, window):
    """For each (id, text), the words that a window which also stands under a smaller id covers; null ids come last."""
    key, first, out = (lambda i: 10**9 if i is None else i), {}, {}
    for i, t in data:
        w = split(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, 10**9), key(i))
    for i, t in data:
        w = split(t)
        out[i, t] = {j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < key(i) for j in range(k, k + window)}
    return out


def test_relative_lz_repeats_inside_an_id(spark):
    data = repeated_passages()
    got = relative_lz.remove_copies(spark.createDataFrame(data, "doc_id long, text string"), 10, 4).collect()
    want = [(i or 0, " ".join(w for k, w in enumerate(split(t)) if k not in gone)) for (i, t), gone in copied_words(data, 10).items()]
    assert sorted((r.doc_id or 0, r.kept) for r in got) == sorted(want)


def test_suffix_array_matches_are_true_and_find_every_copy(docs, texts):
    found = suffix_array.find_repeats(clash(docs), 10, 4).collect()
    inside = [set() for _ in texts]
    for r in found:
        a, b = split(texts[r.doc_id // 3]), split(texts[r.other_doc_id // 3])
        assert r.n_words >= 10 and r.other_doc_id < r.doc_id
        assert a[r.start : r.start + r.n_words] == b[r.other_start : r.other_start + r.n_words]
        inside[r.doc_id // 3].update(range(r.start, r.start + r.n_words))
    want = covered_by_copies(texts, 10)
    assert [w - g for w, g in zip(want, inside, strict=True) if w - g] == []


def test_suffix_array_names_every_copy_of_a_passage(spark):
    rng = random.Random(1)
    data = []
    for k, size in enumerate((52, 55, 60, 80)):
        passage = [f"q{k}x{i}" for i in range(size)]
        for i in range(200):
            data.append((1000 * k + i, " ".join([*(f"a{rng.randrange(10**6)}" for _ in range(rng.randrange(40))), *passage, *(f"b{rng.randrange(10**6)}" for _ in range(rng.randrange(40)))])))
    rng.shuffle(data)
    found = suffix_array.find_repeats(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == {1000 * k + i for k in range(4) for i in range(1, 200)}
    inside = {}
    for r in found:
        inside.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert all(len(inside[1000 * k + i]) >= size for k, size in enumerate((52, 55, 60, 80)) for i in range(1, 200))


def mirrored(n):
    """Two different words of n letters that every polynomial hash modulo a power of two takes for one, from 1024 on."""
    bits = [0]
    while len(bits) < n:
        bits += [1 - x for x in bits]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


def test_words_that_collide_under_polynomials_stay_apart(spark):
    from tokenizers import Tokenizer

    plain_ = [f"w{i}" for i in range(60)]
    for n in (1024, 2048, 8192):
        a, b = mirrored(n)
        data = [(i, " ".join([*plain_[:30], x, *plain_[30:]])) for i, x in enumerate((a, b, b))] + [(3, a), (4, b)]
        documents = spark.createDataFrame(data, "doc_id long, text string")
        assert [r.n_removed for r in sorted(relative_lz.remove_copies(documents, 40, 8).collect())] == [0, 0, 61, 0, 0]
        links = {r.doc_id: r.component_id for r in jaccard_join.link(documents, 4, 100).collect()}
        assert links == {0: 0, 1: 1, 2: 1, 3: 3, 4: 4}
        ids = [x.ids for x in Tokenizer.from_file(tokens.default_path()).encode_batch([t for _, t in data], add_special_tokens=False)]
        assert {r.doc_id: r.ids_crc32 for r in packing.pack(documents, 1 << 20).collect()} == {i: zlib.crc32(np.array([*x, 1], "<u4").tobytes()) for i, x in enumerate(ids)}
        want = {len(x): sum(len(y) == len(x) for y in ids) for x in ids}
        assert {r.n_tokens: r.n_docs for r in tokens.length_histogram(documents).collect()} == want


def test_suffix_array_covers_every_copied_word(spark, texts):
    rng = random.Random(6)
    passage = [f"p{i}" for i in range(14)]
    many = [(1000 + i, " ".join([*rng.choices("abcdefgh", k=12), *passage, *rng.choices("abcdefgh", k=12)])) for i in range(80)]
    data = [*((i * 3, t) for i, t in enumerate(texts)), *many, *((i and i + 2000, t) for i, t in repeated_passages())]
    words = {}
    for i, t in data:
        words.setdefault(i, []).append(split(t))
    inside = {}
    for r in suffix_array.find_repeats(spark.createDataFrame(data, "doc_id long, text string"), 10, 4).collect():
        assert r.n_words >= 10 and (r.doc_id is None or r.other_doc_id < r.doc_id)
        a = {tuple(w[r.start : r.start + r.n_words]) for w in words[r.doc_id]}
        assert a & {tuple(w[r.other_start : r.other_start + r.n_words]) for w in words[r.other_doc_id]}
        inside.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.n_words))
    assert all(gone <= inside.get(i, set()) for (i, _), gone in copied_words(data, 10).items())


def test_copies_of_nothing(none, spark):
    assert relative_lz.remove_copies(none).count() == suffix_array.find_repeats(none).count() == 0
    assert suffix_array.find_repeats(spark.createDataFrame([(1, None), (2, "a b")], "doc_id long, text string")).count() == 0


# --- 2: benchmark


def test_wu_manber_equals_brute_force(spark, docs, texts):
    items = [(1, " ".join(split(texts[5])[:40])), (2, texts[7]), (3, None), (10, ""), (11, "w1 w2"), (12, "W3!w4"), (2, "ß w5"), (4, "NOT there at all"), (None, "w6")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))

    patterns = {}
    for item, t in items:
        w = words(t)
        if w and item is not None:
            for k in range(max(1, len(w) - 9)):
                patterns.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    for block in (8 << 20, 20):
        got = rows(decontaminate.find_contamination(clash(docs), benchmark, part_bytes=block))
        for i, t in enumerate(texts):
            w, hit, its = words(t), set(), set()
            for k in range(len(w)):
                for n in {len(p) for p in patterns}:
                    if (p := tuple(w[k : k + n])) in patterns:
                        hit.update(range(k, k + n))
                        its |= patterns[p]
            assert (got[i * 3].n_words, got[i * 3].n_hit, got[i * 3]["items"]) == (len(w), len(hit), sorted(its))
    clean = {i * 3 for i in range(len(texts)) if not got[i * 3].n_hit}
    for size in (8 << 20, 60):
        assert {r.doc_id for r in decontaminate.drop_contaminated(clash(docs), benchmark, part_bytes=size).collect()} == clean


def test_empty_benchmark(docs, none, spark):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(docs, nothing).agg(F.sum("n_hit")).first()[0] == 0
    assert decontaminate.find_contamination(none, nothing).count() == 0


# --- 3: fingerprints


def test_fingerprints_estimate_likeness(docs, texts):
    got = rows(fingerprint.edit_likeness(clash(docs)))
    assert len(got) == len(texts)

    def shingles(t):
        w = split(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    off = []
    for i, t in enumerate(texts):
        t, after, r = t or "", texts[(i + 1) % len(texts)] or "", got[i * 3]
        k = len(t) // 4
        changed = t[: len(t) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(changed.encode()).hexdigest())
        for other, near in ((changed, r.near_edited), (after, r.near_next)):
            a, b = shingles(t), shingles(other)
            off.append(abs(near - (len(a & b) / len(a | b) if a | b else 1)))
        assert (r.fingerprint == "") == (not t.split())
    assert np.mean(off) < 0.03 and max(off) < 0.35
    same = {}
    for i, t in enumerate(texts):
        same.setdefault(t or "", set()).add(got[i * 3].fingerprint)
    assert all(len(x) == 1 for x in same.values())


def test_fingerprints_of_few_rows(spark, none):
    assert fingerprint.edit_likeness(none).count() == 0
    one = spark.createDataFrame([(5, "a b c d e f")], "doc_id long, text string")
    assert fingerprint.edit_likeness(one).first().near_next == 1
    odd = spark.createDataFrame([(None, "x y"), (5, None), (5, "a"), (5, "a"), (None, None)], "doc_id long, text string")
    assert fingerprint.edit_likeness(odd).count() == fingerprint.fingerprint_documents(odd).count() == 5


# --- 4 and 8: tokens


@pytest.fixture(scope="module")
def encoded(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    t.encode_special_tokens = True
    odd = ["it's <|endoftext|> $'s don't éa ...—,x  1234 a b İI ŉ ''s 'S", "", "éé, 　x\x1cy", "a" * 5000, "\x00\x01 . . ,,'", *(x or "" for x in make_texts(9))]
    ids, bounds = tokens.Encoder(tokens.default_path(), keep=10).encode([x.encode() for x in odd])
    assert [ids[bounds[i] : bounds[i + 1]].tolist() for i in range(len(odd))] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_encoder_tells_equal_hashes_apart(monkeypatch):
    texts = [(x or "").encode() for x in make_texts(11)]
    want = tokens.Encoder(tokens.default_path()).encode(texts)
    real = tk.hash_words
    monkeypatch.setattr(tk, "hash_words", lambda *a, **k: real(*a, **k) % np.uint64(5))
    encoder = tokens.Encoder(tokens.default_path())
    got = [encoder.encode(texts[i : i + 3]) for i in range(0, len(texts), 3)]
    assert np.concatenate([ids for ids, _ in got]).tolist() == want[0].tolist()
    table, one, two = tokens.eights(np.frombuffer(b"abcdefghij-abcdefghik", np.uint8)), np.array([0]), np.array([11])
    assert tokens.same_bytes(table, one, table, two, np.array([9])) and not tokens.same_bytes(table, one, table, two, np.array([10]))


def test_encoder_asks_the_tokenizer_seldom():
    encoder, given = tokens.Encoder(tokens.default_path(), keep=400), []

    class Spy:
        def encode_batch_fast(self, strings, **k):
            given.extend(strings)
            return real.encode_batch_fast(strings, **k)

    real, encoder.tokenizer = encoder.tokenizer, Spy()
    word = "".join(chr(97 + i % 26) + chr(97 + i // 26 % 26) + "\u00e9q!" * (i % 3 == 0) + "x " for i in range(676)).split()
    often = [*word[:150], "a0b", "00", "K\u0331"]
    for k in range(20):  # of what is new, nothing comes twice
        text = " ".join([*often, *(w.capitalize() + chr(97 + k) for w in word[150:250])])
        ids, _ = encoder.encode([text.encode()])
        assert ids.tolist() == real.encode(text, add_special_tokens=False).ids
    assert len(given) < 100  # of 20 * 253 parts
    assert sum(x.split("0").count(word[1]) for x in given) == 1
    assert encoder.known <= 400 + 253
    before = len(given)
    ids, _ = encoder.encode([" ".join(often).upper().encode()])
    assert ids.tolist() == real.encode(" ".join(often).upper(), add_special_tokens=False).ids
    assert word[1].upper() not in "0".join(given[before:]).split("0")


def test_histogram_and_sums(docs, none, encoded):
    lengths = [len(x) for x in encoded]
    h = tokens.length_histogram(clash(docs))
    assert {r.n_tokens: r.n_docs for r in h.collect()} == {n: lengths.count(n) for n in set(lengths)}
    got = rows(tokens.suffix_sums(h, span=16), "n_tokens")
    for n in set(lengths):
        r = got[n]
        assert (r.docs_from, r.tokens_from) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert (r.docs_total, r.tokens_total, r.truncated_total) == (len(lengths), sum(lengths), sum(min(x, n) for x in lengths))
    assert {r.level: r.n_tokens for r in tokens.quantiles(tokens.suffix_sums(h), [0.5, 1.0]).collect()} == {0.5: sorted(lengths)[-(-len(lengths) // 2) - 1], 1.0: max(lengths)}
    assert {r.context_limit: r.tokens for r in tokens.truncated_totals(tokens.suffix_sums(h), [0, 7, 10**6]).collect()} == {k: sum(min(x, k) for x in lengths) for k in (0, 7, 10**6)}
    assert tokens.suffix_sums(tokens.length_histogram(none)).count() == 0


def plain_best_fit(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits)[1]] -= n
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("capacity", [1, 7, 50, 64])
def test_best_fit_equals_the_plain_one(capacity):
    rng = random.Random(capacity)
    for count in (0, 1, 3, 40, 300):
        lengths = [min(capacity, int(rng.expovariate(0.1)) + 1) for _ in range(count)]
        runs, made = packing.best_fit({n: lengths.count(n) for n in set(lengths)}, capacity)
        assert len(runs) <= packing.most_runs(capacity)
        assert made == plain_best_fit(lengths, capacity)
        filled = {}
        for length, _, n, first, bins, at in runs.tolist():
            for j in range(n):
                filled.setdefault(first + j % bins, []).append((at + j // bins * length, length))
        assert sum(map(len, filled.values())) == count
        for parts in filled.values():
            assert [a for a, _ in sorted(parts)] == np.cumsum([0, *(n for _, n in sorted(parts))]).tolist()[:-1]


def test_packing(docs, none, encoded):
    capacity = 100
    got = packing.pack(clash(docs), capacity).collect()
    want = {(i * 3, k // capacity): (k, len(p := [*ids, 1][k : k + capacity]), zlib.crc32(np.array(p, "<u4").tobytes())) for i, ids in enumerate(encoded) for k in range(0, len(ids) + 1, capacity)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *(n for _, n in parts)]).tolist()[:-1] and sum(n for _, n in parts) <= capacity
    assert len(sequences) == plain_best_fit([n for _, n, _ in want.values()], capacity)
    assert packing.pack(none).count() == 0


def test_packing_repeated_rows(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (None, "")], "doc_id long, text string")
    got = packing.pack(d).collect()
    assert len(got) == 4 and sorted(r.offset for r in got) == sorted([0, 3, 6, 7])


# --- 6: Jaccard links


def brute_components(texts, shingle, percent):
    sets = []
    for t in texts:
        w = split((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets.append({tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("shingle, percent, block", [(4, 85, 512), (2, 80, 4), (1, 60, 3)])
def test_links_equal_brute_force(docs, texts, monkeypatch, shingle, percent, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    got = rows(jaccard_join.link(clash(docs), shingle, percent))
    sizes, root = brute_components(texts, shingle, percent)
    assert [got[i * 3].n_shingles for i in range(len(texts))] == sizes
    assert [got[i * 3].component_id for i in range(len(texts))] == [3 * r for r in root]
    kept = {r.doc_id for r in jaccard_join.keep_one(clash(docs), shingle, percent).collect()}
    assert kept == {3 * i for i in range(len(texts)) if root[i] == i}


def test_links_of_a_family_of_edits(spark):
    """Copies with one edit each: all link to the first, hardly any to each other."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(110)]
    texts = [" ".join(base)]
    for k in range(60):
        w = base.copy()
        for a in rng.sample(range(5, 105), 2):
            w[a] = f"new{k}{a}"
        texts.append(" ".join(w))
    got = rows(jaccard_join.link(frame(spark, texts)))
    assert [got[i * 3].component_id for i in range(len(texts))] == [3 * r for r in brute_components(texts, 4, 85)[1]]


def test_links_entries_stay_out_of_the_shared_folder(spark, docs, monkeypatch):
    """The entries of all lists, the largest table, open no file there, and nothing stays on the executors' disks."""
    columns, written = [], tk.written
    monkeypatch.setattr(tk, "written", lambda df: columns.append(set(df.columns)) or written(df))
    held = lambda: set(spark.sparkContext._jsc.getPersistentRDDs().keySet())
    before = held()
    jaccard_join.link(docs).collect()
    assert columns and {"token", "size", "node"} not in columns
    assert held() <= before


def test_links_ids(spark, none):
    d = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (9, "A B  C\nd"), (None, "a b c d"), (None, None), (4, "other words"), (7, "")], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.link(d).filter("doc_id is not null").collect())
    assert got == [(4, 1, 4), (4, 1, 4), (4, 1, 4), (7, 0, 7), (9, 1, 4)]
    assert sorted((r.text or "") for r in jaccard_join.keep_one(d).collect()) == ["", "", "a b c d", "other words"]
    assert jaccard_join.link(none).count() == jaccard_join.keep_one(none).count() == 0


def test_rows_without_words_all_stay(spark):
    data = [(None, None, "a"), (None, None, "b"), (None, "", "c"), (None, "", "d"), (3, " \t", "e"), (3, " \t", "f"), (4, "one", "g"), (4, "one", "h"), (None, "two", "i"), (None, "two", "j"), (5, "\u00a0", "k"), (5, "\u00a0", "l")]
    got = [r.source for r in jaccard_join.keep_one(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()]
    assert {*"abcdef"} <= set(got) and len(got) == 9


# --- 7: toxicity


def test_toxicity_learns_and_leaves_the_test_fold_out(spark, none):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    data = []
    for i in range(1500):
        w = rng.choices(words, k=rng.randint(5, 60))
        bad = rng.random() < 0.2
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["vile", "awful", "nasty"]))
        data.append((i, " ".join(w), int(bad)))
    data += [(5000, None, 1), (5001, "", 0), (None, "vile", 1), (5002, "vile", None), (5003, "fine", 0), (5003, "fine", 0)]
    d = spark.createDataFrame([x[:2] for x in data], "doc_id long, text string")
    labels = spark.createDataFrame([(x[0], 0, x[2]) for x in data], "doc_id long, quality int, toxic int")
    weights = toxicity.train(clash(d), labels)
    got = {r.doc_id: r for r in toxicity.score(clash(d), weights, name="score").collect()}
    held = [x for x in data if x[0] is not None and x[2] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0 and x[1]]
    assert len(held) > 200 and np.mean([(got[i].score >= 0.5) == bool(y) for i, _, y in held]) > 0.97
    assert {r.doc_id for r in d.filter(toxicity.in_test_fold()).collect() if r.doc_id is not None} == {x[0] for x in data if x[0] is not None and zlib.crc32(str(x[0]).encode()) % 5 == 0}
    assert 0 <= got[5000].score == got[5001].score <= 1
    again = toxicity.train(d.repartition(3), labels.repartition(2))
    assert all(np.array_equal(a, b) for a, b in zip(weights, again, strict=True))
    wrong = labels.withColumn("toxic", F.when(toxicity.in_test_fold(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert all(np.array_equal(a, b) for a, b in zip(weights, toxicity.train(d, wrong), strict=True))
    assert {r.doc_id for r in toxicity.drop_toxic(d, weights).collect()} == {k for k, r in got.items() if r.score < 0.5}
    blank = toxicity.train(d, labels.limit(0))
    assert {r.score for r in toxicity.score(d, blank, name="score").collect()} == {0.5}
    assert toxicity.score(none, weights).count() == 0


# --- 9: pages

PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site"><h1>Site</h1></header>
<div class="cookie-notice"><p>We use cookies to improve your experience on this site, accept all of them now.</p></div>
<nav><ul><li><a href=1>Home</a></ul></nav><div id="content"><article><h1>Headline</h1><p>First para of <b>bo</b>ld te&amp;xt &lt;b&gt; with <a href=x>link</a>.
<script>var t="</p><p>no";</script><div class="ad">Buy this thing now, it is great and cheap for you.</div><p>Short.<ul><li>One<li>Two</ul><form><label>Mail</label><input></form>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I love this article so much, thanks for writing it.</p></div></section></article></div>
<aside><p>Related stories that you would want to read as well.</p></aside><!-- <p>hidden</p> --><footer>&copy; me</footer>"""


def test_ftrl_equals_a_plain_one():
    rng = np.random.default_rng(5)
    bits, alpha, beta, l1, l2 = 6, 0.5, 1.0, 0.4, 0.02
    model = toxicity.Ftrl(bits, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n, bias = {}, {}, 1 << bits

    def weight(i):
        if i != bias and abs(z.get(i, 0.0)) <= l1 or z.get(i, 0.0) == 0:
            return 0.0
        own = 0.0 if i == bias else l1
        return ((own if z[i] > 0 else -own) - z[i]) / ((beta + n[i] ** 0.5) / alpha + l2)

    for _ in range(300):
        at, label = np.unique(rng.integers(0, bias, 8)).astype(np.int32), int(rng.integers(0, 2))
        model.learn(at, label)
        features = [*at.tolist(), bias]
        w = {i: weight(i) for i in features}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in features:
            step = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / alpha
            z[i], n[i] = z.get(i, 0.0) + g - step * w[i], n.get(i, 0.0) + g * g
    at, w = model.sparse()
    assert dict(zip(at.tolist(), w.tolist(), strict=True)) == pytest.approx({i: weight(i) for i in z if weight(i)}, rel=1e-5)
    assert 1 < len(at) < bias


def test_main_text():
    assert htmltext.main_text(PAGE) == "Headline First para of bold te&xt <b> with link. Short. One Two"
    plain = "<body><div class=menu><a>One</a> <a>Two</a></div><div><p>A page with div only, and a long first sentence that has words in it.<p>Another one, quite long too,\n\n so that it counts as content of the page.</div><div><a href=1>Terms</a> | <a href=2>Privacy</a></div>"
    assert htmltext.main_text(plain) == "A page with div only, and a long first sentence that has words in it. Another one, quite long too, so that it counts as content of the page."
    assert htmltext.main_text(f"<form id=all>{PAGE}</form>") == htmltext.main_text(PAGE)
    for cut in range(0, len(PAGE), 7):
        htmltext.main_text(PAGE[:cut])
    assert htmltext.main_text(None) == htmltext.main_text("") == htmltext.main_text("<p></p>") == ""
    assert htmltext.main_text("<article><p>x <!-- open") == "x" and htmltext.main_text("<article><p>1 < 2 &am<foo") == "1 < 2 &am"


def test_min_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        pull = [rng.choice([-3, -1, -0.5, 0, 0.5, 2]) for _ in range(n)]
        edges = [(a, b, rng.choice([0.3, 1.0, 2.0])) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(side, pull=pull, edges=edges):
            return sum(p for p, s in zip(pull, side, strict=True) if p > 0 and not s) - sum(p for p, s in zip(pull, side, strict=True) if p < 0 and s) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost([bool(m >> i & 1) for i in range(n)]) for m in range(1 << n))
        assert cost(htmltext.min_cut(pull, edges)) == pytest.approx(best)


def test_labels_of_random_pages_are_cheapest():
    rng = random.Random(4)
    for _ in range(40):
        tags = ["div", "div class=ad", "p", "section", "ul", "li", "nav", "article", "div class=content", "td", "h2"]
        page = htmltext.blocks("".join(f"<{rng.choice(tags)}>{' '.join(['word'] * rng.choice([1, 4, 12, 40]))}{rng.choice(['.', ''])}{rng.choice(['', '</div>', '</p>', '<a>link link</a>'])}" for _ in range(9)))
        pull = [htmltext.odds(b) for b in page]
        known = [b.bias <= htmltext.FORM for b in page]
        ties = [(i - 1, i, htmltext.NEAR / (1 + b.step)) for i, b in enumerate(page) if i and known[i - 1] == known[i]]
        for i, b in enumerate(page):
            before = [k for k in range(i) if page[k].container == b.container]
            if before and known[before[-1]] == known[i]:
                ties.append((before[-1], i, htmltext.SIBLING))

        def cost(side, pull=pull, ties=ties):
            return sum(abs(p) for p, s in zip(pull, side, strict=True) if (p > 0) != bool(s)) + sum(w for a, b, w in ties if side[a] != side[b])

        best = min(cost([m >> i & 1 for i in range(len(page))]) for m in range(1 << len(page)))
        assert cost(htmltext.label(page)) == pytest.approx(best, abs=1e-4)


def test_paragraphs_between_adverts_stay():
    said = [f"Paragraph {i} says something of its own in a short sentence." for i in range(2000)]
    assert htmltext.main_text("".join(f"<div class=ad>Buy {i}</div><div><p>{t}</p></div>" for i, t in enumerate(said))) == " ".join(said)


@pytest.mark.parametrize("wrapper", ["div class='layout has-sidebar'", "div class='with-cookie-notice page'", "div class=no-footer"])
def test_a_wrapper_with_a_modifier_is_no_boilerplate(wrapper):
    assert htmltext.main_text(f"<{wrapper}>{PAGE}</div>") == htmltext.main_text(PAGE)
    assert htmltext.main_text("<div class=sidebar><main><p>Said in main.</p></main></div>") == "Said in main."


def test_large_and_deep_pages():
    sentence = "A sentence of the article that goes on for a while."
    for page in ("<div>" * 100_000 + f"<p>{sentence}", "".join(f"<div>{sentence}" for _ in range(30_000)), "<article>" + f"<p>{sentence}" * 60_000, "<p><button>" + "<div>x" * 30_000, "<span class=promo>" * 30_000 + "<li>x<b>" * 30_000 + "</span>" * 30_000):
        began = time.perf_counter()
        htmltext.main_text(page)
        assert time.perf_counter() - began < 10
    assert htmltext.main_text("<article>" + f"<p>{sentence}" * 60_000) == " ".join([sentence] * 60_000)


def test_pages(spark):
    d = spark.createDataFrame([(1, "u", PAGE, 5), (1, "u", PAGE, 5), (None, None, None, 5), (2, "v", "", 5), (3, "w", "<p>" + "word " * 200_000, 5)], "page_id long, url string, html string, text int")
    got = [(r.page_id, r.text[:8], r.n_chars) for r in htmltext.extract(d).collect()]
    assert sorted(got, key=str) == sorted([(1, "Headline", 63), (1, "Headline", 63), (None, "", 0), (2, "", 0), (3, "word wor", 999_999)], key=str)
    assert htmltext.extract(d.limit(0)).count() == 0


# --- 10: personal data


def base_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_equal_the_expressions():
    rng = random.Random(4)
    alphabet = ["a", "Z", "1", "2", "0", "25", "255", ".", ".", "@", "@", "-", " ", "+", "+1", "(", ")", "%", "_", "é", "x.co", "4111 1111 1111 1111", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 25)))
        assert pii.detect(text) == base_spans(text), text
    assert pii.detect("1" * 5000 + ".2.3.4") == []


@pytest.mark.parametrize(
    "text, kind, span",
    [
        ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
        ("jane dot doe at mail dot example dot org", "email", "jane dot doe at mail dot example dot org"),
        ("call plus one two three four five six seven eight nine zero", "phone", "plus one two three four five six seven eight nine zero"),
        ("аlice@exаmple.com!", "email", "аlice@exаmple.com"),
        ("４１１１ １１１１ １１１１ １１１１", "card", None),
        ("b​ob@example.com", "email", "b​ob@example.com"),
        ("at one nine two dot one six eight dot one dot one ok", "ip", "one nine two dot one six eight dot one dot one"),
        ("from 10 dot zero dot 0 dot 25!", "ip", "10 dot zero dot 0 dot 25"),
    ],
)
def test_disguises(text, kind, span):
    base = pii.detect(text)
    assert [(k, text[a:b]) for k, a, b in pii.added(text, base)] == [(kind, span or text)]


def test_plain_prose_is_left_alone():
    for text in ("I looked at home.com today", "meet me at noon, dot the i", "one two three", "Привет мир", "price (at) 3"):
        assert pii.added(text, pii.detect(text)) == [] == pii.detect(text)


def test_disguises_are_judged_alike_in_every_document():
    found = {
        "plus 49 151 23456789": "plus 49 151 23456789", "john at example.com": "john at example.com", "Please mail john at example.com today": "john at example.com",
        "see j.smith at mail.example.org": "j.smith at mail.example.org", "(one two) 10 dot 0 dot 0 dot 1": "10 dot 0 dot 0 dot 1", "x\none two three four five six seven eight nine": None,
        "I looked at home.com today": None, "Look at home.com": None, "the results at home.com": None, "reach us at home.com": None, "we met at 5.30 today": None,
    }
    for text, span in found.items():
        for more in ("", "\nThe point is this.", "\nAsk bob@example.com now.", "\none two.", "\n(at)"):
            whole = f"{text}.{more}"
            spans = pii.added(whole, pii.detect(whole))
            assert [whole[a:b] for _, a, b in spans] == ([span] if span else []), whole


def test_a_disguise_reads_the_same_by_itself():
    rng = random.Random(12)
    names = [("email", x) for x in ("bob [at] example [dot] com", "аnn@exаmple.com", "j​im@exam​ple.org", "eve _at_ mail.example.com")]
    names += [("ip", "one zero dot 0 dot 0 dot one"), ("phone", "plus 49 one five one two three four five six"), ("card", "４１１１ １１１１ １１１１ １１１１")]
    other = ["\nPlain words here.\n", "\nПривет, мир.\n", "\nbob@x.org;\n", "\n\u200b\u200b\n", "\n4111-1111-1111-1111;\n", "\none; two.\n", "\nA dot and a point.\n"]
    for _ in range(300):
        text, want = "", []
        for _ in range(rng.randint(1, 6)):
            text += rng.choice(other)
            kind, said = rng.choice(names)
            want.append((kind, len(text), len(text) + len(said)))
            text += said
        text += rng.choice(other)
        assert sorted(pii.added(text, pii.detect(text))) == sorted(want), text


def test_the_way_back_through_edits():
    rng = random.Random(3)
    for _ in range(300):
        text, edits, at = "".join(rng.choices("abcdef", k=30)), [], 0
        while (a := at + rng.randint(0, 5)) < 27:
            at = a + rng.randint(1, 3)
            edits.append((a, at, rng.choice(["", "X", "YZ", "long"])))
        t = pii.Transducer(text, edits)
        origin, k = [], 0  # of each character written: its range, and whether it was rewritten
        for a, b, said in [*edits, (30, 30, "")]:
            origin += [(i, i + 1, False) for i in range(k, a)] + [(a, b, True)] * len(said)
            k = b
        assert len(origin) == len(t.text)
        for _ in range(20):
            a = rng.randrange(len(origin))
            b = rng.randint(a + 1, len(origin))
            assert t.source(a, b) == (origin[a][0], origin[b - 1][1])
            inside = any(new for _, _, new in origin[a:b]) or any(x[1] != y[0] and x[:2] != y[:2] for x, y in zip(origin[a : b - 1], origin[a + 1 : b], strict=True))
            assert t.touched(a, b) == inside


def test_long_texts_cost_little():
    text = "word at x.com one two three " * 200_000 + "write to bob [at] example [dot] com"
    tracemalloc.start()
    found = pii.added(text, pii.detect(text))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [text[a:b] for _, a, b in found][-1] == "bob [at] example [dot] com"
    assert peak < 20 * len(text)


def test_no_disguise_is_skipped():
    rng = random.Random(7)
    parts = ["plus ", "PLU\u017f 4", "1", "49", " ", "  ", "\n", " at ", "at", "_at_", "-AT-", "[at]", "{ DOT }", " dot ", " Punto ", "point", "@", " @ ", ".", "one", "Two ", "\u017fix ", "dr\u0131", "un-", ",", "a", "é", "x.co", "(", ")", "\u212a"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(1, 9)))
        assert pii.calls(text) or pii.deobfuscate(text) == [], text


def test_pii_rows(spark, none):
    d = clash(spark.createDataFrame([(1, "é a@b.co, 10.0.0.1 +1 (555) 010-9999", 9), (1, None, 3), (None, "", 0), (2, "x " * 100_000 + "a@b.co", 0)], "doc_id long, text string, n_chars long"))
    got = [(r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find_pii(d).collect()]
    assert (1, [("email", 2, 8), ("ip", 10, 18), ("phone", 19, 36)]) in got and (2, [("email", 200_000, 200_006)]) in got and len(got) == 4
    red = pii.redact_documents(d)
    assert red.columns == d.columns
    assert sorted(("-" if r.text is None else r.text)[:40] for r in red.collect()) == ["", "-", "x " * 20, "é [EMAIL], [IP] [PHONE]"]
    assert [r.n_chars for r in red.collect() if (r.text or "")[:1] == "é"] == [23]
    assert pii.find_pii(none).count() == pii.redact_documents(none).count() == 0
