"""Queries of the training-data operators, and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.llm import decontaminate, fingerprint, htmltext, jaccard_join, packing, pii, relative_lz, suffix_array, tokens, toxicity

QUERIES: dict = {}
ORACLES: dict = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_suffix_dedup(spark, sf_dir):
    """Passages of 50 words or more of a document that a document of smaller id has as well."""
    return suffix_array.copied_passages(read(spark, sf_dir, "documents"))


_COPIED = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50)),
firsts AS (SELECT g, min(doc_id) AS first_doc FROM windows GROUP BY g),
copied AS (SELECT doc_id, i FROM windows JOIN firsts USING (g) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM copied)"""
ORACLES["op1_suffix_dedup"] = f"""{_COPIED}
SELECT doc_id, CAST(min(p) - 1 AS BIGINT) AS start, CAST(count(*) AS BIGINT) AS n_words
FROM (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM gone) GROUP BY doc_id, run"""


@query
def op2_decontamination(spark, sf_dir):
    """Words of every document inside a 10-word window of a benchmark item."""
    found = decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLES["op2_decontamination"] = r"""
WITH lowered AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
patterns AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS g, least(10, len(w)) AS n
             FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM patterns),
grams AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
          FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lowered, lengths WHERE len(w) >= n)),
found AS (SELECT doc_id, i, n, item_id FROM grams JOIN patterns USING (n, g)),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM lowered LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)"""


@query
def op3_fingerprints(spark, sf_dir):
    """Fingerprints of every document and of its edited text, and their likeness."""
    return fingerprint.edit_likeness(read(spark, sf_dir, "documents"))


@query
def op4_token_counts(spark, sf_dir):
    """Exact length histogram of the encoded documents with its suffix sums: one row for each length that occurs."""
    return tokens.suffix_sums(tokens.length_histogram(read(spark, sf_dir, "documents")))


@query
def op5_substring_dedup(spark, sf_dir):
    """Words of every document that a 50-word copy from a document of smaller id covers, and the digest of the rest."""
    found = relative_lz.remove_copies(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op5_substring_dedup"] = rf"""{_COPIED},
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p) AS s
         FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM words) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query
def op6_ngram_jaccard(spark, sf_dir):
    """Components of the documents whose 4-word shingles agree in 85 of 100."""
    return jaccard_join.link(read(spark, sf_dir, "documents"))


ORACLES["op6_ngram_jaccard"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 3], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM words UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT words.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (doc_id) JOIN (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)"""


@query
def op7_toxicity(spark, sf_dir):
    """Toxicity of every document, learnt from labels outside the test fold."""
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = toxicity.score(documents, toxicity.train(documents, read(spark, sf_dir, "labels")), name="score")
    return found.select("doc_id", toxicity.in_test_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op8_packing(spark, sf_dir):
    """Best-fit-decreasing packing of all documents into sequences of 4096 tokens."""
    return packing.pack(read(spark, sf_dir, "documents"))


@query
def op9_html_extraction(spark, sf_dir):
    """Main text of every page."""
    return htmltext.extract(read(spark, sf_dir, "pages"))


# States the result where every page has one article, of headings and paragraphs, and all else lies outside it.
ORACLES["op9_html_extraction"] = r"""
WITH inner_html AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS h FROM pages),
bare AS (SELECT page_id, url, regexp_replace(regexp_replace(h, '</?(h1|p|br)(\s[^>]*)?>', ' ', 'g'), '</?[a-zA-Z][^>]*>', '', 'g') AS t FROM inner_html),
decoded AS (SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS text FROM bare)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM decoded"""


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op10_pii(spark, sf_dir):
    """Personal data in every document. The four counts are of the base patterns; spans also has what the transducers add."""
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_added"))


@query
def pii_base(spark, sf_dir):
    """What the four base patterns of op10_pii find."""
    return op10_pii(spark, sf_dir).drop("spans", "n_added")


def _found(kind: str, pattern: str, keep: str) -> str:
    """Matches of a pattern with their offsets: the parts between the matches and the matches themselves add up to them."""
    size = "list_transform({}, lambda x: length(x))"
    before = f"coalesce(list_sum({size.format('parts[1:i]')}), 0) + coalesce(list_sum({size.format('m[1:i - 1]')}), 0)"
    return f"""SELECT doc_id, '{kind}' AS kind, CAST(a AS BIGINT) AS a, CAST(a + length(v) AS BIGINT) AS b FROM
  (SELECT doc_id, m[i] AS v, {before} AS a FROM (SELECT doc_id, m, parts, unnest(range(1, len(m) + 1)) AS i
    FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS parts FROM texts))) WHERE {keep}"""


_NUMBER = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_NUMBER}) + 1), lambda k: CASE WHEN (length({_NUMBER}) - k) % 2 = 0 THEN CAST(({_NUMBER})[k] AS INT) ELSE CAST(({_NUMBER})[k] AS INT) * 2 - CASE WHEN CAST(({_NUMBER})[k] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
ORACLES["pii_base"] = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_found("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true")}
UNION ALL {_found("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "len(list_filter(string_split(v, '.'), lambda x: length(ltrim(x, '0')) > 3 OR coalesce(TRY_CAST(x AS HUGEINT), 999) > 255)) = 0")}
UNION ALL {_found("card", r"[0-9](?:[\x20-]?[0-9])+", f"length({_NUMBER}) BETWEEN 13 AND 19 AND {_LUHN}")}
UNION ALL {_found("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_NUMBER}) BETWEEN 9 AND 15")}),
ranked AS (SELECT *, CASE kind WHEN 'email' THEN 0 WHEN 'ip' THEN 1 WHEN 'card' THEN 2 ELSE 3 END AS k FROM found)
SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in pii.KINDS)},
       sha256(coalesce(string_agg(concat(kind, ':', a, ':', b), ',' ORDER BY k, a) FILTER (kind IS NOT NULL), '')) AS base_sha256
FROM texts LEFT JOIN ranked USING (doc_id) GROUP BY doc_id"""


@query
def held_out_documents(spark, sf_dir):
    """The test fold of op7_toxicity."""
    return read(spark, sf_dir, "documents").select("doc_id", toxicity.in_test_fold().alias("held_out"))


# crc32 bit by bit: each byte is mixed in, and eight steps follow it.
ORACLES["held_out_documents"] = """
SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
       lambda crc, k: CASE WHEN k >= 0 THEN xor(crc, k) WHEN crc % 2 = 1 THEN xor(crc >> 1, 3988292384) ELSE crc >> 1 END), 4294967295) % 5 = 0 AS held_out FROM documents"""


@query
def edited_documents(spark, sf_dir):
    """The edited texts that op3_fingerprints compares, by length and digest."""
    return op3_fingerprints(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


ORACLES["edited_documents"] = r"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pairs AS (SELECT doc_id, t, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS n FROM texts)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, sha256(concat(left(t, CAST(length(t) - length(t) // 4 AS BIGINT)), left(n, CAST(length(t) // 4 AS BIGINT)))) AS edited_sha256 FROM pairs"""
