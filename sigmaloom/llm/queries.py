"""One query per operator, with production parameters, over its whole table; and their SQL where SQL can say it."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, decontam, embed_dedup, html_main, langid, prefix_trie, quality_rules, resample, simhash, suffix_dedup, token_output, warc
from .common import written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _vocabulary(name: str) -> Path:
    import public_tokenizers

    return Path(public_tokenizers.path(name))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the strings of 200 bytes that repeat."""
    rest = suffix_dedup.remove_repeats(_read(spark, sf_dir, "documents"))
    return rest.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_main.extract(_read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links at a cosine of 0.9 or more, and its component."""
    return embed_dedup.near_duplicates(_read(spark, sf_dir, "embeddings"))


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every document's ids as read back from a token store."""
    docs = _read(spark, sf_dir, "documents")
    stored = token_output.token_output(docs, _vocabulary("word_bpe_49k.json").read_text(), end_id=1)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = pa.array([zlib.crc32(i) for i in batch.column(3).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], sums], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the bytes decoded from them."""
    import public_tokenizers

    vocabulary = _vocabulary("byte_bpe_multi_50k.tiktoken").read_bytes()
    encoded = byte_bpe.encode(_read(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN, decoded=True)
    return encoded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt from the documents that are not held out."""
    docs = _read(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which words and items of the benchmark each document holds."""
    found = decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn with its repaired role and its part of the rendered conversation."""
    return chat_format.format_chats(_read(spark, sf_dir, "conversations")).drop("pos")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as read back from the archives."""
    records = warc.warc_round_trip(_read(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark, and its rank among the drawn twentieth."""
    found = resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of all conversations, the first turns of each taken from a shared one."""
    turns = written(prefix_trie.numbered_turns(_read(spark, sf_dir, "conversations")), "numbered")
    return prefix_trie.trie(prefix_trie.with_shared_heads(turns), turns.select("conv_id"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's signals and the verdict of the base rules and of the rules certified by language."""
    found = quality_rules.apply_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_suffix_dedup, op4_html_main_text, op5_simhash, op6_embedding_dedup, op7_token_output, op8_byte_bpe, op9_chat_format, op10_warc, op11_importance_resampling, op12_prefix_trie, op13_quality_rules, pipeline)}


OP2_SQL = r"""
WITH i AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE text IS NOT NULL),
test AS (SELECT DISTINCT item_id, least(len(w), 10) AS m, list_slice(w, k, k + least(len(w), 10) - 1) AS win
         FROM i, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS t(k) WHERE len(w) > 0),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
found AS (SELECT DISTINCT d.doc_id, p, s.m, s.item_id
          FROM d, (SELECT DISTINCT m FROM test) AS sizes, unnest(range(1, len(d.w) - sizes.m + 2)) AS t(p), test AS s
          WHERE s.m = sizes.m AND list_slice(d.w, p, p + sizes.m - 1) = s.win),
words AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM found, unnest(range(p, p + m)) AS t(q) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS holder FROM p GROUP BY h)
SELECT page_id, octet_length(payload) AS payload_bytes,
       list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           (((CAST('0x' || substr(h, ((5 * i) // 4 + 1)::INT, 2) AS INT)) >> (3 - (5 * i) % 4)::INT) & 31) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM p JOIN g USING (h)
"""


OP6_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a, v AS b WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach AS r JOIN pairs AS p ON r.b = p.a),
least AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON counts.a = vec_id LEFT JOIN least ON least.a = vec_id
"""


#: The CRC is made from its polynomial, bit by bit, over the hexadecimal digits of each distinct feature.
OP11_SQL = r"""
WITH texts AS (SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, row_number() OVER (), text FROM benchmark),
words AS (SELECT side, id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM texts),
runs AS (SELECT side, id, array_to_string(list_slice(w, k, k + m - 1), ' ') AS f FROM words, unnest([1, 2, 3]) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(k)),
counted AS (SELECT side, id, f, count(*) AS n FROM runs GROUP BY ALL),
digits AS (SELECT f, list_transform(range(1, length(hex(encode(f))) + 1), lambda i: instr('0123456789ABCDEF', substr(hex(encode(f)), i, 1)) - 1) AS d FROM (SELECT DISTINCT f FROM counted)),
low AS (SELECT f, list_transform(range(0, len(d) // 2), lambda i: list_slice(d, (2 * i + 1)::INT, (2 * i + 2)::INT)) AS b FROM digits),
halves AS (SELECT f, list_reduce(flatten(list_transform(b, lambda p: [p[2], p[1]])), lambda c, x: xor(xor(c, x) >> 4,
    xor(xor(CASE WHEN xor(c, x) & 1 = 1 THEN 498536548 ELSE 0 END, CASE WHEN xor(c, x) & 2 = 2 THEN 997073096 ELSE 0 END),
        xor(CASE WHEN xor(c, x) & 4 = 4 THEN 1994146192 ELSE 0 END, CASE WHEN xor(c, x) & 8 = 8 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) AS c FROM low),
crc AS (SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM halves),
per AS (SELECT side, id, bucket, sum(n)::BIGINT AS n FROM counted JOIN crc USING (f) GROUP BY ALL),
sums AS (SELECT bucket, sum(n) FILTER (side = 0) AS s, sum(n) FILTER (side = 1) AS t FROM per GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM sums),
gain AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + 10000) / ((coalesce(s, 0)::DOUBLE + 1) * (all_t + 10000))))::BIGINT AS g FROM sums, totals),
weights AS (SELECT id, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM per JOIN gain USING (bucket) WHERE side = 0 GROUP BY id),
scored AS (SELECT w.id AS doc_id, len(w.w) >= 20 AS enough, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || w.id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM words AS w LEFT JOIN weights USING (id) WHERE side = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY enough ORDER BY score DESC, doc_id) AS r, count(*) FILTER (enough) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN enough AND r <= 5 * n // 100 THEN r END AS rank FROM ranked
"""

#: The CRC as above; paths are lists of digests.
OP12_SQL = r"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, xor(list_reduce(flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: [ascii(s) & 15, ascii(s) >> 4])), lambda c, x: xor(xor(c, x) >> 4,
    xor(xor(CASE WHEN xor(c, x) & 1 = 1 THEN 498536548 ELSE 0 END, CASE WHEN xor(c, x) & 2 = 2 THEN 997073096 ELSE 0 END),
        xor(CASE WHEN xor(c, x) & 4 = 4 THEN 1994146192 ELSE 0 END, CASE WHEN xor(c, x) & 8 = 8 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT), 4294967295) % 4 AS h
    FROM (SELECT DISTINCT conv_id FROM t)),
taken AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h),
had AS (SELECT conv_id, count(*) AS n FROM taken GROUP BY conv_id),
r AS (SELECT * FROM taken UNION ALL SELECT conv_id, pos - h + coalesce(n, 0), role, text FROM t JOIN c USING (conv_id) LEFT JOIN had USING (conv_id) WHERE pos > h),
p AS (SELECT conv_id, coalesce(list(sha256(sha256(role) || sha256(text)) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS p,
    coalesce(list(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) ORDER BY pos) FILTER (pos IS NOT NULL), []) AS w FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
n AS (SELECT conv_id, d AS depth, list_slice(p, 1, d) AS key, len(p) = d AS ends, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS words FROM p, unnest(range(0, len(p) + 1)) AS t(d)),
node AS (SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM n GROUP BY key, depth),
kids AS (SELECT list_slice(key, 1, depth - 1) AS key, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
sums AS (SELECT list_slice(u.key, 1, k) AS key, sum((n_convs - 1) * words) AS saved, count(*) FILTER (kids.n IS NULL) AS leaves FROM node AS u LEFT JOIN kids USING (key), unnest(range(0, u.depth + 1)) AS t(k) GROUP BY 1)
SELECT v.conv_id, v.depth, CASE WHEN v.depth > 0 THEN up.conv_id END AS parent_conv_id, v.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, v.ends_sha256
FROM node AS v LEFT JOIN node AS up ON up.key = list_slice(v.key, 1, v.depth - 1) AND up.depth = v.depth - 1 LEFT JOIN kids ON kids.key = v.key JOIN sums ON sums.key = v.key
"""

OP13_SQL = r"""
WITH w AS (SELECT doc_id, lang, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l,
    length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS n_symbols FROM documents),
windows AS (SELECT doc_id, k, w[k] AS a, w[k + 1] AS b, w[k + 2] AS c FROM w, unnest(range(1, len(w) - 1)) AS t(k)),
again AS (SELECT doc_id, k FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
repeated AS (SELECT doc_id, count(DISTINCT p) AS n FROM again, unnest([k, k + 1, k + 2]) AS t(p) GROUP BY doc_id),
s AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
    coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(l) - len(list_distinct(l)), 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN repeated USING (doc_id)),
d AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
labelled AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
cuts AS (SELECT rule, sign, generate_subscripts(cs, 1) AS place, unnest(cs) AS cutoff FROM (VALUES ('symbols', 1, [2000, 1000, 500, 300, 200, 100, 50, 20]),
    ('long_words', 1, [12000, 10000, 9000, 8000, 7500, 7000, 6500, 6250, 6000, 5750]), ('short_words', -1, [2000, 2500, 3000, 3500, 3750, 4000, 4250, 4500]),
    ('repeated_lines', 1, [900, 800, 700, 600, 500, 450, 400, 350, 300, 250])) AS r(rule, sign, cs)),
valued AS (SELECT d.*, rule, CASE rule WHEN 'symbols' THEN n_symbols WHEN 'repeated_lines' THEN n_dup_lines ELSE word_chars END * 1000 AS x, CASE rule WHEN 'repeated_lines' THEN n_lines ELSE n_words END AS y
    FROM d, (SELECT DISTINCT rule FROM cuts)),
counts AS (SELECT lang, v.rule, place, cutoff, count(*) FILTER (quality = 1) AS n_good, count(*) FILTER (quality = 1 AND sign * (x - cutoff * y) > 0) AS good_out,
    count(*) FILTER (quality = 0 AND sign * (x - cutoff * y) > 0) AS bad_out FROM valued AS v JOIN labelled USING (doc_id) JOIN cuts USING (rule) WHERE NOT base_failed GROUP BY ALL),
tested AS (SELECT *, list_sum(list_transform(range(0, good_out + 1), lambda i: exp(lgamma(n_good + 1) - lgamma(i + 1) - lgamma(n_good - i + 1) + i * ln(0.005::DOUBLE) + (n_good - i) * ln(0.995::DOUBLE))))
    <= 0.05 / (4 * (SELECT count(*) FROM (SELECT DISTINCT lang FROM counts))) AND good_out < n_good AS certified FROM counts WHERE n_good > 0),
best AS (SELECT * FROM tested WHERE certified AND bad_out > 0 QUALIFY row_number() OVER (PARTITION BY lang, rule ORDER BY bad_out DESC, place) = 1),
failed AS (SELECT DISTINCT v.doc_id FROM valued AS v JOIN best AS b ON v.rule = b.rule AND v.lang IS NOT DISTINCT FROM b.lang WHERE CASE v.rule WHEN 'short_words' THEN -1 ELSE 1 END * (x - cutoff * y) > 0)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND f.doc_id IS NULL AS kept FROM d LEFT JOIN failed AS f USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": OP2_SQL, "op6_embedding_dedup": OP6_SQL, "op10_warc": OP10_SQL, "op11_importance_resampling": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_quality_rules": OP13_SQL}
