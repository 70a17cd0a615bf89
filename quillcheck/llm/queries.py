"""The queries of this package and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillcheck.llm import cross_tokens, importance, lm_score, media, mixing, packing, pii, quality_rules, repair_shards, simhash, substring_dedup, url_filter, winnowing
from quillcheck.llm.common import table, written

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> str:
    """A public tokenizer's file; every executor has the package that holds it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ef_trie_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that lose text: what stays, what went, and the documents that have it first."""
    changed = substring_dedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"), changed_only=True)
    return changed.select("doc_id", "first_doc_ids", "n_words", "n_removed", "removed", "text")


def op3_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = repair_shards.write_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))
    return repair_shards.read_back(shards)


def op4_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", "kept_without", "policy")
    return quality_rules.judged(table(spark, sf_dir, "documents")).select(*columns)


def op6_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), carry=["doc_id", "source"])


def op7_best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op8_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex16("fp").alias("fingerprint"), "component_id")


def op9_url_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encode(table(spark, sf_dir, "documents")), "media", compression="zstd")
    digests = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return media.features(stored).select(*digests, media.feature_text().alias("feature"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokens.linked(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))


def op13_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_ef_trie_scores": op1_ef_trie_scores,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_repair_tokens": op3_repair_tokens,
    "op4_contextual_pii": op4_contextual_pii,
    "op5_quality_rules": op5_quality_rules,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_best_two_fit": op7_best_two_fit,
    "op8_simhash_golay": op8_simhash_golay,
    "op9_url_trees": op9_url_trees,
    "op10_media_columns": op10_media_columns,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_token_alignment": op12_token_alignment,
    "op13_winnowing": op13_winnowing,
}

#: Rows are told apart by their place, so that repeated doc_ids count as in the query.
_OP5 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
words AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
sums AS (SELECT r, count(*) AS n_words, sum(length(w)) AS word_chars, count(*) FILTER (w = upper(w) AND w <> lower(w)) AS n_upper FROM words GROUP BY r),
grams AS (SELECT r, i, w, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM words WINDOW o AS (PARTITION BY r ORDER BY i)),
repeated AS (SELECT r, i FROM grams WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY r, w, b, c) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, (VALUES (0), (1), (2)) v(k) GROUP BY r),
lines AS (SELECT r, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM lines WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_upper, 0) AS n_upper, length(t) - length(replace(t, '!', '')) AS n_exclamations FROM d LEFT JOIN sums USING (r) LEFT JOIN covered USING (r) LEFT JOIN dup USING (r)),
f AS (SELECT *, CAST((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT + 8 * (2 * n_upper > n_words)::INT + 16 * (10 * n_exclamations > 3 * n_words)::INT
  + 32 * (100 * n_dup_lines > 70 * n_lines)::INT + 64 * (word_chars > 40 * n_words)::INT AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, (fail_bits & 31) = 0 AS kept, fail_bits, CASE WHEN bit_count(fail_bits & 31) = 1 THEN fail_bits & 31 ELSE 0 END AS kept_without, 'v1' AS policy FROM f
"""

#: crc32 is folded over the bytes of each different word, by a table that is made from the polynomial.
_OP11 = r"""
WITH RECURSIVE steps AS (SELECT b AS byte, b AS v, 0 AS k FROM range(256) r(b) UNION ALL SELECT byte, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(v ORDER BY byte) AS c FROM steps WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ws FROM documents),
b AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS w FROM benchmark),
words AS (SELECT r, unnest(ws) AS w FROM d),
seen AS (SELECT DISTINCT w FROM (SELECT w FROM words UNION ALL SELECT w FROM b)),
bytes AS (SELECT w, list_transform(range(1, length(hex(encode(w))), 2), lambda i: ('0x' || substr(hex(encode(w)), i, 2))::BIGINT) AS bs FROM seen),
bucketed AS (SELECT w, xor(list_reduce(bs, lambda x, y: xor(x >> 8, c[1 + xor(x & 255, y)]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM words JOIN bucketed USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM b JOIN bucketed USING (w) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + 10000)::DOUBLE) / ((s.n + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (bucket)),
weights AS (SELECT r, count(*) AS n, sum(g) AS weight FROM words JOIN bucketed USING (w) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT r, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, 10 * count(*) OVER () // 100 AS k FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= k THEN rank END AS BIGINT) AS rank FROM scored LEFT JOIN placed USING (r)
"""

SQL: dict[str, str] = {"op5_quality_rules": _OP5, "op11_importance_resampling": _OP11}
