"""The contract queries of the training-data operators, over whole tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, hnsw, html_extract, lm_score, mixing, packing, quality_fm, quality_rules, simhash, suffix_dedup


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return hnsw.search(hnsw.build_index(rows), rows.filter("vec_id % 20 = 0"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_main_text(_table(spark, sf_dir, "pages"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality_fm.fit(docs, _table(spark, sf_dir, "labels"))
    scored = quality_fm.add_score(docs.select("doc_id", "text", "n_chars"), model, "score")
    return scored.select("doc_id", quality_fm.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(_table(spark, sf_dir, "documents"))
    base = quality_rules.apply_policy(quality_rules.apply_policy(led, "v1"), "base", "_base")
    counts = [F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return base.select("doc_id", *counts, (~F.col("_base")).alias("base_failed"), "kept", "fail_bits")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffix_dedup.remove_repeats(docs, length=50, with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(_table(spark, sf_dir, "documents"), tokenizer_path())


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash_dedup, op2_nearest_neighbours, op3_html_extraction, op4_quality_classifier,
        op5_quality_rules, op6_source_mixing, op7_best_fit_packing, op8_suffix_dedup, op9_lm_score, op10_chat_formatting,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op5_quality_rules": r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
tri AS (
  SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
grams AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS c FROM tri),
cover AS (
  SELECT r, count(DISTINCT i + k) AS n
  FROM grams, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1 GROUP BY r),
lines AS (
  SELECT r, unnest(string_split(t, chr(10))) AS x FROM w),
dup AS (
  SELECT r, count(*) - count(DISTINCT x) AS n, count(*) AS m FROM lines
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words,
         coalesce(dup.m, 0) AS n_lines
  FROM w LEFT JOIN cover USING (r) LEFT JOIN dup USING (r)),
b AS (
  SELECT *, CAST(CAST(n_words < 50 AS INT)
    + 2 * CAST(100 * n_repeat_words > 50 * n_words AS INT)
    + 4 * CAST(n_words > 1000000 AS INT)
    + 8 * CAST(word_chars < 2 * n_words OR word_chars > 20 * n_words AS INT)
    + 16 * CAST(10 * n_symbols > 3 * n_words AS INT)
    + 32 * CAST(n_lines >= 4 AND 10 * n_dup_lines > 5 * n_lines AS INT) AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b""",
    "op10_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
h AS (
  SELECT *, string_agg(md5(md5(role) || md5(text)), '') OVER (
           PARTITION BY conv_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS prefix
  FROM t),
ends AS (SELECT prefix, min(conv_id) AS conv_id FROM h WHERE pos = n GROUP BY prefix),
kept AS (SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM h WHERE pos < n))
SELECT conv_id, CAST(floor(turn / 256) AS BIGINT) AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g') || chr(10)
         || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM t WHERE conv_id IN (SELECT conv_id FROM kept)
GROUP BY conv_id, floor(turn / 256)""",
    "op8_suffix_dedup": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h,
         CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n
  FROM documents),
w AS (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS p FROM d WHERE n >= 50),
s AS (SELECT r, doc_id, p, substr(h, 2 * p + 1, 100) AS x FROM w),
m AS (SELECT x, min(doc_id) AS k FROM s GROUP BY x),
g AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM s JOIN m USING (x) WHERE k < doc_id),
i AS (SELECT r, p, sum(CASE WHEN q IS NULL OR p > q + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM g),
spans AS (SELECT r, k, min(p) AS a, max(p) + 50 AS b FROM i GROUP BY r, k),
e AS (SELECT r, a, b, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS f FROM spans),
z AS (
  SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last,
         string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS front
  FROM e JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(front, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN z USING (r)""",
}
