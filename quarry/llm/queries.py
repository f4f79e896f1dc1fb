"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import bpe_encode
from quarry.llm.common import fold
from quarry.llm.chat import perspectives
from quarry.llm.decontaminate import leaks
from quarry.llm.langid import identify
from quarry.llm.lm import lm_score
from quarry.llm.quality import quality_rules
from quarry.llm.simhash import near_duplicates
from quarry.llm.toxicity import learn_lexicon, score_toxicity
from quarry.llm.warc import archive_folder, read_warc, write_warc
from quarry.llm.wrappers import main_text
from quarry.plans.shared import table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = quality_rules(docs, keep_rows=False)
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "host_docs", "host_failed",
    )


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_encode(docs, tokenizer_file(), as_bytes=True)
    return out.select(
        F.col("_row.doc_id").alias("doc_id"), F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id"), 4) == 2
    out = identify(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), ~held_out)
    return out.select("_row.doc_id", "lang_pred", "score").select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 4) == 2
    lexicon = learn_lexicon(docs, table(spark, sf_dir, "labels"), ~held_out)
    out = score_toxicity(docs, lexicon).select("_row.doc_id", "score", "n_hits")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_hits")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its leaked items; clean documents have an empty list."""
    out = leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    own = out.select("_row.doc_id", "leaks")
    return own.select("doc_id", F.array_sort(F.array_distinct("leaks.item_id")).alias("item_ids"), (F.size("leaks") > 0).alias("contaminated"), "leaks")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(F.col("doc_id"), 7) == 2
    out = lm_score(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    out = read_warc(spark, folder)
    return out.select(
        F.col("page").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to"
    )


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perspectives(table(spark, sf_dir, "conversations"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("_row.page_id", "_row.url", "text", F.char_length("text").cast("long").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_bpe": op2_bpe,
    "op3_lm": op3_lm,
    "op4_simhash": op4_simhash,
    "op5_decontaminate": op5_decontaminate,
    "op6_language": op6_language,
    "op7_warc": op7_warc,
    "op8_chat": op8_chat,
    "op9_main_text": op9_main_text,
    "op10_toxicity": op10_toxicity,
}

SQL: dict[str, str] = {}

SQL["op1_quality"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT rid, doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d
), pos AS (
  SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM w WHERE len(ws) >= 5
), win AS (
  SELECT rid, p, array_to_string(ws[p:p + 4], ' ') AS g FROM pos
), dup AS (
  SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT p + k) AS n FROM dup, (SELECT unnest(range(0, 5)) AS k) GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(lines) AS n_lines, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid
), f AS (
  SELECT *, n_words < 10 AS r1, 100 * n_repeat_words > 20 * n_words AS r2, 100 * n_symbols > 10 * word_chars AS r3, 100 * n_dup_lines > 30 * n_lines AS r4 FROM m
), h AS (
  SELECT source, count(*) AS host_docs, count(*) FILTER (WHERE r1 OR r2) AS host_failed, count(*) FILTER (WHERE r1) AS f1, count(*) FILTER (WHERE r2) AS f2, count(*) FILTER (WHERE r3) AS f3,
    count(*) FILTER (WHERE r4) AS f4 FROM f WHERE source IS NOT NULL GROUP BY source
), long AS (
  SELECT source, host_docs, unnest([1, 2, 3, 4]) AS r, unnest([f1, f2, f3, f4]) AS n FROM h
), prior AS (
  SELECT r, avg(n / host_docs) AS a, var_pop(n / host_docs) AS v FROM long GROUP BY r
), k AS (
  SELECT r, a, CASE WHEN v > 0 AND a * (1 - a) / v - 1 > 0 THEN a * (1 - a) / v - 1 ELSE 10.0 END AS k FROM prior
), verdict AS (
  SELECT source, bool_or((n + a * k) / (host_docs + k) > 0.5) AS host_rejected FROM long JOIN k USING (r) GROUP BY source
)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, r1 OR r2 AS base_failed,
  NOT (r1 OR r2) AND NOT coalesce(host_rejected, FALSE) AS kept, host_docs, host_failed
FROM f LEFT JOIN h ON f.source = h.source LEFT JOIN verdict v ON f.source = v.source
"""

SQL["op8_chat"] = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS text FROM conversations
), p AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'
), s AS (
  SELECT t.*, perspective, CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id
), l AS (
  SELECT *, '<|im_start|>' || role || chr(10) || CASE WHEN role = 'user' THEN speaker || ': ' ELSE '' END AS lead FROM s
), r AS (
  SELECT *, lead || text || '<|im_end|>' || chr(10) AS rendered FROM l
), w AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text) - 1 AS seq,
    coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM r
)
SELECT conv_id, perspective, CAST(seq AS BIGINT) AS seq, turn, speaker, role, rendered, CAST(start AS BIGINT) AS start,
  CAST(CASE WHEN speaker = perspective THEN start + length(lead) END AS BIGINT) AS train_start,
  CAST(CASE WHEN speaker = perspective THEN start + length(rendered) - 1 END AS BIGINT) AS train_end
FROM w
"""
