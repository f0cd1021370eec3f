"""The operators of this folder as named queries over the test tables."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.llm import (
    bpe, chat, divergence, html_text, language, licenses, mixing, ngram_join, quality, rank_bpe, repeats, vector_links, whitening,
)
from patronage.llm.common import QUERIES, SQL, query, table  # noqa: F401

RANKS, MERGES = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"

query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op5_byte_bpe")
def byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(docs, path, pattern).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), bpe.id_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


OP4 = r"""WITH rows AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
split AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM rows),
placed AS (SELECT rid, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (SELECT rid, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM placed WINDOW o AS (PARTITION BY rid ORDER BY i)),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows WHERE c IS NOT NULL),
covered AS (SELECT rid, count(DISTINCT i + d) AS n FROM again, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY rid),
measured AS (SELECT rid, doc_id, source, len(words) AS n_words,
  length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(lines) AS n_lines
  FROM split LEFT JOIN covered c USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  n_words < 50 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_dup_lines > 30 * n_lines
  OR 100 * n_symbols > 10 * word_chars AS strict_failed FROM measured),
hosts AS (SELECT source, count(*) AS n, count(*) FILTER (strict_failed) AS f FROM failed GROUP BY source),
moments AS (SELECT sum(n)::DOUBLE AS n, sum(f) / sum(n) AS mean, count(*) AS hosts, sum(f * f / n) AS raw FROM hosts),
prior AS (SELECT mean, mean * (1 - mean) AS noise, greatest(0, raw / n - mean * mean - mean * (1 - mean) * hosts / n) AS spread FROM moments),
verdict AS (SELECT source, CASE WHEN spread > 0 AND noise > 0 THEN (f + mean * greatest(noise / spread - 1, 0))
  / (n + greatest(noise / spread - 1, 0)) ELSE mean END > 0.5 AS host_rejected FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR (host_rejected AND strict_failed)) AS kept, host_rejected
FROM failed JOIN verdict ON failed.source IS NOT DISTINCT FROM verdict.source"""


@query("op4_quality_rules", OP4)
def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return quality.judge(docs, carry=["doc_id"]).select("doc_id", *quality.MEASURES, "base_failed", "kept", "host_rejected")


OP3 = r"""WITH sized AS (SELECT doc_id, source, row_number() OVER () AS rid, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, '')))[1:13] AS BIGINT) AS place FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
  [5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INTEGER)]::DOUBLE AS weight FROM sized GROUP BY source),
ratios AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM sources),
levels AS (SELECT r.ratio, (1.5::DOUBLE * (SELECT sum(source_size) FROM sources)
  - coalesce((SELECT sum(cap) FROM ratios x WHERE x.ratio < r.ratio), 0)) / (SELECT sum(weight) FROM ratios x WHERE x.ratio >= r.ratio) AS level
  FROM ratios r),
chosen AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level < ratio),
plan AS (SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * weight THEN cap ELSE level * weight END AS target FROM ratios, chosen),
wanted AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM plan),
ordered AS (SELECT rid, 2 * sum(size) OVER (PARTITION BY source ORDER BY place, rid) - size AS mid2 FROM sized)
SELECT s.doc_id, s.size, p.source_size, p.target, CAST(s.size * (p.whole + CASE WHEN p.target > p.whole * p.source_size
  AND o.mid2 <= 2 * (p.target - p.whole * p.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN wanted p ON s.source IS NOT DISTINCT FROM p.source JOIN ordered o USING (rid)"""


@query("op3_mix_sources", OP3)
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, (5, 2, 1), 1.5).select("doc_id", "size", "source_size", "target", "taken")


@query("op8_ngram_join")
def ngram_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.near_copies(table(spark, folder, "documents"))


@query("op10_run_length_index")
def run_length_index(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op2_html_text")
def html_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


@query("op9_language")
def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = language.learn(docs)
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@query("op7_vector_links")
def near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return vector_links.link_vectors(table(spark, folder, "embeddings"))


@query("op1_chat_windows")
def chat_windows(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"),
    )
    return chat.read_back(chat.windows(turns.unionByName(planted)))


@query("op6_licenses", licenses.scan_sql())
def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return licenses.scan(docs).withColumn("score", F.round("score", 6)).drop("text")


@query("op11_whitening")
def whitened_vectors(spark: SparkSession, folder: str) -> DataFrame:
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return whitening.whiten(vectors).select(
        "vec_id", "component", "n", F.col("deviation").cast("long").alias("deviation"), "whitened", "explained", "identity_error"
    )


@query("op12_rank_bpe")
def rank_array_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return rank_bpe.round_trip(docs, public_tokenizers.path(MERGES)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), rank_bpe.id_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op13_source_divergence", divergence.audit_sql())
def source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(table(spark, folder, "documents"))
