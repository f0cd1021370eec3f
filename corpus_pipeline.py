"""From raw documents to token numbers: five stages, each over all its predecessor kept.

Quality rules drop documents, the n-gram join leaves one document of each
group of near copies, long strings that stand elsewhere too are cut out of the
texts, sources are brought to their target weights by dropping and repeating
documents, and what is left is encoded.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from patronage.llm import bpe, mixing, ngram_join, quality, repeats
from patronage.session import materialize

RANKS = "byte_bpe_50k.tiktoken"
#: Weights go to sources in turn; the mix is to have this share of all words.
WEIGHTS, SHARE = (5, 2, 1), 1.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules, or their host's rules, do not reject."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return ngram_join.keep_first(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the long strings that stand elsewhere too, cut at whole characters."""
    cut = repeats.remove_repeats(docs)
    text = F.when(F.col("text").isNotNull(), F.col("kept_text"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.expand(mixing.mix(docs, WEIGHTS, SHARE)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token numbers of each text, with digests of the numbers and of the bytes that they spell."""
    path, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.round_trip(docs.select("doc_id", "source", "lang", "text"), path, pattern).select(
        "doc_id", "source", "lang", F.size("ids").cast("long").alias("n_tokens"), "ids", bpe.id_digest(F.col("ids")).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_copies),
    ("suffix-array dedup", repeated_strings),
    ("mixing sources to target weights", source_mix),
    ("byte-level BPE", tokens),
]

#: Shingle sets, byte spans and merges have no SQL form; the tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
