"""The registered queries of this subpackage: each applies an operator, with production
parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, hilbert_shards, importance, line_dedup, merkle, mixing, mtree_search, ngram_join, oracle, quality_rules, sentencepiece_codec, toxicity, url_filter
from .common import table

MODEL = "piece_bpe_32k.model"
WORD_MODEL = "word_bpe_49k.json"


def tokenizer_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digests(turns.unionByName(extra))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path())


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents", "doc_id", "source", "text"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.verdicts(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))


def op7_mtree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return mtree_search.top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0)).drop("n_computed")


def op8_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard_documents(table(spark, sf_dir, "documents", "doc_id", "lang", "source", "text"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    return url_filter.judge_urls(pages, url_filter.listed_by_label(pages))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.digests(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path(WORD_MODEL))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digests(table(spark, sf_dir, "documents", *merkle.FIELDS))


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.verdicts(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_join, op2_chat_format, op3_sentencepiece, op4_mixing, op5_toxicity, op6_quality_rules, op7_mtree_search, op8_hilbert_shards, op9_url_filter, op10_line_dedup,
        op11_bpe, op12_merkle, op13_importance,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op7_mtree_search": mtree_search.ORACLE,
    "op9_url_filter": url_filter.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_merkle": oracle.merkle(),
    "op13_importance": oracle.importance(importance.BUCKETS, importance.SEED, importance.LEAST_WORDS, importance.PERCENT),
}
