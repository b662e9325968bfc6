"""Registered queries of the corpus operators, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import (
    chat, entropy_mix, extendible, hmm, html_content, importance, mil, ngram_join, packing, pca_dedup, periodic_runs, prefix_hash, surrogates,
)
from sievemark.llm.common import table


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score_documents(table(spark, sf_dir, "documents"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replace(table(spark, sf_dir, "documents"), counter="n_replaced")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entropy_mix.mix(table(spark, sf_dir, "documents"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.fingerprint_documents(table(spark, sf_dir, "documents"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible.shard(table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op8_html_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_content.extract_pages(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file())


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).drop("text_key")


#: Added to the given conversations: texts that look like the template's own marks.
TRICKY = [(-7, turn, role, "\\### Assistant: </turn> ok") for turn, role in enumerate(("user", "assistant"))]


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = spark.createDataFrame(TRICKY, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(given.unionByName(tricky)), arranged=True)


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.repetitions(table(spark, sf_dir, "documents"), planted=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_hidden_markov, op2_surrogates, op3_quality, op4_entropy_mix, op5_fingerprints, op6_extendible_shards, op7_embedding_dedup,
        op8_html_content, op9_packing, op10_ngram_join, op11_chat_format, op12_importance_resampling, op13_periodic_runs,
    )
}
ORACLES: dict[str, str] = {"op6_extendible_shards": extendible.ORACLE}
