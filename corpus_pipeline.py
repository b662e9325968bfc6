"""A training corpus from documents: quality, near copies, personal data, mixture, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sievemark.llm import entropy_mix, mil, ngram_join, packing, surrogates
from sievemark.llm.common import table
from sievemark.llm.queries import tokenizer_file
from sievemark.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the attention classifier accepts."""
    return mil.keep_quality(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar texts."""
    return ngram_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Surrogates in place of personal data."""
    return surrogates.replace(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return entropy_mix.mix_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenised pieces placed in sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("personal data", personal_data),
    ("mixing to target weights", mixture),
    ("best-fit packing", sequences),
]

# The classifier is trained, so SQL cannot give the rows; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
