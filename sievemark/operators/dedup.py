"""Exact-duplicate removal over pooled splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import split_rank

INDEX_BITS = 56


def check_policy(policy: str) -> None:
    if policy not in S.LABEL_CONFLICT_POLICIES:
        raise ValueError(
            f"label_conflict_policy must be one of {sorted(S.LABEL_CONFLICT_POLICIES)}, got {policy!r}"
        )


def pool_splits(*parts: DataFrame) -> DataFrame:
    """Concatenate splits, keeping where each record came from."""
    pooled = parts[0]
    for part in parts[1:]:
        pooled = pooled.unionByName(part)
    return (
        pooled.withColumnRenamed("split", "source_split")
        .withColumnRenamed("split_index", "source_index")
        .withColumn("pool_rank", split_rank(F.col("source_split")))
    )


def dedup_groups(pooled: DataFrame) -> DataFrame:
    """One row per content hash: its first record in pool order and its label spread.

    Everything is a map-side combined min/max/count, so no task sees a whole
    group however many copies a hash has. Pool rank and index (from 0, below
    2^56) are packed into one number, and splits travel as ranks, so that
    the aggregate hashes and does not sort. A record of another split than
    train, val or test is an error.
    """
    place = F.shiftleft(F.col("pool_rank").cast("long"), INDEX_BITS).bitwiseOR(F.col("source_index").cast("long"))
    known = F.when(F.col("source_split").isin(*S.MODEL_SPLITS), place).otherwise(
        F.raise_error(F.concat(F.lit("unknown split "), F.coalesce("source_split", F.lit("NULL")))).cast("long")
    )
    label = pooled.schema["label"].dataType
    index = pooled.schema["source_index"].dataType
    rank = F.shiftright("first", INDEX_BITS).cast("int")
    return (
        pooled.withColumn("_place", known).groupBy("content_hash")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            (F.min("label") != F.max("label")).alias("conflicting"),
            F.min("_place").alias("first"),
            F.min_by("label", "_place").alias("label"),
        )
        .select(
            "content_hash", "copies", F.coalesce("conflicting", F.lit(False)).alias("conflicting"),
            F.element_at(F.array(*[F.lit(s) for s in S.MODEL_SPLITS]), rank).alias("source_split"),
            F.col("first").bitwiseAND(F.lit((1 << INDEX_BITS) - 1)).cast(index).alias("source_index"),
            F.col("label").cast(label).alias("label"), rank.alias("pool_rank"),
        )
    )


def deduplicate(pooled: DataFrame, policy: str = "drop") -> DataFrame:
    """The retained record of every content hash."""
    check_policy(policy)
    groups = dedup_groups(pooled)
    kept = groups.where(~F.col("conflicting")) if policy == "drop" else groups
    return kept.select("source_split", "source_index", "pool_rank", "label", "content_hash")


def dedup_report(pooled: DataFrame, policy: str = "drop") -> DataFrame:
    check_policy(policy)
    drops = F.col("conflicting") & F.lit(policy == "drop")
    return dedup_groups(pooled).agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("input_records"),
        F.count(F.lit(1)).alias("unique_records"),
        F.count_if(F.col("copies") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("redundant_copies_removed"),
        F.count_if("conflicting").alias("label_conflict_groups"),
        F.lit(policy).alias("label_conflict_policy"),
        F.count_if(drops).alias("label_conflict_records_dropped"),
        F.count_if(~drops).alias("retained_records"),
    )
