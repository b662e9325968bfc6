"""Readers of the engine's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark import schemas as S


def scan_labeled_samples(spark: SparkSession, path: str, split: str) -> DataFrame:
    """Vectors and labels of one split; only that split's partition is read."""
    if split not in S.MODEL_SPLITS:
        raise ValueError(f"unexpected split {split!r}")
    return spark.read.schema(S.SAMPLES).parquet(path).where(F.col("split") == split)


def lookup_sample(samples: DataFrame, split: str, index: int) -> DataFrame:
    """The record at (split, index): one row, or none when out of bounds."""
    if split not in S.MODEL_SPLITS:
        raise ValueError(f"unexpected split {split!r}")
    if index < 0:
        raise IndexError(f"index {index} is out of bounds")
    return samples.where((F.col("split") == split) & (F.col("split_index") == index))


def get_sample(samples: DataFrame, split: str, index: int):
    row = lookup_sample(samples, split, index).first()
    if row is None:
        raise IndexError(f"index {index} is out of bounds for split {split!r}")
    return row


def model_metric(metrics: DataFrame, column: str, missing: str = "error", run_id: str | None = None) -> DataFrame:
    """One named metric per model in one row each: of its latest run, or of ``run_id``.

    ``missing`` decides what an absent value becomes: ``error``, ``null``, or
    ``half`` (0.5, the default threshold).
    """
    if missing not in ("error", "null", "half"):
        raise ValueError(f"unknown policy {missing!r}")
    if run_id is not None:
        metrics = metrics.where(F.col("run_id") == run_id)
    found = (
        F.max_by(column, F.struct("logged_at", "run_id")) if column in metrics.columns
        else F.max(F.lit(None).cast("double"))
    )
    out = metrics.groupBy("model").agg(found.alias(column))
    value: Column = F.col(column)
    if missing == "half":
        value = F.coalesce(value, F.lit(0.5))
    if missing == "error":
        message = F.concat(F.lit(f"no {column} for model "), F.col("model"))
        value = F.coalesce(value, F.raise_error(message).cast("double"))
    return out.select("model", value.alias(column))
