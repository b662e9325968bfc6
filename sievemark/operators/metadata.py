"""Per-record metadata and data-set level QC columns."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions import identity, vectors
from sievemark.operators.quantiles import exact_quantile
from sievemark.operators.skew import HOT_ROWS, attach_group_values
from sievemark.sources.buckets import Bucketed


def extract_metadata(samples: DataFrame, width: int, height: int, namespace: uuid.UUID) -> DataFrame:
    """One row of identity, geometry and intensity statistics per sample.

    ``samples`` has split, split_index, label, vec and, unless it is to be
    taken over every element here, content_hash.  Vectors of another size or
    with missing or non-finite values are an error, raised when the row is
    evaluated.
    """
    if "content_hash" not in samples.columns:
        samples = samples.withColumn("content_hash", vectors.vector_hash(F.col("vec")))
    valid = (F.size("vec") == width * height) & vectors.all_finite(F.col("vec"))
    checked = samples.withColumn(
        "vec",
        F.when(valid, F.col("vec")).otherwise(
            F.raise_error(F.lit("vector has the wrong size or a non-finite value")).cast("array<double>")
        ),
    )
    return (
        checked.withColumn("mean_value", vectors.vec_mean(F.col("vec")))
        .select(
            identity.record_uuid(
                namespace, F.col("split"), F.col("split_index"), F.col("content_hash")
            ).alias("record_id"),
            "split", "split_index", "label",
            F.lit(width).cast("long").alias("width"),
            F.lit(height).cast("long").alias("height"),
            "mean_value",
            vectors.vec_std(F.col("vec"), F.col("mean_value")).alias("std_value"),
            F.array_min("vec").alias("min_value"),
            F.array_max("vec").alias("max_value"),
            "content_hash",
        )
    )


def hash_groups(rows: DataFrame, key: str = "content_hash") -> DataFrame:
    """One row per content hash: size and whether it spans splits.

    Splits differ when the smallest and largest of their 64-bit hashes do,
    which combines on the map side in a hash aggregate, so a hot hash sends
    one row per task. NULL splits do not count.
    """
    split = F.when(F.col("split").isNotNull(), F.xxhash64("split"))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("duplicate_count"),
        (F.min(split) != F.max(split)).alias("cross_split_duplicate_flag"),
    )


def duplicate_groups(rows: DataFrame, key: str = "content_hash") -> DataFrame:
    return hash_groups(rows, key).where("duplicate_count > 1")


def add_duplicate_flags(
    rows: DataFrame, *, key: str = "content_hash", spread_by: str = "record_id", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Duplicate count and flags on every row."""
    flagged = attach_group_values(
        rows, duplicate_groups(rows, key), key, "duplicate_count",
        ["duplicate_count", "cross_split_duplicate_flag"],
        spread_by=[spread_by], hot_rows=hot_rows,
    )
    return _filled_flags(flagged)


def add_stored_duplicate_flags(stored: Bucketed) -> DataFrame:
    """``add_duplicate_flags`` of rows stored in buckets of their hash: no row is shuffled."""
    values = ["duplicate_count", "cross_split_duplicate_flag"]
    return _filled_flags(stored.with_group_values(lambda rows: duplicate_groups(rows, stored.key), values))


def _filled_flags(flagged: DataFrame) -> DataFrame:
    return (
        flagged.withColumn("duplicate_count", F.coalesce("duplicate_count", F.lit(1).cast("long")))
        .withColumn("exact_duplicate_flag", F.col("duplicate_count") > 1)
        .withColumn(
            "cross_split_duplicate_flag", F.coalesce("cross_split_duplicate_flag", F.lit(False))
        )
    )


def duplicate_peers(rows: DataFrame, *, key: str = "content_hash", id_col: str = "record_id",
                    hot_rows: int = HOT_ROWS) -> DataFrame:
    """Membership of every duplicate group, one row per member.

    The peers of a record are the rows with its hash.  This form is exact at
    any group size and linear in the input.
    """
    flagged = add_duplicate_flags(rows.select(key, "split", id_col), key=key, spread_by=id_col,
                                  hot_rows=hot_rows)
    return flagged.where("duplicate_count > 1").select(
        key, F.col(id_col).alias("peer_id"), "duplicate_count"
    )


def add_qc_fields(
    metadata: DataFrame,
    *,
    low_variance_quantile: float = S.LOW_VARIANCE_QUANTILE,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The four QC columns.  They inform; no record is removed.

    The peers of a record are the rows of ``duplicate_peers`` with its hash.

    Pass a written metadata table: several passes read it, and its columns
    are cheap there, while a fresh ``extract_metadata`` reads the vectors.
    """
    threshold = exact_quantile(metadata, "std_value", low_variance_quantile)
    flagged = add_duplicate_flags(metadata, hot_rows=hot_rows).withColumn(
        "low_variance_flag", F.col("std_value") <= F.lit(threshold)
    )
    return flagged.select(
        *metadata.columns, "low_variance_flag", "duplicate_count", "exact_duplicate_flag",
        "cross_split_duplicate_flag",
    )


def low_variance_rows(metadata: DataFrame, quantile: float = S.LOW_VARIANCE_QUANTILE) -> DataFrame:
    threshold = exact_quantile(metadata, "std_value", quantile)
    return metadata.where(F.col("std_value") <= F.lit(threshold))


def lowest_variance_sample(flagged: DataFrame, k: int = 5) -> DataFrame:
    return (
        flagged.select("record_id", "split", "split_index", "label", "mean_value", "std_value")
        .orderBy("std_value", "record_id").limit(k)
    )


def split_counts(rows: DataFrame) -> DataFrame:
    """Rows per model split, listing a split that has none as 0."""
    wanted = rows.sparkSession.createDataFrame([(s,) for s in S.MODEL_SPLITS], "split string")
    found = rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    return wanted.join(found, "split", "left").select(
        "split", F.coalesce("n", F.lit(0)).alias("total_records")
    )
