"""The seven analysis tables over the metadata table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.functions.labels import class_name, rank_in, split_rank

TOP_K = 3

# Criterion, metric column, ascending; in report order.
EXTREMES = (
    ("darkest", "mean_value", True),
    ("brightest", "mean_value", False),
    ("lowest_contrast", "std_value", True),
)


def class_balance(metadata: DataFrame) -> DataFrame:
    positives = F.count_if(F.col("label") == 1)
    total = F.count(F.lit(1))
    return metadata.groupBy("split").agg(
        total.alias("total_records"),
        F.count_if(F.col("label") == 0).alias("negative_records"),
        positives.alias("positive_records"),
        F.round(F.lit(100.0) * positives / total, 2).alias("pct_positive"),
    )


def characteristics(metadata: DataFrame, decimals: int = 2) -> DataFrame:
    return metadata.groupBy("label").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.round(F.avg("mean_value"), decimals).alias("avg_mean_value"),
        F.round(F.avg("std_value"), decimals).alias("avg_std_value"),
        F.round(F.min("mean_value"), decimals).alias("min_mean_value"),
        F.round(F.max("mean_value"), decimals).alias("max_mean_value"),
        F.round(F.min("std_value"), decimals).alias("min_std_value"),
        F.round(F.max("std_value"), decimals).alias("max_std_value"),
    ).withColumn("class_name", class_name(F.col("label")))


def characteristics_by_split(metadata: DataFrame, decimals: int = 2) -> DataFrame:
    return metadata.groupBy("split", "label").agg(
        F.count(F.lit(1)).alias("total_records"),
        F.round(F.avg("mean_value"), decimals).alias("avg_mean_value"),
        F.round(F.avg("std_value"), decimals).alias("avg_std_value"),
    ).withColumn("class_name", class_name(F.col("label")))


def qc_summary(metadata: DataFrame) -> DataFrame:
    """Totals and duplicate groups in one row.

    Counts are first combined per hash, which replaces the row multiplication
    of two filtered distinct counts by one map-side combined aggregate.
    """
    per_hash = metadata.groupBy("content_hash").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("low_variance_flag").alias("low"),
        F.count_if("exact_duplicate_flag").alias("dup"),
        F.count_if("cross_split_duplicate_flag").alias("cross"),
    )

    def total(c: str):
        return F.coalesce(F.sum(c), F.lit(0))

    return per_hash.agg(
        total("n").alias("total_records"),
        total("low").alias("low_variance_records"),
        total("dup").alias("duplicate_records"),
        F.count_if(F.col("dup") > 0).alias("duplicate_groups"),
        total("cross").alias("cross_split_duplicate_records"),
        F.count_if(F.col("cross") > 0).alias("cross_split_duplicate_groups"),
    )


def cross_split_duplicates(metadata: DataFrame) -> DataFrame:
    return metadata.where("cross_split_duplicate_flag").select(
        "content_hash", "record_id", "split", "split_index", "label",
        "duplicate_count",
    )


def _runs(field: str):
    """``value xN`` per distinct value of a field of ``runs``, in order."""
    values = F.array_sort(F.array_distinct(F.col(f"runs.{field}")))

    def text(value):
        same = F.filter("runs", lambda r: r[field] == value)
        n = F.aggregate(same, F.lit(0).cast("long"), lambda total, r: total + r["n"])
        return F.concat(value.cast("string"), F.lit(" x"), n.cast("string"))

    return F.array_join(F.transform(values, text), ", ")


def duplicate_label_conflicts(metadata: DataFrame) -> DataFrame:
    """Duplicate groups whose labels disagree, with every member's label and split as runs (``0 x5, 1 x2``).

    Members are counted per (hash, label, split) before anything is gathered,
    so a group contributes a few counts, whatever its size.  A NULL label
    agrees with every label.
    """
    return (
        metadata.groupBy("content_hash", "label", "split").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("content_hash").agg(
            F.sum("n").alias("record_count"),
            F.collect_list(F.struct("label", "split", "n")).alias("runs"),
            F.min("label").alias("lo"), F.max("label").alias("hi"),
        )
        .where("lo <> hi")
        .select(
            "content_hash", "record_count",
            F.size(F.array_compact(F.array_distinct("runs.label"))).cast("long").alias("distinct_label_count"),
            _runs("label").alias("labels"), _runs("split").alias("splits"),
        )
    )


def extreme_records(metadata: DataFrame, k: int = TOP_K) -> DataFrame:
    """Top ``k`` per criterion; each is a per-task top-k, never a global sort."""
    columns = [
        "record_id", "split", "split_index", "label", "mean_value", "std_value",
        "min_value", "max_value", "low_variance_flag", "exact_duplicate_flag",
    ]
    parts = []
    for criterion, metric, ascending in EXTREMES:
        key = F.col(metric).asc() if ascending else F.col(metric).desc()
        top = metadata.select(*columns).orderBy(key, "record_id").limit(k)
        position = F.row_number().over(Window.orderBy(key, "record_id"))  # over k rows
        parts.append(
            top.withColumn("selection_rank", position.cast("long"))
            .withColumn("criterion", F.lit(criterion))
            .withColumn("metric_name", F.lit(metric))
            .withColumn("metric_value", F.col(metric))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_tables(metadata: DataFrame) -> dict[str, DataFrame]:
    """All seven tables in report order."""
    order = split_rank(F.col("split"))
    criterion = rank_in(F.col("criterion"), [name for name, _, _ in EXTREMES])
    return {
        "class_balance": class_balance(metadata).orderBy(order),
        "characteristics": characteristics(metadata).orderBy("label"),
        "characteristics_by_split": characteristics_by_split(metadata).orderBy(order, "label"),
        "qc_summary": qc_summary(metadata),
        "cross_split_duplicates": cross_split_duplicates(metadata).orderBy("content_hash", "split", "split_index"),
        "duplicate_label_conflicts": duplicate_label_conflicts(metadata).orderBy("content_hash"),
        "extreme_records": extreme_records(metadata).orderBy(criterion, "selection_rank"),
    }
