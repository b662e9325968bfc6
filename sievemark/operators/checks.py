"""Data-quality rules: each returns the violations; empty means passed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark import schemas as S
from sievemark.functions.labels import sigmoid
from sievemark.functions.vectors import all_finite, is_finite, vec_sum

HASH_PATTERN = "^[0-9a-f]{64}$"


class CheckFailed(ValueError):
    """A data-quality rule found violations."""


def require(violations: DataFrame, message: str) -> None:
    """Raise with up to five violations; looks no further than those."""
    found = violations.limit(5).collect()
    if found:
        raise CheckFailed(f"{message}: " + "; ".join(str(row.asDict()) for row in found))


def check_labels(rows: DataFrame, allowed: Sequence[int] = (0, 1)) -> DataFrame:
    return rows.where(F.col("label").isNull() | ~F.col("label").isin(*allowed))


def check_dimensions(rows: DataFrame, width: int, height: int) -> DataFrame:
    wrong = (F.col("width") != width) | (F.col("height") != height)
    return rows.where(F.coalesce(wrong, F.lit(True)))


def check_vectors(rows: DataFrame, size: int, vec: str = "vec") -> DataFrame:
    """Vectors of another size or with missing or non-finite values."""
    good = (F.size(vec) == size) & all_finite(F.col(vec))
    return rows.where(~F.coalesce(good, F.lit(False)))


def check_missing_nonfinite(rows: DataFrame) -> DataFrame:
    """Per column: NULLs and, for numbers, non-finite values; only columns that have any.

    One aggregate over one scan, whatever the number of columns.
    """
    parts = []
    for f in rows.schema.fields:
        value = F.col(f.name)
        bad = F.count_if(value.isNotNull() & ~is_finite(value)) if isinstance(
            f.dataType, (T.DoubleType, T.FloatType)) else F.lit(0).cast("long")
        parts.append(F.struct(
            F.lit(f.name).alias("column_name"),
            F.count_if(value.isNull()).alias("missing"), bad.alias("nonfinite"),
        ))
    return (
        rows.agg(F.array(*parts).alias("c")).select(F.inline("c"))
        .where("missing > 0 or nonfinite > 0")
    )


def check_peer_ids(metadata: DataFrame, peers: DataFrame, key: str = "content_hash") -> DataFrame:
    """What is wrong with the members listed in ``peers`` (key, peer_id), one row per problem.

    Members are matched by (key, id), which is unique, and group sizes by key
    after counting, so a hot group stays spread and is never gathered.
    """
    listed = peers.groupBy(F.col(key), F.col("peer_id").alias("record_id")).agg(F.count(F.lit(1)).alias("times"))
    rows = metadata.select(key, "record_id", "duplicate_count")
    members = rows.join(listed, [key, "record_id"], "full").select(
        key, "record_id",
        F.when(F.col("duplicate_count").isNull(), "not a record of the group")
        .when((F.col("duplicate_count") < 2) & F.col("times").isNotNull(), "peers without duplicates")
        .when((F.col("duplicate_count") >= 2) & F.col("times").isNull(), "own id missing")
        .when(F.col("times") > 1, "repeated peer").alias("problem"),
    )
    stated = rows.groupBy(key).agg(F.max("duplicate_count").alias("stated")).where("stated > 1")
    sizes = stated.join(listed.groupBy(key).agg(F.sum("times").alias("found")), key, "left").select(
        key, F.lit(None).cast(rows.schema["record_id"].dataType).alias("record_id"),
        F.when(F.coalesce("found", F.lit(0)) != F.col("stated"), "wrong number of peers").alias("problem"),
    )
    return members.unionByName(sizes).where("problem is not null")


def row_rules() -> dict[str, Column]:
    """What each row of the row model must meet."""
    return {
        "split": F.col("split").isin(*S.MODEL_SPLITS),
        "split_index": F.col("split_index") >= 0,
        "label": F.col("label").isin(0, 1),
        "width": F.col("width") > 0,
        "height": F.col("height") > 0,
        "mean_value": is_finite(F.col("mean_value")),
        "std_value": is_finite(F.col("std_value")) & (F.col("std_value") >= 0),
        "min_value": is_finite(F.col("min_value")),
        "max_value": is_finite(F.col("max_value")),
        "content_hash": F.col("content_hash").rlike(HASH_PATTERN),
    }


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))


def check_row_schema(metadata: DataFrame) -> DataFrame:
    """Rows outside the ranges and patterns of the row model, with the broken rule."""
    return (
        metadata.select("record_id", F.array_join(_broken(row_rules()), ",").alias("broken_rules"))
        .where("broken_rules <> ''")
    )


def write_checked(rows: DataFrame, path: str, rules: dict[str, Column] | None = None) -> dict[str, int]:
    """Write ``rows`` and return how many break each rule, counted while they are written.

    All rules together cost no scan of their own: they are observed on the
    rows that pass to the writer. A rule that is not true, NULL included, is
    broken. ``broken_rows`` lists the rows of rules that counted some.
    """
    rules = row_rules() if rules is None else rules
    seen = Observation("rules")
    counts = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    rows.observe(seen, *counts).write.mode("overwrite").parquet(path)
    return {name: int(seen.get.get(name) or 0) for name in rules}


def broken_rows(stored: DataFrame, counted: dict[str, int], rules: dict[str, Column] | None = None) -> DataFrame:
    """``stored`` rows that break a rule which counted any, with ``broken_rules``; nothing is read if none did."""
    rules = {n: r for n, r in (row_rules() if rules is None else rules).items() if counted.get(n)}
    if not rules:
        return stored.withColumn("broken_rules", F.lit(None).cast("array<string>")).limit(0)
    return stored.withColumn("broken_rules", _broken(rules)).where(F.size("broken_rules") > 0)


def check_lengths(vectors: DataFrame, labels: DataFrame, split: str = "split") -> DataFrame:
    """Splits whose vector and label counts differ."""
    v = vectors.groupBy(split).agg(F.count(F.lit(1)).alias("vectors"))
    y = labels.groupBy(split).agg(F.count(F.lit(1)).alias("labels"))
    joined = v.join(y, split, "full").na.fill(0, ["vectors", "labels"])
    return joined.where("vectors <> labels")


def missing_required(required: DataFrame, present: DataFrame, column: str) -> DataFrame:
    return required.select(column).join(present.select(column), column, "left_anti")


def check_tables_exist(spark: SparkSession, names: Sequence[str]) -> list[str]:
    return [name for name in names if not spark.catalog.tableExists(name)]


def check_scores(scored: DataFrame, score: str = "positive_score") -> DataFrame:
    value = F.col(score)
    return scored.where(~F.coalesce(is_finite(value) & value.between(0.0, 1.0), F.lit(False)))


def check_unique(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_additivity(explained: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """Rows where base + sum(phi) misses the margin, or the probability is not its logistic."""
    gap = F.abs(F.col("base") + vec_sum(F.col("phi")) - F.col("margin"))
    drift = F.abs(sigmoid(F.col("margin")) - F.col("probability"))
    ok = (gap <= tolerance) & (drift <= tolerance) & ~F.isnan(gap)
    return explained.where(~F.coalesce(ok, F.lit(False)))


def attribution_problem(version: str, fresh: Column, rtol: float = 1e-7, atol: float = 1e-8) -> Column:
    """Why a stored prediction may not be explained by this model; NULL when it may."""
    stored = F.col("positive_score")
    close = is_finite(stored) & (F.abs(fresh - stored) <= F.lit(atol) + F.lit(rtol) * F.abs(stored))
    return (
        F.when(~F.col("model_version").eqNullSafe(F.lit(version)), "other model version")
        .when(~F.coalesce(close, F.lit(False)), "stored score differs")
    )


def check_attribution_version(content: DataFrame, version: str, fresh: Column) -> DataFrame:
    return (
        content.withColumn("problem", attribution_problem(version, fresh))
        .where("problem is not null").select("content_id", "problem")
    )
