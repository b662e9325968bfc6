"""Positions and running totals that never pull a whole group into one task.

A window over a label, a split or nothing at all would sort billions of rows
in one task.  Here rows are first cut into order-preserving buckets; only the
small bucket totals are summed in order, and rows are sorted inside a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark.session import materialize

HASH_PREFIX = 4            # 65,536 buckets of a hex digest
BUCKET_ROWS = 1_000_000    # rows one task orders
MAX_BUCKETS = 10_000


def bucketed_row_number(
    df: DataFrame,
    group: Sequence[str],
    bucket: Column,
    order: Sequence[Column],
    name: str = "row_number",
) -> DataFrame:
    """1-based row number per ``group`` in ``order``.

    ``bucket`` must be monotone in ``order`` and not NULL.  A NULL in a
    ``group`` column is an error: it would fall out of the join.  Row-level
    work is partitioned by (group, bucket).
    """
    keys = [*group, "_bucket"]
    rows = df.withColumns({
        **{g: F.coalesce(g, F.raise_error(F.lit(f"{g} must not be NULL")).cast(df.schema[g].dataType)) for g in group},
        "_bucket": bucket,
    })
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    )
    local = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return (
        rows.withColumn("_local", local)
        .join(offsets, keys)
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_bucket", "_local", "_offset")
    )


def hash_rank(df: DataFrame, group: Sequence[str], key: str, name: str = "rank") -> DataFrame:
    """Row number per group in the order of a hex digest column."""
    return bucketed_row_number(df, group, F.substring(key, 1, HASH_PREFIX), [F.col(key)], name)


def index_rank(
    df: DataFrame, group: Sequence[str], major: Column, index: str, name: str = "rank"
) -> DataFrame:
    """Row number per group in the order (major, integer index).

    Buckets are cut where the data lie, so sparse indexes do not make one
    bucket each. ``df`` is read several times; pass a written table.
    """
    keyed = df.withColumn("_index", F.col(index).cast("double"))
    bounds = quantile_bounds(keyed, "_index")
    chunk = F.lit(0.0)
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        keyed = Bucketizer(splits=splits, inputCol="_index", outputCol="_chunk").transform(keyed)
        chunk = F.col("_chunk")
    bucket = F.struct(major.alias("major"), chunk.alias("chunk"))
    return bucketed_row_number(keyed, group, bucket, [major, F.col(index)], name).drop("_index", "_chunk")


def range_row_number(
    df: DataFrame, order: Sequence[Column], name: str = "row_number", partitions: int | None = None
) -> DataFrame:
    """1-based row number over a total order of arbitrary columns.

    Rows are range partitioned and written to the shared folder, so the range
    number is plain data; only one count per range is summed in order.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()), "ranges"
    )
    return bucketed_row_number(ranged, [], F.col("_bucket"), order, name)


def quantile_bounds(df: DataFrame, column: str, rows_per_bucket: int = BUCKET_ROWS) -> list[float]:
    """Boundaries that cut ``column`` into even buckets of about ``rows_per_bucket`` rows.

    At most ``MAX_BUCKETS`` numbers reach the driver; small inputs need none.
    """
    buckets = min(MAX_BUCKETS, -(-df.count() // rows_per_bucket))
    if buckets < 2:
        return []
    probabilities = [i / buckets for i in range(1, buckets)]
    return sorted(set(df.approxQuantile(column, probabilities, 1.0 / (4 * buckets))))


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    totals: Sequence[str],
    *,
    descending: bool = False,
    bounds: Sequence[float] | None = None,
) -> DataFrame:
    """Add ``<total>_before``: the sum over rows that come earlier in ``order``.

    ``(group, order)`` must be unique and ``order`` a double column.
    """
    bounds = quantile_bounds(df, order) if bounds is None else sorted(set(bounds))
    if bounds:
        splits = [float("-inf"), *bounds, float("inf")]
        rows = Bucketizer(splits=splits, inputCol=order, outputCol="_bucket").transform(df)
    else:
        rows = df.withColumn("_bucket", F.lit(0.0))

    def direction(c: str) -> Column:
        return F.col(c).desc() if descending else F.col(c).asc()

    keys = [*group, "_bucket"]
    earlier_buckets = Window.partitionBy(*group).orderBy(direction("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1
    )
    earlier_rows = Window.partitionBy(*keys).orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, -1
    )
    sums = rows.groupBy(*keys).agg(*[F.sum(c).alias(f"_s_{c}") for c in totals])
    offsets = sums.select(
        *keys,
        *[F.coalesce(F.sum(f"_s_{c}").over(earlier_buckets), F.lit(0)).alias(f"_o_{c}") for c in totals],
    )
    out = rows.select(
        "*", *[F.coalesce(F.sum(c).over(earlier_rows), F.lit(0)).alias(f"_l_{c}") for c in totals]
    ).join(offsets, keys)
    return out.select(
        *df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"{c}_before") for c in totals]
    )
