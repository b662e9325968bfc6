"""Joining per-group values back to rows when one group may hold a third of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast when it has at most ``max_rows`` rows, else as it is.

    The check reads no more than one row beyond the limit.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def attach_group_values(
    rows: DataFrame,
    groups: DataFrame,
    key: str,
    size: str,
    values: Sequence[str],
    *,
    spread_by: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left join ``groups`` (one row per string ``key``) to ``rows``.

    A group larger than ``hot_rows`` is repeated under as many salts as it is
    times too large, and its rows are spread over them by ``spread_by``, so no
    task receives a whole hot group. Only keys and salt counts are broadcast,
    of at most the ``BROADCAST_ROWS`` largest groups; others join unsalted.
    NULL keys match nothing and are spread as well. Groups as many as the rows
    are merged at every size: Spark takes them for small by their columns'
    widths and would send all of them through the driver.
    """
    large = groups.where(F.col(size) > hot_rows).orderBy(F.col(size).desc(), key).limit(BROADCAST_ROWS)
    hot = F.broadcast(large.select(F.col(key).alias("_hot_key"), F.ceil(F.col(size) / hot_rows).alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    salted = groups.join(hot, groups[key] == F.col("_hot_key"), "left").select(
        F.col(key).alias("_group_key"), F.struct(*values).alias("_values"),
        F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("_group_salt"),
    )
    spread = F.xxhash64(*spread_by)
    marked = rows.join(hot, rows[key] == F.col("_hot_key"), "left").withColumn(
        "_salt", F.when(F.col(key).isNull(), spread).otherwise(F.pmod(spread, salts))
    )
    same = (F.col(key) == F.col("_group_key")) & (F.col("_salt") == F.col("_group_salt"))
    return marked.join(salted.hint("merge"), same, "left").select(*rows.columns, *[F.col("_values")[v].alias(v) for v in values])
