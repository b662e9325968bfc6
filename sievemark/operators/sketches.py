"""Opt-in approximate forms by mergeable sketches: one small sketch a part, stored, merged and queried without the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The sizes of the sketches and the errors they bound, with about 99 % certainty for ranks and two deviations for counts.
KLL_SIZE = 400
RANK_ERROR = 0.0103
THETA_LOG = 14
COUNT_ERROR = 2 / (2**THETA_LOG) ** 0.5


def quantile_sketches(rows: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(*by, sketch): a quantile sketch of ``value`` per part. NULL and NaN values do not count."""
    known = F.when(~F.isnan(value), F.col(value).cast("double"))
    return rows.groupBy(*by).agg(F.kll_sketch_agg_double(known, F.lit(KLL_SIZE)).alias("sketch"))


def merged_quantiles(sketches: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(*by, n, quantiles) of the merged sketches: each value's rank is within ``RANK_ERROR`` of the rows. Empty parts give no row."""
    merged = sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(KLL_SIZE)).alias("sketch"))
    n = F.kll_sketch_get_n_double("sketch")
    filled = merged.select(*by, "sketch", n.alias("n")).where("n > 0")
    return filled.select(*by, "n", F.kll_sketch_get_quantile_double("sketch", F.array(*map(F.lit, map(float, probabilities)))).alias("quantiles"))


def low_variance_bound(sketches: DataFrame, quantile: float = 0.01) -> DataFrame:
    """One row: the value below which about ``quantile`` of the rows lie, from stored sketches."""
    return merged_quantiles(sketches, [quantile]).select(F.col("quantiles")[0].alias("threshold"))


def id_sketches(rows: DataFrame, key: str, facets: Sequence[str]) -> DataFrame:
    """(facet, value, sketch): the ids of each facet value, and of all rows under the facet ``all``; NULL values are values."""
    cells = rows.select(F.col(key).alias("key"), F.explode(F.array(
        F.struct(F.lit("all").alias("facet"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets],
    )).alias("c"))
    return cells.where("key is not null").groupBy("c.facet", "c.value").agg(F.theta_sketch_agg("key", F.lit(THETA_LOG)).alias("sketch"))


def merged_ids(sketches: DataFrame) -> DataFrame:
    """Sketches of several parts as one a facet value."""
    return sketches.groupBy("facet", "value").agg(F.theta_union_agg("sketch", F.lit(THETA_LOG)).alias("sketch"))


def distinct_ids(sketches: DataFrame, filters: dict[str, Sequence[str | None]] | None = None) -> DataFrame:
    """One row: about how many distinct ids meet every filter.

    A filter is a facet with the values it allows: sketches of the values are
    united, those of the facets intersected; no filter counts all ids. Counts
    are exact below ``2^THETA_LOG`` ids a facet value; beyond, a
    union is within ``COUNT_ERROR`` of itself and an intersection within that share of the largest facet.
    """
    parts: list[DataFrame] = []
    for facet, values in (filters or {"all": [None]}).items():
        allowed = F.lit(False)
        for v in values:
            allowed = allowed | F.col("value").eqNullSafe(F.lit(v))
        chosen = sketches.where((F.col("facet") == facet) & allowed)
        parts.append(chosen.agg(F.theta_union_agg("sketch", F.lit(THETA_LOG)).alias("sketch")))
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united.agg(F.theta_sketch_estimate(F.theta_intersection_agg("sketch")).alias("ids"))


def rank_share(rows: DataFrame, value: str, at: Column) -> DataFrame:
    """One row: the shares of rows below ``at`` and not above it, to hold an approximate quantile against the exact ranks."""
    return rows.agg(
        (F.count_if(F.col(value) < at) / F.count(value)).alias("below"), (F.count_if(F.col(value) <= at) / F.count(value)).alias("not_above")
    )
