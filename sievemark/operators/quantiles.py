"""Exact interpolated quantile of a column of any size."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark.operators.ranking import running_totals
from sievemark.session import materialize

DIRECT_ROWS = 1_000_000
RANK_ERROR = 1e-4


def exact_quantile(
    df: DataFrame, column: str, q: float, *, direct_rows: int = DIRECT_ROWS, rank_error: float = RANK_ERROR
) -> float | None:
    """Linear-interpolated quantile, the same value pandas and SQL give.

    Above ``direct_rows`` rows a sketch first brackets the wanted
    positions; rows outside the bracket are only counted, and the bracket
    (about ``6 * rank_error`` of the rows) is narrowed again until few
    enough are left to order in one place.
    """
    if not 0 <= q <= 1:
        raise ValueError("q must be in [0, 1]")
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    total = values.count()
    if not total:
        return None
    position = q * (total - 1)
    first, last = math.floor(position), math.ceil(position)
    below, inside, error = 0, total, rank_error
    while inside > direct_rows and error < 0.25:
        target = (position - below) / inside  # relative to the rows that are left
        asked = [max(0.0, target - 2 * error), min(1.0, target + 2 * error)]
        low, high = values.approxQuantile("v", asked, error)
        counted = values.agg(
            F.count_if(F.col("v") < low).alias("less"), F.count_if(F.col("v").between(low, high)).alias("n")
        ).first()
        start, end = below + counted["less"], below + counted["less"] + counted["n"]
        if not (start <= first and last < end):
            error *= 4  # the sketch missed: ask for a wider bracket
            continue
        if counted["n"] > inside / 2 and low < high:
            break
        below, inside = start, counted["n"]
        values = materialize(values.where(F.col("v").between(low, high)), "bracket")
        if low == high:
            break
    counts = values.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    if inside <= direct_rows:
        ordered = counts.select("v", (F.sum("n").over(Window.orderBy("v")) + below).alias("upto"))
    else:  # equal values fill the bracket: order its distinct values in buckets
        totals = running_totals(materialize(counts, "counts"), [], "v", ["n"])
        ordered = totals.select("v", (F.col("n_before") + F.col("n") + below).alias("upto"))
    ends = ordered.agg(
        F.min(F.when(F.col("upto") > first, F.col("v"))).alias("a"),
        F.min(F.when(F.col("upto") > last, F.col("v"))).alias("b"),
    ).first()
    return ends["a"] + (ends["b"] - ends["a"]) * (position - first)
