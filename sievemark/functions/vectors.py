"""Expressions over fixed-length numeric arrays."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec_sum(vec: Column) -> Column:
    return F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x)


def vec_mean(vec: Column) -> Column:
    return F.try_divide(vec_sum(vec), F.size(vec))


def vec_std(vec: Column, mean: Column) -> Column:
    """Population standard deviation (ddof 0) around an already computed mean."""
    squares = F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.sqrt(F.try_divide(squares, F.size(vec)))


def vector_hash(vec: Column, dtype: str = "float64", bits: int = 40) -> Column:
    """SHA-256 over element type, size and every element, in units of 2^-``bits``.

    Scaling by a power of two is exact, so engines agree on the digits.
    """
    units = F.transform(vec, lambda x: F.floor(x * F.lit(float(2**bits))).cast("bigint").cast("string"))
    return F.sha2(F.concat_ws(":", F.lit(dtype), F.size(vec).cast("string"), F.array_join(units, ",", "null")), 256)


def dot(left: Column, right: Column) -> Column:
    return vec_sum(F.zip_with(left, right, lambda a, b: a * b))


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def all_finite(vec: Column) -> Column:
    """No element missing, NaN (which sorts above infinity) or infinite; stays in generated code."""
    infinity = float("inf")
    whole = F.size(F.array_compact(vec)) == F.size(vec)
    return whole & (F.array_max(vec) < infinity) & (F.array_min(vec) > -infinity)


def standardize(vec: Column, mean: Column, scale: Column) -> Column:
    """(x - mean) / scale per feature; a constant feature (scale 0) is left centred."""
    safe = F.transform(scale, lambda s: F.when(s == 0, F.lit(1.0)).otherwise(s))
    return F.zip_with(F.zip_with(vec, mean, lambda x, m: x - m), safe, lambda x, s: x / s)


def literal_vector(values) -> Column:
    """A constant array; one folded literal however many numbers there are."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")
