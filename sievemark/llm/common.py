"""Small helpers the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
FOLDS = 5
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column) -> Column:
    """crc32 of the key's decimal text, modulo five; a NULL key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % FOLDS


def whole_text(column: str = "text") -> Column:
    """The text with NULL as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def hash_sample(rows: DataFrame, key: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the smallest hashes of ``key``: the same ones on every run.

    Only rows whose hash lies in about the wanted share of all hashes are
    ordered, so that a task passes on few rows however many tasks there are.
    """
    total = rows.count()
    share = min(1.0, (1.3 * size + 100) / max(total, 1))
    hashed = F.xxhash64(key)
    some = rows if share >= 1 else rows.filter(hashed <= F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
    return some.orderBy(hashed, key).limit(size)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of each batch with about ``limit`` bytes of text (or one row), so that per-byte arrays stay small."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pa.compute.binary_length(sizes).fill_null(0), dtype=np.int64)
        start = total = 0
        for i, n in enumerate(lengths):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(n)
        yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def column_of(batch: pa.RecordBatch, column: str) -> list:
    return batch.column(batch.schema.get_field_index(column)).to_pylist()


def row_numbers() -> Iterator[int]:
    """Numbers no other task gives; they are data only once the result is written."""
    task = TaskContext.get().partitionId()
    n = task << 33
    while True:
        yield n
        n += 1


def batch_of(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
