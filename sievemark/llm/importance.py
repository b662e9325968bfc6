"""Importance resampling towards a target corpus: n-grams found by overlapped regex scanning, counted by CRC."""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
import regex

from sievemark.llm.common import batch_of, column_of, row_numbers, text_slices
from sievemark.operators.ranking import range_row_number
from sievemark.session import materialize

BUCKETS = 10_000
ORDERS = 2
LEAST_WORDS = 20
PERCENT = 25
SEED = 7
COARSE = 256

# Digits, lower-case ASCII letters and every byte of a longer code point belong to words; all else separates them.
_TO_BLANK = bytes(b if 0x30 <= b < 0x3A or 0x61 <= b < 0x7B or b >= 0x80 else 0x20 for b in range(256))

FEATURES = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("buckets", pa.binary())])
FEATURES_DDL = "doc_id long, row long, n_words long, buckets binary"
COUNTS = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])
WEIGHTS = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64()),
])
WEIGHTS_DDL = "doc_id long, row long, n_words long, n_features long, weight long"


def patterns(orders: int) -> list[regex.Pattern]:
    """One pattern an order: that many words from a word's beginning to a word's end, in a text of single blanks."""
    return [regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1)) for n in range(1, orders + 1)]


def collapsed(text: bytes) -> bytes:
    """A-Z in lower case and every run of separators as one blank, none at the ends."""
    return b" ".join(text.lower().translate(_TO_BLANK).split())


def scan(text: bytes, compiled: list[regex.Pattern], buckets: int) -> tuple[int, array]:
    """The number of words, and the bucket of every n-gram span in the order of the patterns."""
    line, found, n_words = collapsed(text), array("I"), 0
    for k, pattern in enumerate(compiled):
        found.extend(zlib.crc32(m[0]) % buckets for m in pattern.finditer(line, overlapped=True))
        if k == 0:
            n_words = len(found)
    return n_words, found


def stored_kind(buckets: int) -> str:
    """How a bucket number is stored: in as few bytes as all of them need."""
    return "<u2" if buckets <= 1 << 16 else "<u4"


def feature_rows(docs: DataFrame, *, key: str = "doc_id", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, a row number, the number of words and the buckets of all features, as ``stored_kind``, per row.

    NULL text has no features. The row number is data only once the result is written.
    """

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled, numbers = patterns(orders), row_numbers()
        for batch in text_slices(batches):
            done = [scan(text or b"", compiled, buckets) for text in column_of(batch, "text")]
            yield batch_of(
                FEATURES, doc_id=column_of(batch, "doc_id"), row=[next(numbers) for _ in done], n_words=[n for n, _ in done],
                buckets=[np.asarray(found, dtype=stored_kind(buckets)).tobytes() for _, found in done],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(scanned, FEATURES_DDL)


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows: one sum a task, at most ``buckets`` numbers on the driver."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for found in column_of(batch, "buckets"):
                total += np.bincount(np.frombuffer(found, dtype=stored_kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield batch_of(COUNTS, bucket=some, n=total[some])

    counts = np.zeros(buckets, dtype=np.int64)
    for bucket, n in features.select("buckets").mapInArrow(summed, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target to that in the raw corpus, rounded down."""
    size, s_all, t_all = float(raw.size), float(raw.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (s_all + size) / ((s + 1.0) * (t_all + size))))
        for s, t in zip(raw.tolist(), target.tolist(), strict=True)
    ], dtype=np.int64)


def weighing(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that turns feature rows into weights: the mean gain of a row's features, rounded down (none: 0)."""

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(b, dtype=stored_kind(gain.size)) for b in column_of(batch, "buckets")]
            yield batch_of(
                WEIGHTS, **{c: batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "row", "n_words")},
                n_features=[f.size for f in found], weight=[int(gain[f].sum()) // f.size if f.size else 0 for f in found],
            )

    return weighed


def gumbel(key: Column, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel draw made from a keyed digest; a NULL key counts as the empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def lowest_drawn(scores: DataFrame, n: int) -> int | None:
    """The ``n``-th highest ``score``, from two counts: of score classes, then of the scores of one class."""
    if n < 1:
        return None
    rest, chosen = n, scores
    for width in (COARSE, 1):
        groups = chosen.groupBy(F.floor(F.col("score") / width).cast("long").alias("g")).count().collect()
        for g, count in sorted(((r["g"], r["count"]) for r in groups), reverse=True):
            if rest <= count:
                break
            rest -= count
        chosen = chosen.filter(F.floor(F.col("score") / width).cast("long") == g)
    return g


def resample(
    docs: DataFrame, target: DataFrame, *, orders: int = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; ranks go to the drawn rows alone.

    Words are runs of letters, digits and non-ASCII code points, A-Z lowered;
    features are all runs of 1 to ``orders`` words. A row's score is its mean
    bucket gain towards ``target`` plus a Gumbel draw from its id, so that the
    highest ``percent`` of the rows with ``least_words`` words are a sample
    without replacement by importance. Equal scores go by id (NULL last),
    then by the order in which rows were read; repeated rows are drawn one
    by one. NULL text has no features and weight 0. Buckets are written once
    and read again for the weights, so each text is scanned once.

    The Gumbel draw hangs on the id alone, as reruns must agree: rows of one id have one draw.
    An empty table gives no row; with an empty target only the corpus counts.
    Other columns are ignored.
    """
    features = materialize(feature_rows(docs, orders=orders, buckets=buckets), "features")
    wanted = feature_rows(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), orders=orders, buckets=buckets)
    gain = gains(bucket_counts(features, buckets), bucket_counts(wanted, buckets))
    scored = materialize(
        features.mapInArrow(weighing(gain), WEIGHTS_DDL).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored"
    )
    able = F.col("n_words") >= least_words
    n = percent * scored.filter(able).count() // 100
    lowest = lowest_drawn(scored.filter(able).select("score"), n)
    columns = ["doc_id", "n_features", "weight", "score"]
    if lowest is None:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    high = able & (F.col("score") >= lowest)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    ranked = range_row_number(scored.filter(high), order, "rank").withColumn("rank", F.when(F.col("rank") <= n, F.col("rank").cast("long")))
    return ranked.select(*columns, "rank").unionByName(scored.filter(~high).select(*columns, F.lit(None).cast("long").alias("rank")))
