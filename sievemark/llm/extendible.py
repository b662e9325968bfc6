"""Sharding by extendible hashing: only oversized buckets split on one more bit of the hash."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.llm.common import whole_text
from sievemark.operators.ranking import bucketed_row_number
from sievemark.session import materialize

SHARD_BYTES = 1 << 20
BITS = 48
MARGIN = 4
STEP = 8
RANK_ROWS = 256


def hash_bits(key):
    """The first 48 bits of the key's SHA-256, as a number; a NULL key counts as the empty text."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def bits(prefix, depth):
    return F.lpad(F.bin(prefix), depth, F.lit("0"))


def _split(rows: DataFrame, low: int, high: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Leaves between two depths, as (cell, depth, prefix, shard_bytes, shard_rows), and the cells still too large.

    ``cell`` is a hash prefix of ``high`` bits. Bucket sizes at all depths are
    sums over cells, so a row is read once however often its bucket splits.
    """
    cell = F.shiftright("hash", BITS - high) if high else F.lit(0).cast("long")
    cells = rows.groupBy(cell.alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes"), F.count("*").alias("cell_rows"))
    cells = materialize(cells, "cells")
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn(
        "prefix", F.floor(F.col("cell") / F.pow(F.lit(2.0), F.lit(high) - F.col("depth"))).cast("long")
    )
    fits = (
        levels.groupBy("depth", "prefix").agg(F.sum("cell_bytes").alias("shard_bytes"), F.sum("cell_rows").alias("shard_rows"))
        .filter(F.col("shard_bytes") <= limit)
    )
    # Cells and leaves grow with the input, so none is broadcast.
    first = levels.select("cell", "depth", "prefix").join(fits.hint("merge"), ["depth", "prefix"]).groupBy("cell").agg(
        F.min(F.struct("depth", "prefix", "shard_bytes", "shard_rows")).alias("leaf")
    ).select("cell", "leaf.*")
    leaves = materialize(first, "leaves")
    return leaves, cells.join(leaves.hint("merge"), "cell", "left_anti").select("cell")


def _named(rows: DataFrame) -> DataFrame:
    """Rows with a number, the hash of their id and the bytes of their text; the number is data once this is written."""
    return rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), hash_bits(F.col("doc_id")).alias("hash"),
                       F.octet_length(whole_text()).cast("long").alias("n_bytes"))


COLUMNS = ["doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows"]


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_bytes, shard, depth, shard_bytes, shard_rows) of every row.

    Documents are placed by the bits of a hash of their id. The directory
    starts as one bucket; a bucket above ``limit`` bytes of text splits on its
    next bit, the others stay, so ``shard`` is a string of ``depth`` bits and
    no two shards' strings begin alike. A document larger than the limit
    cannot fit: it is a shard of its own, named by its id, and from the second
    of several such rows of one id, smaller ones first, also by a number. Rows whose whole
    hash is equal (repeated ids) and that together exceed the limit go to
    numbered overflow pages of that bucket, each within the limit. NULL text
    is empty; an empty table gives no row. Other columns are not read.
    """
    numbered = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return _placed(materialize(_named(numbered), "hashed"), limit).select(*COLUMNS)


def _placed(named: DataFrame, limit: int) -> DataFrame:
    """The shard of every numbered row."""
    columns = ["row", *COLUMNS]
    large = named.filter(F.col("n_bytes") > limit).withColumn("id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    # Rows of one id by size; equal sizes are spread, as any order of theirs will do.
    bucket = F.struct(F.col("n_bytes"), F.pmod(F.xxhash64("row"), F.lit(64)).alias("part"))
    copy = bucketed_row_number(large, ["id"], bucket, [bucket, F.col("row")], "copy")
    alone = copy.select(
        "row", "doc_id", "n_bytes", F.concat(F.lit("alone:"), "id", F.when(F.col("copy") > 1, F.concat(F.lit("/"), F.col("copy") - 1)).otherwise("")).alias("shard"),
        F.lit(BITS).alias("depth"), F.col("n_bytes").alias("shard_bytes"), F.lit(1).cast("long").alias("shard_rows"),
    )
    left = named.filter(F.col("n_bytes") <= limit)
    total = left.agg(F.sum("n_bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1)))) + MARGIN)
    parts = [alone]
    while True:
        leaves, large = _split(left, low, high, limit)
        placed = left.withColumn("cell", F.shiftright("hash", BITS - high)).join(leaves.hint("merge"), "cell")
        parts.append(placed.select("row", "doc_id", "n_bytes", bits(F.col("prefix"), F.col("depth")).alias("shard"), "depth", "shard_bytes", "shard_rows"))
        large = materialize(large, "large")
        if large.isEmpty():
            break
        left = left.withColumn("cell", F.shiftright("hash", BITS - high)).join(large.hint("merge"), "cell", "left_semi").drop("cell")
        if high == BITS:
            parts.append(_overflow(left, limit))
            break
        left = materialize(left, "left")
        low, high = high + 1, min(BITS, high + STEP)
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Pages for rows that share a whole hash: as many rows each as the largest of them allows."""
    stored = materialize(rows, "overflow")
    sizes = materialize(stored.groupBy("hash").agg(F.max("n_bytes").alias("largest"), F.count("*").alias("rows")), "overflow-sizes")
    joined = materialize(stored.join(sizes, "hash"), "overflow-rows")
    bucket = F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / RANK_ROWS))
    ranked = bucketed_row_number(joined, ["hash"], bucket, [bucket, F.col("row")], "rank")
    page = F.floor((F.col("rank") - 1) / F.floor(F.lit(limit) / F.col("largest")))
    paged = ranked.withColumn("shard", F.concat(bits(F.col("hash"), F.lit(BITS)), F.lit("/"), page.cast("string")))
    pages = paged.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return paged.join(pages, "shard").withColumn("depth", F.lit(BITS))


def directory(sharded: DataFrame) -> DataFrame:
    """One row per shard; together with its depth, a shard's bits say which directory entries point to it."""
    return sharded.groupBy("shard").agg(
        F.max("depth").alias("depth"), F.max("shard_bytes").alias("shard_bytes"), F.max("shard_rows").alias("shard_rows")
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> str:
    """Write ``docs`` with one folder per shard, each row to its own; returns the folders' column.

    Rows are numbered and written once, so that repeated rows are told apart.
    The column is ``shard``, with as many underscores as it takes to differ from those of ``docs``.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    stored = materialize(docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("kept"), F.monotonically_increasing_id().alias("row")), "numbered")
    named = _named(stored.select("row", F.col("kept.doc_id").alias("doc_id"), F.col("kept.text").alias("text")))
    placed = _placed(materialize(named, "hashed"), limit).select("row", "shard")
    joined = stored.join(placed.hint("merge"), "row").repartition("shard")
    joined.select("kept.*", F.col("shard").alias(name)).write.partitionBy(name).parquet(path)
    return name


ORACLE = f"""
WITH named AS (
    SELECT row_number() OVER () AS r, doc_id, ('0x' || substr(sha256(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12))::BIGINT AS hash,
           strlen(coalesce(text, ''))::BIGINT AS n_bytes
    FROM documents
), deep AS (
    SELECT n.*, d.depth, n.hash >> (48 - d.depth) AS prefix
    FROM named n, (SELECT unnest(range(0, 49))::INT AS depth) d WHERE n.n_bytes <= {SHARD_BYTES}
), buckets AS (
    SELECT depth, prefix, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows FROM deep GROUP BY depth, prefix
), leaves AS (
    SELECT d.r, d.doc_id, d.n_bytes, min(d.depth) AS depth, min_by(d.prefix, d.depth) AS prefix,
           min_by(b.shard_bytes, d.depth) AS shard_bytes, min_by(b.shard_rows, d.depth) AS shard_rows
    FROM deep d JOIN buckets b USING (depth, prefix) WHERE b.shard_bytes <= {SHARD_BYTES} GROUP BY d.r, d.doc_id, d.n_bytes
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth, '0') END AS shard, depth, shard_bytes, shard_rows FROM leaves
UNION ALL
SELECT doc_id, n_bytes, 'alone:' || coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN copy > 0 THEN '/' || copy ELSE '' END, 48, n_bytes, 1
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n_bytes) - 1 AS copy FROM named WHERE n_bytes > {SHARD_BYTES}) q
"""
