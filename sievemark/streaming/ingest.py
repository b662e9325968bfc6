"""Micro-batch ingest with the same merges as a batch run.

State is kept as change sets: each batch writes the rows it changed under its
own batch id, and the current state is the latest row per key.  Change sets
are stored in folders by a hash of the key, so a batch reads the folders its
keys lie in.  A repeated batch overwrites its own change set, and ``compact``
folds change sets into one when there are many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemark import schemas as S
from sievemark.operators.ingest import Scorer, merge_content, merge_sources, rescore_due, apply_scores


# Folders of a change set, by a hash of the key. Part of the stored layout.
PARTS = 16

KEYS = {"content": "content_id", "sources": "path"}
SCHEMAS = {"content": S.CONTENT, "sources": S.SOURCES}


def part_of(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int")


class CatalogStore:
    """Change sets of the content and source tables below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        # An empty change set before the first one, so that state is always readable.
        for table, schema in SCHEMAS.items():
            empty = spark.createDataFrame([], schema).withColumn("part", F.lit(0))
            empty.write.mode("ignore").partitionBy("part").parquet(f"{self.root}/{table}/change=-1")

    def _changes(self, table: str, before: int | None) -> DataFrame:
        stored = T.StructType([
            *SCHEMAS[table].fields, T.StructField("change", T.LongType()), T.StructField("part", T.IntegerType())
        ])
        changes = self.spark.read.schema(stored).parquet(f"{self.root}/{table}")
        return changes if before is None else changes.where(F.col("change") < before)

    def _latest(self, table: str, before: int | None, only: DataFrame | None = None) -> DataFrame:
        """The latest row per key; with ``only``, of its keys, from the folders these lie in.

        The latest change is found on the key column alone; other columns are
        read for the rows that are returned.
        """
        key = KEYS[table]
        changes = self._changes(table, before)
        found = changes.select(key, "change", "part")
        if only is not None:
            keys = only.select(key).where(F.col(key).isNotNull()).distinct()
            parts = [r["part"] for r in keys.select(part_of(F.col(key)).alias("part")).distinct().collect()]  # at most PARTS
            changes, found = (df.where(F.col("part").isin(parts)) for df in (changes, found))
            found = found.join(keys, key, "left_semi")
        latest = found.groupBy("part", key).agg(F.max("change").alias("change"))
        return changes.join(latest, ["change", "part", key]).select(*SCHEMAS[table].fieldNames())

    def content(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        """Latest content rows, as of before a change, for the digests of ``only`` if given."""
        return self._latest("content", before, only)

    def sources(self, before: int | None = None, only: DataFrame | None = None) -> DataFrame:
        return self._latest("sources", before, only)

    def _write(self, table: str, rows: DataFrame, change: int) -> DataFrame:
        path = f"{self.root}/{table}/change={change}"
        placed = rows.withColumn("part", part_of(F.col(KEYS[table])))
        # Rebalancing gives a folder few files when it is small and splits it when it is large.
        placed.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path).select(*rows.columns)

    def apply(self, batch: DataFrame, change: int, *, scorer: Scorer | None = None, retry_failed: bool = False,
              max_bytes: int | None = None) -> None:
        """Merge one batch.  State is read as of before ``change``, so a replay gives the same result."""
        batch = batch.persist()
        try:
            old_content = self.content(change, only=batch)
            new_content = self._write(
                "content", merge_content(old_content, batch, scorer=scorer, retry_failed=retry_failed, max_bytes=max_bytes), change
            )
            old_sources = self.sources(change, only=batch)
            self._write("sources", merge_sources(old_sources, batch, new_content, max_bytes=max_bytes), change)
        finally:
            batch.unpersist()

    def rescore(self, scorer: Scorer, change: int, *, retry_failed: bool = False) -> DataFrame:
        """Write a change set with every due content re-predicted; returns those rows."""
        due = self.content(change).where(rescore_due(scorer.version, retry_failed))
        return self._write("content", apply_scores(due, scorer, F.lit(True), F.current_timestamp()), change)

    def compact(self, root: str) -> "CatalogStore":
        """Current state as one change set of a new store."""
        target = CatalogStore(self.spark, root)
        target._write("content", self.content(), 0)
        target._write("sources", self.sources(), 0)
        return target


def stream_ingest(batches: DataFrame, store: CatalogStore, checkpoint: str, *, first_change: int = 0,
                  scorer: Scorer | None = None):
    """Run a streaming DataFrame of batch rows into the store until its input is used up."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        store.apply(batch, first_change + batch_id, scorer=scorer)

    query = (
        batches.writeStream.foreachBatch(merge)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return query
