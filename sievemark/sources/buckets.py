"""Tables stored in buckets of a key: joins and aggregates on the key read them where they lie."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.operators.skew import BROADCAST_ROWS, HOT_ROWS
from sievemark.session import scratch_path


@dataclass(frozen=True)
class Bucketed:
    """A stored table. ``regular`` lies in buckets of ``key``; ``spread`` holds the rows of hot and NULL keys.

    A bucket is one task's work, so a key of very many rows is kept out of
    them. At most ``BROADCAST_ROWS`` keys are hot: facts per hot key can be
    broadcast.
    """

    path: str
    key: str
    buckets: int
    hot_keys: int
    regular: DataFrame
    spread: DataFrame

    def rows(self) -> DataFrame:
        return self.regular.unionByName(self.spread)

    def with_group_values(self, groups: Callable[[DataFrame], DataFrame], values: Sequence[str]) -> DataFrame:
        """Every row with its key's ``values``, NULL for a key without.

        ``groups`` makes one row per key of rows; joined to the rows in
        buckets it needs no shuffle, and of the rest it is broadcast.
        """
        near = self.regular.join(groups(self.regular).hint("merge"), self.key, "left").select(*self.regular.columns, *values)
        if self.hot_keys:
            hot = groups(self.spread.where(F.col(self.key).isNotNull()))
            far = self.spread.join(F.broadcast(hot), self.key, "left").select(*self.spread.columns, *values)
        else:
            nothing = [F.lit(None).cast(near.schema[v].dataType).alias(v) for v in values]
            far = self.spread.select("*", *nothing)
        return near.unionByName(far)


def default_buckets(spark: SparkSession) -> int:
    """As many as shuffle partitions: with fewer, Spark shuffles a stored side rather than the other one."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _store(rows: DataFrame, key: str, buckets: int, path: str) -> None:
    name = f"sievemark_{uuid.uuid4().hex}"
    rows.write.bucketBy(buckets, key).sortBy(key).option("path", f"{path}/regular").format("parquet").saveAsTable(name)
    rows.sparkSession.sql(f"DROP TABLE {name}")  # files outside the warehouse stay


def _describe(spark: SparkSession, key: str, buckets: int, hot_keys: int, path: str) -> Bucketed:
    """The layout is written last: a table without it is unfinished and cannot be opened."""
    spark.createDataFrame([(key, buckets, hot_keys)], "key string, buckets int, hot_keys long").coalesce(1).write.parquet(f"{path}/layout")
    return open_bucketed(spark, path)


def write_bucketed(
    df: DataFrame, key: str, *, buckets: int | None = None, hot_rows: int = HOT_ROWS, path: str | None = None
) -> Bucketed:
    """Store ``df`` in buckets of ``key``. It is read three times, so pass a written table.

    Rows are shuffled once, by the key, and each bucket is one file sorted by
    it. Keys of more than ``hot_rows`` rows (of them at most the
    ``BROADCAST_ROWS`` largest) and NULL keys are written beside the buckets.
    """
    spark = df.sparkSession
    buckets = buckets or default_buckets(spark)
    path = path or scratch_path(spark, "bucketed")
    known = df.where(F.col(key).isNotNull())
    size = F.count(F.lit(1))
    large = known.groupBy(key).agg(size.alias("_rows")).where(F.col("_rows") > hot_rows)
    large.orderBy(F.col("_rows").desc(), key).limit(BROADCAST_ROWS).select(key).write.parquet(f"{path}/hot")
    hot = spark.read.schema(df.select(key).schema).parquet(f"{path}/hot")
    hot_keys = hot.count()
    regular, spread = known, df.where(F.col(key).isNull())
    if hot_keys:
        regular = known.join(F.broadcast(hot), key, "left_anti").select(*df.columns)
        spread = spread.unionByName(known.join(F.broadcast(hot), key, "left_semi").select(*df.columns))
    _store(regular.repartition(buckets, key), key, buckets, path)
    spread.write.parquet(f"{path}/spread")
    return _describe(spark, key, buckets, hot_keys, path)


def open_bucketed(spark: SparkSession, path: str) -> Bucketed:
    """A table that ``write_bucketed`` stored, in this or another application."""
    key, buckets, hot_keys = spark.read.parquet(f"{path}/layout").first()
    spread = spark.read.parquet(f"{path}/spread")
    name = f"sievemark_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE {name} ({spread.schema.toDDL()}) USING parquet"
        f" CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}/regular'"
    )
    return Bucketed(path, key, buckets, hot_keys, spark.table(name), spread)


def upsert_bucketed(stored: Bucketed, changed: DataFrame, path: str | None = None) -> Bucketed:
    """The next state: ``changed`` rows replace rows of their key. Both have one row per key, none of it NULL.

    Only ``changed`` is shuffled, to the buckets of the stored rows; each
    bucket is merged and written by one task. The old state stays as it is.
    """
    if stored.hot_keys:
        raise ValueError("a table with several rows per key has no row to replace")
    spark, key, columns = changed.sparkSession, stored.key, stored.regular.columns
    path = path or scratch_path(spark, "bucketed")
    old = stored.regular.select(key, F.struct(*columns).alias("_old"))
    new = changed.repartition(stored.buckets, key).select(key, F.struct(*columns).alias("_new"))
    merged = old.join(new, key, "full_outer").select(F.coalesce("_new", "_old").alias("_row")).select("_row.*")
    _store(merged, key, stored.buckets, path)
    stored.spread.write.parquet(f"{path}/spread")
    return _describe(spark, key, stored.buckets, 0, path)
