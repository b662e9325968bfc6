"""Counts of the catalog that follow its changes: signed images of the rows a merge touched, added to a small table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.operators.catalog import FACETS, NEED_ATTENTION, add_outcomes, join_catalog
from sievemark.session import materialize

# What is counted besides the facets' values.
RECORDS, CLASSIFIED, ATTENTION, CONTENTS, LATEST = "records", "classified", "need_attention", "unique_contents", "last_processed_at"


def _cells(sign: Column) -> Column:
    """What one catalog row adds to the counts."""
    none = F.lit(0).cast("long")

    def cell(facet: str, value: Column, n: Column) -> Column:
        return F.struct(F.lit(facet).alias("facet"), value.alias("value"), n.alias("n"))

    return F.array(
        cell(RECORDS, F.lit(""), sign), cell(CLASSIFIED, F.lit(""), F.when(F.col("predicted_class").isNotNull(), sign).otherwise(none)),
        cell(ATTENTION, F.lit(""), F.when(F.col("processing_status").isin(*NEED_ATTENTION), sign).otherwise(none)),
        # NULLs are counted too, so that the charts can show them.
        *[cell(facet, F.col(column).cast("string"), sign) for facet, column in FACETS.items()],
    )


def _summed(cells: DataFrame) -> DataFrame:
    return cells.groupBy("facet", "value").agg(F.sum("n").cast("long").alias("n")).where("n <> 0")


def _latest(rows: DataFrame) -> DataFrame:
    return rows.agg(F.max(F.unix_micros("processed_at")).alias("n")).where("n is not null").select(
        F.lit(LATEST).alias("facet"), F.lit("").alias("value"), "n"
    )


def count_tiles(catalog: DataFrame) -> DataFrame:
    """(facet, value, n) of the whole catalog, as ``change_tiles`` keeps it; with the latest processing time in microseconds."""
    counted = _summed(catalog.select(F.inline(_cells(F.lit(1).cast("long")))))
    contents = catalog.agg(F.count_distinct("content_id").alias("n")).where("n > 0").select(F.lit(CONTENTS).alias("facet"), F.lit("").alias("value"), "n")
    return counted.unionByName(contents).unionByName(_latest(catalog))


def touched_rows(sources: DataFrame, content: DataFrame, paths: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalog rows of the paths and of all sources of the content ids, with their copies; other rows are not joined."""
    mine = sources.join(paths, "path", "left_semi").unionByName(sources.join(ids, "content_id", "left_semi")).dropDuplicates(["path"])
    return add_outcomes(join_catalog(mine, content.join(ids, "content_id", "left_semi")))


def change_tiles(
    tiles: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame], changed_sources: DataFrame, changed_content: DataFrame
) -> DataFrame:
    """``tiles`` after a change of the catalog, without a look at rows the change does not touch.

    ``before`` and ``after`` are (sources, content); ``changed_sources`` and
    ``changed_content`` are the rows a merge or a rescore wrote. Touched are
    the changed paths and all sources of a content that changed, or that a
    changed path had before or has now. Each touched row is subtracted as it
    was and added as it is; a content counts while any source refers to it.
    A replayed change subtracts and adds the same rows.
    """
    paths = materialize(changed_sources.select("path").distinct(), "paths")
    own = [state[0].join(paths, "path", "left_semi").select("content_id") for state in (before, after)]
    ids = changed_content.select("content_id").unionByName(own[0]).unionByName(own[1]).where("content_id is not null").distinct()
    ids = materialize(ids, "ids")
    old, new = (materialize(touched_rows(*state, paths, ids), "touched") for state in (before, after))
    signed = [rows.select(F.inline(_cells(F.lit(sign).cast("long")))) for rows, sign in ((old, -1), (new, 1))]
    referred = [rows.where("content_id is not null").select("content_id").distinct() for rows in (old, new)]
    gained, lost = referred[1].join(referred[0], "content_id", "left_anti"), referred[0].join(referred[1], "content_id", "left_anti")
    contents = [
        part.select(F.lit(CONTENTS).alias("facet"), F.lit("").alias("value"), F.lit(sign).cast("long").alias("n")) for part, sign in ((gained, 1), (lost, -1))
    ]
    counts = tiles.where(F.col("facet") != LATEST).unionByName(signed[0]).unionByName(signed[1]).unionByName(contents[0]).unionByName(contents[1])
    latest = tiles.where(F.col("facet") == LATEST).unionByName(_latest(new)).groupBy("facet", "value").agg(F.max("n").alias("n"))
    return _summed(counts).unionByName(latest)


def kpis(tiles: DataFrame) -> DataFrame:
    """The tiles' row from the counts."""
    return tiles.agg(*[
        F.coalesce(F.sum(F.when(F.col("facet") == name, F.col("n"))), F.lit(0)).alias(name) for name in (RECORDS, CONTENTS, CLASSIFIED, ATTENTION)
    ])


def facet_values(tiles: DataFrame) -> DataFrame:
    return tiles.where(F.col("facet").isin(*FACETS) & F.col("value").isNotNull())


def value_distributions(tiles: DataFrame) -> DataFrame:
    chart = F.when(F.col("facet") == "classes", "predicted_class").when(F.col("facet") == "statuses", "processing_status")
    known = F.when(F.col("facet") == "classes", F.coalesce("value", F.lit("unclassified"))).otherwise(F.col("value"))
    return tiles.select(chart.alias("chart"), known.alias("value"), "n").where("chart is not null and value is not null")


def status_counts(tiles: DataFrame) -> DataFrame:
    return tiles.where("facet = 'statuses'").select(F.col("value").alias("status"), "n")


def catalog_stamp(tiles: DataFrame) -> DataFrame:
    number = lambda name: F.max(F.when(F.col("facet") == name, F.col("n")))
    return tiles.agg(F.coalesce(number(RECORDS), F.lit(0)).alias("records"), F.timestamp_micros(number(LATEST)).alias("last_processed_at"))
