"""Writers.  Each writes in parallel from the tasks that hold the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark.functions.labels import split_rank


def sink_metadata_table(metadata: DataFrame, path: str) -> DataFrame:
    """Replace the metadata table and return it as stored."""
    metadata.write.mode("overwrite").partitionBy("split").parquet(path)
    return metadata.sparkSession.read.schema(metadata.schema).parquet(path).select(*metadata.columns)


def ordered_rows(table: DataFrame) -> DataFrame:
    """Rows by split rank and index; arrays as compact JSON text for CSV."""
    shown = [
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in table.schema.fields
    ]
    return table.select(*shown).orderBy(split_rank(F.col("split")), "split_index")


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with header; one file only when asked, since that takes one task."""
    shown = df.select(*[
        F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
        for f in df.schema.fields
    ])
    (shown.coalesce(1) if single_file else shown).write.mode("overwrite").csv(path, header=True)


def sink_ordered_csv(table_path: str, csv_path: str, spark, single_file: bool = False) -> None:
    """Export the persisted table, not the frame it was built from."""
    write_csv(ordered_rows(spark.read.parquet(table_path)), csv_path, single_file)


def sink_tables(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """One CSV per named report table."""
    for name, table in tables.items():
        write_csv(table, f"{folder}/{name}")
    return tables


def sink_split_manifest(manifest: DataFrame, report: DataFrame, folder: str) -> None:
    write_csv(manifest, f"{folder}/split_manifest")
    report.write.mode("overwrite").json(f"{folder}/split_report")


def sink_predictions(predictions: DataFrame, path: str, requested: Sequence[str]) -> list[str]:
    """Predictions partitioned by model and split; models without rows are skipped.

    Returns the models written; none at all is an error.
    """
    rows = predictions.where(F.col("model").isin(list(requested)))
    rows.write.mode("overwrite").partitionBy("model", "split").parquet(path)
    written = [r["model"] for r in rows.sparkSession.read.schema(rows.schema).parquet(path)
               .select("model").distinct().collect()]
    if not written:
        raise RuntimeError("no predictions were written; train a requested model first")
    return sorted(written)


def sink_pixel_long(pixels: DataFrame, path: str) -> None:
    pixels.write.mode("overwrite").csv(path, header=True)


def sink_model_metrics(metrics: DataFrame, matrix: DataFrame, folder: str) -> None:
    """Append one run's metric row and 2x2 matrix; both carry model, run_id and logged_at."""
    for name, table in (("model_metrics", metrics), ("confusion", matrix)):
        missing = {"model", "run_id", "logged_at"} - set(table.columns)
        if missing:
            raise ValueError(f"{name} lacks {sorted(missing)}")
    metrics.write.mode("append").parquet(f"{folder}/model_metrics")
    matrix.write.mode("append").parquet(f"{folder}/confusion")
