"""End-to-end flows: each step writes a table and the next one reads it."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.operators import analysis, attribution, checks, dedup, metadata, metrics, models, predictions, splits
from sievemark.operators.ingest import Scorer, sample_batch
from sievemark.sources import sinks
from sievemark.sources.files import file_batch
from sievemark.streaming.ingest import CatalogStore


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a step has already left its output."""
    try:
        spark.read.parquet(path)
    except Exception as exc:
        if "PATH_NOT_FOUND" in str(exc) or "UNABLE_TO_INFER_SCHEMA" in str(exc):
            return False
        raise
    return True


def build_metadata(samples: DataFrame, path: str, width: int, height: int, namespace: uuid.UUID,
                   *, force: bool = False) -> DataFrame:
    """Extract, flag, check and store the metadata table; an existing one is reused unless forced.

    The members of its duplicate groups go to ``<path>-peers``.
    """
    spark = samples.sparkSession
    if not force and table_exists(spark, path):
        return spark.read.parquet(path)
    raw = f"{path}-extracted"
    metadata.extract_metadata(samples, width, height, namespace).write.mode("overwrite").parquet(raw)
    stored = sinks.sink_metadata_table(metadata.add_qc_fields(spark.read.parquet(raw)), path)
    metadata.duplicate_peers(stored).write.mode("overwrite").parquet(f"{path}-peers")
    checks.require(checks.check_labels(stored), "unexpected labels")
    checks.require(checks.check_dimensions(stored, width, height), "unexpected dimensions")
    checks.require(checks.check_missing_nonfinite(stored), "missing or non-finite values")
    checks.require(checks.check_peer_ids(stored, spark.read.parquet(f"{path}-peers")), "wrong duplicate ids")
    checks.require(checks.check_row_schema(stored), "rows outside the schema")
    return stored


def run_analysis(stored: DataFrame, folder: str) -> dict[str, DataFrame]:
    return sinks.sink_tables(analysis.report_tables(stored), folder)


def build_split_table(samples: DataFrame, folder: str, *, policy: str = "drop", preserve: bool = True,
                      val_fraction: float = 0.1, test_fraction: float = 0.1,
                      seed: int = S.DEFAULT_SEED) -> DataFrame:
    """Deduplicate, split, check and store manifest and report; returns the manifest."""
    pooled = dedup.pool_splits(samples.select("split", "split_index", "label", "content_hash"))
    fractions = splits.resolve_fractions(pooled, preserve, val_fraction, test_fraction)
    assigned = splits.build_splits(
        pooled, policy=policy, preserve=False, val_fraction=fractions[0], test_fraction=fractions[1], seed=seed
    )
    splits.split_manifest(assigned).write.mode("overwrite").parquet(f"{folder}/manifest")
    manifest = samples.sparkSession.read.parquet(f"{folder}/manifest")
    checks.require(splits.repeated_hashes(manifest), "duplicates survived deduplication")
    report = splits.split_report(pooled, manifest, policy, *fractions, seed, preserve)
    sinks.sink_split_manifest(manifest, report, folder)
    return manifest


def training_rows(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    lookup = manifest.select(
        F.col("source_split").alias("split"), F.col("source_index").alias("split_index"), "assigned_split"
    )
    return samples.join(lookup, ["split", "split_index"])


def train(rows: DataFrame, name: str, folder: str, *, n_iter: int = S.SEARCH_ITERATIONS, use_cv: bool = False,
          folds: int = S.CV_FOLDS, seed: int = S.DEFAULT_SEED, grid: dict | None = None,
          augment_copies: int = 0) -> tuple[models.Tuning, DataFrame]:
    """Tune on train (scored on validation or by folds), threshold on validation, test once."""
    if augment_copies:
        held = rows.where(F.col("assigned_split") != "train").withColumn("copy", F.lit(0))
        rows = splits.augment_training(
            rows.where(F.col("assigned_split") == "train"), augment_copies, seed=seed
        ).unionByName(held)
    tuning = models.tune_and_fit(rows, name, n_iter=n_iter, use_cv=use_cv, folds=folds, seed=seed, grid=grid)
    val = tuning.model.score(rows.where(F.col("assigned_split") == "val"))
    run = {"run_id": F.lit(uuid.uuid4().hex), "logged_at": F.lit(datetime.now(timezone.utc))}
    result = models.evaluate(rows, tuning.model).withColumns({
        **run,
        "tuning_roc_auc": F.lit(tuning.score),
        "training_cv_roc_auc": F.lit(tuning.score if use_cv else None).cast("double"),
        "validation_roc_auc": F.lit(metrics.auc_rank(val).first()["auc"]),
    }).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.MODEL_METRICS.fields])
    test = tuning.model.score(rows.where(F.col("assigned_split") == "test"))
    matrix = metrics.confusion_matrix(test, result.select("threshold")).withColumns({"model": F.lit(name), **run})
    sinks.sink_model_metrics(result, matrix, folder)
    sinks.write_csv(models.search_results(rows.sparkSession, tuning), f"{folder}/{name}_search_results")
    return tuning, result


def select_model(rows: DataFrame, trained: dict[str, object], thresholds: dict[str, float], folder: str) -> DataFrame:
    """Compare candidates on validation only and store the manifest of the best."""
    val = rows.where(F.col("assigned_split") == "val")
    candidates = None
    for name, model in trained.items():
        scored = model.score(val)
        row = metrics.threshold_metrics(scored, thresholds[name]).select(
            F.lit(name).alias("model"), F.lit(f"{folder}/{name}").alias("model_path"), "threshold",
            F.col("roc_auc").alias("validation_roc_auc"),
            *[F.col(c).alias(f"validation_{c}") for c in ("accuracy", "balanced_accuracy", "sensitivity", "specificity")],
        )
        candidates = row if candidates is None else candidates.unionByName(row)
    if candidates is None:
        raise RuntimeError("no fitted candidate models were found")
    compared = predictions.model_comparison(candidates)
    sinks.write_csv(compared, f"{folder}/model_selection")
    manifest = predictions.selection_manifest(compared)
    manifest.write.mode("overwrite").json(f"{folder}/selected_model")
    return manifest


def predict(rows: DataFrame, manifest: DataFrame, stored_metadata: DataFrame, trained: dict[str, object],
            model_table: DataFrame, path: str, requested: Sequence[str], split: str = "test") -> list[str]:
    """Prediction rows of the requested models on one split; untrained models are skipped."""
    identified = predictions.validated_manifest(manifest.where(F.col("assigned_split") == split), stored_metadata)
    vectors = rows.select(
        F.col("split").alias("source_split"), F.col("split_index").alias("source_index"), "vec"
    )
    base = identified.select(
        "record_id", F.col("assigned_split").alias("split"), "source_split", "source_index", "label"
    ).join(vectors, predictions.KEYS)
    scored = None
    for name in requested:
        if name in trained:
            part = trained[name].score(base).withColumnRenamed("score", "prediction_score").drop("vec").withColumn(
                "model", F.lit(name))
            scored = part if scored is None else scored.unionByName(part)
    if scored is None:
        raise RuntimeError("no predictions were written; train a requested model first")
    return sinks.sink_predictions(predictions.prediction_table(scored, model_table), path, requested)


def explain(rows: DataFrame, model, threshold: float, folder: str, width: int, *, background: DataFrame | None = None,
            save_pixels: bool = False) -> DataFrame:
    """Contributions of the selected records, with summary and long pixel table.

    ``rows`` has record_id, split, split_index, label and vec.  The pixel
    table is written for a single record and for more only when asked.
    """
    if isinstance(model, models.LogisticModel):
        explained = attribution.explain_linear(rows, model, background)
    elif isinstance(model, models.BoostedModel):
        phi = attribution.explain_trees(rows, model)
        explained = rows.join(phi, "record_id")
    else:
        raise ValueError(f"no exact attribution for model {model.name!r}")
    explained.write.mode("overwrite").parquet(f"{folder}/explained")
    stored = rows.sparkSession.read.parquet(f"{folder}/explained")
    checks.require(checks.check_additivity(stored, 1e-6), "contributions do not add up")
    sinks.write_csv(attribution.attribution_summary(stored, F.lit(threshold), model.name), f"{folder}/summary")
    if save_pixels:
        sinks.sink_pixel_long(attribution.attribution_pixels(stored, width), f"{folder}/pixels")
    return stored


def catalog_scorer(model, threshold: float) -> Scorer:
    """A trained model for ingest and rescoring."""
    version = models.model_version(model, threshold)
    return Scorer(model.raw_score, threshold, model.kind, version)


def explain_catalog(content: DataFrame, model, threshold: float) -> DataFrame:
    """Contributions of scored contents under the model that scored them.

    Rows scored by another version, or whose stored score is not what the
    model gives now, carry the reason in ``problem`` and no contributions.
    """
    scorer = catalog_scorer(model, threshold)
    scored = scorer.with_raw(content.where(F.col("features").isNotNull()))
    fresh = scorer.columns(F.col("_raw"))["positive_score"]
    marked = scored.withColumn("problem", checks.attribution_problem(scorer.version, fresh)).select(
        F.col("content_id").alias("record_id"), F.col("features").alias("vec"), "problem"
    )
    good = marked.where(F.col("problem").isNull())
    if isinstance(model, models.LogisticModel):
        explained = attribution.explain_linear(good, model)
    elif isinstance(model, models.BoostedModel):
        explained = attribution.explain_trees(good, model)
    else:
        raise ValueError(f"no exact attribution for model {model.name!r}")
    return marked.select("record_id", "problem").join(explained.drop("problem", "vec"), "record_id", "left")


def ingest_directory(store: CatalogStore, directory: str, change: int, *, scorer: Scorer | None = None,
                     retry_failed: bool = False, feature_count: int = 784, max_bytes: int | None = None,
                     max_pixels: int | None = None) -> None:
    batch = file_batch(store.spark, directory, feature_count, max_bytes=max_bytes, max_pixels=max_pixels)
    store.apply(batch, change, scorer=scorer, retry_failed=retry_failed, max_bytes=max_bytes)


def ingest_dataset(store: CatalogStore, samples: DataFrame, manifest: DataFrame, dataset: str, width: int,
                   height: int, change: int, *, scorer: Scorer | None = None, retry_failed: bool = False) -> None:
    store.apply(sample_batch(samples, manifest, dataset, width, height), change, scorer=scorer, retry_failed=retry_failed)
