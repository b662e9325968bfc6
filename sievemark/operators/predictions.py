"""Joining splits, metadata, model scores and provenance into prediction tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import class_name, outcome_cell
from sievemark.operators.checks import check_unique, require
from sievemark.operators.skew import broadcast_if_small

KEYS = ["source_split", "source_index"]

# Columns of the prediction table, in order.
PREDICTION_COLUMNS = [
    "record_id", "split", "source_split", "source_index", "label", "true_class",
    "model", "prediction_score", "score_type", "threshold", "predicted_label",
    "predicted_class", "model_file", "experiment_name", "experiment_id", "run_id",
    "run_name", "tracking_uri", "outcome", "correct",
]


def parse_model_list(value: str, known=S.MODEL_NAMES) -> list[str]:
    """Model names of a comma list or ``all``; unknown or no names are an error."""
    text = value.strip().lower()
    if text == "all":
        return list(known)
    names = list(dict.fromkeys(part.strip() for part in text.split(",") if part.strip()))
    for name in names:
        if name not in known:
            raise ValueError(f"unknown model {name!r}; choose from {sorted(known)} or 'all'")
    if not names:
        raise ValueError("no models selected")
    return names


def join_manifest_metadata(manifest: DataFrame, metadata: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """Manifest rows with their metadata identity, and the columns ``also``, left joined on the source coordinates."""
    known = metadata.select(
        F.col("split").alias("source_split"), F.col("split_index").alias("source_index"),
        "record_id", F.col("label").alias("stored_label"), F.col("content_hash").alias("stored_hash"), *also,
    )
    return manifest.join(known, KEYS, "left")


def manifest_problems(joined: DataFrame) -> DataFrame:
    """Counts of everything that would make the join unusable, in one row."""
    return joined.agg(
        F.count_if(F.col("record_id").isNull()).alias("missing_rows"),
        F.count_if(F.col("stored_hash") != F.col("content_hash")).alias("hash_mismatches"),
        F.count_if(F.col("stored_label") != F.col("label")).alias("label_mismatches"),
    )


def validated_manifest(manifest: DataFrame, metadata: DataFrame) -> DataFrame:
    """``join_manifest_metadata`` after checking it is one-to-one, complete and consistent."""
    require(check_unique(manifest, KEYS), "manifest repeats source coordinates")
    require(check_unique(metadata, ["split", "split_index"]), "metadata repeats source coordinates")
    joined = join_manifest_metadata(manifest, metadata)
    problems = manifest_problems(joined)
    require(problems.where("missing_rows + hash_mismatches + label_mismatches > 0"), "metadata does not fit the manifest")
    return joined


def provenance_defaults(models: DataFrame, provenance: DataFrame) -> DataFrame:
    """Every model with its provenance, absent values as explicit defaults.

    Without a recorded path a model's own ``model_file``, where it has one, is its path.
    """
    joined = models.join(broadcast_if_small(provenance), "model", "left")
    if "model_file" in models.columns:
        joined = joined.withColumn("model_path", F.coalesce("model_path", "model_file"))
    return joined.withColumns({
        "provenance_available": F.coalesce("provenance_available", F.lit(False)),
        "model_source": F.coalesce("model_source", F.lit("local_joblib")),
    })


def prediction_table(scored: DataFrame, models: DataFrame) -> DataFrame:
    """One row per record and model.

    ``scored`` has record_id, split, source coordinates, label, model and
    prediction_score; ``models`` one row per model with threshold, score_type,
    model_file and provenance.
    """
    known = models.select(
        "model", "threshold", "score_type", "model_file",
        "experiment_name", "experiment_id", "run_id", "run_name", "tracking_uri",
    )
    decided = scored.join(broadcast_if_small(known), "model").withColumn(
        "predicted_label", (F.col("prediction_score") >= F.col("threshold")).cast("int")
    )
    return decided.withColumns({
        "true_class": class_name(F.col("label")),
        "predicted_class": class_name(F.col("predicted_label")),
        "outcome": outcome_cell(F.col("label"), F.col("predicted_label")),
        "correct": F.col("label") == F.col("predicted_label"),
    }).select(*PREDICTION_COLUMNS)


def disagreements(predictions: DataFrame) -> DataFrame:
    """Records on which models decide differently: one map-side combined pass, no self-join."""
    return (
        predictions.groupBy("record_id")
        .agg(
            F.count(F.lit(1)).alias("models"),
            F.sum("predicted_label").cast("long").alias("positive_votes"),
            F.min("label").alias("label"),
        )
        .where("positive_votes > 0 and positive_votes < models")
    )


def model_comparison(candidates: DataFrame) -> DataFrame:
    """Candidates ranked by validation AUC (ties by name); rank 1 is selected.

    One row per trained model, so a global order costs nothing.
    """
    order = Window.orderBy(F.col("validation_roc_auc").desc_nulls_last(), "model")
    return candidates.withColumn("rank", F.row_number().over(order)).withColumn("selected", F.col("rank") == 1)


SELECTION_RULE = "largest validation ROC AUC, ties by model name; the test split is never read"


def selection_manifest(comparison: DataFrame) -> DataFrame:
    return comparison.where("selected").select(
        F.col("model").alias("selected_model"), "model_path",
        F.lit("validation_roc_auc").alias("selection_metric"),
        F.col("validation_roc_auc").alias("selection_score"),
        F.col("threshold").alias("decision_threshold"),
        F.lit(SELECTION_RULE).alias("selection_rule"),
    )


def resolve_active_model(manifest: DataFrame | None, name: str | None, default: str = "logistic") -> str:
    """Explicit name, else the setting; ``best`` means the selected model."""
    wanted = (name or default).strip().lower()
    if wanted == "best":
        row = manifest.first() if manifest is not None else None
        if row is None:
            raise FileNotFoundError("'best' needs a model selection; compare the candidates first")
        wanted = row["selected_model"].lower()
    if wanted not in S.MODEL_NAMES:
        raise ValueError(f"unknown model {wanted!r}; expected one of {S.MODEL_NAMES}")
    return wanted


def run_parameters(report: DataFrame) -> DataFrame:
    """Split report as key/value parameters of a training run."""
    names = {
        "strategy": "split_strategy",
        "split_fingerprint": "split_fingerprint",
        "label_conflict_policy": "split_label_conflict_policy",
        "redundant_copies_removed": "split_redundant_copies_removed",
        "label_conflict_records_dropped": "split_label_conflict_records_dropped",
        **{f"split_size_{s}": f"split_size_{s}" for s in S.MODEL_SPLITS},
    }
    pairs = [
        F.struct(F.lit(key).alias("key"), F.col(column).cast("string").alias("value"))
        for column, key in names.items() if column in report.columns
    ]
    return report.select(F.inline(F.array(*pairs)))
