"""Incremental, idempotent ingest as merges of a batch into the catalog tables.

Nothing is processed file by file: a batch is classified with expressions,
collapsed to one row per content digest, and merged with the stored state.
The sequential rules (first valid copy extracts, a bad file name never
downgrades valid content) become per-digest aggregates.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import file_extension, geometry, limit_text, score_and_decide
from sievemark.functions.vectors import is_finite
from sievemark.operators.catalog import copies
from sievemark.operators.skew import HOT_ROWS, attach_group_values
from sievemark.session import materialize

# A batch row: one source file or record, with what decoding its bytes gave.
BATCH_COLUMNS = [
    "path", "filename", "content_id", "file_size", "format", "width", "height",
    "color_mode", "exif", "features", "decode_error", "split", "label", "seen_at", "read_error",
]


@dataclass(frozen=True)
class Scorer:
    """A model as the catalog sees it: raw score as an expression over the features, threshold, kind and version."""

    raw_score: Callable[[Column], Column]
    raw_threshold: float
    kind: str
    version: str

    def __post_init__(self):
        if self.kind == "probability" and not 0 <= self.raw_threshold <= 1:
            raise ValueError("decision threshold must be a probability in [0, 1]")
        if not math.isfinite(self.raw_threshold):
            raise ValueError("decision threshold must be finite")

    def with_raw(self, content: DataFrame) -> DataFrame:
        return content.withColumn("_raw", self.raw_score(F.col("features")))

    def columns(self, raw: Column) -> dict[str, Column]:
        """Prediction columns of a raw score; ``valid`` is false where it is unusable."""
        out = score_and_decide(raw, F.lit(self.raw_threshold), self.kind)
        score = out["positive_score"]
        valid = F.coalesce(is_finite(score) & score.between(0.0, 1.0), F.lit(False))
        return {**out, "valid": valid}


def classify_sources(batch: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Verdict on every source from its name and, if the caller sets a limit, its size."""
    expected = F.create_map(*[F.lit(x) for pair in S.EXTENSION_FORMATS.items() for x in pair])
    out = batch.withColumn("expected_format", F.try_element_at(expected, file_extension(F.col("filename"))))
    unreadable = F.col("read_error").isNotNull()
    too_big = F.lit(False) if max_bytes is None else F.col("file_size") > max_bytes
    return out.withColumn(
        "source_status",
        F.when(unreadable, "failed")
        .when(F.col("expected_format").isNull() | too_big, "unsupported")
        .otherwise("accepted"),
    ).withColumn(
        "source_error",
        F.when(unreadable, F.col("read_error"))
        .when(F.col("expected_format").isNull(), "Unsupported extension")
        .when(too_big, f"File exceeds {limit_text(max_bytes or 0)}"),
    )


def collapse_contents(classified: DataFrame) -> DataFrame:
    """One row per digest of the batch.

    All copies carry the same bytes, so any accepted copy tells what decoding
    gave; for unsupported content the error of the first path counts.
    """
    accepted = F.col("source_status") == "accepted"
    decoded = ["format", "width", "height", "color_mode", "exif", "features", "decode_error", "file_size"]
    return (
        classified.where(F.col("content_id").isNotNull() & (F.col("source_status") != "failed"))
        .groupBy("content_id")
        .agg(
            F.max_by(F.struct(*decoded), accepted).alias("d"),
            F.count_if(accepted).alias("accepted_copies"),
            F.collect_set(F.when(accepted, F.col("expected_format"))).alias("expected_formats"),
            F.min(F.struct("path", "source_error")).alias("first_source"),
            F.max("seen_at").alias("batch_time"),
        )
    )


def merge_content(
    snapshot: DataFrame, batch: DataFrame, *, scorer: Scorer | None = None, retry_failed: bool = False,
    pipeline_version: str = S.PIPELINE_VERSION, max_bytes: int | None = None,
) -> DataFrame:
    """State of every content row the batch touches.

    ``snapshot`` is read only for the digests of the batch; the result has the
    CONTENT schema.  Rows the batch does not mention are not returned.
    """
    groups = collapse_contents(classify_sources(batch, max_bytes))
    old = snapshot.select("content_id", F.struct(*[c for c in snapshot.columns if c != "content_id"]).alias("old"))
    # Merged at every size, as all joins of the state below: a broadcast of it would pass through the driver.
    m = groups.join(old.hint("merge"), "content_id", "left")

    is_new = F.col("old").isNull()
    any_accepted = F.col("accepted_copies") > 0
    was = F.col("old.processing_status")
    needs_extract = (
        is_new
        | (F.col("old.pipeline_version") != pipeline_version)
        | (F.lit(retry_failed) & (was == "failed"))
    )
    extracts = any_accepted & F.coalesce(needs_extract | (was == "unsupported"), F.lit(False))
    unsupported = is_new & ~any_accepted
    broken = F.col("d.decode_error").isNotNull()
    tries = F.when(F.lit(retry_failed) & broken, F.col("accepted_copies")).otherwise(F.lit(1))
    geo = geometry(F.col("d.width"), F.col("d.height"))
    decoded = {
        "format": F.col("d.format"), "width": F.col("d.width"), "height": F.col("d.height"),
        "aspect_ratio": geo["aspect_ratio"], "color_mode": F.col("d.color_mode"),
        "megapixels": geo["megapixels"], "exif": F.col("d.exif"), "features": F.col("d.features"),
    }

    values = {
        name: F.when(extracts & ~broken, value).otherwise(F.col(f"old.{name}"))
        for name, value in decoded.items()
    }
    values["file_size"] = F.coalesce("old.file_size", "d.file_size")
    values["processing_status"] = (
        F.when(extracts & broken, "failed").when(extracts, "awaiting_model")
        .when(unsupported, "unsupported").otherwise(was)
    )
    values["error"] = (
        F.when(extracts, F.col("d.decode_error"))
        .when(unsupported, F.col("first_source.source_error")).otherwise(F.col("old.error"))
    )
    values["attempts"] = F.coalesce("old.attempts", F.lit(0)) + F.when(extracts, tries).otherwise(F.lit(0))
    touched = extracts | unsupported
    values["pipeline_version"] = F.when(touched, F.lit(pipeline_version)).otherwise(F.col("old.pipeline_version"))
    values["processed_at"] = F.when(touched, F.col("batch_time")).otherwise(F.col("old.processed_at"))
    for name in ("predicted_class", "confidence", "positive_score", "model_version"):
        values[name] = F.when(~extracts, F.col(f"old.{name}"))

    merged = m.select(
        "content_id",
        *[values[c].alias(c) for c in S.CONTENT.fieldNames() if c != "content_id"],
        # Some source is still accepted once its extension is compared with the decoded format.
        (any_accepted & (values["format"].isNull() | F.array_contains("expected_formats", values["format"])))
        .alias("_valid_source"),
        F.col("batch_time").alias("_now"),
    )
    if scorer is not None:
        due = (
            F.col("_valid_source") & F.col("features").isNotNull() & (F.col("processing_status") != "failed")
            & (
                ~F.col("model_version").eqNullSafe(F.lit(scorer.version))
                | (F.col("processing_status") == "awaiting_model")
                | (F.lit(retry_failed) & (F.col("processing_status") == "model_error"))
            )
        )
        merged = apply_scores(merged, scorer, due, F.col("_now"))
    return merged.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.CONTENT.fields])


def apply_scores(content: DataFrame, scorer: Scorer, due: Column, now: Column) -> DataFrame:
    """Score the ``due`` rows; an unusable score marks that row alone as model_error."""
    marked = scorer.with_raw(content.withColumn("_due", F.coalesce(due, F.lit(False))))
    p = scorer.columns(F.col("_raw"))
    ok = F.col("_due") & p["valid"]
    changed = {
        "processing_status": F.when(ok, "complete").otherwise("model_error"),
        "error": F.when(~ok, "Model returned an invalid score"),
        "predicted_class": F.when(ok, p["predicted_class"]),
        "confidence": F.when(ok, p["confidence"]),
        "positive_score": F.when(ok, p["positive_score"]),
        "model_version": F.lit(scorer.version),
        "processed_at": now,
    }
    return marked.select(*[
        F.when(F.col("_due"), changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
        for c in content.columns
    ])


def merge_sources(
    snapshot: DataFrame, batch: DataFrame, content_formats: DataFrame, *, hot_rows: int = HOT_ROWS, max_bytes: int | None = None
) -> DataFrame:
    """State of every path the batch mentions; the last row per path wins.

    ``content_formats`` (content_id, format) is the content state after the
    batch.  A path that could not be read keeps its old name, split and label.
    """
    columns = ["filename", "content_id", "split", "label", "source_status", "source_error", "expected_format"]
    # Copies, their formats and the rows themselves all read the verdicts: they are reduced and written once.
    verdicts = materialize(
        classify_sources(batch, max_bytes).groupBy("path")
        .agg(F.max(F.struct("seen_at", *columns)).alias("s"))
        .select("path", "s.*"),
        "verdicts",
    )
    formats = copies(verdicts).join(content_formats.select("content_id", "format").hint("merge"), "content_id", "left")
    joined = attach_group_values(
        verdicts, formats, "content_id", "copies", ["format"], spread_by=["path"], hot_rows=hot_rows
    )
    mismatch = (F.col("source_status") == "accepted") & (F.col("format") != F.col("expected_format"))
    unread = F.col("source_status") == "failed"
    old = snapshot.select("path", F.struct("filename", "split", "label").alias("old"))
    out = joined.join(old.hint("merge"), "path", "left")
    known = F.col("old").isNotNull()
    status = F.when(mismatch, "unsupported").otherwise(F.col("source_status"))
    error = F.when(mismatch, "Extension does not match decoded format").otherwise(F.col("source_error"))
    result = out.select(
        "path",
        F.when(unread & known, F.col("old.filename")).otherwise(F.col("filename")).alias("filename"),
        F.when(~unread, F.col("content_id")).alias("content_id"),
        F.when(unread & known, F.col("old.split"))
        .when(unread, S.EXTERNAL_SPLIT)
        .otherwise(F.coalesce("split", F.lit(S.EXTERNAL_SPLIT))).alias("split"),
        F.when(unread & known, F.col("old.label")).when(~unread, F.col("label")).alias("label"),
        status.alias("source_status"), error.alias("source_error"), "seen_at",
    )
    return result.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.SOURCES.fields])


def upsert(snapshot: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """New snapshot: changed rows replace rows of the same key."""
    kept = snapshot.join(changed.select(key).hint("merge"), key, "left_anti")
    return kept.unionByName(changed)


def batch_statuses(sources: DataFrame, content: DataFrame) -> DataFrame:
    """Histogram of what became of the batch's sources."""
    # Counted per content first, so a hot content joins as one row.
    counted = sources.groupBy("content_id", "source_status").agg(F.count(F.lit(1)).alias("n"))
    joined = counted.join(content.select("content_id", "processing_status").hint("merge"), "content_id", "left")
    status = F.when(F.col("source_status") != "accepted", F.col("source_status")).otherwise(F.col("processing_status"))
    return joined.groupBy(status.alias("status")).agg(F.sum("n").alias("n"))


def stale_predictions(content: DataFrame, version: str) -> DataFrame:
    """Contents whose stored prediction did not come from this model version."""
    return content.where(
        F.col("features").isNotNull()
        & F.col("processing_status").isin("complete", "awaiting_model")
        & ~F.col("model_version").eqNullSafe(F.lit(version))
    )


def rescore_due(version: str, retry_failed: bool = False) -> Column:
    statuses = ["complete", "awaiting_model"] + (["model_error"] if retry_failed else [])
    return (
        F.col("features").isNotNull()
        & F.col("processing_status").isin(statuses)
        & (~F.col("model_version").eqNullSafe(F.lit(version)) | (F.col("processing_status") != "complete"))
    )


def rescore(content: DataFrame, scorer: Scorer, *, retry_failed: bool = False, now: Column | None = None) -> DataFrame:
    """Content with due rows re-predicted from stored features; a second run changes nothing."""
    return apply_scores(
        content, scorer, rescore_due(scorer.version, retry_failed),
        F.current_timestamp() if now is None else now,
    )


def assign_catalog_split(samples: DataFrame, manifest: DataFrame) -> DataFrame:
    """Assigned split of each (split, split_index), ``excluded`` when deduplication dropped it."""
    lookup = manifest.select(
        F.col("source_split").alias("split"), F.col("source_index").alias("split_index"), "assigned_split"
    )
    return samples.join(lookup, ["split", "split_index"], "left").withColumn(
        "assigned_split", F.coalesce("assigned_split", F.lit(S.EXCLUDED_SPLIT))
    )


def sample_batch(samples: DataFrame, manifest: DataFrame, dataset: str, width: int, height: int) -> DataFrame:
    """Data set rows as an ingest batch under their assigned split; labels are audit-only."""
    assigned = assign_catalog_split(samples, manifest)
    bad = (F.size("vec") != width * height) | ~F.col("label").isin(0, 1)
    checked = F.when(bad, F.raise_error(F.lit("invalid vector size or binary label")).cast("array<double>"))
    return assigned.select(
        F.concat(F.lit(dataset + "::"), F.col("split"), F.lit(":"), F.col("split_index").cast("string")).alias("path"),
        F.format_string("%s_%06d.png", "split", "split_index").alias("filename"),
        F.col("content_hash").alias("content_id"),
        F.size("vec").cast("long").alias("file_size"),
        F.lit("PNG").alias("format"),
        F.lit(width).cast("long").alias("width"), F.lit(height).cast("long").alias("height"),
        F.lit("L").alias("color_mode"), F.lit("{}").alias("exif"),
        F.coalesce(checked, F.col("vec")).alias("features"),
        F.lit(None).cast("string").alias("decode_error"),
        F.col("assigned_split").alias("split"), F.col("label").cast("long").alias("label"),
        F.current_timestamp().alias("seen_at"), F.lit(None).cast("string").alias("read_error"),
    )
