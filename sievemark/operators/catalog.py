"""The browsable catalog: join, filters, order, pages and summaries."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
import math
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import normalize_label, outcome_text
from sievemark.operators.ranking import range_row_number
from sievemark.operators.skew import HOT_ROWS, attach_group_values
from sievemark.sources.buckets import Bucketed

NEED_ATTENTION = ("failed", "model_error", "unsupported")
SORT_COLUMNS = ("filename", "processed_at", "confidence", "width", "height", "file_size")
FACETS = {
    "statuses": "processing_status",
    "classes": "predicted_class",
    "formats": "format",
    "splits": "split",
    "outcomes": "outcome",
}

# Columns of the result export, in order.
VISIBLE_COLUMNS = [
    "filename", "split", "label", "format", "width", "height", "aspect_ratio",
    "file_size", "color_mode", "predicted_class", "confidence",
    "true_class", "outcome", "processing_status", "copies", "error",
]
EXPORT_COLUMNS = [*VISIBLE_COLUMNS, "content_id", "processed_at", "model_version"]

CONTENT_COLUMNS = [
    "file_size", "format", "width", "height", "aspect_ratio", "color_mode", "megapixels", "exif",
    "processing_status", "error", "predicted_class", "confidence", "positive_score",
    "model_version", "processed_at", "attempts", "pipeline_version",
]

# Positions beyond this are looked up by range instead of a per-task top-k.
TOP_K_ROWS = 100_000


def copies(sources: DataFrame) -> DataFrame:
    """Sources per content id; sources without content are not copies of each other."""
    return sources.where(F.col("content_id").isNotNull()).groupBy("content_id").agg(
        F.count(F.lit(1)).alias("copies")
    )


def join_catalog(sources: DataFrame, content: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Every source with its content; status and prediction show only for accepted sources."""
    per_content = copies(sources).join(
        content.select("content_id", F.struct(*CONTENT_COLUMNS).alias("c")).hint("merge"), "content_id", "left"
    )
    return _shown(attach_group_values(
        sources, per_content, "content_id", "copies", ["copies", "c"],
        spread_by=["path"], hot_rows=hot_rows,
    ))


def join_stored(sources: Bucketed, content: Bucketed) -> DataFrame:
    """``join_catalog`` of tables stored in as many buckets of the content id: neither is shuffled."""
    packed = content.regular.select("content_id", F.struct(*CONTENT_COLUMNS).alias("c"))
    return _shown(sources.with_group_values(lambda rows: copies(rows).join(packed.hint("merge"), "content_id", "left"), ["copies", "c"]))


def _shown(joined: DataFrame) -> DataFrame:
    accepted = F.col("source_status") == "accepted"
    known = F.col("c").isNotNull()
    masked = {
        "processing_status": F.when(accepted, F.col("c.processing_status")).otherwise(F.col("source_status")),
        "error": F.coalesce("source_error", "c.error"),
        "predicted_class": F.when(accepted, F.col("c.predicted_class")),
        "confidence": F.when(accepted, F.col("c.confidence")),
        "positive_score": F.when(accepted, F.col("c.positive_score")),
    }
    return joined.select(
        "path", "filename",
        F.coalesce("split", F.lit(S.EXTERNAL_SPLIT)).alias("split"),
        "label",
        F.when(known, F.col("content_id")).alias("content_id"),
        *[masked.get(c, F.col(f"c.{c}")).alias(c) for c in CONTENT_COLUMNS],
        F.coalesce("copies", F.lit(0)).alias("copies"),
    )


def add_outcomes(catalog: DataFrame) -> DataFrame:
    outcome = outcome_text(F.col("true_class"), F.col("predicted_class"))
    return (
        catalog.withColumn("true_class", normalize_label(F.col("label")))
        .withColumn("outcome", outcome)
        .withColumn("misclassified", F.col("outcome").isin("false positive", "false negative"))
    )


@dataclass(frozen=True)
class Filters:
    """Settings of the catalog view; the defaults pass everything."""

    search: str = ""
    statuses: Sequence[str] = ()
    classes: Sequence[str] = ()
    formats: Sequence[str] = ()
    splits: Sequence[str] = ()
    outcomes: Sequence[str] = ()
    min_confidence: float = 0.0
    include_unclassified: bool = True
    min_width: int = 0
    min_height: int = 0
    max_bytes: float | None = None
    only_duplicates: bool = False


def search(text: str) -> Column:
    """Case-insensitive literal substring of the file name or the path."""
    wanted = F.lower(F.lit(text))
    return F.contains(F.lower("filename"), wanted) | F.contains(F.lower("path"), wanted)


def filter_catalog(catalog: DataFrame, f: Filters) -> DataFrame:
    out = catalog
    if f.search:
        out = out.where(search(f.search))
    for setting, column in FACETS.items():
        if chosen := list(getattr(f, setting)):
            out = out.where(F.col(column).isin(chosen))
    enough = F.col("confidence") >= f.min_confidence
    out = out.where(enough | F.col("confidence").isNull() if f.include_unclassified else enough)
    out = out.where(
        (F.coalesce("width", F.lit(0)) >= f.min_width) & (F.coalesce("height", F.lit(0)) >= f.min_height)
    )
    if f.max_bytes is not None:
        out = out.where(F.col("file_size").isNull() | (F.col("file_size") <= f.max_bytes))
    if f.only_duplicates:
        out = out.where("copies > 1")
    return out


def sort_key(column: str, descending: bool = False) -> list[Column]:
    """NULLs last both ways; the path breaks ties."""
    if column not in SORT_COLUMNS:
        raise ValueError(f"sort column must be one of {SORT_COLUMNS}")
    key = F.col(column)
    return [key.desc_nulls_last() if descending else key.asc_nulls_last(), F.col("path").asc()]


def sort_catalog(catalog: DataFrame, column: str = "filename", descending: bool = False) -> DataFrame:
    return catalog.orderBy(*sort_key(column, descending))


def page(
    catalog: DataFrame, number: int, size: int, column: str = "filename", descending: bool = False,
    *, top_k_rows: int = TOP_K_ROWS,
) -> DataFrame:
    """Page ``number`` (clamped to 1..last) of ``size`` rows."""
    if size < 1:
        raise ValueError("size must be at least 1")
    pages = max(1, math.ceil(catalog.count() / size))
    number = min(max(1, number), pages)
    start = (number - 1) * size
    order = sort_key(column, descending)
    if start + size <= top_k_rows:
        return catalog.orderBy(*order).offset(start).limit(size)
    position = range_row_number(catalog, order, "_position")
    return position.where(F.col("_position").between(start + 1, start + size)).drop("_position")


def position_of(catalog: DataFrame, path: str, column: str = "filename", descending: bool = False) -> DataFrame:
    """0-based place of one path in the sorted catalog: a count, not a sort."""
    at = F.broadcast(  # path is unique: one row
        catalog.where(F.col("path") == path).select(F.col(column).alias("_v"), F.lit(1).alias("_one"))
    )
    key = F.col(column)
    earlier_value = key > F.col("_v") if descending else key < F.col("_v")
    earlier = (
        earlier_value
        | (F.col("_v").isNull() & key.isNotNull())
        | (key.eqNullSafe(F.col("_v")) & (F.col("path") < F.lit(path)))
    )
    return (
        catalog.withColumn("_one", F.lit(1)).join(at, "_one")
        .agg(F.count_if(F.coalesce(earlier, F.lit(False))).alias("position"),
             F.count_if(F.col("path") == path).alias("found"))
    )


def kpis(catalog: DataFrame) -> DataFrame:
    return catalog.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_distinct("content_id").alias("unique_contents"),
        F.count("predicted_class").alias("classified"),
        F.count_if(F.col("processing_status").isin(*NEED_ATTENTION)).alias("need_attention"),
    )


def facet_values(catalog: DataFrame) -> DataFrame:
    """Every value of every facet with its count, in one pass over the catalog."""
    pairs = F.array(*[
        F.struct(F.lit(facet).alias("facet"), F.col(column).alias("value")) for facet, column in FACETS.items()
    ])
    return (
        catalog.select(F.inline(pairs)).where("value is not null")
        .groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def value_distributions(catalog: DataFrame) -> DataFrame:
    pairs = F.array(
        F.struct(F.lit("predicted_class").alias("chart"),
                 F.coalesce("predicted_class", F.lit("unclassified")).alias("value")),
        F.struct(F.lit("processing_status").alias("chart"), F.col("processing_status").alias("value")),
    )
    return (
        catalog.select(F.inline(pairs)).where("value is not null")
        .groupBy("chart", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def catalog_stamp(catalog: DataFrame) -> DataFrame:
    """Row count and latest processing time: changes when the catalog does."""
    return catalog.agg(F.count(F.lit(1)).alias("records"), F.max("processed_at").alias("last_processed_at"))


def status_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy(F.col("processing_status").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def filtered_export(catalog: DataFrame) -> DataFrame:
    return catalog.select(*EXPORT_COLUMNS)


def field_value_rows(records: DataFrame, key: str, prefix: str = "") -> DataFrame:
    """Each record as (Field, Value) rows: readable names, six digits, a dash for nothing."""
    fields = []
    for f in records.schema.fields:
        value = F.col(f.name)
        text = value.cast("string")
        if f.dataType.typeName() in ("double", "float"):
            text = F.when(F.isnan(value), F.lit("")).otherwise(six_digits(value))
        shown = F.when(F.coalesce(text, F.lit("")) == "", F.lit("—")).otherwise(text)
        fields.append(F.struct(F.lit(prefix + f.name.replace("_", " ")).alias("field"), shown.alias("value")))
    return records.select(F.col(key).alias("record_key"), F.inline(F.array(*fields)))


def six_digits(value: Column) -> Column:
    """Six significant digits without trailing zeros; an exponent below 1e-4 and from 1e6."""
    text = F.format_string("%.6g", value)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+(e|$)", "$1$2"), r"\.(e|$)", "$1")
    infinite = F.when(value > 0, F.lit("inf")).otherwise(F.lit("-inf"))
    return F.when(value.isNull(), F.lit(None)).when(F.abs(value) == float("inf"), infinite).otherwise(short)


def json_fields(records: DataFrame, key: str, column: str, prefix: str = "EXIF ") -> DataFrame:
    """Entries of a JSON object string as (Field, Value) rows; bad JSON gives none."""
    entries = F.from_json(F.col(column), "map<string,string>")
    return records.select(F.col(key).alias("record_key"), F.explode(entries).alias("k", "v")).select(
        "record_key",
        F.concat(F.lit(prefix), F.replace(F.col("k"), F.lit("_"), F.lit(" "))).alias("field"),
        F.when(F.coalesce("v", F.lit("")) == "", F.lit("—")).otherwise(F.col("v")).alias("value"),
    )


def resolve_ids(metadata: DataFrame, selector: str, id_col: str = "record_id") -> tuple[DataFrame, DataFrame]:
    """Rows for one id, a comma list or ``all``, and the ids that do not exist.

    A list keeps the order of the request (column ``ordinal``) and collapses
    repeated ids; ``all`` is ordered by split and index.
    """
    wanted = selector.strip()
    if not wanted:
        raise ValueError("selector cannot be empty")
    spark = metadata.sparkSession
    empty = spark.createDataFrame([], f"{id_col} string")
    if wanted.lower() == "all":
        return metadata, empty
    parts = [part.strip() for part in wanted.split(",") if part.strip()]
    ids = list(dict.fromkeys(str(uuid.UUID(part)) for part in parts))  # a malformed id raises
    if not ids:
        raise ValueError("no ids were supplied")
    request = spark.createDataFrame(list(enumerate(ids)), f"ordinal int, {id_col} string")
    return select_ids(metadata, request, id_col)


def select_ids(metadata: DataFrame, request: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Requested rows with their ordinal, and requested ids without a row."""
    found = metadata.join(request, id_col)
    missing = request.join(metadata.select(id_col), id_col, "left_anti").select(id_col)
    return found, missing
