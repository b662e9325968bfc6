"""The given tables seen as labelled records, and the same views as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.identity import dataset_namespace, record_uuid
from sievemark.functions.labels import split_rank
from sievemark.functions.vectors import vector_hash
from sievemark.operators.catalog import add_outcomes, join_stored
from sievemark.operators.dedup import pool_splits
from sievemark.operators.ingest import Scorer, merge_content, merge_sources
from sievemark.operators.metadata import add_qc_fields, extract_metadata
from sievemark.operators.ranking import index_rank
from sievemark.session import materialize
from sievemark.sources.buckets import Bucketed, write_bucketed

WIDTH = HEIGHT = 8
NAMESPACE = dataset_namespace("sievemark:given")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- Vectors ---------------------------------------------------------------------

def samples(spark: SparkSession, folder: str, indexed: bool = False) -> DataFrame:
    """Embeddings as labelled vectors, hashed over every element."""
    e = table(spark, folder, "embeddings")
    last = F.col("vec_id") % 10
    rows = e.select(
        "vec_id",
        F.when(last < 7, "train").when(last == 7, "val").otherwise("test").alias("split"),
        (F.col("label") >= 5).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("vec"),
        vector_hash(F.col("embedding").cast("array<double>")).alias("content_hash"),
    )
    if not indexed:
        return rows
    ranked = index_rank(rows, ["split"], F.lit(0), "vec_id", "_position")
    return ranked.withColumn("split_index", F.col("_position") - 1).drop("_position")


SAMPLES_SQL = """
samples AS (
  SELECT vec_id,
         CASE WHEN vec_id % 10 < 7 THEN 'train' WHEN vec_id % 10 = 7 THEN 'val' ELSE 'test' END AS split,
         CAST(label >= 5 AS INTEGER) AS label,
         CAST(embedding AS DOUBLE[]) AS vec,
         sha256('float64:' || CAST(len(embedding) AS VARCHAR) || ':' || list_aggregate(list_transform(embedding,
           lambda e: CAST(CAST(floor(CAST(e AS DOUBLE) * 1099511627776) AS BIGINT) AS VARCHAR)), 'string_agg', ',')) AS content_hash
  FROM embeddings
),
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY split ORDER BY vec_id) - 1 AS split_index FROM samples
)
"""


def uuid_sql(split: str, index: str, digest: str) -> str:
    """Version-5 UUID text in SQL."""
    name = f"({split} || ':' || CAST({index} AS VARCHAR) || ':' || {digest})"
    raw = f"sha1(unhex('{NAMESPACE.hex}') || encode({name}))"
    return f"""(SELECT substr(r,1,8) || '-' || substr(r,9,4) || '-5' || substr(r,14,3) || '-'
        || translate(substr(r,17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(r,18,3) || '-'
        || substr(r,21,12) FROM (SELECT {raw} AS r) q)"""


def metadata(spark: SparkSession, folder: str) -> DataFrame:
    return extract_metadata(samples(spark, folder, indexed=True), WIDTH, HEIGHT, NAMESPACE)


def stored_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata as a written table: the vectors are read once, QC runs on narrow rows."""
    return materialize(metadata(spark, folder), "metadata")


def qc_metadata(spark: SparkSession, folder: str) -> DataFrame:
    return add_qc_fields(stored_metadata(spark, folder))


# Groups and flags over a view ``metadata``.
QC_SQL = """
groups AS (
  SELECT content_hash, count(*) AS duplicate_count, count(DISTINCT split) > 1 AS cross_split_duplicate_flag
  FROM metadata GROUP BY content_hash
),
qc AS (
  SELECT m.*, m.std_value <= (SELECT quantile_cont(std_value, 0.01) FROM metadata) AS low_variance_flag,
         g.duplicate_count, g.duplicate_count > 1 AS exact_duplicate_flag,
         g.cross_split_duplicate_flag
  FROM metadata m JOIN groups g USING (content_hash)
)
"""

METADATA_SQL = SAMPLES_SQL + f""",
metadata AS (
  SELECT {uuid_sql('split', 'split_index', 'content_hash')} AS record_id, split, split_index, label,
         8 AS width, 8 AS height,
         list_aggregate(vec, 'avg') AS mean_value, list_aggregate(vec, 'stddev_pop') AS std_value,
         list_aggregate(vec, 'min') AS min_value, list_aggregate(vec, 'max') AS max_value, content_hash
  FROM indexed
),
""" + QC_SQL


# --- Documents -------------------------------------------------------------------

def split_of_source(source: Column) -> Column:
    n = F.substring(source, 4, 10).cast("int") % 10
    return F.when(n < 7, "train").when(n == 7, "val").otherwise("test")


def docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as records with true exact copies; a missing label counts as 0."""
    labels = table(spark, folder, "labels")
    return (
        table(spark, folder, "documents").join(labels, "doc_id", "left")
        .select(
            "doc_id", split_of_source(F.col("source")).alias("split"), F.col("doc_id").alias("split_index"),
            F.coalesce("quality", F.lit(0)).alias("label"), F.col("n_chars"), "quality", "toxic",
            F.sha2(F.col("text"), 256).alias("content_hash"),
        )
        .withColumn("record_id", record_uuid(NAMESPACE, F.col("split"), F.col("split_index"), F.col("content_hash")))
    )


def pooled_docs(spark: SparkSession, folder: str, stored: DataFrame | None = None) -> DataFrame:
    """Documents as a pool, from their records where these are already written."""
    return pool_splits((docs(spark, folder) if stored is None else stored).select("split", "split_index", "label", "content_hash"))


# One record per hash of a view ``pooled``, without hashes whose labels disagree.
KEPT_SQL = """
dedup AS (
  SELECT *, count(*) OVER g AS copies, min(label) OVER g <> max(label) OVER g AS conflicting,
         row_number() OVER (PARTITION BY content_hash ORDER BY pool_rank, source_index) AS rn
  FROM pooled WINDOW g AS (PARTITION BY content_hash)
),
kept AS (
  SELECT source_split, source_index, pool_rank, label, content_hash FROM dedup WHERE rn = 1 AND NOT conflicting
)
"""

DOCS_SQL = f"""
docs AS (
  SELECT d.doc_id,
         CASE WHEN CAST(substr(source, 4) AS INTEGER) % 10 < 7 THEN 'train'
              WHEN CAST(substr(source, 4) AS INTEGER) % 10 = 7 THEN 'val' ELSE 'test' END AS split,
         d.doc_id AS split_index, coalesce(quality, 0) AS label, n_chars, quality, toxic, text,
         sha256(text) AS content_hash
  FROM documents d LEFT JOIN labels l USING (doc_id)
),
pooled AS (
  SELECT split AS source_split, split_index AS source_index, label, content_hash,
         CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS pool_rank
  FROM docs
),
""" + KEPT_SQL


def doc_qc(spark: SparkSession, folder: str) -> DataFrame:
    """Documents, which have true copies, with their length in place of a vector's statistics, and the QC columns."""
    length = F.col("n_chars").cast("double")
    rows = docs(spark, folder).select(
        "record_id", "split", "split_index", "label", length.alias("mean_value"), length.alias("std_value"), "content_hash"
    )
    return add_qc_fields(materialize(rows, "doc-metadata"))


DOC_QC_SQL = DOCS_SQL + f""",
metadata AS (
  SELECT {uuid_sql('split', 'split_index', 'content_hash')} AS record_id, split, split_index, label,
         CAST(n_chars AS DOUBLE) AS mean_value, CAST(n_chars AS DOUBLE) AS std_value, content_hash
  FROM docs
),
""" + QC_SQL


def scored(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with their length as a score: real ties, both classes."""
    return docs(spark, folder).where("quality is not null").select(
        "doc_id", "record_id", "split", "split_index", "content_hash",
        F.col("quality").alias("label"), F.col("n_chars").cast("double").alias("score"),
    )


SCORED_SQL = DOCS_SQL + """,
scored AS (
  SELECT doc_id, split, split_index, content_hash, quality AS label, CAST(n_chars AS DOUBLE) AS score
  FROM docs WHERE quality IS NOT NULL
)
"""


# --- Catalog ---------------------------------------------------------------------

SCORER_V1 = Scorer(lambda f: f[0] / F.lit(1000.0) - F.lit(2.0), 0.0, "margin", "v1")
SCORER_V2 = Scorer(lambda f: f[0] / F.lit(1000.0) - F.lit(1.0), 0.5, "margin", "v2")


def batch(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as an ingest batch; the digest decides what decoding gives."""
    d = docs(spark, folder)
    digit = F.substring("content_hash", 1, 1)
    hexed = lambda start: F.conv(F.substring("content_hash", start, 2), 16, 10).cast("long") + 16
    last = F.col("doc_id") % 10
    ext = F.when(last <= 6, ".png").when(last == 7, ".jpg").when(last == 8, ".tiff").otherwise(".txt")
    unreadable = F.col("doc_id") % 97 == 0
    broken = digit == "e"
    fmt = (
        F.when(digit.isin("b", "c"), "JPEG").when(digit == "d", "TIFF").when(digit == "f", "BMP")
        .when(~broken, "PNG")
    )
    good = ~unreadable & ~broken
    return d.select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.concat(F.lit("Doc"), F.col("doc_id").cast("string"), ext).alias("filename"),
        F.when(~unreadable, F.col("content_hash")).alias("content_id"),
        F.col("n_chars").alias("file_size"),
        F.when(good, fmt).alias("format"),
        F.when(good, hexed(2)).alias("width"),
        F.when(good, hexed(4)).alias("height"),
        F.when(good, F.lit("L")).alias("color_mode"),
        F.when(good, F.concat(F.lit('{"first_digit": "'), digit, F.lit('"}'))).alias("exif"),
        F.when(good, F.array(F.col("n_chars").cast("double"))).alias("features"),
        F.when(~unreadable & broken, F.lit("cannot identify image file")).alias("decode_error"),
        "split", F.col("quality").cast("long").alias("label"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id")).alias("seen_at"),
        F.when(unreadable, F.lit("unreadable")).alias("read_error"),
        "doc_id",
    )


def build_catalog(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(sources, content) after ingesting every document once with the first model.

    Each table is written before the next step reads it, as an ingest does.
    """
    rows = materialize(batch(spark, folder), "batch")
    content = materialize(
        merge_content(spark.createDataFrame([], S.CONTENT), rows, scorer=SCORER_V1), "content"
    )
    sources = materialize(merge_sources(spark.createDataFrame([], S.SOURCES), rows, content), "sources")
    return sources, content


_stored: dict[tuple, tuple[Bucketed, Bucketed]] = {}


def table_state(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """When the table's path last changed, its files and their bytes, as the file system tells without reading any of them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = store.getContentSummary(where)
    return store.getFileStatus(where).getModificationTime(), size.getFileCount(), size.getLength()


def catalog_tables(spark: SparkSession, folder: str) -> tuple[Bucketed, Bucketed]:
    """The stored catalog of a folder, ingested on first use in a session and again when its tables change.

    Sources and content lie in as many buckets of the content id. Browsing reads tables that an ingest left in the shared folder; ingest
    itself is what ``build_catalog`` and the ingest queries measure.
    """
    key = (spark.sparkContext.applicationId, folder, *(table_state(spark, f"{folder}/{name}.parquet") for name in ("documents", "labels")))
    if key not in _stored:
        _stored[key] = tuple(write_bucketed(df, "content_id") for df in build_catalog(spark, folder))
    return _stored[key]


def catalog(spark: SparkSession, folder: str) -> DataFrame:
    return add_outcomes(join_stored(*catalog_tables(spark, folder)))


BATCH_SQL = DOCS_SQL + """,
exts AS (
  SELECT *, CASE WHEN doc_id % 10 <= 6 THEN '.png' WHEN doc_id % 10 = 7 THEN '.jpg'
                 WHEN doc_id % 10 = 8 THEN '.tiff' ELSE '.txt' END AS ext,
         CASE WHEN doc_id % 10 <= 6 THEN 'PNG' WHEN doc_id % 10 = 7 THEN 'JPEG'
              WHEN doc_id % 10 = 8 THEN 'TIFF' END AS expected_format,
         substr(content_hash, 1, 1) AS digit, doc_id % 97 = 0 AS unreadable
  FROM docs
),
batch AS (
  SELECT doc_id, 'doc/' || doc_id || ext AS path, 'Doc' || doc_id || ext AS filename, expected_format,
         CASE WHEN NOT unreadable THEN content_hash END AS content_id, n_chars AS file_size,
         digit = 'e' AS broken,
         CASE WHEN digit = 'e' THEN NULL WHEN digit IN ('b', 'c') THEN 'JPEG' WHEN digit = 'd' THEN 'TIFF'
              WHEN digit = 'f' THEN 'BMP' ELSE 'PNG' END AS decoded_format,
         CAST('0x' || substr(content_hash, 2, 2) AS BIGINT) + 16 AS w,
         CAST('0x' || substr(content_hash, 4, 2) AS BIGINT) + 16 AS h, digit,
         split, CAST(quality AS BIGINT) AS label,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(doc_id) AS seen_at,
         CASE WHEN unreadable THEN 'failed' WHEN expected_format IS NULL THEN 'unsupported' ELSE 'accepted' END
           AS verdict
  FROM exts
)
"""

CATALOG_SQL = BATCH_SQL + """,
content AS (
  SELECT content_id, any_value(file_size) AS file_size, bool_or(verdict = 'accepted') AS extracted,
         bool_or(verdict = 'accepted' AND expected_format = decoded_format) AS valid,
         any_value(broken) AS broken, any_value(w) AS w, any_value(h) AS h, any_value(digit) AS digit,
         any_value(decoded_format) AS decoded_format
  FROM batch WHERE content_id IS NOT NULL GROUP BY content_id
),
state AS (
  SELECT content_id, file_size,
         CASE WHEN extracted AND NOT broken THEN decoded_format END AS format,
         CASE WHEN extracted AND NOT broken THEN w END AS width,
         CASE WHEN extracted AND NOT broken THEN h END AS height,
         CASE WHEN extracted AND NOT broken THEN 'L' END AS color_mode,
         CASE WHEN extracted AND NOT broken THEN '{"first_digit": "' || digit || '"}' END AS exif,
         CASE WHEN NOT extracted THEN 'unsupported' WHEN broken THEN 'failed'
              WHEN coalesce(valid, false) THEN 'complete' ELSE 'awaiting_model' END AS processing_status,
         CASE WHEN NOT extracted THEN 'Unsupported extension' WHEN broken THEN 'cannot identify image file' END AS error,
         CAST(extracted AS BIGINT) AS attempts, file_size / 1000.0 - 2.0 AS raw
  FROM content
),
scored_state AS (
  SELECT *, CASE WHEN processing_status = 'complete' THEN 1 / (1 + exp(-raw)) END AS positive_score,
         CASE WHEN processing_status = 'complete'
              THEN CASE WHEN raw >= 0 THEN 'pneumonia' ELSE 'normal' END END AS predicted_class,
         CASE WHEN processing_status = 'complete' THEN 'v1' END AS model_version
  FROM state
),
source_state AS (
  SELECT b.path, b.filename, b.content_id, b.split, CASE WHEN verdict <> 'failed' THEN b.label END AS label, b.seen_at,
         CASE WHEN verdict = 'accepted' AND s.format <> b.expected_format THEN 'unsupported' ELSE verdict END
           AS source_status,
         CASE WHEN verdict = 'failed' THEN 'unreadable'
              WHEN verdict = 'unsupported' THEN 'Unsupported extension'
              WHEN s.format <> b.expected_format THEN 'Extension does not match decoded format' END AS source_error
  FROM (SELECT * REPLACE (CASE WHEN verdict = 'failed' THEN 'external' ELSE split END AS split) FROM batch) b
  LEFT JOIN scored_state s USING (content_id)
),
joined AS (
  SELECT s.path, s.filename, s.split, s.label, c.content_id, c.file_size, c.format, c.width, c.height,
         c.width * 1.0 / c.height AS aspect_ratio, c.color_mode, c.width * c.height / 1000000.0 AS megapixels, c.exif,
         CASE WHEN source_status = 'accepted' THEN c.processing_status ELSE source_status END AS processing_status,
         coalesce(s.source_error, c.error) AS error,
         CASE WHEN source_status = 'accepted' THEN c.predicted_class END AS predicted_class,
         CASE WHEN source_status = 'accepted' THEN
           CASE WHEN c.predicted_class = 'pneumonia' THEN c.positive_score ELSE 1 - c.positive_score END END AS confidence,
         CASE WHEN source_status = 'accepted' THEN c.positive_score END AS positive_score,
         c.model_version, c.attempts,
         (SELECT count(*) FROM source_state d WHERE d.content_id = s.content_id) AS copies
  FROM source_state s LEFT JOIN scored_state c ON c.content_id = s.content_id
),
catalog AS (
  SELECT *, CASE WHEN true_class = predicted_class THEN 'correct'
                 WHEN predicted_class = 'pneumonia' AND true_class = 'normal' THEN 'false positive'
                 WHEN predicted_class = 'normal' AND true_class = 'pneumonia' THEN 'false negative'
                 ELSE 'unlabeled' END AS outcome
  FROM (SELECT *, CASE label WHEN 1 THEN 'pneumonia' WHEN 0 THEN 'normal' END AS true_class FROM joined) j
)
"""
