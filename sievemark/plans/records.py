"""Queries: reading, identities, derived columns and per-record rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions import identity, labels, vectors
from sievemark.functions.raster import gray_features
from sievemark.operators import checks, dedup
from sievemark.operators.catalog import field_value_rows, json_fields
from sievemark.operators.metadata import add_duplicate_flags, duplicate_peers
from sievemark.operators.ranking import index_rank
from sievemark.plans import given
from sievemark.plans.registry import query
from sievemark.session import scratch_path
from sievemark.sources import files, sinks, tables

SAMPLES = "WITH " + given.SAMPLES_SQL
METADATA = "WITH " + given.METADATA_SQL
DOCS = "WITH " + given.DOCS_SQL
SCORED = "WITH " + given.SCORED_SQL
CATALOG = "WITH " + given.CATALOG_SQL
BATCH = "WITH " + given.BATCH_SQL


# --- Sources -------------------------------------------------------------------

def _page_files(spark, folder: str) -> str:
    """Pages as a tree of JSON files below one folder per tenth of the pages."""
    path = scratch_path(spark, "pages")
    (
        given.table(spark, folder, "pages").select("page_id", "html", (F.col("page_id") % 10).alias("part"))
        .write.option("maxRecordsPerFile", 1000).partitionBy("part").json(path)
    )
    return path


@query("scan_file_tree", sql="""
SELECT page_id, length(html) AS chars, 'json' AS extension FROM pages
""")
def scan_file_tree(spark, folder):
    found = files.scan_file_tree(spark, _page_files(spark, folder)).where(F.col("filename").endswith(".json"))
    lines = found.select("filename", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    page = F.from_json("line", "page_id bigint, html string")
    return lines.where("line <> ''").select(
        page["page_id"].alias("page_id"), F.length(page["html"]).cast("long").alias("chars"),
        F.element_at(F.split("filename", r"\."), -1).alias("extension"),
    )


@query("scan_bounded", sql="""
SELECT 0 AS failed_with_content, count(*) AS pages, CAST(sum(length(html)) AS BIGINT) AS chars FROM pages
""")
def scan_bounded(spark, folder):
    found = files.scan_bounded(spark, _page_files(spark, folder))
    lines = found.where("read_error is null and filename like '%.json'").select(
        F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line")
    )
    read = lines.where("line <> ''").select(F.from_json("line", "page_id bigint, html string").alias("p"))
    failed = found.where("read_error is not null").agg(
        F.count("content").cast("int").alias("failed_with_content")
    ).withColumn("_one", F.lit(1))
    totals = read.agg(
        F.count(F.lit(1)).alias("pages"), F.sum(F.length("p.html")).cast("long").alias("chars")
    ).withColumn("_one", F.lit(1))
    return failed.join(totals, "_one").drop("_one")


@query("scan_decoded_images", sql="""
SELECT DISTINCT CAST(page_id % 10 AS INTEGER) AS part, true AS without_size, 'cannot identify image file' AS decode_error FROM pages
""")
def scan_decoded_images(spark, folder):
    """Files that are no images stay in the result as failed rows."""
    found = files.scan_decoded_images(spark, _page_files(spark, folder))
    part = F.regexp_extract("path", "part=([0-9]+)/", 1).cast("int")
    return found.select(
        part.alias("part"), (F.col("width").isNull() & F.col("height").isNull()).alias("without_size"), "decode_error"
    ).distinct()


def _axis_sql(name: str, cells: str, size: int) -> str:
    """Shares of old cells in ``size`` new ones, per old number of cells."""
    return f"""
{name} AS (
  SELECT before, after, cell, share / sum(share) OVER (PARTITION BY before, after) AS share FROM (
    SELECT before, after, cell, greatest(0, 1 - abs(cell + 0.5 - (after + 0.5) * before / {size}.0) / greatest(before / {size}.0, 1)) AS share
    FROM (SELECT DISTINCT {cells} AS before FROM pictures) b, (SELECT unnest(range({size})) AS after) a, (SELECT unnest(range(40)) AS cell) c
    WHERE cell < before
  ) q WHERE share > 0
)"""


@query("resampled_features", sql="""
WITH pictures AS (
  SELECT vec_id, 9 + vec_id % 31 AS width, 7 + vec_id % 23 AS height, CASE vec_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 4 END AS channels, embedding
  FROM embeddings
),
samples AS (
  SELECT vec_id, width, height, channels, i, CAST(floor(abs(CAST(embedding[i % 64 + 1] AS DOUBLE)) * 1024) AS BIGINT) + i * 7 AS v
  FROM pictures, (SELECT unnest(range(39 * 29 * 4)) AS i) q WHERE i < width * height * channels
),
pixels AS (
  SELECT vec_id, width, height, (i // channels) // width AS r, (i // channels) % width AS c,
         CASE WHEN any_value(channels) = 1 THEN max(v % 256)
              ELSE (sum((v % 256) * CASE i % channels WHEN 2 THEN 19595 WHEN 1 THEN 38470 WHEN 0 THEN 7471 ELSE 0 END) + 32768) // 65536 END AS g
  FROM samples GROUP BY vec_id, width, height, channels, i // channels
),""" + _axis_sql("across", "width", 28) + "," + _axis_sql("down", "height", 28) + """,
wide AS (
  SELECT vec_id, height, r, after AS x, floor(sum(g * share) + 0.5 + 1e-9) AS g
  FROM pixels JOIN across ON before = width AND cell = c GROUP BY vec_id, height, r, after
),
done AS (
  SELECT vec_id, after * 28 + x AS position, floor(sum(g * share) + 0.5 + 1e-9) AS g
  FROM wide JOIN down ON before = height AND cell = r GROUP BY vec_id, after, x
)
SELECT vec_id, CAST(position AS INTEGER) AS position, CAST(g AS INTEGER) AS intensity FROM done
""")
def resampled_features(spark, folder):
    """Pictures of many sizes, gray and in colour, made of the vectors' digits: every intensity at the model's size."""
    width, height = 9 + F.col("vec_id") % 31, 7 + F.col("vec_id") % 23
    channels = F.element_at(F.array(F.lit(1), F.lit(3), F.lit(4)), (F.col("vec_id") % 3 + 1).cast("int"))
    sized = given.table(spark, folder, "embeddings").select("vec_id", "embedding", width.alias("width"), height.alias("height"), channels.alias("channels"))
    places = F.sequence(F.lit(0).cast("long"), F.col("width") * F.col("height") * F.col("channels") - 1)
    value = lambda i: F.floor(F.abs(F.get("embedding", (i % 64).cast("int")).cast("double")) * 1024) + i * 7
    pixels = F.unhex(F.array_join(F.transform(places, lambda i: F.lpad(F.hex(F.pmod(value(i), F.lit(256))), 2, "0")), ""))
    pictures = sized.select("vec_id", "width", "height", "channels", pixels.alias("pixels"))
    features = gray_features(F.col("width"), F.col("height"), F.col("channels"), F.col("pixels"), 28, 28)
    return pictures.select("vec_id", F.posexplode(features).alias("position", "intensity")).withColumn("intensity", F.col("intensity").cast("int"))


@query("scan_labeled_samples", sql=SAMPLES + """
SELECT split, split_index, CAST(label AS BIGINT) AS label, len(vec) AS features, round(list_aggregate(vec, 'sum'), 6) AS total
FROM indexed WHERE split = 'val'
""")
def scan_labeled_samples(spark, folder):
    path = scratch_path(spark, "samples")
    given.samples(spark, folder, indexed=True).select(
        "split", "split_index", F.col("label").cast("long").alias("label"), "vec"
    ).write.partitionBy("split").parquet(path)
    return tables.scan_labeled_samples(spark, path, "val").select(
        "split", "split_index", "label", F.size("vec").cast("long").alias("features"),
        F.round(vectors.vec_sum(F.col("vec")), 6).alias("total"),
    )


@query("pool_splits", sql=DOCS + """
SELECT source_split, source_index, label, content_hash, pool_rank FROM pooled
""")
def pool_splits(spark, folder):
    d = given.docs(spark, folder).select("split", "split_index", "label", "content_hash")
    parts = [d.where(F.col("split") == s) for s in S.MODEL_SPLITS]
    return dedup.pool_splits(*parts).select("source_split", "source_index", "label", "content_hash", "pool_rank")


@query("lookup_sample", sql=SAMPLES + """
SELECT vec_id, split, split_index, label FROM indexed WHERE split = 'test' AND split_index = 5
""")
def lookup_sample(spark, folder):
    found = tables.lookup_sample(given.samples(spark, folder, indexed=True), "test", 5)
    return found.select("vec_id", "split", "split_index", "label")


@query("sink_metadata_table", sql=METADATA + """
SELECT record_id, split, split_index, label, width, height, round(mean_value, 6) AS mean_value,
       round(std_value, 6) AS std_value, content_hash, low_variance_flag, duplicate_count,
       cross_split_duplicate_flag FROM qc
""")
def sink_metadata_table(spark, folder):
    stored = sinks.sink_metadata_table(given.qc_metadata(spark, folder), scratch_path(spark, "metadata"))
    return stored.select(
        "record_id", "split", "split_index", "label", F.col("width").cast("int").alias("width"),
        F.col("height").cast("int").alias("height"), F.round("mean_value", 6).alias("mean_value"),
        F.round("std_value", 6).alias("std_value"), "content_hash", "low_variance_flag", "duplicate_count",
        "cross_split_duplicate_flag",
    )


@query("sink_ordered_csv", sql=METADATA + """
SELECT record_id, split, CAST(split_index AS VARCHAR) AS split_index, CAST(label AS VARCHAR) AS label, content_hash,
       row_number() OVER (ORDER BY CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END, split_index) AS line
FROM metadata
""")
def sink_ordered_csv(spark, folder):
    table, csv = scratch_path(spark, "metadata"), scratch_path(spark, "csv")
    rows = given.metadata(spark, folder).select("record_id", "split", "split_index", "label", "content_hash")
    sinks.sink_metadata_table(rows, table)
    sinks.sink_ordered_csv(table, csv, spark)
    written = spark.read.option("header", True).csv(csv)
    keyed = written.withColumn("_i", F.col("split_index").cast("long"))
    return index_rank(keyed, [], labels.split_rank(F.col("split")), "_i", "line").select(
        "record_id", "split", "split_index", "label", "content_hash", "line"
    )


# --- Identities ----------------------------------------------------------------

@query("content_hash", sql="""
SELECT doc_id, sha256(encode('uint8') || encode('(' || CAST(octet_length(encode(text)) AS VARCHAR) || ',)') || encode(text)) AS content_hash
FROM documents
""")
def content_hash(spark, folder):
    text = F.encode("text", "UTF-8")
    shape = F.concat(F.lit("("), F.octet_length(text).cast("string"), F.lit(",)"))
    return given.table(spark, folder, "documents").select(
        "doc_id", identity.content_hash("uint8", shape, text).alias("content_hash")
    )


@query("file_digest", sql="SELECT page_id, sha256(html) AS content_id FROM pages")
def file_digest(spark, folder):
    return given.table(spark, folder, "pages").select(
        "page_id", identity.file_digest(F.col("html")).alias("content_id")
    )


@query("record_uuid", sql=DOCS + f"""
SELECT doc_id, {given.uuid_sql('split', 'split_index', 'content_hash')} AS record_id FROM docs
""")
def record_uuid(spark, folder):
    return given.docs(spark, folder).select("doc_id", "record_id")


@query("short_id", sql="SELECT doc_id, substr(sha256(text), 1, 8) AS short_id FROM documents")
def short_id(spark, folder):
    return given.table(spark, folder, "documents").select(
        "doc_id", identity.short_id(identity.file_digest(F.col("text"))).alias("short_id")
    )


@query("path_key", sql="SELECT page_id, substr(sha256(url), 1, 16) AS path_key FROM pages")
def path_key(spark, folder):
    return given.table(spark, folder, "pages").select(
        "page_id", identity.path_key(F.col("url")).alias("path_key")
    )


# --- Vectors and labels --------------------------------------------------------

@query("vector_stats", sql=METADATA + """
SELECT record_id, width, height, round(mean_value, 6) AS mean_value, round(std_value, 6) AS std_value,
       round(min_value, 6) AS min_value, round(max_value, 6) AS max_value FROM metadata
""")
def vector_stats(spark, folder):
    m = given.metadata(spark, folder)
    return m.select(
        "record_id", F.col("width").cast("int").alias("width"), F.col("height").cast("int").alias("height"),
        *[F.round(c, 6).alias(c) for c in ("mean_value", "std_value", "min_value", "max_value")],
    )


@query("to_gray2d", sql=SAMPLES + "SELECT vec_id FROM samples WHERE vec_id % 7 = 0 OR vec_id % 11 = 0 OR vec_id % 13 = 0")
def to_gray2d(spark, folder):
    """Every 7th vector is one element short, every 11th has a NaN and every 13th is missing."""
    size = given.WIDTH * given.HEIGHT
    i = F.col("vec_id")
    vec = (
        F.when(i % 7 == 0, F.slice("vec", 1, size - 1))
        .when(i % 11 == 0, F.concat(F.slice("vec", 1, size - 1), F.array(F.lit(float("nan")))))
        .when(i % 13 != 0, F.col("vec"))
    )
    return checks.check_vectors(given.samples(spark, folder).withColumn("vec", vec), size).select("vec_id")


@query("flatten_features", sql=SAMPLES + """
SELECT vec_id, generate_subscripts(vec, 1) - 1 AS feature, round(CAST(CAST(unnest(vec) AS FLOAT) AS DOUBLE), 6) AS value FROM samples
""")
def flatten_features(spark, folder):
    flat = given.samples(spark, folder).select("vec_id", F.col("vec").cast("array<float>").alias("vec"))
    return flat.select("vec_id", F.posexplode("vec").alias("feature", "v")).select(
        "vec_id", F.col("feature").cast("long").alias("feature"), F.round(F.col("v").cast("double"), 6).alias("value")
    )


@query("class_name", sql="""
SELECT doc_id, CASE WHEN quality = 0 THEN 'normal' WHEN quality = 1 THEN 'pneumonia' END AS class_name
FROM documents LEFT JOIN labels USING (doc_id)
""")
def class_name(spark, folder):
    return given.docs(spark, folder).select("doc_id", labels.class_name(F.col("quality")).alias("class_name"))


@query("split_rank", sql=CATALOG + """
SELECT path, CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 WHEN 'test' THEN 3 ELSE 99 END AS split_rank,
       CASE split WHEN 'train' THEN 0 WHEN 'val' THEN 1 WHEN 'test' THEN 3 WHEN 'external' THEN 5 ELSE 99 END AS menu_rank
FROM catalog
""")
def split_rank(spark, folder):
    return given.catalog(spark, folder).select(
        "path", labels.split_rank(F.col("split")).alias("split_rank"), labels.menu_rank(F.col("split")).alias("menu_rank")
    )


@query("normalize_label", sql="""
SELECT event_id, CASE
    WHEN lower(trim(raw)) IN ('1', '1.0', 'pneumonia', 'positive', 'true') THEN 'pneumonia'
    WHEN lower(trim(raw)) IN ('0', '0.0', 'normal', 'negative', 'false') THEN 'normal'
    ELSE nullif(lower(trim(raw)), '') END AS true_class
FROM (SELECT event_id, CASE event_id % 9 WHEN 0 THEN ' 1' WHEN 1 THEN '0.0' WHEN 2 THEN 'Positive' WHEN 3 THEN 'FALSE'
             WHEN 4 THEN '  ' WHEN 5 THEN NULL WHEN 6 THEN 'Normal ' ELSE upper(event_type) END AS raw FROM events) e
""")
def normalize_label(spark, folder):
    kind = F.col("event_id") % 9
    raw = F.upper("event_type")
    for number, text in ((0, " 1"), (1, "0.0"), (2, "Positive"), (3, "FALSE"), (4, "  "), (5, None), (6, "Normal ")):
        raw = F.when(kind == number, F.lit(text).cast("string")).otherwise(raw)
    return given.table(spark, folder, "events").select("event_id", labels.normalize_label(raw).alias("true_class"))


@query("geometry_columns", sql=BATCH + """
SELECT doc_id, round(w * 1.0 / h, 9) AS aspect_ratio, round(CAST(w AS DOUBLE) * h / 1000000, 9) AS megapixels
FROM batch WHERE content_id IS NOT NULL AND NOT broken
""")
def geometry_columns(spark, folder):
    geo = labels.geometry(F.col("width"), F.col("height"))
    return given.batch(spark, folder).where("width is not null").select(
        "doc_id", *[F.round(c, 9).alias(n) for n, c in geo.items()]
    )


@query("outcome_cell", sql="""
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 1 THEN 'TP' WHEN quality = 0 AND toxic = 0 THEN 'TN'
                    WHEN quality = 0 AND toxic = 1 THEN 'FP' WHEN quality = 1 AND toxic = 0 THEN 'FN' ELSE '' END AS outcome
FROM documents LEFT JOIN labels USING (doc_id)
""")
def outcome_cell(spark, folder):
    return given.docs(spark, folder).select(
        "doc_id", labels.outcome_cell(F.col("quality"), F.col("toxic")).alias("outcome")
    )


@query("outcome_text", sql=CATALOG + """
SELECT path, true_class, outcome, outcome IN ('false positive', 'false negative') AS misclassified FROM catalog
""")
def outcome_text(spark, folder):
    return given.catalog(spark, folder).select("path", "true_class", "outcome", "misclassified")


@query("sigmoid_score", sql="""
SELECT doc_id, round(1 / (1 + exp(-(n_chars / 1000.0 - 2.0))), 9) AS score,
       CASE WHEN n_chars / 1000.0 - 2.0 >= 0.5 THEN 'pneumonia' ELSE 'normal' END AS predicted_class FROM documents
""")
def sigmoid_score(spark, folder):
    raw = F.col("n_chars") / F.lit(1000.0) - F.lit(2.0)
    out = labels.score_and_decide(raw, F.lit(0.5), "margin")
    return given.table(spark, folder, "documents").select(
        "doc_id", F.round(out["positive_score"], 9).alias("score"), out["predicted_class"].alias("predicted_class")
    )


@query("confidence", sql="""
SELECT doc_id, round(CASE WHEN raw >= 0.5 THEN s ELSE 1 - s END, 9) AS confidence
FROM (SELECT doc_id, raw, 1 / (1 + exp(-raw)) AS s
      FROM (SELECT doc_id, n_chars / 1000.0 - 2.0 AS raw FROM documents) a) b
""")
def confidence(spark, folder):
    raw = F.col("n_chars") / F.lit(1000.0) - F.lit(2.0)
    out = labels.score_and_decide(raw, F.lit(0.5), "margin")
    return given.table(spark, folder, "documents").select("doc_id", F.round(out["confidence"], 9).alias("confidence"))


@query("model_version", sql=SCORED + """
SELECT split, sha256('length' || CAST(count(*) AS VARCHAR) || CAST(CAST(max(score) AS BIGINT) AS VARCHAR)) AS model_version
FROM scored GROUP BY split
""")
def model_version(spark, folder):
    per_split = given.scored(spark, folder).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").cast("long").alias("top")
    )
    return per_split.select("split", identity.model_version(F.lit("length"), F.col("n"), F.col("top")).alias("model_version"))


@query("field_value_rows", sql=CATALOG + """
SELECT path AS record_key, unnest(['filename', 'file size', 'width', 'error', 'megapixels', 'tiny', 'huge']) AS field,
       unnest([filename, coalesce(CAST(file_size AS VARCHAR), '—'), coalesce(CAST(width AS VARCHAR), '—'),
               coalesce(error, '—'), coalesce(printf('%.6g', CAST(megapixels AS DOUBLE)), '—'),
               coalesce(printf('%.6g', CAST(width AS DOUBLE) / 9999991), '—'),
               coalesce(printf('%.6g', CAST(file_size AS DOUBLE) * 1234567.1), '—')]) AS value FROM catalog
""")
def field_value_rows_query(spark, folder):
    shown = given.catalog(spark, folder).select(
        "path", "filename", "file_size", "width", "error", "megapixels",
        (F.col("width").cast("double") / F.lit(9999991.0)).alias("tiny"),
        (F.col("file_size").cast("double") * F.lit(1234567.1)).alias("huge"),
    )
    return field_value_rows(shown, "path").where("field <> 'path'")


@query("json_flatten", sql="""
SELECT event_id AS record_key, 'EXIF k' AS field, json_extract_string(props, '$.k') AS value FROM events
WHERE json_extract_string(props, '$.k') IS NOT NULL
""")
def json_flatten(spark, folder):
    return json_fields(given.table(spark, folder, "events"), "event_id", "props")


# --- Rules ---------------------------------------------------------------------

@query("check_labels", sql="SELECT vec_id, label FROM embeddings WHERE label NOT IN (0, 1)")
def check_labels(spark, folder):
    return checks.check_labels(given.table(spark, folder, "embeddings")).select("vec_id", "label")


@query("check_dimensions", sql=BATCH + """
SELECT path FROM batch WHERE (doc_id % 3 = 0 AND (content_id IS NULL OR broken OR w <> 100))
                         OR (doc_id % 5 = 0 AND (content_id IS NULL OR broken OR h <> 100))
""")
def check_dimensions(spark, folder):
    """Documents resized to 100 x 100, but every 3rd kept its width and every 5th its height."""
    i = F.col("doc_id")
    rows = given.batch(spark, folder).withColumns({
        "width": F.when(i % 3 == 0, F.col("width")).otherwise(100),
        "height": F.when(i % 5 == 0, F.col("height")).otherwise(100),
    })
    return checks.check_dimensions(rows, 100, 100).select("path")


@query("check_missing_nonfinite", sql="""
SELECT 'quality' AS column_name, count(*) AS missing, CAST(0 AS BIGINT) AS nonfinite
FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL HAVING count(*) > 0
UNION ALL
SELECT 'toxic', count(*), 0 FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL HAVING count(*) > 0
""")
def check_missing_nonfinite(spark, folder):
    return checks.check_missing_nonfinite(given.docs(spark, folder))


@query("check_row_schema", sql=METADATA + """
SELECT record_id, concat_ws(',', CASE WHEN split_index % 17 = 0 THEN 'width' END,
                            CASE WHEN split_index % 13 = 0 THEN 'std_value' END,
                            CASE WHEN split_index % 11 = 0 THEN 'content_hash' END) AS broken_rules
FROM metadata WHERE split_index % 17 = 0 OR split_index % 13 = 0 OR split_index % 11 = 0
""")
def check_row_schema(spark, folder):
    return checks.check_row_schema(spoiled_metadata(spark, folder))


def spoiled_metadata(spark, folder):
    """Every 17th row lost its width, every 13th has a negative deviation, every 11th an upper-case hash."""
    i = F.col("split_index")
    return given.stored_metadata(spark, folder).withColumns({
        "width": F.when(i % 17 != 0, F.col("width")),
        "std_value": F.when(i % 13 == 0, -F.col("std_value") - 1).otherwise(F.col("std_value")),
        "content_hash": F.when(i % 11 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")),
    })


@query("rules_while_writing", sql=METADATA + """,
counted AS (
  SELECT count(*) FILTER (WHERE split_index % 17 = 0) AS width, count(*) FILTER (WHERE split_index % 13 = 0) AS std_value,
         count(*) FILTER (WHERE split_index % 11 = 0) AS content_hash FROM metadata
)
SELECT rule, coalesce(n, 0) AS counted, coalesce(n, 0) AS listed FROM (VALUES ('split'), ('split_index'), ('label'), ('width'), ('height'), ('mean_value'),
  ('std_value'), ('min_value'), ('max_value'), ('content_hash')) r(rule)
LEFT JOIN (SELECT unnest(['width', 'std_value', 'content_hash']) AS rule, unnest([width, std_value, content_hash]) AS n FROM counted) c USING (rule)
""")
def rules_while_writing(spark, folder):
    """Rows that break each rule: counted by the write itself, and listed from what was written."""
    path = scratch_path(spark, "checked")
    counted = checks.write_checked(spoiled_metadata(spark, folder), path)
    broken = checks.broken_rows(spark.read.parquet(path), counted)
    listed = broken.select(F.explode("broken_rules").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("listed"))
    rules = spark.createDataFrame(list(counted.items()), "rule string, counted long")      # one row a rule
    return rules.join(listed, "rule", "left").select("rule", "counted", F.coalesce("listed", F.lit(0)).cast("long").alias("listed"))


@query("check_peer_ids", sql=DOCS + f""",
rows AS (
  SELECT {given.uuid_sql('split', 'split_index', 'content_hash')} AS record_id, doc_id, content_hash,
         count(*) OVER (PARTITION BY content_hash) AS n,
         count(*) FILTER (WHERE doc_id % 7 <> 0) OVER (PARTITION BY content_hash)
           + count(*) FILTER (WHERE doc_id % 11 = 0 AND doc_id % 7 <> 0) OVER (PARTITION BY content_hash) AS listed
  FROM docs
)
SELECT content_hash, record_id, CASE WHEN doc_id % 7 = 0 THEN 'own id missing' ELSE 'repeated peer' END AS problem
FROM rows WHERE n > 1 AND (doc_id % 7 = 0 OR doc_id % 11 = 0)
UNION ALL SELECT DISTINCT content_hash, NULL, 'wrong number of peers' FROM rows WHERE n > 1 AND listed <> n
""")
def check_peer_ids(spark, folder):
    """Document groups whose member table lost every 7th document and lists every 11th twice."""
    rows = add_duplicate_flags(given.docs(spark, folder))
    peers = duplicate_peers(given.docs(spark, folder)).join(
        rows.select(F.col("record_id").alias("peer_id"), "split_index"), "peer_id")
    kept = peers.where("split_index % 7 <> 0")
    return checks.check_peer_ids(rows, kept.unionByName(kept.where("split_index % 11 = 0")))


@query("check_lengths", sql=DOCS + """
SELECT split, count(*) AS vectors, count(quality) AS labels FROM docs GROUP BY split HAVING count(*) <> count(quality)
""")
def check_lengths(spark, folder):
    d = given.docs(spark, folder)
    return checks.check_lengths(d, d.where("quality is not null"))


@query("check_scores", sql=CATALOG + """
SELECT path FROM catalog WHERE positive_score IS NULL OR positive_score < 0 OR positive_score > 1
""")
def check_scores(spark, folder):
    return checks.check_scores(given.catalog(spark, folder)).select("path")


@query("check_one_to_one", sql="SELECT text, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def check_one_to_one(spark, folder):
    return checks.check_unique(given.table(spark, folder, "documents"), ["text"])


@query("missing_required", sql="""
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""")
def missing_required(spark, folder):
    return checks.missing_required(
        given.table(spark, folder, "documents"), given.table(spark, folder, "labels"), "doc_id"
    )
