"""Queries: ingest merges and the browsable catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.operators import catalog, checks, ingest, sketches, tiles
from sievemark.operators.ranking import range_row_number
from sievemark.plans import given
from sievemark.plans.curation import ASSIGNED_SQL, assigned_docs
from sievemark.plans.registry import query
from sievemark.session import materialize, scratch_path
from sievemark.sources import sinks
from sievemark.sources.buckets import upsert_bucketed, write_bucketed
from sievemark.streaming.ingest import CatalogStore, stream_ingest

CATALOG = "WITH " + given.CATALOG_SQL
BATCH = "WITH " + given.BATCH_SQL
SHOWN = "path, filename, split, processing_status"


def empty(spark, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


# --- Filters -------------------------------------------------------------------

def filtered(name: str, where: str, settings: dict) -> None:
    filters = catalog.Filters(**settings)

    @query(name, sql=CATALOG + f"SELECT {SHOWN} FROM catalog WHERE {where}")
    def run(spark, folder):
        return catalog.filter_catalog(given.catalog(spark, folder), filters).select(*SHOWN.split(", "))


filtered("catalog_search", "lower(filename) LIKE '%doc1%' OR lower(path) LIKE '%doc1%'", {"search": "dOC1"})
filtered(
    "catalog_facets",
    "processing_status IN ('complete', 'awaiting_model') AND predicted_class IN ('normal') AND format IN ('PNG')"
    " AND split IN ('train', 'test') AND outcome IN ('correct', 'unlabeled')",
    {"statuses": ["complete", "awaiting_model"], "classes": ["normal"], "formats": ["PNG"],
     "splits": ["train", "test"], "outcomes": ["correct", "unlabeled"]},
)
filtered("min_confidence", "confidence >= 0.75", {"min_confidence": 0.75, "include_unclassified": False})
filtered("min_dimensions", "coalesce(width, 0) >= 100 AND coalesce(height, 0) >= 50", {"min_width": 100, "min_height": 50})
filtered("max_size", "file_size IS NULL OR file_size <= 2000", {"max_bytes": 2000})
filtered("only_duplicates", "copies > 1", {"only_duplicates": True})


@query("need_attention", sql=CATALOG + """
SELECT processing_status, count(*) AS n FROM catalog
WHERE processing_status IN ('failed', 'model_error', 'unsupported') GROUP BY processing_status
""")
def need_attention(spark, folder):
    rows = given.catalog(spark, folder).where(F.col("processing_status").isin(*catalog.NEED_ATTENTION))
    return rows.groupBy("processing_status").agg(F.count(F.lit(1)).alias("n"))


DOC_IDS = "WITH " + given.DOCS_SQL + f""",
docs_ids AS (SELECT doc_id, split, split_index, {given.uuid_sql('split', 'split_index', 'content_hash')} AS record_id FROM docs)
"""


@query("resolve_ids", sql=DOC_IDS + """
SELECT doc_id, record_id, first_seen AS ordinal FROM docs_ids JOIN (
  SELECT record_id, min(item_id) AS first_seen FROM benchmark b JOIN docs_ids d ON d.doc_id = b.item_id * 3 GROUP BY record_id) f
USING (record_id)
""")
def resolve_ids(spark, folder):
    """Request one record per benchmark item, in item order, by its id."""
    rows = given.docs(spark, folder)
    items = given.table(spark, folder, "benchmark").select((F.col("item_id") * 3).alias("doc_id"), "item_id")
    request = rows.join(items, "doc_id").groupBy("record_id").agg(F.min("item_id").alias("ordinal"))
    found, _ = catalog.select_ids(rows, request, "record_id")
    return found.select("doc_id", "record_id", "ordinal")


@query("semi_id_set", sql="""
SELECT doc_id, sha256(text) AS content_hash FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)
""")
def semi_id_set(spark, folder):
    wanted = given.table(spark, folder, "labels").where("toxic = 1").select("doc_id")
    return given.docs(spark, folder).join(wanted, "doc_id", "left_semi").select("doc_id", "content_hash")


@query("anti_missing", sql="SELECT item_id AS doc_id FROM benchmark WHERE item_id NOT IN (SELECT doc_id FROM labels)")
def anti_missing(spark, folder):
    wanted = given.table(spark, folder, "benchmark").select(F.col("item_id").alias("doc_id"))
    return checks.missing_required(wanted, given.table(spark, folder, "labels"), "doc_id")


# --- Catalog views -------------------------------------------------------------

@query("join_catalog", sql=CATALOG + """
SELECT path, filename, split, label, content_id, file_size, format, width, height, round(aspect_ratio, 6) AS aspect_ratio,
       color_mode, round(megapixels, 6) AS megapixels, exif, processing_status, error, predicted_class,
       round(confidence, 9) AS confidence, round(positive_score, 9) AS positive_score, model_version, attempts, copies
FROM catalog
""")
def join_catalog(spark, folder):
    out = catalog.join_stored(*given.catalog_tables(spark, folder)).drop("processed_at", "pipeline_version")
    digits = {"aspect_ratio": 6, "megapixels": 6, "confidence": 9, "positive_score": 9}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query("copies", sql=CATALOG + "SELECT path, copies FROM catalog")
def copies(spark, folder):
    return given.catalog(spark, folder).select("path", "copies")


@query("join_assigned_split", sql=ASSIGNED_SQL + """
SELECT d.split, d.split_index, coalesce(a.assigned_split, 'excluded') AS assigned_split
FROM docs d LEFT JOIN assigned a ON a.source_split = d.split AND a.source_index = d.split_index
""")
def join_assigned_split(spark, folder):
    rows = ingest.assign_catalog_split(given.docs(spark, folder), assigned_docs(spark, folder))
    return rows.select("split", "split_index", "assigned_split")


@query("catalog_sort", sql=CATALOG + """
SELECT path, confidence IS NULL AS unscored, row_number() OVER (ORDER BY round(confidence, 9) DESC NULLS LAST, path) AS position
FROM catalog
""")
def catalog_sort(spark, folder):
    rows = given.catalog(spark, folder).select("path", F.round("confidence", 9).alias("confidence"))
    ordered = range_row_number(rows, catalog.sort_key("confidence", descending=True), "position")
    return ordered.select("path", F.col("confidence").isNull().alias("unscored"), "position")


@query("page", sql=CATALOG + """
SELECT path, filename, file_size FROM catalog ORDER BY file_size DESC NULLS LAST, path LIMIT 24 OFFSET 48
""")
def page(spark, folder):
    return catalog.page(given.catalog(spark, folder), 3, 24, "file_size", descending=True).select(
        "path", "filename", "file_size"
    )


@query("position_of", sql=CATALOG + """
SELECT pos AS position, CAST(1 AS BIGINT) AS found
FROM (SELECT path, row_number() OVER (ORDER BY file_size NULLS LAST, path) - 1 AS pos FROM catalog) x WHERE path = 'doc/100.png'
""")
def position_of(spark, folder):
    return catalog.position_of(given.catalog(spark, folder), "doc/100.png", "file_size")


@query("kpi_tiles", sql=CATALOG + """
SELECT count(*) AS records, count(DISTINCT content_id) AS unique_contents, count(predicted_class) AS classified,
       count(*) FILTER (WHERE processing_status IN ('failed', 'model_error', 'unsupported')) AS need_attention FROM catalog
""")
def kpi_tiles(spark, folder):
    return catalog.kpis(given.catalog(spark, folder))


# The catalog once every due content has the second model's score.
RESCORED = (
    CATALOG.replace("WHEN coalesce(valid, false) THEN 'complete' ELSE 'awaiting_model' END", "ELSE 'complete' END")
    .replace("file_size / 1000.0 - 2.0 AS raw", "file_size / 1000.0 - 1.0 AS raw").replace("raw >= 0 THEN", "raw >= 0.5 THEN")
)


@query("maintained_tiles", sql=RESCORED + """
SELECT 'records' AS facet, '' AS value, count(*) AS n FROM catalog
UNION ALL SELECT 'unique_contents', '', count(DISTINCT content_id) FROM catalog
UNION ALL SELECT 'classified', '', count(predicted_class) FROM catalog
UNION ALL SELECT * FROM (SELECT 'need_attention', '', count(*) AS n FROM catalog WHERE processing_status IN ('failed', 'model_error', 'unsupported')) q WHERE n > 0
UNION ALL SELECT 'statuses', processing_status, count(*) FROM catalog GROUP BY 2
UNION ALL SELECT 'classes', predicted_class, count(*) FROM catalog GROUP BY 2
UNION ALL SELECT 'formats', format, count(*) FROM catalog GROUP BY 2
UNION ALL SELECT 'splits', split, count(*) FROM catalog GROUP BY 2
UNION ALL SELECT 'outcomes', outcome, count(*) FROM catalog GROUP BY 2
""")
def maintained_tiles(spark, folder):
    """Counts kept through an ingest of two thirds, one of everything with replays, and a rescore of all due contents."""
    rows = materialize(given.batch(spark, folder), "batch")
    state = (empty(spark, S.SOURCES), empty(spark, S.CONTENT))
    counts = tiles.count_tiles(catalog.add_outcomes(catalog.join_catalog(*state)))
    for batch in (rows.where("doc_id % 3 <> 1"), rows):
        content = materialize(ingest.merge_content(state[1], batch, scorer=given.SCORER_V1), "content")
        sources = materialize(ingest.merge_sources(state[0], batch, content), "sources")
        after = tuple(materialize(ingest.upsert(*x), "state") for x in ((state[0], sources, "path"), (state[1], content, "content_id")))
        counts = materialize(tiles.change_tiles(counts, state, after, sources, content), "tiles")
        state = after
    due = materialize(ingest.apply_scores(state[1].where(ingest.rescore_due("v2")), given.SCORER_V2, F.lit(True), F.col("processed_at")), "rescored")
    after = (state[0], materialize(ingest.upsert(state[1], due, "content_id"), "state"))
    counts = tiles.change_tiles(counts, state, after, empty(spark, S.SOURCES), due)
    return counts.where(F.col("facet") != tiles.LATEST)


SKETCHED = (
    ("all", {}), ("complete", {"processing_status": ["complete"]}), ("complete in train", {"processing_status": ["complete"], "split": ["train"]}),
    ("png or without format", {"format": ["PNG", None]}), ("failed in train or val", {"processing_status": ["failed"], "split": ["train", "val"]}),
)


@query("distinct_ids_sketch", sql=CATALOG + """
SELECT 'all' AS filter, count(DISTINCT content_id) AS ids, true AS within_bound FROM catalog
UNION ALL SELECT 'complete', count(DISTINCT content_id), true FROM catalog WHERE processing_status = 'complete'
UNION ALL SELECT 'complete in train', count(*), true FROM (
  SELECT content_id FROM catalog WHERE processing_status = 'complete' AND content_id IS NOT NULL
  INTERSECT SELECT content_id FROM catalog WHERE split = 'train') q
UNION ALL SELECT 'png or without format', count(DISTINCT content_id), true FROM catalog WHERE format = 'PNG' OR format IS NULL
UNION ALL SELECT 'failed in train or val', count(*), true FROM (
  SELECT content_id FROM catalog WHERE processing_status = 'failed' AND content_id IS NOT NULL
  INTERSECT SELECT content_id FROM catalog WHERE split IN ('train', 'val')) q
""")
def distinct_ids_sketch(spark, folder):
    """Distinct contents under several filters, exact and from sketches of three parts that were stored and merged."""
    rows = given.catalog(spark, folder).select("content_id", "processing_status", "split", "format", F.pmod(F.xxhash64("path"), F.lit(3)).alias("part"))
    rows = materialize(rows, "catalog")
    facets = ["processing_status", "split", "format"]
    stored = [materialize(sketches.id_sketches(rows.where(F.col("part") == k), "content_id", facets), "sketches") for k in range(3)]
    merged = materialize(sketches.merged_ids(stored[0].unionByName(stored[1]).unionByName(stored[2])), "sketches")
    ids = rows.where("content_id is not null")
    total = F.count_distinct("content_id")
    out = None
    for name, filters in SKETCHED:
        exact = ids
        for facet, values in filters.items():
            allowed = F.coalesce(F.col(facet).isin([v for v in values if v is not None]), F.lit(False)) | (F.col(facet).isNull() & F.lit(None in values))
            # A content meets a facet by any of its records.
            exact = exact.join(ids.where(allowed).select("content_id").distinct(), "content_id", "left_semi")
        counted = exact.agg(total.alias("ids")).withColumn("_one", F.lit(1))
        about = sketches.distinct_ids(merged, filters).select(F.col("ids").alias("about"), F.lit(1).alias("_one"))
        near = F.abs(F.col("about") - F.col("ids")) <= F.lit(sketches.COUNT_ERROR) * F.greatest(F.col("ids"), F.lit(ids.count()))
        row = counted.join(F.broadcast(about), "_one").select(F.lit(name).alias("filter"), "ids", near.alias("within_bound"))
        out = row if out is None else out.unionByName(row)
    return out


@query("facet_values", sql=CATALOG + """
SELECT facet, value, count(*) AS n FROM (
  SELECT 'statuses' AS facet, processing_status AS value FROM catalog UNION ALL SELECT 'classes', predicted_class FROM catalog
  UNION ALL SELECT 'formats', format FROM catalog UNION ALL SELECT 'splits', split FROM catalog
  UNION ALL SELECT 'outcomes', outcome FROM catalog) f WHERE value IS NOT NULL GROUP BY facet, value
""")
def facet_values(spark, folder):
    return catalog.facet_values(given.catalog(spark, folder))


@query("value_distributions", sql=CATALOG + """
SELECT 'predicted_class' AS chart, coalesce(predicted_class, 'unclassified') AS value, count(*) AS n FROM catalog GROUP BY 2
UNION ALL SELECT 'processing_status', processing_status, count(*) FROM catalog GROUP BY 2
""")
def value_distributions(spark, folder):
    return catalog.value_distributions(given.catalog(spark, folder))


@query("catalog_stamp", sql=CATALOG + """
SELECT count(*) AS records, CAST(epoch(max(t)) AS BIGINT) AS last_processed_at FROM catalog LEFT JOIN (
  SELECT content_id, max(seen_at) AS t FROM batch WHERE content_id IS NOT NULL GROUP BY content_id) p USING (content_id)
""")
def catalog_stamp(spark, folder):
    return catalog.catalog_stamp(given.catalog(spark, folder)).withColumn(
        "last_processed_at", F.unix_timestamp("last_processed_at")
    )


@query("status_counts", sql=CATALOG + "SELECT processing_status AS status, count(*) AS n FROM catalog GROUP BY 1")
def status_counts(spark, folder):
    return catalog.status_counts(given.catalog(spark, folder))


@query("sink_filtered_export", sql=CATALOG + """
SELECT filename, split, format, CAST(width AS VARCHAR) AS width, predicted_class, true_class, outcome, processing_status,
       CAST(copies AS VARCHAR) AS copies, error, content_id, model_version FROM catalog WHERE processing_status = 'complete'
""")
def sink_filtered_export(spark, folder):
    path = scratch_path(spark, "export")
    rows = catalog.filter_catalog(given.catalog(spark, folder), catalog.Filters(statuses=["complete"]))
    sinks.write_csv(catalog.filtered_export(rows), path)
    return spark.read.option("header", True).csv(path).select(
        "filename", "split", "format", "width", "predicted_class", "true_class", "outcome",
        "processing_status", "copies", "error", "content_id", "model_version",
    )


# --- Ingest --------------------------------------------------------------------

@query("ingest_classify_source", sql=BATCH + """
SELECT path, verdict AS source_status, CASE verdict WHEN 'failed' THEN 'unreadable' WHEN 'unsupported' THEN 'Unsupported extension' END AS source_error
FROM batch
""")
def ingest_classify_source(spark, folder):
    return ingest.classify_sources(given.batch(spark, folder)).select("path", "source_status", "source_error")


def two_batches(spark, folder):
    """Two thirds of the documents first, then everything: replayed and new rows together."""
    rows = materialize(given.batch(spark, folder), "batch")
    return rows.where("doc_id % 3 <> 1"), rows


# Copies accepted in the first batch (a0) and in the second (a1) per content.
MERGED_SQL = BATCH + """,
g AS (
  SELECT content_id, any_value(broken) AS broken, any_value(decoded_format) AS decoded_format, any_value(file_size) AS file_size,
         count(*) FILTER (WHERE verdict = 'accepted' AND doc_id % 3 <> 1) AS a0,
         count(*) FILTER (WHERE verdict = 'accepted') AS a1,
         coalesce(bool_or(verdict = 'accepted' AND expected_format = decoded_format AND doc_id % 3 <> 1), false) AS v0,
         coalesce(bool_or(verdict = 'accepted' AND expected_format = decoded_format), false) AS v1
  FROM batch WHERE content_id IS NOT NULL GROUP BY content_id
)
"""


@query("ingest_merge_content", sql=MERGED_SQL + """
SELECT content_id, file_size, CASE WHEN a1 > 0 AND NOT broken THEN decoded_format END AS format,
       CASE WHEN a1 = 0 THEN 'unsupported' WHEN broken THEN 'failed' ELSE 'awaiting_model' END AS processing_status,
       CASE WHEN broken THEN CAST(a0 > 0 AS BIGINT) + a1 ELSE CAST(a1 > 0 AS BIGINT) END AS attempts FROM g
""")
def ingest_merge_content(spark, folder):
    first, second = two_batches(spark, folder)
    state = write_bucketed(materialize(ingest.merge_content(empty(spark, S.CONTENT), first), "content"), "content_id")
    changed = ingest.merge_content(state.regular, second, retry_failed=True)
    return upsert_bucketed(state, changed).regular.select(
        "content_id", "file_size", "format", "processing_status", "attempts"
    )


@query("ingest_unsupported_not_poison", sql=BATCH + """,
g AS (SELECT content_id, any_value(broken) AS broken, bool_or(verdict = 'accepted') AS good,
             bool_or(verdict = 'unsupported') AS bad FROM batch WHERE content_id IS NOT NULL GROUP BY content_id)
SELECT content_id, CASE WHEN NOT good THEN 'unsupported' WHEN broken THEN 'failed' ELSE 'awaiting_model' END AS processing_status
FROM g WHERE bad
""")
def ingest_unsupported_not_poison(spark, folder):
    """Badly named copies arrive first and last; validly named ones in between."""
    rows = materialize(given.batch(spark, folder), "batch")
    bad_names = rows.where("filename like '%.txt'")
    state = materialize(ingest.merge_content(empty(spark, S.CONTENT), bad_names), "content")
    state = materialize(ingest.upsert(state, ingest.merge_content(state, rows), "content_id"), "content")
    return ingest.merge_content(state, bad_names).select("content_id", "processing_status")


@query("ingest_merge_sources", sql=CATALOG + """
SELECT path, filename, CASE WHEN source_status = 'failed' THEN NULL ELSE content_id END AS content_id, split, label,
       source_status, source_error FROM source_state
""")
def ingest_merge_sources(spark, folder):
    first, second = two_batches(spark, folder)
    content = materialize(ingest.merge_content(empty(spark, S.CONTENT), second), "content")
    state = materialize(ingest.merge_sources(empty(spark, S.SOURCES), first, content), "sources")
    changed = materialize(ingest.merge_sources(state, second, content), "sources")
    return ingest.upsert(state, changed, "path").drop("seen_at")


@query("ingest_failed_source", sql=BATCH + """
SELECT path, filename, split, label, 'failed' AS source_status, 'lost' AS source_error
FROM batch WHERE content_id IS NOT NULL
""")
def ingest_failed_source(spark, folder):
    """Every readable source becomes unreadable: name, split and label must survive."""
    rows = materialize(given.batch(spark, folder).where("read_error is null"), "batch")
    none = empty(spark, S.CONTENT)
    state = ingest.merge_sources(empty(spark, S.SOURCES), rows, none)
    lost = rows.withColumns({
        "read_error": F.lit("lost"), "content_id": F.lit(None).cast("string"), "filename": F.lit("?"),
        "split": F.lit(None).cast("string"), "label": F.lit(None).cast("long"),
    })
    return ingest.merge_sources(state, lost, none).select(
        "path", "filename", "split", "label", "source_status", "source_error"
    )




@query("score_on_ingest", sql=MERGED_SQL + """
SELECT content_id, CASE WHEN a1 = 0 THEN 'unsupported' WHEN broken THEN 'failed' WHEN v1 THEN 'complete'
                        ELSE 'awaiting_model' END AS processing_status,
       CASE WHEN v1 AND NOT broken THEN 'v2' END AS model_version,
       CASE WHEN v1 AND NOT broken THEN CASE WHEN file_size / 1000.0 - 1.0 >= 0.5 THEN 'pneumonia' ELSE 'normal' END END AS predicted_class,
       CASE WHEN v1 AND NOT broken THEN round(1 / (1 + exp(-(file_size / 1000.0 - 1.0))), 9) END AS positive_score
FROM g
""")
def score_on_ingest(spark, folder):
    first, second = two_batches(spark, folder)
    state = materialize(ingest.merge_content(empty(spark, S.CONTENT), first, scorer=given.SCORER_V1), "content")
    changed = ingest.merge_content(state, second, scorer=given.SCORER_V2)
    return ingest.upsert(state, changed, "content_id").select(
        "content_id", "processing_status", "model_version", "predicted_class",
        F.round("positive_score", 9).alias("positive_score"),
    )


@query("ingest_samples", sql=ASSIGNED_SQL + """
SELECT d.split || '_' || lpad(CAST(d.split_index AS VARCHAR), 6, '0') || '.png' AS filename,
       coalesce(a.assigned_split, 'excluded') AS split, d.label, d.content_hash AS content_id, 'accepted' AS source_status
FROM docs d LEFT JOIN assigned a ON a.source_split = d.split AND a.source_index = d.split_index
""")
def ingest_samples(spark, folder):
    rows = given.docs(spark, folder).withColumn("vec", F.array(F.col("n_chars").cast("double")))
    batch = ingest.sample_batch(rows, assigned_docs(spark, folder), "given", 1, 1)
    content = ingest.merge_content(empty(spark, S.CONTENT), batch)
    return ingest.merge_sources(empty(spark, S.SOURCES), batch, content).select(
        "filename", "split", F.col("label").cast("int").alias("label"), "content_id", "source_status"
    )


@query("stale_predictions", sql=MERGED_SQL + """
SELECT content_id FROM g WHERE NOT broken AND a1 > 0
""")
def stale_predictions(spark, folder):
    content = given.catalog_tables(spark, folder)[1].regular
    return ingest.stale_predictions(content, "v2").select("content_id")


@query("rescore_candidates", sql=MERGED_SQL + """
SELECT content_id FROM g WHERE NOT broken AND a1 > 0 AND NOT v1
""")
def rescore_candidates(spark, folder):
    content = given.catalog_tables(spark, folder)[1].regular
    return content.where(ingest.rescore_due("v1")).select("content_id")


@query("rescore_catalog", sql=MERGED_SQL + """
SELECT content_id, CASE WHEN a1 = 0 THEN 'unsupported' WHEN broken THEN 'failed' ELSE 'complete' END AS processing_status,
       CASE WHEN a1 > 0 AND NOT broken THEN 'v2' END AS model_version,
       CASE WHEN a1 > 0 AND NOT broken THEN round(1 / (1 + exp(-(file_size / 1000.0 - 1.0))), 9) END AS positive_score FROM g
""")
def rescore_catalog(spark, folder):
    content = given.catalog_tables(spark, folder)[1].regular
    once = ingest.rescore(content, given.SCORER_V2)
    return ingest.rescore(once, given.SCORER_V2).select(
        "content_id", "processing_status", "model_version", F.round("positive_score", 9).alias("positive_score")
    )


@query("retry_failed", sql=MERGED_SQL + """
SELECT content_id, a1 + a1 AS attempts FROM g WHERE broken AND a1 > 0
""")
def retry_failed(spark, folder):
    rows = materialize(given.batch(spark, folder), "batch")
    state = materialize(ingest.merge_content(empty(spark, S.CONTENT), rows, retry_failed=True), "content")
    again = ingest.merge_content(state, rows, retry_failed=True)
    return again.where("processing_status = 'failed'").select("content_id", "attempts")


@query("stream_ingest", sql=CATALOG + """
SELECT c.path, c.split, c.content_id, c.processing_status, c.copies FROM catalog c
""")
def stream_ingest_query(spark, folder):
    """Documents arrive as a stream in about three batches; the store must equal one batch ingest."""
    landing, root = scratch_path(spark, "landing"), scratch_path(spark, "store")
    rows = given.batch(spark, folder).drop("doc_id")
    rows.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(3))).write.partitionBy("part").parquet(landing)
    third = -(-len(spark.read.parquet(landing).inputFiles()) // 3)
    arriving = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", third).parquet(f"{landing}/part=*")
    store = CatalogStore(spark, root)
    stream_ingest(arriving, store, scratch_path(spark, "stream-checkpoint"), scorer=given.SCORER_V1)
    joined = catalog.join_catalog(store.sources(), store.content())
    return joined.select("path", "split", "content_id", "processing_status", "copies")


@query("check_attribution_version", sql=MERGED_SQL + """,
f AS (SELECT *, 1 / (1 + exp(-(file_size / 1000.0 - 2.0))) AS stored,
             1 / (1 + exp(-(file_size / 1000.0 - 2.0 - CASE WHEN file_size >= 3000 THEN 0.01 ELSE 0 END))) AS fresh FROM g)
SELECT content_id, CASE WHEN NOT (v1 AND NOT broken) THEN 'other model version' ELSE 'stored score differs' END AS problem
FROM f WHERE NOT (v1 AND NOT broken) OR abs(fresh - stored) > 1e-8 + 1e-7 * stored
""")
def check_attribution_version(spark, folder):
    """Stored scores against a model that differs for long texts only."""
    content = given.catalog_tables(spark, folder)[1].regular
    raw = F.col("file_size") / F.lit(1000.0) - F.lit(2.0)
    fresh = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.when(F.col("file_size") >= 3000, raw - 0.01).otherwise(raw)))
    return checks.check_attribution_version(content, "v1", fresh)
