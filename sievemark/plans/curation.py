"""Queries: QC columns, analysis tables, deduplication and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.vectors import vec_sum
from sievemark.operators import analysis, dedup, digests, metadata, predictions, sketches, splits
from sievemark.operators.quantiles import exact_quantile
from sievemark.plans import given
from sievemark.plans.registry import query
from sievemark.session import materialize, scratch_path
from sievemark.sources import sinks
from sievemark.sources.buckets import write_bucketed

METADATA = "WITH " + given.METADATA_SQL
DOCS = "WITH " + given.DOCS_SQL
DOC_QC = "WITH " + given.DOC_QC_SQL
DOC_GROUPS = DOCS + f""",
rows AS (
  SELECT doc_id, {given.uuid_sql('split', 'split_index', 'content_hash')} AS record_id, split, split_index, label, content_hash
  FROM docs
),
groups AS (
  SELECT content_hash, count(*) AS duplicate_count, count(DISTINCT split) > 1 AS cross_split
  FROM rows GROUP BY content_hash
)
"""


# --- QC columns ----------------------------------------------------------------

@query("low_variance_threshold", sql=METADATA + """
SELECT round(quantile_cont(std_value, 0.01), 9) AS threshold FROM metadata
""")
def low_variance_threshold(spark, folder):
    rows = given.stored_metadata(spark, folder)
    value = exact_quantile(rows, "std_value", S.LOW_VARIANCE_QUANTILE)
    return rows.agg(F.round(F.max(F.lit(value)), 9).alias("threshold"))


@query("low_variance_sketch", sql=METADATA + "SELECT count(*) AS n, true AS within_bound FROM metadata")
def low_variance_sketch(spark, folder):
    """The threshold from one sketch a split, held against the exact ranks of the rows."""
    rows = given.stored_metadata(spark, folder)
    parts = materialize(sketches.quantile_sketches(rows, "std_value", ["split"]), "sketches")
    merged = sketches.merged_quantiles(parts, [S.LOW_VARIANCE_QUANTILE]).select("n", F.col("quantiles")[0].alias("threshold"))
    threshold = merged.first()["threshold"]
    share = sketches.rank_share(rows, "std_value", F.lit(threshold)).withColumn("_one", F.lit(1))
    low, high = S.LOW_VARIANCE_QUANTILE - sketches.RANK_ERROR, S.LOW_VARIANCE_QUANTILE + sketches.RANK_ERROR
    within = (F.col("below") <= high) & (F.col("not_above") >= low)
    return merged.withColumn("_one", F.lit(1)).join(F.broadcast(share), "_one").select("n", within.alias("within_bound"))


@query("low_variance_rows", sql=METADATA + "SELECT record_id, round(std_value, 6) AS std_value FROM qc WHERE low_variance_flag")
def low_variance_rows(spark, folder):
    return metadata.low_variance_rows(given.stored_metadata(spark, folder)).select(
        "record_id", F.round("std_value", 6).alias("std_value")
    )


@query("lowest_variance_sample", sql=METADATA + """
SELECT record_id, split, split_index, label, round(mean_value, 6) AS mean_value, round(std_value, 6) AS std_value
FROM qc WHERE low_variance_flag ORDER BY qc.std_value, record_id LIMIT 5
""")
def lowest_variance_sample(spark, folder):
    flagged = metadata.low_variance_rows(given.stored_metadata(spark, folder))
    return metadata.lowest_variance_sample(flagged).withColumns(
        {c: F.round(c, 6) for c in ("mean_value", "std_value")}
    )


@query("duplicate_count", sql=DOC_GROUPS + """
SELECT doc_id, duplicate_count, duplicate_count > 1 AS exact_duplicate_flag FROM rows JOIN groups USING (content_hash)
""")
def duplicate_count(spark, folder):
    return metadata.add_duplicate_flags(given.docs(spark, folder)).select(
        "doc_id", "duplicate_count", "exact_duplicate_flag"
    )


@query("stored_duplicate_flags", sql=DOC_GROUPS + """
SELECT doc_id, duplicate_count, duplicate_count > 1 AS exact_duplicate_flag, cross_split AS cross_split_duplicate_flag
FROM rows JOIN groups USING (content_hash)
""")
def stored_duplicate_flags(spark, folder):
    """Duplicate columns of documents that were stored in buckets of their hash."""
    rows = materialize(given.docs(spark, folder).select("doc_id", "split", "content_hash"), "documents")
    return metadata.add_stored_duplicate_flags(write_bucketed(rows, "content_hash")).select(
        "doc_id", "duplicate_count", "exact_duplicate_flag", "cross_split_duplicate_flag"
    )


@query("cross_split_flag", sql=DOC_GROUPS + """
SELECT doc_id, cross_split AS cross_split_duplicate_flag FROM rows JOIN groups USING (content_hash)
""")
def cross_split_flag(spark, folder):
    return metadata.add_duplicate_flags(given.docs(spark, folder)).select("doc_id", "cross_split_duplicate_flag")


@query("duplicate_peer_ids", sql=DOC_GROUPS + """
SELECT record_id, CASE WHEN duplicate_count > 1 THEN content_hash END AS peer_key, duplicate_count
FROM rows JOIN groups USING (content_hash)
""")
def duplicate_peer_ids(spark, folder):
    """Each record with the key of its members in ``duplicate_peers``, NULL when alone."""
    flagged = metadata.add_duplicate_flags(given.docs(spark, folder))
    return flagged.select("record_id", F.when(F.col("duplicate_count") > 1, F.col("content_hash")).alias("peer_key"),
                          "duplicate_count")


@query("duplicate_peers", sql=DOC_GROUPS + """
SELECT content_hash, record_id AS peer_id, duplicate_count FROM rows JOIN groups USING (content_hash) WHERE duplicate_count > 1
""")
def duplicate_peers(spark, folder):
    return metadata.duplicate_peers(given.docs(spark, folder))


@query("split_counts", sql=DOCS + """
SELECT s.split, count(d.doc_id) AS total_records
FROM (VALUES ('train'), ('val'), ('test')) s(split) LEFT JOIN docs d USING (split) GROUP BY s.split
""")
def split_counts(spark, folder):
    return metadata.split_counts(given.docs(spark, folder))


# --- Analysis tables -----------------------------------------------------------

@query("class_balance", sql=DOCS + """
SELECT split, count(*) AS total_records, count(*) FILTER (WHERE label = 0) AS negative_records,
       count(*) FILTER (WHERE label = 1) AS positive_records,
       round(100.0 * count(*) FILTER (WHERE label = 1) / count(*), 2) AS pct_positive
FROM docs GROUP BY split
""")
def class_balance(spark, folder):
    return analysis.class_balance(given.docs(spark, folder))


@query("vector_characteristics", sql=METADATA + """
SELECT label, CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'pneumonia' END AS class_name, count(*) AS total_records,
       round(avg(mean_value), 6) AS avg_mean_value, round(avg(std_value), 6) AS avg_std_value,
       round(min(mean_value), 6) AS min_mean_value, round(max(mean_value), 6) AS max_mean_value,
       round(min(std_value), 6) AS min_std_value, round(max(std_value), 6) AS max_std_value
FROM metadata GROUP BY label
""")
def vector_characteristics(spark, folder):
    return analysis.characteristics(given.metadata(spark, folder), decimals=6)


@query("vector_characteristics_by_split", sql=METADATA + """
SELECT split, label, CASE label WHEN 0 THEN 'normal' WHEN 1 THEN 'pneumonia' END AS class_name,
       count(*) AS total_records, round(avg(mean_value), 6) AS avg_mean_value, round(avg(std_value), 6) AS avg_std_value
FROM metadata GROUP BY split, label
""")
def vector_characteristics_by_split(spark, folder):
    return analysis.characteristics_by_split(given.metadata(spark, folder), decimals=6)


@query("qc_summary", sql=DOC_QC + """
SELECT count(*) AS total_records, count(*) FILTER (WHERE low_variance_flag) AS low_variance_records,
       count(*) FILTER (WHERE exact_duplicate_flag) AS duplicate_records,
       count(DISTINCT content_hash) FILTER (WHERE exact_duplicate_flag) AS duplicate_groups,
       count(*) FILTER (WHERE cross_split_duplicate_flag) AS cross_split_duplicate_records,
       count(DISTINCT content_hash) FILTER (WHERE cross_split_duplicate_flag) AS cross_split_duplicate_groups
FROM qc
""")
def qc_summary(spark, folder):
    return analysis.qc_summary(given.doc_qc(spark, folder))


@query("cross_split_duplicates", sql=DOC_QC + """
SELECT content_hash, record_id, split, split_index, label, duplicate_count FROM qc WHERE cross_split_duplicate_flag
""")
def cross_split_duplicates(spark, folder):
    return analysis.cross_split_duplicates(given.doc_qc(spark, folder))


@query("duplicate_label_conflicts", sql=DOC_GROUPS + """,
conflicts AS (SELECT content_hash, count(*) AS record_count, count(DISTINCT label) AS distinct_label_count
              FROM rows GROUP BY content_hash HAVING count(DISTINCT label) > 1),
by_label AS (SELECT content_hash, string_agg(label || ' x' || n, ', ' ORDER BY label) AS labels
             FROM (SELECT content_hash, label, count(*) AS n FROM rows GROUP BY ALL) a GROUP BY content_hash),
by_split AS (SELECT content_hash, string_agg(split || ' x' || n, ', ' ORDER BY split) AS splits
             FROM (SELECT content_hash, split, count(*) AS n FROM rows GROUP BY ALL) a GROUP BY content_hash)
SELECT * FROM conflicts JOIN by_label USING (content_hash) JOIN by_split USING (content_hash)
""")
def duplicate_label_conflicts(spark, folder):
    return analysis.duplicate_label_conflicts(given.docs(spark, folder))


def _extreme(order: str, criterion: str, metric: str) -> str:
    return f"""SELECT * FROM (SELECT record_id, split, split_index, label, low_variance_flag, exact_duplicate_flag,
        '{criterion}' AS criterion, row_number() OVER (ORDER BY {order}, record_id) AS selection_rank,
        '{metric}' AS metric_name, round({metric}, 6) AS metric_value FROM qc) x WHERE selection_rank <= 3"""


EXTREMES_SQL = METADATA + " UNION ALL ".join([
    _extreme("mean_value", "darkest", "mean_value"),
    _extreme("mean_value DESC", "brightest", "mean_value"),
    _extreme("std_value", "lowest_contrast", "std_value"),
])


def _extremes(spark, folder):
    return analysis.extreme_records(given.qc_metadata(spark, folder)).select(
        "record_id", "split", "split_index", "label", "low_variance_flag", "exact_duplicate_flag", "criterion",
        "selection_rank", "metric_name", F.round("metric_value", 6).alias("metric_value"),
    )


query("extreme_records", sql=EXTREMES_SQL)(_extremes)


@query("union_criteria", sql=DOC_QC + """
SELECT criterion, count(*) AS n FROM (
  SELECT 'low_variance' AS criterion FROM qc WHERE low_variance_flag
  UNION ALL SELECT 'duplicate' FROM qc WHERE exact_duplicate_flag
  UNION ALL SELECT 'cross_split' FROM qc WHERE cross_split_duplicate_flag) u GROUP BY criterion
""")
def union_criteria(spark, folder):
    rows = given.doc_qc(spark, folder)
    criteria = {"low_variance": "low_variance_flag", "duplicate": "exact_duplicate_flag",
                "cross_split": "cross_split_duplicate_flag"}
    # Every selection in one pass: a row contributes one entry per criterion it meets.
    met = F.array_compact(F.array(*[F.when(F.col(flag), F.lit(name)) for name, flag in criteria.items()]))
    return rows.select(F.explode(met).alias("criterion")).groupBy("criterion").agg(F.count(F.lit(1)).alias("n"))


@query("sink_analysis_tables", sql=DOC_GROUPS + """
SELECT 'class_balance' AS report, count(DISTINCT split) AS lines FROM docs
UNION ALL SELECT 'characteristics', count(DISTINCT label) FROM docs
UNION ALL SELECT 'characteristics_by_split', count(*) FROM (SELECT DISTINCT split, label FROM docs) s
UNION ALL SELECT 'qc_summary', 1
UNION ALL SELECT 'cross_split_duplicates', count(*) FROM rows JOIN groups USING (content_hash) WHERE cross_split
UNION ALL SELECT 'duplicate_label_conflicts', count(*) FROM (
  SELECT content_hash FROM rows GROUP BY content_hash HAVING count(DISTINCT label) > 1) c
UNION ALL SELECT 'extreme_records', 9
""")
def sink_analysis_tables(spark, folder):
    rows = given.docs(spark, folder).select(
        "record_id", "split", "split_index", "label", "content_hash",
        F.col("n_chars").cast("double").alias("mean_value"), (F.col("n_chars") % 97).cast("double").alias("std_value"),
        F.lit(0.0).alias("min_value"), F.col("n_chars").cast("double").alias("max_value"),
    )
    path = scratch_path(spark, "report")
    stored = sinks.sink_metadata_table(metadata.add_qc_fields(rows), scratch_path(spark, "metadata"))
    written = sinks.sink_tables(analysis.report_tables(stored), path)
    out = None
    for name in written:
        lines = spark.read.option("header", True).csv(f"{path}/{name}").agg(F.count(F.lit(1)).alias("lines"))
        lines = lines.select(F.lit(name).alias("report"), "lines")
        out = lines if out is None else out.unionByName(lines)
    return out


# --- Deduplication and splits --------------------------------------------------

@query("dedup_keep_first", sql=DOCS + """
SELECT source_split, source_index, label, content_hash FROM dedup WHERE rn = 1
""")
def dedup_keep_first(spark, folder):
    return dedup.deduplicate(given.pooled_docs(spark, folder), "keep_first").drop("pool_rank")


@query("dedup_drop_conflicts", sql=DOCS + "SELECT source_split, source_index, label, content_hash FROM kept")
def dedup_drop_conflicts(spark, folder):
    return dedup.deduplicate(given.pooled_docs(spark, folder), "drop").drop("pool_rank")


@query("dedup_report", sql=DOCS + """
SELECT count(*) AS input_records, count(DISTINCT content_hash) AS unique_records,
       count(DISTINCT content_hash) FILTER (WHERE copies > 1) AS duplicate_groups,
       count(*) FILTER (WHERE rn > 1) AS redundant_copies_removed,
       count(DISTINCT content_hash) FILTER (WHERE conflicting) AS label_conflict_groups,
       'drop' AS label_conflict_policy,
       count(*) FILTER (WHERE rn = 1 AND conflicting) AS label_conflict_records_dropped,
       count(*) FILTER (WHERE rn = 1 AND NOT conflicting) AS retained_records
FROM dedup
""")
def dedup_report(spark, folder):
    return dedup.dedup_report(given.pooled_docs(spark, folder), "drop")


# Quotas and splits over the views ``pooled`` and ``kept``.
ASSIGN_STEPS = """,
fractions AS (
  SELECT avg(CASE WHEN source_split = 'val' THEN 1.0 ELSE 0.0 END) AS v,
         avg(CASE WHEN source_split = 'test' THEN 1.0 ELSE 0.0 END) AS t FROM pooled
),
n1 AS (SELECT label, count(*) AS n FROM kept GROUP BY label),
d1 AS (SELECT label, n, sum(n) OVER () - ceil(t * sum(n) OVER ()) AS drawn, sum(n) OVER () AS total FROM n1, fractions),
f1 AS (SELECT *, floor(n * drawn / total) AS fl, n * drawn / total - floor(n * drawn / total) AS rest FROM d1),
q1 AS (SELECT label, n, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= drawn - sum(fl) OVER ()
                               THEN 1 ELSE 0 END AS dev FROM f1),
d2 AS (SELECT label, n, dev, sum(dev) OVER () - ceil(v / (1 - t) * sum(dev) OVER ()) AS drawn,
              sum(dev) OVER () AS total FROM q1, fractions),
f2 AS (SELECT *, floor(dev * drawn / total) AS fl, dev * drawn / total - floor(dev * drawn / total) AS rest FROM d2),
quotas AS (
  SELECT label, CAST(train AS BIGINT) AS train_quota, CAST(dev - train AS BIGINT) AS val_quota,
         CAST(n - dev AS BIGINT) AS test_quota
  FROM (SELECT *, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, label) <= drawn - sum(fl) OVER ()
                         THEN 1 ELSE 0 END AS train FROM f2) x
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || content_hash)) AS r FROM kept
),
assigned AS (
  SELECT o.*, CASE WHEN r <= test_quota THEN 'test' WHEN r <= test_quota + val_quota THEN 'val' ELSE 'train' END AS assigned_split
  FROM ordered o JOIN quotas USING (label)
),
manifest AS (
  SELECT *, row_number() OVER (PARTITION BY assigned_split ORDER BY pool_rank, source_index) - 1 AS assigned_index
  FROM assigned
)
"""
ASSIGNED_SQL = DOCS + ASSIGN_STEPS


def assigned_docs(spark, folder, docs=None):
    return splits.build_splits(given.pooled_docs(spark, folder, docs))


@query("stratified_split", sql=ASSIGNED_SQL + """
SELECT source_split, source_index, label, content_hash, assigned_split FROM assigned
""")
def stratified_split(spark, folder):
    return assigned_docs(spark, folder).drop("pool_rank")


@query("split_quotas", sql=ASSIGNED_SQL + "SELECT label, train_quota, val_quota, test_quota FROM quotas")
def split_quotas(spark, folder):
    pooled = given.pooled_docs(spark, folder)
    return splits.split_quotas(dedup.deduplicate(pooled), *splits.resolve_fractions(pooled))


@query("assigned_index", sql=ASSIGNED_SQL + """
SELECT assigned_split, assigned_index, source_split, source_index, label, content_hash FROM manifest
""")
def assigned_index(spark, folder):
    return splits.split_manifest(assigned_docs(spark, folder))


@query("manifest_union", sql=ASSIGNED_SQL + """
SELECT assigned_split, source_split, label, count(*) AS n FROM manifest GROUP BY ALL
""")
def manifest_union(spark, folder):
    return assigned_docs(spark, folder).groupBy("assigned_split", "source_split", "label").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("split_sizes", sql=ASSIGNED_SQL + "SELECT assigned_split, count(*) AS size FROM assigned GROUP BY assigned_split")
def split_sizes(spark, folder):
    return splits.split_sizes(assigned_docs(spark, folder))


@query("official_split", sql=DOCS + """
SELECT source_split, source_index, label, content_hash, source_split AS assigned_split FROM pooled
""")
def official_split(spark, folder):
    return splits.build_splits(given.pooled_docs(spark, folder), deduplicate_records=False).drop("pool_rank")


LANES_SQL = ", ".join(
    f"sum(CAST(CAST('0x' || substr(content_hash, {start}, 15) AS BIGINT) AS HUGEINT)) AS lane{start}"
    for start in splits.FINGERPRINT_LANES
)
LANES_TEXT = " || ':' || ".join(f"CAST(lane{start} AS VARCHAR)" for start in splits.FINGERPRINT_LANES)


@query("split_fingerprint", sql=ASSIGNED_SQL + f"""
SELECT substr(sha256(string_agg(t, '|' ORDER BY r)), 1, 16) AS split_fingerprint FROM (
  SELECT CASE assigned_split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS r,
         assigned_split || ':' || CAST(n AS VARCHAR) || ':' || {LANES_TEXT} AS t
  FROM (SELECT assigned_split, count(*) AS n, {LANES_SQL} FROM assigned GROUP BY assigned_split) a) b
""")
def split_fingerprint(spark, folder):
    return splits.split_fingerprint(assigned_docs(spark, folder))


def _tree_sql(name: str, below: str, depth: int) -> str:
    line = "prefix || ':' || digest"
    return f"""
{name} AS (
  SELECT split, {depth} AS depth, substr(prefix, 1, {depth}) AS prefix, sha256(string_agg({line}, chr(10) ORDER BY {line})) AS digest,
         CAST(sum(hashes) AS BIGINT) AS hashes FROM {below} GROUP BY split, substr(prefix, 1, {depth})
)"""


@query("split_fingerprint_tree", sql=ASSIGNED_SQL + """,
leaves AS (
  SELECT assigned_split AS split, 4 AS depth, substr(content_hash, 1, 4) AS prefix,
         sha256(string_agg(content_hash, chr(10) ORDER BY content_hash)) AS digest, count(*) AS hashes
  FROM assigned GROUP BY assigned_split, substr(content_hash, 1, 4)
),""" + _tree_sql("middle", "leaves", 2) + "," + _tree_sql("top", "middle", 0) + """
SELECT * FROM leaves UNION ALL SELECT * FROM middle UNION ALL SELECT * FROM top
""")
def split_fingerprint_tree(spark, folder):
    return digests.digest_tree(assigned_docs(spark, folder), depth=4)


@query("split_tree_difference", sql=ASSIGNED_SQL + """,
moved AS (SELECT assigned_split AS split, CASE assigned_split WHEN 'train' THEN 'val' ELSE 'train' END AS target, content_hash AS hash
          FROM assigned WHERE content_hash LIKE '%0')
SELECT split, hash, 1 AS "left", 0 AS "right" FROM moved UNION ALL SELECT target, hash, 0, 1 FROM moved
""")
def split_tree_difference(spark, folder):
    """The manifest against one in which every hash that ends in 0 has another split, found by walking both trees."""
    first = assigned_docs(spark, folder).select("assigned_split", "content_hash")
    other = F.when(F.col("assigned_split") == "train", "val").otherwise("train")
    second = first.withColumn("assigned_split", F.when(F.col("content_hash").endswith("0"), other).otherwise(F.col("assigned_split")))
    left, right = (digests.write_by_prefix(m, scratch_path(spark, "manifest")) for m in (first, second))
    leaves = digests.tree_difference(digests.digest_tree(left, depth=4), digests.digest_tree(right, depth=4))
    return digests.changed_hashes(left, right, leaves)


@query("split_overlap_check", sql=DOCS + """
SELECT content_hash, count(*) AS occurrences, min(source_split) <> max(source_split) AS across_splits
FROM pooled GROUP BY content_hash HAVING count(*) > 1
""")
def split_overlap_check(spark, folder):
    return splits.repeated_hashes(splits.official_split(given.pooled_docs(spark, folder)))


@query("check_no_leakage", sql=ASSIGNED_SQL + """
SELECT content_hash, count(*) AS occurrences, true AS across_splits FROM assigned GROUP BY content_hash HAVING count(*) > 1
""")
def check_no_leakage(spark, folder):
    return splits.repeated_hashes(assigned_docs(spark, folder))


@query("sink_split_manifest", sql=ASSIGNED_SQL + """
SELECT assigned_split, CAST(assigned_index AS VARCHAR) AS assigned_index, source_split,
       CAST(source_index AS VARCHAR) AS source_index, CAST(label AS VARCHAR) AS label, content_hash FROM manifest
""")
def sink_split_manifest(spark, folder):
    pooled, assigned = given.pooled_docs(spark, folder), assigned_docs(spark, folder)
    fractions = splits.resolve_fractions(pooled)
    report = splits.split_report(pooled, assigned, "drop", *fractions, S.DEFAULT_SEED, True)
    path = scratch_path(spark, "splits")
    sinks.sink_split_manifest(splits.split_manifest(assigned), report, path)
    return spark.read.option("header", True).csv(f"{path}/split_manifest")


@query("stratified_kfold", sql=ASSIGNED_SQL + """
SELECT source_split, source_index, CAST((row_number() OVER (PARTITION BY label ORDER BY sha256('42:' || content_hash)) - 1) % 3 AS INTEGER) AS fold
FROM assigned WHERE assigned_split = 'train'
""")
def stratified_kfold(spark, folder):
    train = assigned_docs(spark, folder).where("assigned_split = 'train'")
    return splits.stratified_folds(train, 3).select("source_split", "source_index", "fold")


@query("holdout_fold", sql=ASSIGNED_SQL + """
SELECT source_split, source_index, CASE WHEN assigned_split = 'train' THEN -1 ELSE 0 END AS fold
FROM assigned WHERE assigned_split <> 'test'
""")
def holdout_fold(spark, folder):
    return splits.holdout_fold(assigned_docs(spark, folder)).select("source_split", "source_index", "fold")


@query("seeded_sample", sql=DOCS + """
SELECT doc_id, content_hash FROM docs ORDER BY sha256('42:' || CAST(doc_id AS VARCHAR)), doc_id LIMIT 100
""")
def seeded_sample(spark, folder):
    return splits.seeded_sample(given.docs(spark, folder), S.BACKGROUND_SIZE, "doc_id").select("doc_id", "content_hash")


@query("run_parameters", sql=ASSIGNED_SQL + """,
report AS (SELECT count(*) FILTER (WHERE rn > 1) AS copies,
                  count(*) FILTER (WHERE rn = 1 AND conflicting) AS conflicts FROM dedup)
SELECT 'split_strategy' AS key, 'deduplicate_then_split' AS value
UNION ALL SELECT 'split_label_conflict_policy', 'drop'
UNION ALL SELECT 'split_redundant_copies_removed', CAST(copies AS VARCHAR) FROM report
UNION ALL SELECT 'split_label_conflict_records_dropped', CAST(conflicts AS VARCHAR) FROM report
UNION ALL SELECT 'split_size_' || assigned_split, CAST(count(*) AS VARCHAR) FROM assigned GROUP BY assigned_split
""")
def run_parameters(spark, folder):
    pooled, assigned = given.pooled_docs(spark, folder), assigned_docs(spark, folder)
    fractions = splits.resolve_fractions(pooled)
    report = splits.split_report(pooled, assigned, "drop", *fractions, S.DEFAULT_SEED, True)
    return predictions.run_parameters(report).where("key <> 'split_fingerprint'")


def _unit_sql(tag: str) -> str:
    return f"CAST('0x' || substr(sha256('42:{tag}:' || content_hash || ':' || copy), 1, 13) AS BIGINT) / 4503599627370496.0"


@query("augment_union", sql="WITH " + given.SAMPLES_SQL + f""",
train AS (SELECT vec_id, label, vec, content_hash FROM samples WHERE split = 'train'),
copied AS (
  SELECT train.*, copy, {_unit_sql('a')} < 0.5 AS warped, 1 + ({_unit_sql('sx')} * 2 - 1) * 0.03 AS sx, 1 + ({_unit_sql('sy')} * 2 - 1) * 0.03 AS sy,
         ({_unit_sql('tx')} * 2 - 1) * 0.03 * 8 AS tx, ({_unit_sql('ty')} * 2 - 1) * 0.03 * 8 AS ty, radians(({_unit_sql('r')} * 2 - 1) * 5.0) AS turn,
         {_unit_sql('p')} < 0.5 AS changed, 1.0 + ({_unit_sql('c')} * 2 - 1) * 0.05 AS gain, ({_unit_sql('b')} * 2 - 1) * 0.05 AS shift
  FROM train, (VALUES (1), (2)) c(copy)
),
places AS (
  SELECT *, p % 8 - 3.5 - tx AS x, p // 8 - 3.5 - ty AS y FROM copied, (SELECT unnest(range(64)) AS p) q
),
origins AS (
  SELECT *, (x * cos(turn) + y * sin(turn)) / sx + 3.5 AS ox, (y * cos(turn) - x * sin(turn)) / sy + 3.5 AS oy FROM places
),
corners AS (
  SELECT o.*, CASE WHEN floor(ox) + i BETWEEN 0 AND 7 AND floor(oy) + j BETWEEN 0 AND 7
                   THEN vec[CAST((floor(oy) + j) * 8 + floor(ox) + i AS INTEGER) + 1] ELSE 0 END AS v,
         (CASE i WHEN 1 THEN ox - floor(ox) ELSE 1 - (ox - floor(ox)) END) * (CASE j WHEN 1 THEN oy - floor(oy) ELSE 1 - (oy - floor(oy)) END) AS share
  FROM origins o, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) n(i, j)
),
cells AS (
  SELECT vec_id, label, copy, p, CASE WHEN any_value(warped) THEN sum(v * share) ELSE any_value(vec[p + 1]) END AS v,
         any_value(changed) AS changed, any_value(gain) AS gain, any_value(shift) AS shift
  FROM corners GROUP BY vec_id, label, copy, p
)
SELECT vec_id, label, 0 AS copy, CAST(p AS INTEGER) AS position, round(vec[p + 1], 6) AS value FROM train, (SELECT unnest(range(64)) AS p) q
UNION ALL
SELECT vec_id, label, copy, CAST(p AS INTEGER), round(CASE WHEN changed THEN greatest(0.0, least(1.0, v * gain + shift)) ELSE v END, 6) FROM cells
""")
def augment_union(spark, folder):
    """Originals and changed copies, every value of each."""
    train = given.samples(spark, folder).where("split = 'train'")
    rows = splits.augment_training(train, copies=2, top=1.0)
    return rows.select("vec_id", "label", "copy", F.posexplode("vec").alias("position", "value")).withColumn("value", F.round("value", 6) + 0.0)
