"""Queries: thresholds, curves, metrics, predictions and model choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import sigmoid
from sievemark.operators import metrics, models, predictions
from sievemark.operators.skew import broadcast_if_small
from sievemark.plans import given
from sievemark.plans.curation import ASSIGNED_SQL, assigned_docs
from sievemark.plans.registry import query
from sievemark.session import materialize, scratch_path
from sievemark.sources import sinks, tables

SCORED = "WITH " + given.SCORED_SQL
CATALOG = "WITH " + given.CATALOG_SQL

ROC_SQL = SCORED + """,
steps AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n FROM scored GROUP BY score),
roc AS (
  SELECT score AS threshold, CAST(sum(p) OVER w AS BIGINT) AS tp, CAST(sum(n) OVER w AS BIGINT) AS fp,
         CAST(sum(p) OVER w AS DOUBLE) / (sum(p) OVER ()) AS tpr, CAST(sum(n) OVER w AS DOUBLE) / (sum(n) OVER ()) AS fpr
  FROM steps WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)
)
"""
AUC_SQL = """
ranked AS (
  SELECT *, rank() OVER (PARTITION BY grp ORDER BY score) + (count(*) OVER (PARTITION BY grp, score) - 1) / 2.0 AS r
  FROM grouped
),
aucs AS (
  SELECT grp, CASE WHEN count(*) FILTER (WHERE score IS NULL) > 0 THEN NULL
      WHEN count(*) FILTER (WHERE label = 1) = 0 OR count(*) FILTER (WHERE label = 0) = 0 THEN NULL
      ELSE (sum(CASE WHEN label = 1 THEN CAST(r AS DOUBLE) END)
            - count(*) FILTER (WHERE label = 1) * (count(*) FILTER (WHERE label = 1) + 1) / 2.0)
           / (count(*) FILTER (WHERE label = 1) * count(*) FILTER (WHERE label = 0)) END AS auc
  FROM ranked GROUP BY grp
)
"""


@query("roc_points", sql=ROC_SQL + "SELECT threshold, tp, fp, round(tpr, 9) AS tpr, round(fpr, 9) AS fpr FROM roc")
def roc_points(spark, folder):
    return metrics.roc_points(given.scored(spark, folder)).withColumns(
        {c: F.round(c, 9) for c in ("tpr", "fpr")}
    )


@query("select_threshold", sql=ROC_SQL + """
SELECT threshold, round(tpr - fpr, 9) AS youden_j FROM roc ORDER BY tpr - fpr DESC, threshold DESC LIMIT 1
""")
def select_threshold(spark, folder):
    return metrics.select_threshold(given.scored(spark, folder)).withColumn("youden_j", F.round("youden_j", 9))


@query("average_rank", sql=SCORED + """
SELECT score, count(*) AS ties, avg(CAST(rn AS DOUBLE)) AS average_rank
FROM (SELECT score, row_number() OVER (ORDER BY score) AS rn FROM scored) x GROUP BY score
""")
def average_rank(spark, folder):
    return metrics.average_rank(given.scored(spark, folder))


@query("auc_rank", sql=SCORED + ", grouped AS (SELECT split AS grp, label, score FROM scored), " + AUC_SQL + """
SELECT grp AS split, round(auc, 9) AS auc FROM aucs
""")
def auc_rank(spark, folder):
    return metrics.auc_rank(given.scored(spark, folder), ["split"]).withColumn("auc", F.round("auc", 9))


CELLS = """count(*) FILTER (WHERE label = 1 AND p = 1) AS tp, count(*) FILTER (WHERE label = 0 AND p = 0) AS tn,
         count(*) FILTER (WHERE label = 0 AND p = 1) AS fp, count(*) FILTER (WHERE label = 1 AND p = 0) AS fn"""


@query("confusion_matrix", sql=SCORED + f""",
c AS (SELECT {CELLS} FROM (SELECT label, CAST(score >= 1500 AS INTEGER) AS p FROM scored) d)
SELECT 0 AS actual, tn AS predicted_0, fp AS predicted_1 FROM c UNION ALL SELECT 1, fn, tp FROM c
""")
def confusion_matrix(spark, folder):
    return metrics.confusion_matrix(given.scored(spark, folder), 1500.0)


METRIC_SQL = """round(CAST(tp + tn AS DOUBLE) / nullif(tp + tn + fp + fn, 0), 9) AS accuracy,
       round((CAST(tp AS DOUBLE) / nullif(tp + fn, 0) + CAST(tn AS DOUBLE) / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy,
       round(CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 9) AS sensitivity,
       round(CAST(tn AS DOUBLE) / nullif(tn + fp, 0), 9) AS specificity"""


@query("threshold_metrics", sql=SCORED + f""", grouped AS (SELECT 1 AS grp, label, score FROM scored), {AUC_SQL},
c AS (SELECT {CELLS} FROM (SELECT label, CAST(score >= 1500 AS INTEGER) AS p FROM scored) d)
SELECT 1500.0::DOUBLE AS threshold, {METRIC_SQL}, round(auc, 9) AS roc_auc FROM c, aucs
""")
def threshold_metrics(spark, folder):
    out = metrics.threshold_metrics(given.scored(spark, folder), 1500.0)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "threshold"})


@query("evaluate", sql=SCORED + f""",
steps AS (SELECT score, count(*) FILTER (WHERE label = 1) AS p, count(*) FILTER (WHERE label = 0) AS n
          FROM scored WHERE split = 'val' GROUP BY score),
roc AS (SELECT score, CAST(sum(p) OVER w AS DOUBLE) / (sum(p) OVER ()) - CAST(sum(n) OVER w AS DOUBLE) / (sum(n) OVER ()) AS j
        FROM steps WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
best AS (SELECT score AS threshold FROM roc ORDER BY j DESC, score DESC LIMIT 1),
grouped AS (SELECT 1 AS grp, label, score FROM scored WHERE split = 'test'), {AUC_SQL},
c AS (SELECT {CELLS} FROM (SELECT label, CAST(score >= threshold AS INTEGER) AS p FROM scored, best WHERE split = 'test') d)
SELECT threshold, {METRIC_SQL}, round(auc, 9) AS roc_auc FROM c, aucs, best
""")
def evaluate(spark, folder):
    rows = given.scored(spark, folder)
    threshold = metrics.select_threshold(rows.where("split = 'val'"))
    out = metrics.threshold_metrics(rows.where("split = 'test'"), threshold)
    return out.withColumns({c: F.round(c, 9) for c in out.columns if c != "threshold"})


@query("outcome_counts", sql=SCORED + """
SELECT CASE WHEN label = 1 AND score >= 1500 THEN 'TP' WHEN label = 0 AND score < 1500 THEN 'TN'
            WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome, count(*) AS n FROM scored GROUP BY 1
""")
def outcome_counts(spark, folder):
    decided = given.scored(spark, folder).withColumn("predicted", (F.col("score") >= 1500).cast("int"))
    return metrics.outcome_counts(decided, "label", "predicted")


@query("exclude_other_model_and_split", sql=CATALOG + """
SELECT count(*) FILTER (WHERE outcome = 'unlabeled') AS unlabeled,
       count(*) FILTER (WHERE outcome <> 'unlabeled' AND model_version IS DISTINCT FROM 'v1') AS other_version,
       count(*) FILTER (WHERE outcome <> 'unlabeled' AND model_version = 'v1' AND split NOT IN ('train','val','test')) AS outside_model_splits,
       count(*) FILTER (WHERE outcome <> 'unlabeled' AND model_version = 'v1' AND split IN ('train','val','test')) AS used
FROM catalog
""")
def exclude_other_model_and_split(spark, folder):
    return metrics.metric_input_report(given.catalog(spark, folder), "v1")


@query("split_metrics", sql=CATALOG + f""",
used AS (SELECT split, CAST(true_class = 'pneumonia' AS INTEGER) AS label, positive_score AS score,
                CAST(predicted_class = 'pneumonia' AS INTEGER) AS p
         FROM catalog WHERE outcome <> 'unlabeled' AND model_version = 'v1' AND split IN ('train','val','test')),
both_levels AS (SELECT split AS grp, label, score, p FROM used
                UNION ALL SELECT 'all', label, score, p FROM used WHERE (SELECT count(DISTINCT split) FROM used) <> 1),
grouped AS (SELECT grp, label, score FROM both_levels), {AUC_SQL},
c AS (SELECT grp, count(*) AS records, {CELLS} FROM both_levels GROUP BY grp)
SELECT grp AS split, records, tp, fn, fp, tn, {METRIC_SQL},
       round(CAST(tp AS DOUBLE) / nullif(tp + fp, 0), 9) AS precision,
       round(2.0 * (CAST(tp AS DOUBLE) / nullif(tp + fp, 0)) * (CAST(tp AS DOUBLE) / nullif(tp + fn, 0))
             / nullif(CAST(tp AS DOUBLE) / nullif(tp + fp, 0) + CAST(tp AS DOUBLE) / nullif(tp + fn, 0), 0), 9) AS f1,
       round(auc, 9) AS auc
FROM c JOIN aucs USING (grp)
""")
def split_metrics(spark, folder):
    out = metrics.split_metrics(metrics.model_metric_input(given.catalog(spark, folder), "v1"))
    return out.withColumns({c: F.round(c, 9) for c in (*metrics.metric_columns(), "auc")})


# --- Predictions of several models ----------------------------------------------

# Two models that score the same documents; their thresholds come from validation.
CANDIDATES_SQL = ASSIGNED_SQL + f""",
rows AS (
  SELECT m.assigned_split AS split, m.source_split, m.source_index, m.label, m.content_hash, d.n_chars,
         {given.uuid_sql('m.source_split', 'm.source_index', 'm.content_hash')} AS record_id
  FROM manifest m JOIN docs d ON d.split = m.source_split AND d.split_index = m.source_index
),
long AS (
  SELECT *, 'logistic' AS model, 1 / (1 + exp(-(n_chars / 1000.0 - 2.0))) AS prediction_score FROM rows
  UNION ALL SELECT *, 'svm' AS model, (n_chars % 1000) / 500.0 - 1.0 FROM rows
),
models AS (SELECT model, round(avg(prediction_score), 6) AS threshold FROM long WHERE split = 'val' GROUP BY model),
decided AS (
  SELECT l.*, threshold, CAST(round(prediction_score, 9) >= threshold AS INTEGER) AS predicted_label FROM long l JOIN models USING (model)
)
"""


def candidate_scores(spark, folder) -> DataFrame:
    """Retained documents under both models: the manifest joined to stored metadata, one row per model."""
    stored = materialize(given.docs(spark, folder), "docs")  # texts are read and hashed once
    joined = predictions.join_manifest_metadata(assigned_docs(spark, folder, stored), stored, also=["n_chars"])
    n = F.col("n_chars")
    both = F.array(
        F.struct(F.lit("logistic").alias("model"), F.round(sigmoid(n / F.lit(1000.0) - 2.0), 9).alias("prediction_score")),
        F.struct(F.lit("svm").alias("model"), F.round(n % 1000 / F.lit(500.0) - 1.0, 9).alias("prediction_score")),
    )
    return materialize(joined.select(
        "record_id", F.col("assigned_split").alias("split"), "source_split", "source_index", "label", F.inline(both)
    ), "scores")


def candidate_models(scores: DataFrame) -> DataFrame:
    thresholds = scores.where("split = 'val'").groupBy("model").agg(
        F.round(F.avg("prediction_score"), 6).alias("threshold")
    )
    provenance = scores.sparkSession.createDataFrame(
        [("svm", True, "tracked", "runs/run-svm/model", "store", "trials", "7", "run-svm", "margin", None)], S.PROVENANCE
    )
    known = thresholds.withColumn("model_file", F.concat(F.lit("models/"), F.col("model")))
    return predictions.provenance_defaults(known, provenance).withColumn(
        "score_type", F.when(F.col("model") == "svm", "margin").otherwise("probability")
    )


def prediction_rows(spark, folder) -> DataFrame:
    scores = candidate_scores(spark, folder)
    return predictions.prediction_table(scores, candidate_models(scores))


PREDICTION_SQL = CANDIDATES_SQL + """,
predictions AS (
  SELECT record_id, split, source_split, source_index, label,
         CASE label WHEN 0 THEN 'normal' ELSE 'pneumonia' END AS true_class, model,
         round(prediction_score, 9) AS prediction_score, CASE model WHEN 'svm' THEN 'margin' ELSE 'probability' END AS score_type,
         threshold, predicted_label, CASE predicted_label WHEN 0 THEN 'normal' ELSE 'pneumonia' END AS predicted_class,
         'models/' || model AS model_file, CASE model WHEN 'svm' THEN 'trials' END AS experiment_name,
         CASE model WHEN 'svm' THEN '7' END AS experiment_id, CASE model WHEN 'svm' THEN 'run-svm' END AS run_id,
         CASE model WHEN 'svm' THEN 'margin' END AS run_name, CASE model WHEN 'svm' THEN 'store' END AS tracking_uri,
         CASE WHEN label = 1 AND predicted_label = 1 THEN 'TP' WHEN label = 0 AND predicted_label = 0 THEN 'TN'
              WHEN label = 0 THEN 'FP' ELSE 'FN' END AS outcome, label = predicted_label AS correct
  FROM decided
)
"""


@query("predict_table", sql=PREDICTION_SQL + "SELECT * FROM predictions")
def predict_table(spark, folder):
    return prediction_rows(spark, folder)


@query("sink_predictions", sql=PREDICTION_SQL + """
SELECT model, split, count(*) AS rows, count(*) FILTER (WHERE correct) AS correct FROM predictions GROUP BY model, split
""")
def sink_predictions(spark, folder):
    path = scratch_path(spark, "predictions")
    sinks.sink_predictions(prediction_rows(spark, folder), path, predictions.parse_model_list("all"))
    return spark.read.parquet(path).groupBy("model", "split").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("correct").alias("correct")
    )


@query("prediction_disagreement", sql=PREDICTION_SQL + """
SELECT record_id, count(*) AS models, CAST(sum(predicted_label) AS BIGINT) AS positive_votes, min(label) AS label
FROM predictions GROUP BY record_id HAVING sum(predicted_label) > 0 AND sum(predicted_label) < count(*)
""")
def prediction_disagreement(spark, folder):
    return predictions.disagreements(prediction_rows(spark, folder))


@query("join_manifest_metadata", sql=ASSIGNED_SQL + f"""
SELECT source_split, source_index, label, content_hash, assigned_split,
       {given.uuid_sql('source_split', 'source_index', 'content_hash')} AS record_id, label AS stored_label,
       content_hash AS stored_hash FROM assigned
""")
def join_manifest_metadata(spark, folder):
    return predictions.join_manifest_metadata(assigned_docs(spark, folder), given.docs(spark, folder)).drop("pool_rank")


@query("check_hash_match", sql=ASSIGNED_SQL + """
SELECT count(*) FILTER (WHERE source_index % 7 = 0) AS missing_rows,
       count(*) FILTER (WHERE source_index % 7 <> 0 AND source_index % 11 = 0) AS hash_mismatches,
       count(*) FILTER (WHERE source_index % 7 <> 0 AND source_index % 13 = 0) AS label_mismatches FROM assigned
""")
def check_hash_match(spark, folder):
    """Stored metadata that lost every 7th row, and has another hash every 11th and another label every 13th."""
    i = F.col("split_index")
    stored = given.docs(spark, folder).where(i % 7 != 0).withColumns({
        "content_hash": F.when(i % 11 == 0, F.upper("content_hash")).otherwise(F.col("content_hash")),
        "label": F.when(i % 13 == 0, 1 - F.col("label")).otherwise(F.col("label")),
    })
    joined = predictions.join_manifest_metadata(assigned_docs(spark, folder), stored)
    return predictions.manifest_problems(joined)


@query("join_labels_check", sql=ASSIGNED_SQL + """
SELECT count(*) AS rows, count(*) FILTER (WHERE l.quality IS NULL) AS without_stored_label,
       count(*) FILTER (WHERE l.quality <> a.label) AS mismatches
FROM assigned a LEFT JOIN labels l ON l.doc_id = a.source_index
""")
def join_labels_check(spark, folder):
    stored = given.table(spark, folder, "labels").select(F.col("doc_id").alias("source_index"), "quality")
    return assigned_docs(spark, folder).join(stored, "source_index", "left").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.col("quality").isNull()).alias("without_stored_label"),
        F.count_if(F.col("quality") != F.col("label")).alias("mismatches"),
    )


@query("broadcast_model", sql=CANDIDATES_SQL + """
SELECT record_id, model, threshold, predicted_label FROM decided
""")
def broadcast_model(spark, folder):
    scores = candidate_scores(spark, folder)
    known = candidate_models(scores).select("model", "threshold")  # one row per trained model
    return scores.join(broadcast_if_small(known), "model").select(
        "record_id", "model", "threshold", (F.col("prediction_score") >= F.col("threshold")).cast("int").alias("predicted_label")
    )


@query("provenance_defaults", sql=CANDIDATES_SQL + """
SELECT model, threshold, model = 'svm' AS provenance_available,
       CASE model WHEN 'svm' THEN 'tracked' ELSE 'local_joblib' END AS model_source,
       CASE model WHEN 'svm' THEN 'runs/run-svm/model' ELSE 'models/' || model END AS model_path,
       CASE model WHEN 'svm' THEN 'run-svm' END AS run_id FROM models
""")
def provenance_defaults(spark, folder):
    return candidate_models(candidate_scores(spark, folder)).select(
        "model", "threshold", "provenance_available", "model_source", "model_path", "run_id"
    )


@query("scan_model_metrics", sql=CANDIDATES_SQL + """
SELECT n.model, coalesce(m.threshold, 0.5) AS threshold
FROM (VALUES ('logistic'), ('svm'), ('xgboost')) n(model) LEFT JOIN models m USING (model)
""")
def scan_model_metrics(spark, folder):
    names = spark.createDataFrame([(m,) for m in S.MODEL_NAMES], "model string")
    stored = candidate_models(candidate_scores(spark, folder)).select("model", "threshold")
    current = names.join(stored, "model", "left").withColumns(
        {"run_id": F.lit("current"), "logged_at": F.lit("2024-01-02 00:00:00").cast("timestamp")})
    earlier = current.withColumns({  # a larger threshold, as of an earlier run
        "threshold": F.lit(99.0), "run_id": F.lit("earlier"), "logged_at": F.lit("2024-01-01 00:00:00").cast("timestamp")})
    return tables.model_metric(earlier.unionByName(current), "threshold", missing="half")


COMPARISON_SQL = CANDIDATES_SQL + ", grouped AS (SELECT model AS grp, label, round(prediction_score, 9) AS score FROM long WHERE split = 'val'), " + AUC_SQL


def comparison(scores: DataFrame) -> DataFrame:
    val = scores.where("split = 'val'")
    aucs = metrics.auc_rank(val, ["model"], score="prediction_score").select(
        "model", F.round("auc", 9).alias("validation_roc_auc")
    )
    return predictions.model_comparison(aucs)


@query("model_rank", sql=COMPARISON_SQL + """
SELECT CAST(row_number() OVER (ORDER BY round(auc, 9) DESC, grp) AS INTEGER) AS rank, grp AS model,
       round(auc, 9) AS validation_roc_auc, row_number() OVER (ORDER BY round(auc, 9) DESC, grp) = 1 AS selected FROM aucs
""")
def model_rank(spark, folder):
    return comparison(candidate_scores(spark, folder))


@query("select_best", sql=COMPARISON_SQL + """
SELECT grp AS selected_model, 'models/' || grp AS model_path, 'validation_roc_auc' AS selection_metric,
       round(auc, 9) AS selection_score, threshold AS decision_threshold
FROM aucs JOIN models ON model = grp ORDER BY round(auc, 9) DESC, grp LIMIT 1
""")
def select_best(spark, folder):
    scores = candidate_scores(spark, folder)
    known = candidate_models(scores).select("model", "threshold", F.col("model_file").alias("model_path"))
    ranked = comparison(scores).join(known, "model")
    return predictions.selection_manifest(ranked).drop("selection_rule")


@query("class_weights", sql="WITH " + given.DOCS_SQL + """
SELECT label, count(*) AS n, round((SELECT count(*) FROM docs) * 1.0 / (2 * count(*)), 9) AS weight FROM docs GROUP BY label
""")
def class_weights(spark, folder):
    return models.class_weights(given.docs(spark, folder)).withColumn("weight", F.round("weight", 9))


@query("search_rank", sql="""
SELECT CAST(rank() OVER (ORDER BY mean_test_score DESC) AS INTEGER) AS rank_test_score, source, mean_test_score
FROM (SELECT source, round(avg(CAST(quality AS DOUBLE)), 3) AS mean_test_score FROM documents JOIN labels USING (doc_id) GROUP BY source) s
""")
def search_rank(spark, folder):
    """Sources of documents stand for settings: a few candidates, some with equal scores."""
    rows = given.table(spark, folder, "documents").join(given.table(spark, folder, "labels"), "doc_id")
    scores = rows.groupBy("source").agg(F.round(F.avg(F.col("quality").cast("double")), 3).alias("mean_test_score"))
    return models.rank_candidates(scores)
