"""Queries: moments, training, tuning and attribution."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievemark import schemas as S

from sievemark.operators import attribution, checks, metrics, models, splits
from sievemark.operators.dedup import pool_splits
from sievemark.plans import given
from sievemark.plans.curation import ASSIGN_STEPS
from sievemark.plans.registry import query
from sievemark.session import materialize, scratch_path
from sievemark.sources import sinks

SAMPLES = "WITH " + given.SAMPLES_SQL

# Deduplicated vectors under their assigned split.
TRAINING_SQL = SAMPLES + """,
pooled AS (
  SELECT split AS source_split, split_index AS source_index, label, content_hash,
         CASE split WHEN 'train' THEN 1 WHEN 'val' THEN 2 ELSE 3 END AS pool_rank
  FROM indexed
),
""" + given.KEPT_SQL + ASSIGN_STEPS

MOMENTS_SQL = """
cells AS (SELECT vec_id, split, label, generate_subscripts(vec, 1) - 1 AS feature, unnest(vec) AS x FROM samples),
moments AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS scale FROM cells WHERE split = 'train' GROUP BY feature)
"""


def training_samples(spark, folder):
    """Vectors under their deduplicated split."""
    rows = materialize(given.samples(spark, folder, indexed=True), "samples")
    manifest = splits.build_splits(pool_splits(rows.select("split", "split_index", "label", "content_hash")))
    lookup = manifest.select(
        F.col("source_split").alias("split"), F.col("source_index").alias("split_index"), "assigned_split"
    )
    return materialize(rows.join(lookup, ["split", "split_index"]), "training")


@query("feature_moments", sql=SAMPLES + "," + MOMENTS_SQL + """
SELECT feature, round(mean, 9) AS mean, round(scale, 9) AS scale FROM moments
""")
def feature_moments(spark, folder):
    train = given.samples(spark, folder).where("split = 'train'")
    return models.moment_rows(models.feature_moments(train)).select(
        F.col("feature").cast("long").alias("feature"), F.round("mean", 9).alias("mean"), F.round("scale", 9).alias("scale")
    )


@query("background_mean", sql=SAMPLES + """,
background AS (SELECT vec FROM samples WHERE split = 'train' ORDER BY sha256('42:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 100)
SELECT feature, round(avg(x), 9) AS mean
FROM (SELECT generate_subscripts(vec, 1) - 1 AS feature, unnest(vec) AS x FROM background) c GROUP BY feature
""")
def background_mean(spark, folder):
    train = given.samples(spark, folder).where("split = 'train'")
    sample = splits.seeded_sample(train, S.BACKGROUND_SIZE, "vec_id")
    return models.moment_rows(models.feature_moments(sample)).select(
        F.col("feature").cast("long").alias("feature"), F.round("mean", 9).alias("mean")
    )


# A linear model fitted in closed form, so that SQL can follow it: standardised
# class means, b = (m1 - m0) / scale.
CENTROID_SQL = SAMPLES + "," + MOMENTS_SQL + """,
class_means AS (
  SELECT feature, avg(x) FILTER (WHERE label = 1) AS m1, avg(x) FILTER (WHERE label = 0) AS m0
  FROM cells WHERE split = 'train' GROUP BY feature
),
model AS (SELECT feature, mean, scale, (m1 - m0) / scale AS beta FROM moments JOIN class_means USING (feature)),
intercept AS (SELECT -sum(beta * ((m1 - mean) + (m0 - mean)) / (2 * scale)) AS b FROM model JOIN class_means USING (feature)),
phis AS (SELECT vec_id, feature, x, beta * (x - mean) / scale AS phi FROM cells JOIN model USING (feature)),
margins AS (SELECT vec_id, sum(phi) + (SELECT b FROM intercept) AS margin FROM phis GROUP BY vec_id)
"""


def centroid_model(spark, folder) -> models.LogisticModel:
    train = given.samples(spark, folder).where("split = 'train'")
    scaler = models.Standardizer.fit(train)
    m1, m0 = (models.feature_moments(train.where(F.col("label") == c)).first()["mean"] for c in (1, 0))
    beta = tuple((a - b) / s for a, b, s in zip(m1, m0, scaler.scale))
    middle = ((a - m) + (b - m) for a, b, m in zip(m1, m0, scaler.mean))
    intercept = -sum(w * c / (2 * s) for w, c, s in zip(beta, middle, scaler.scale))
    return models.LogisticModel(scaler, beta, intercept)


def explained(spark, folder):
    rows = given.samples(spark, folder)
    return attribution.explain_linear(rows, centroid_model(spark, folder))


@query("linear_attribution", sql=CENTROID_SQL + """
SELECT vec_id, round(margin, 6) AS margin, round(1 / (1 + exp(-margin)), 6) AS probability,
       round((SELECT b FROM intercept), 6) AS base, true AS additive FROM margins
""")
def linear_attribution(spark, folder):
    return explained(spark, folder).select(
        "vec_id", F.round("margin", 6).alias("margin"), F.round("probability", 6).alias("probability"),
        F.round("base", 6).alias("base"), (F.abs("residual") < 1e-8).alias("additive"),
    )


@query("attribution_pixels", sql=CENTROID_SQL + """
SELECT vec_id, CAST(feature // 8 AS INTEGER) AS "row", CAST(feature % 8 AS INTEGER) AS "column",
       round(x, 6) AS intensity, round(phi, 6) AS attribution FROM phis
""")
def attribution_pixels(spark, folder):
    return attribution.attribution_pixels(explained(spark, folder), given.WIDTH, "vec_id").withColumns(
        {c: F.round(c, 6) for c in ("intensity", "attribution")}
    )


@query("attribution_scale", sql=CENTROID_SQL + """
SELECT vec_id, round(CASE WHEN max(abs(phi)) = 0 THEN 1 ELSE max(abs(phi)) END, 6) AS scale FROM phis GROUP BY vec_id
""")
def attribution_scale(spark, folder):
    return attribution.attribution_scale(explained(spark, folder)).select("vec_id", F.round("scale", 6).alias("scale"))


@query("attribution_summary", sql=CENTROID_SQL + """
SELECT vec_id, split, label, 'logistic' AS model, round(1 / (1 + exp(-margin)), 6) AS positive_probability,
       0.5::DOUBLE AS decision_threshold, CAST(margin >= 0 AS INTEGER) AS prediction,
       CASE WHEN margin >= 0 THEN 'pneumonia' ELSE 'normal' END AS predicted_label
FROM margins JOIN samples USING (vec_id)
""")
def attribution_summary(spark, folder):
    rows = explained(spark, folder).withColumns({"record_id": F.col("vec_id"), "split_index": F.col("vec_id")})
    out = attribution.attribution_summary(rows, F.lit(0.5), "logistic")
    return out.drop("split_index").withColumnRenamed("record_id", "vec_id").withColumn(
        "positive_probability", F.round("positive_probability", 6)
    )


@query("sink_summary", sql=CENTROID_SQL + """
SELECT CAST(vec_id AS VARCHAR) AS record_id, CAST(margin >= 0 AS INTEGER) AS prediction,
       CASE WHEN margin >= 0 THEN 'pneumonia' ELSE 'normal' END AS predicted_label, 'logistic' AS model
FROM margins
""")
def sink_summary(spark, folder):
    path = scratch_path(spark, "summary")
    rows = explained(spark, folder).withColumns({"record_id": F.col("vec_id"), "split_index": F.col("vec_id")})
    sinks.write_csv(attribution.attribution_summary(rows, F.lit(0.5), "logistic"), path)
    return spark.read.option("header", True).csv(path).select(
        "record_id", F.col("prediction").cast("int").alias("prediction"), "predicted_label", "model"
    )


@query("sink_pixel_long", sql=CENTROID_SQL + """
SELECT CAST(feature // 8 AS INTEGER) AS "row", count(*) AS n, round(sum(phi), 6) AS total FROM phis GROUP BY 1
""")
def sink_pixel_long(spark, folder):
    path = scratch_path(spark, "pixels")
    sinks.sink_pixel_long(attribution.attribution_pixels(explained(spark, folder), given.WIDTH, "vec_id"), path)
    read = spark.read.schema("vec_id bigint, row int, column int, intensity double, attribution double")
    return read.option("header", True).csv(path).groupBy("row").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("attribution"), 6).alias("total")
    )


@query("check_additivity", sql=CENTROID_SQL + "SELECT vec_id FROM margins WHERE vec_id % 13 = 0 OR vec_id % 17 = 0")
def check_additivity(spark, folder):
    """Every 13th margin and every 17th probability is shifted."""
    i = F.col("vec_id")
    rows = explained(spark, folder).withColumns({
        "margin": F.when(i % 13 == 0, F.col("margin") + 0.001).otherwise(F.col("margin")),
        "probability": F.when(i % 17 == 0, F.col("probability") + 0.001).otherwise(F.col("probability")),
    })
    return checks.check_additivity(rows).select("vec_id")


# --- Fitted models: SQL states which rows are tested and what any fit must satisfy, and repeats small fits -----------

FITTED_SQL = TRAINING_SQL + """,
training AS (
  SELECT i.vec_id, i.vec, i.label, i.content_hash FROM assigned a
  JOIN indexed i ON i.split = a.source_split AND i.split_index = a.source_index WHERE a.assigned_split = 'train'
),
train_cells AS (SELECT vec_id, label, generate_subscripts(vec, 1) - 1 AS feature, unnest(vec) AS x FROM training),
scales AS (SELECT feature, avg(x) AS mean, stddev_pop(x) AS scale FROM train_cells GROUP BY feature),
tested AS (
  SELECT count(*) FILTER (WHERE label = 0) AS test_negatives, count(*) FILTER (WHERE label = 1) AS test_positives
  FROM assigned WHERE assigned_split = 'test'
)
"""


def newton_sql(points: str, loss: str, C: float, penalise_intercept: int, rounds: int) -> str:
    """Newton's method for one weight and an intercept: ``points`` has x and y (-1 or 1), ``loss`` gives d1 and d2 by the margin m."""
    return f"""
fit(step, w, b) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT step + 1, w - (hbb * gw - hwb * gb) / (hww * hbb - hwb * hwb), b - (hww * gb - hwb * gw) / (hww * hbb - hwb * hwb)
  FROM (
    SELECT any_value(step) AS step, any_value(w) AS w, any_value(b) AS b,
           any_value(w) + {C} * sum(d1 * y * x) AS gw, {penalise_intercept} * any_value(b) + {C} * sum(d1 * y) AS gb,
           1 + {C} * sum(d2 * x * x) AS hww, {penalise_intercept} + {C} * sum(d2) AS hbb, {C} * sum(d2 * x) AS hwb
    FROM (SELECT *, {loss} FROM (SELECT step, w, b, x, y, y * (w * x + b) AS m FROM fit, ({points}) p WHERE step < {rounds}) q) d
    HAVING count(*) > 0
  ) s
)
"""


def fitted_summary(rows, model, better: float = 0.5):
    """Test rows by class from the confusion matrix, whether the fit beats an area on the rows it was
    fitted to, and whether the reported accuracy is that of the matrix."""
    result = materialize(models.evaluate(rows, model), "result")
    matrix = metrics.confusion_matrix(model.score(rows.where("assigned_split = 'test'")), result.select("threshold"))
    total = F.col("predicted_0") + F.col("predicted_1")
    right = F.when(F.col("actual") == 0, F.col("predicted_0")).otherwise(F.col("predicted_1"))
    counted = matrix.agg(
        F.sum(F.when(F.col("actual") == 0, total)).alias("test_negatives"),
        F.sum(F.when(F.col("actual") == 1, total)).alias("test_positives"), (F.sum(right) / F.sum(total)).alias("share"),
    )
    auc = metrics.auc_rank(model.score(rows.where("assigned_split = 'train'"))).select(F.col("auc").alias("train_auc"))
    one = lambda df: F.broadcast(df.withColumn("_one", F.lit(1)))
    return result.select("model", "accuracy").withColumn("_one", F.lit(1)).join(one(counted), "_one").join(one(auc), "_one").select(
        "model", "test_negatives", "test_positives", (F.col("train_auc") > better).alias(f"train_auc>{better}"),
        (F.abs(F.col("accuracy") - F.col("share")) < 1e-12).alias("metrics_agree"),
    )


ONE_FEATURE = "SELECT (x - mean) / scale AS x, 2 * label - 1 AS y FROM train_cells JOIN scales USING (feature) WHERE feature = 0"


@query("fit_logistic", sql=FITTED_SQL.replace("WITH", "WITH RECURSIVE", 1) + "," + newton_sql(
    ONE_FEATURE, "-1 / (1 + exp(m)) AS d1, exp(m) / ((1 + exp(m)) * (1 + exp(m))) AS d2", 0.1, 1, 12) + """
SELECT 'logistic' AS model, test_negatives, test_positives, true AS "train_auc>0.5", true AS metrics_agree,
       round(w, 6) AS coefficient, round(b, 6) AS intercept
FROM tested, fit WHERE step = 12
""")
def fit_logistic(spark, folder):
    """A fit to all features, and the numbers of a fit to the first."""
    rows = training_samples(spark, folder)
    train = rows.where("assigned_split = 'train'")
    one = models.fit_logistic(train.withColumn("vec", F.slice("vec", 1, 1)), C=0.1)
    return fitted_summary(rows, models.fit_logistic(train, C=0.1)).withColumns({
        "coefficient": F.round(F.lit(one.coefficients[0]), 6), "intercept": F.round(F.lit(one.intercept), 6)})


@query("fit_margin", sql=FITTED_SQL.replace("WITH", "WITH RECURSIVE", 1) + """,
landmark AS (SELECT vec FROM training ORDER BY sha256('42:' || content_hash) LIMIT 1),
landmark_cells AS (SELECT generate_subscripts(vec, 1) - 1 AS feature, unnest(vec) AS z FROM landmark),
kernel AS (
  SELECT vec_id, any_value(label) AS label, exp(-0.01 * sum(CASE WHEN scale > 0 THEN ((x - z) / scale) * ((x - z) / scale) ELSE 0 END)) AS k
  FROM train_cells JOIN scales USING (feature) JOIN landmark_cells USING (feature) GROUP BY vec_id
),""" + newton_sql("SELECT k AS x, 2 * label - 1 AS y FROM kernel", "-2 * greatest(0, 1 - m) AS d1, CASE WHEN m < 1 THEN 2 ELSE 0 END AS d2", 1.0, 0, 30) + """
SELECT 'svm' AS model, test_negatives, test_positives, true AS "train_auc>0.5", true AS metrics_agree,
       round(w, 6) AS landmark_weight, round(b, 6) AS intercept
FROM tested, fit WHERE step = 30
""")
def fit_margin(spark, folder):
    """A fit with the usual landmarks, and the numbers of a fit with one."""
    rows = training_samples(spark, folder)
    train = rows.where("assigned_split = 'train'")
    one = models.fit_margin(train, C=1.0, gamma=0.01, landmarks=1)
    return fitted_summary(rows, models.fit_margin(train)).withColumns({
        "landmark_weight": F.round(F.lit(one.coefficients[0]), 6), "intercept": F.round(F.lit(one.intercept), 6)})


@query("fit_boosted", sql=FITTED_SQL + """,
cuts AS (
  SELECT DISTINCT feature, cut FROM (
    SELECT feature, unnest(quantile_disc(x, list_transform(range(1, 64), lambda i: i / 64.0))) AS cut, max(x) AS top FROM train_cells GROUP BY feature
  ) q WHERE cut < top
),
-- Before the first tree every probability is 0.5: gradients are 0.5 - label, hessians 0.25.
sums AS (
  SELECT c.feature, cut, sum(0.5 - label) AS gl, count(*) * 0.25 AS hl
  FROM cuts c JOIN train_cells t ON t.feature = c.feature AND t.x <= c.cut GROUP BY c.feature, cut
),
whole AS (SELECT sum(0.5 - label) AS g, count(*) * 0.25 AS h FROM training),
gains AS (
  SELECT feature, cut, hl AS left_hessian, h - hl AS right_hessian,
         0.5 * (gl * gl / (hl + 1) + (g - gl) * (g - gl) / (h - hl + 1) - g * g / (h + 1)) AS gain
  FROM sums, whole WHERE hl >= 3 AND h - hl >= 3
)
SELECT 'xgboost' AS model, test_negatives, test_positives, true AS "train_auc>0.5", true AS metrics_agree,
       CAST(feature AS INTEGER) AS first_feature, round(cut, 6) AS first_cut, round(gain, 6) AS first_gain,
       CAST(left_hessian AS DOUBLE) AS left_hessian, CAST(right_hessian AS DOUBLE) AS right_hessian
FROM tested, (SELECT * FROM gains ORDER BY round(gain, 9) DESC, feature, cut LIMIT 1) best
""")
def fit_boosted(spark, folder):
    """A fit, and its first split."""
    rows = training_samples(spark, folder)
    model = models.fit_boosted(rows.where("assigned_split = 'train'"), n_estimators=10, max_depth=3, min_child_weight=3, max_bins=64)
    tree = model.trees[0]
    return fitted_summary(rows, model).withColumns({
        "first_feature": F.lit(tree.feature[0]).cast("int"), "first_cut": F.round(F.lit(tree.cut[0]), 6), "first_gain": F.round(F.lit(tree.gain[0]), 6),
        "left_hessian": F.round(F.lit(tree.cover[tree.left[0]]), 6), "right_hessian": F.round(F.lit(tree.cover[tree.right[0]]), 6)})


# Settings under which some weights are left: a model that scores every row alike has an area of 0.5.
TUNED_GRID = {"C": [0.1, 0.3, 1.0, 3.0], "penalty": ["l1", "l2"], "class_weight": [None, "balanced"]}


@query("tune_and_fit", sql=FITTED_SQL + """
SELECT 'logistic' AS model, test_negatives, test_positives, true AS "train_auc>0.6", true AS metrics_agree FROM tested
""")
def tune_and_fit(spark, folder):
    rows = training_samples(spark, folder)
    return fitted_summary(rows, models.tune_and_fit(rows, "logistic", grid=TUNED_GRID, n_iter=6).model, 0.6)


@query("search_results", sql=TRAINING_SQL + """
SELECT setting, true AS scored, true AS ranked, (SELECT count(*) FROM assigned WHERE assigned_split = 'train') AS train_rows
FROM (VALUES ('{"C": 0.001, "class_weight": null, "penalty": "l1"}'), ('{"C": 0.03, "class_weight": "balanced", "penalty": "l1"}'),
             ('{"C": 0.001, "class_weight": null, "penalty": "l2"}')) s(setting)
""")
def search_results(spark, folder):
    """Scores are areas, ranks follow them, and a model without weights left scores 0.5 in every fold."""
    rows = training_samples(spark, folder)
    found = models.tune_and_fit(rows, "logistic", use_cv=True, n_iter=3)
    train_rows = F.lit(rows.where("assigned_split = 'train'").count())
    score, scores = F.col("mean_test_score"), [r["mean_test_score"] for r in found.results]
    better = sum(((F.lit(s) > score).cast("int") for s in scores), F.lit(0))
    constant = F.col("setting").contains('"C": 0.001') & F.col("setting").contains('"l1"')
    return models.search_results(spark, found).select(
        "setting", F.when(constant, (score == 0.5) & (F.col("std_test_score") == 0)).otherwise(score.between(0.2, 0.9)).alias("scored"),
        (F.col("rank_test_score") == better + 1).alias("ranked"), train_rows.alias("train_rows"))


@query("tree_attribution", sql=TRAINING_SQL + """
SELECT vec_id, true AS additive FROM assigned a JOIN indexed i ON i.split = a.source_split AND i.split_index = a.source_index
""")
def tree_attribution(spark, folder):
    rows = training_samples(spark, folder)
    model = models.fit_boosted(rows.where("assigned_split = 'train'"), n_estimators=10, max_depth=3)
    out = attribution.explain_trees(rows, model, key="vec_id")
    return out.select("vec_id", (F.abs("residual") < 1e-8).alias("additive"))


@query("sink_model_metrics", sql=TRAINING_SQL + """
SELECT 'logistic' AS model, run_id, label AS actual, count(*) AS n FROM assigned, (VALUES ('run-1'), ('run-2')) r(run_id)
WHERE assigned_split = 'test' GROUP BY run_id, label
""")
def sink_model_metrics(spark, folder):
    """Two runs of one model appended to the same tables."""
    rows = training_samples(spark, folder)
    path = scratch_path(spark, "metrics")
    for i, strength in enumerate((0.1, 1.0), start=1):
        model = models.fit_logistic(rows.where("assigned_split = 'train'"), C=strength)
        run = {"run_id": F.lit(f"run-{i}"), "logged_at": F.timestamp_seconds(F.lit(1704067200 + i))}
        result = materialize(models.evaluate(rows, model).withColumns(run), "result")
        scored = model.score(rows.where("assigned_split = 'test'"))
        matrix = metrics.confusion_matrix(scored, result.select("threshold"))
        sinks.sink_model_metrics(result, matrix.withColumns({"model": F.lit(model.name), **run}), path)
    return spark.read.parquet(f"{path}/confusion").select(
        "model", "run_id", "actual", (F.col("predicted_0") + F.col("predicted_1")).alias("n"))
