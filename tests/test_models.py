"""Training, tuning, selection and attribution."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.identity import dataset_namespace
from sievemark.operators import attribution, checks, ingest, metrics, models, predictions
from sievemark.plans import flows
from sievemark.session import materialize, scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    """150 rows of 4 features; the last is constant; the label follows the first two."""
    rng = np.random.default_rng(1)
    x = rng.normal(100, 30, (150, 4))
    x[:, 3] = 77
    y = (x[:, 0] + x[:, 1] + rng.normal(0, 10, 150) > 200).astype(int)
    data = [(f"r{i:03d}", ("train", "val", "test")[0 if i < 90 else 1 if i < 120 else 2], i, int(y[i]), x[i].tolist(),
             f"{i:064x}") for i in range(150)]
    df = spark.createDataFrame(
        data, "record_id string, split string, split_index bigint, label int, vec array<double>, content_hash string")
    return materialize(df.withColumn("assigned_split", F.col("split")))


@pytest.fixture(scope="module")
def train(rows):
    return rows.where("assigned_split = 'train'")


@pytest.fixture(scope="module")
def logistic(train):
    return models.fit_logistic(train, C=1.0)


@pytest.fixture(scope="module")
def boosted(train):
    return models.fit_boosted(train, n_estimators=5, max_depth=3)


def matrix(df):
    return np.array([r["vec"] for r in df.orderBy("record_id").collect()])


def coalition_values(value, m):
    """Shapley values by enumerating every coalition of m players."""
    phi = np.zeros(m)
    for j in range(m):
        others = [k for k in range(m) if k != j]
        for size in range(m):
            weight = math.factorial(size) * math.factorial(m - 1 - size) / math.factorial(m)
            for s in itertools.combinations(others, size):
                phi[j] += weight * (value(set(s) | {j}) - value(set(s)))
    return phi


def test_moments_are_population_moments(train):
    x = matrix(train)
    row = models.feature_moments(train).first()
    assert row["mean"] == pytest.approx(x.mean(axis=0)) and row["scale"] == pytest.approx(x.std(axis=0))


def test_logistic_separates(rows, logistic):
    result = models.evaluate(rows, logistic).first()
    assert result["roc_auc"] > 0.9 and result["accuracy"] > 0.75


def test_linear_attribution_against_every_coalition(spark, rows, train, logistic):
    got = attribution.explain_linear(rows, logistic, background=train).orderBy("record_id").limit(3).collect()
    x, background = matrix(rows), matrix(train)
    scale = np.array([s or 1.0 for s in logistic.standardizer.scale])
    z = (x - logistic.standardizer.mean) / scale
    r = ((background - logistic.standardizer.mean) / scale).mean(axis=0)
    beta = np.array(logistic.coefficients)
    for i, row in enumerate(got):
        def value(s):
            mixed = np.array([z[i, k] if k in s else r[k] for k in range(4)])
            return mixed @ beta + logistic.intercept
        assert row["phi"] == pytest.approx(coalition_values(value, 4), abs=1e-10)
        assert row["phi"][3] == 0.0
        assert row["base"] == pytest.approx(value(set()), abs=1e-10)
        assert abs(row["residual"]) < 1e-9


def test_additivity_check_finds_planted_errors(rows, logistic):
    explained = attribution.explain_linear(rows, logistic)
    assert checks.check_additivity(explained).count() == 0
    spoiled = explained.withColumn("base", F.when(F.col("record_id") == "r007", F.col("base") + 0.1).otherwise(F.col("base")))
    assert [r["record_id"] for r in checks.check_additivity(spoiled).collect()] == ["r007"]


def test_empty_background_is_an_error(rows, logistic):
    with pytest.raises(ValueError):
        attribution.explain_linear(rows, logistic, background=rows.limit(0))


def test_trees_against_every_coalition(rows, boosted):
    got = attribution.explain_trees(rows, boosted).orderBy("record_id").limit(4).collect()

    def walk(tree, node, x, known):
        feature = tree.feature[node]
        if feature < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if feature in known:
            return walk(tree, left if x[feature] <= tree.cut[node] else right, x, known)
        shares = [tree.cover[c] / tree.cover[node] for c in (left, right)]
        return shares[0] * walk(tree, left, x, known) + shares[1] * walk(tree, right, x, known)

    x = matrix(rows)
    for i, row in enumerate(got):
        value = lambda s: sum(walk(t, 0, x[i], s) for t in boosted.trees)
        assert row["phi"] == pytest.approx(coalition_values(value, 4), abs=1e-9)
        assert row["base"] == pytest.approx(value(set()), abs=1e-9)
        assert abs(row["residual"]) < 1e-9


def test_tree_margin_is_the_model_probability(rows, boosted):
    explained = attribution.explain_trees(rows, boosted)
    joined = explained.join(boosted.score(rows).select("record_id", "score"), "record_id")
    assert joined.where("abs(score - probability) > 1e-9").count() == 0
    assert joined.count() == 150


def test_pixels_scale_and_summary(rows, logistic):
    explained = attribution.explain_linear(rows, logistic)
    pixels = attribution.attribution_pixels(explained, 2)
    assert pixels.count() == 600
    last = pixels.where("record_id = 'r000'").orderBy("row", "column").collect()
    assert [(r["row"], r["column"]) for r in last] == [(0, 0), (0, 1), (1, 0), (1, 1)] and last[3]["intensity"] == 77.0
    zero = attribution.attribution_scale(explained.withColumn("phi", F.lit([0.0, 0.0])))
    assert zero.where("scale <> 1").count() == 0
    summary = attribution.attribution_summary(explained, F.lit(0.5), "logistic").toPandas()
    assert ((summary["positive_probability"] >= 0.5) == (summary["prediction"] == 1)).all()


def test_settings_are_distinct_and_reproducible():
    for name, size in (("logistic", 32), ("svm", 70), ("xgboost", 1296)):
        every = models.sample_settings(models.GRIDS[name], 10**6)
        assert len(every) == size == len({str(s) for s in every})
        assert models.sample_settings(models.GRIDS[name], 8) == every[:8] != models.sample_settings(models.GRIDS[name], 8, seed=7)


def test_holdout_tuning_refits_on_train_only(spark, rows, train):
    grid = {"C": [0.01, 1.0], "penalty": ["l2"], "class_weight": [None]}
    tuning = models.tune_and_fit(rows, "logistic", n_iter=2, grid=grid)
    again = models.fit_logistic(train, **tuning.best)
    assert tuning.model.coefficients == pytest.approx(again.coefficients, abs=1e-6)
    assert tuning.method.startswith("holdout") and len(tuning.results) == 2
    ranks = [r["rank_test_score"] for r in models.search_results(spark, tuning).orderBy("rank_test_score").collect()]
    assert ranks[0] == 1


def test_fold_tuning_never_reads_validation(rows, train):
    grid = {"C": [1.0], "penalty": ["l2"], "class_weight": ["balanced"]}
    spoiled = rows.withColumn("label", F.when(F.col("assigned_split") == "val", 1 - F.col("label")).otherwise(F.col("label")))
    kw = dict(n_iter=1, use_cv=True, folds=3, grid=grid)
    assert models.tune_and_fit(rows, "logistic", **kw).score == pytest.approx(
        models.tune_and_fit(spoiled, "logistic", **kw).score, abs=1e-9)


def test_margin_model_learns_a_ring(spark):
    """Not linearly separable: inside against outside of a circle."""
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (240, 2))
    y = (np.hypot(x[:, 0], x[:, 1]) < 1.1).astype(int)
    df = spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(240)], "record_id int, label int, vec array<double>")
    model = models.fit_margin(df, C=10.0, gamma=0.5)
    assert metrics.auc_rank(model.score(df)).first()["auc"] > 0.95


def test_version_depends_on_name_fit_and_threshold(logistic):
    other = models.LogisticModel(logistic.standardizer, logistic.coefficients, logistic.intercept, name="svm")
    versions = {models.model_version(logistic, 0.5), models.model_version(logistic, 0.6), models.model_version(other, 0.5)}
    assert len(versions) == 3


def test_catalog_scorer_equals_model_score(rows, logistic):
    scorer = flows.catalog_scorer(logistic, 0.4)
    out = scorer.columns(F.col("_raw"))
    raw = scorer.with_raw(logistic.score(rows).withColumn("features", F.col("vec")))
    both = raw.select("score", out["positive_score"].alias("p"), out["predicted_class"].alias("c"), out["valid"].alias("ok"))
    assert both.where("abs(score - p) > 1e-12 or not ok or (c = 'pneumonia') <> (score >= 0.4)").count() == 0


def test_catalog_is_explained_by_its_own_model_only(spark, rows, logistic, boosted):
    content = rows.where("record_id < 'r020'").select(
        F.col("record_id").alias("content_id"), F.col("vec").alias("features"), F.lit("complete").alias("processing_status"),
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("error", "string"), ("predicted_class", "string"), ("confidence", "double"), ("positive_score", "double"),
            ("model_version", "string"), ("processed_at", "timestamp"))])
    for model in (logistic, boosted):
        scored = materialize(ingest.rescore(content, flows.catalog_scorer(model, 0.5)))
        assert scored.where("processing_status = 'complete' and positive_score between 0 and 1").count() == 20
        spoiled = scored.withColumn("positive_score", F.col("positive_score") + F.when(F.col("content_id") == "r003", 0.01).otherwise(0.0))
        got = flows.explain_catalog(spoiled, model, 0.5).toPandas().set_index("record_id")
        assert got.loc["r003", "problem"] == "stored score differs" and got.loc["r003", "phi"] is None
        assert got["problem"].notna().sum() == 1 and got["residual"].abs().max() < 1e-8
        stale = flows.explain_catalog(scored, model, 0.6)
        assert stale.where("problem = 'other model version' and phi is null").count() == 20
    short = content.withColumn("features", F.lit([1.0]))
    bad = ingest.rescore(short, flows.catalog_scorer(boosted, 0.5))
    assert bad.where("processing_status = 'model_error' and positive_score is null").count() == 20


def test_class_weights(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label int")
    got = {r["label"]: r["weight"] for r in models.class_weights(df).collect()}
    assert got == {0: pytest.approx(40 / 60), 1: pytest.approx(2.0)}


def test_train_select_predict_explain(spark, rows):
    """The whole path on one small data set."""
    folder = scratch_path(spark, "run")
    samples = rows.select("split", "split_index", "label", "vec", "content_hash")
    stored = flows.build_metadata(samples, f"{folder}/metadata", 2, 2, dataset_namespace("run"))
    manifest = flows.build_split_table(samples, f"{folder}/splits")
    data = materialize(flows.training_rows(samples, manifest))
    grid = {"C": [0.1, 1.0], "penalty": ["l2"], "class_weight": [None]}
    tuning, result = flows.train(data, "logistic", f"{folder}/metrics", n_iter=2, grid=grid)
    row = result.first()
    assert row["validation_roc_auc"] == pytest.approx(row["tuning_roc_auc"], abs=1e-6) and row["training_cv_roc_auc"] is None
    boosted = models.fit_boosted(data.where("assigned_split = 'train'"), n_estimators=3, max_depth=2)
    trained = {"logistic": tuning.model, "xgboost": boosted}
    best = flows.select_model(data, trained, {"logistic": row["threshold"], "xgboost": 0.5}, f"{folder}/selection")
    assert predictions.resolve_active_model(best, "best") in trained
    table = spark.createDataFrame(
        [("logistic", row["threshold"], "probability", "m1"), ("xgboost", 0.5, "probability", "m2")],
        "model string, threshold double, score_type string, model_file string")
    table = predictions.provenance_defaults(table, spark.createDataFrame([], S.PROVENANCE))
    written = flows.predict(data, manifest, stored, trained, table, f"{folder}/predictions", predictions.parse_model_list("all"))
    assert written == ["logistic", "xgboost"]
    out = spark.read.parquet(f"{folder}/predictions")
    n_test = manifest.where("assigned_split = 'test'").count()
    assert out.count() == 2 * n_test and set(out.columns) == set(predictions.PREDICTION_COLUMNS)
    with pytest.raises(RuntimeError):
        flows.predict(data, manifest, stored, {}, table, f"{folder}/none", ["svm"])
    identified = rows.drop("assigned_split")
    explained = flows.explain(identified.where("record_id = 'r001'"), tuning.model, row["threshold"], f"{folder}/explain", 2,
                              save_pixels=True)
    assert explained.count() == 1 and spark.read.option("header", True).csv(f"{folder}/explain/pixels").count() == 4
    flows.explain(identified, boosted, 0.5, f"{folder}/explain-trees", 2)
    with pytest.raises(ValueError):
        flows.explain(identified, models.MarginModel(tuning.model.standardizer, (), 1.0, (), 0.0), 0.0, f"{folder}/x", 2)


def test_augmented_training_leaves_other_splits_alone(spark, rows):
    grid = {"C": [1.0], "penalty": ["l2"], "class_weight": [None]}
    tuning, result = flows.train(rows, "logistic", scratch_path(spark, "m"), n_iter=1, grid=grid, augment_copies=1)
    assert result.count() == 1


def test_stored_models_score_alike(spark, rows):
    train = rows.where("assigned_split = 'train'")
    for model in (models.fit_logistic(train), models.fit_margin(train, landmarks=16),
                  models.fit_boosted(train, n_estimators=3, max_depth=2)):
        path = scratch_path(spark, "model")
        models.save_model(model, 0.25, path, spark)
        loaded, threshold = models.load_model(spark, path)
        assert threshold == 0.25 and models.model_version(loaded, 0.25) == models.model_version(model, 0.25)
        before, after = ([r["score"] for r in m.score(rows).orderBy("record_id").collect()] for m in (model, loaded))
        assert before == after


def test_disagreements(spark):
    df = spark.createDataFrame(
        [("a", 1, 1), ("a", 0, 1), ("b", 1, 1), ("b", 1, 1), ("c", 0, 0)], "record_id string, predicted_label int, label int")
    assert [r["record_id"] for r in predictions.disagreements(df).collect()] == ["a"]
