"""Training, tuning and scoring of the three binary classifiers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass, field
import hashlib
import itertools
import json
import time

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import sigmoid
from sievemark.functions.vectors import dot, literal_vector, standardize, vector_hash
from sievemark.operators import boosting, solvers
from sievemark.operators.metrics import auc_rank, select_threshold, threshold_metrics
from sievemark.operators.skew import broadcast_if_small
from sievemark.operators.solvers import rbf
from sievemark.operators.splits import holdout_fold, stratified_folds
from sievemark.session import materialize

LANDMARKS = 200


# --- Moments and weights -------------------------------------------------------

def feature_moments(rows: DataFrame, vec: str = "vec") -> DataFrame:
    """Mean and population standard deviation per feature, one row of arrays.

    The summarizer merges one small buffer per task; exploding the vectors
    would multiply the rows by the number of features.
    """
    stats = rows.select(
        Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(vec))).alias("s")
    )
    n = F.col("s.count").cast("double")
    return stats.select(
        vector_to_array("s.mean").alias("mean"),
        # The summarizer's variance has n - 1 in its denominator.
        F.transform(vector_to_array("s.variance"), lambda v: F.sqrt(v * (n - 1) / n)).alias("scale"),
        F.col("s.count").alias("n"),
    )


def moment_rows(moments: DataFrame) -> DataFrame:
    """Moments as one row per feature."""
    return moments.select(F.posexplode(F.arrays_zip("mean", "scale")).alias("feature", "m")).select(
        "feature", "m.mean", "m.scale"
    )


def class_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """``balanced`` weights n / (classes * n_c); one row per class."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    totals = F.broadcast(  # one row
        counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("classes")).withColumn("_one", F.lit(1))
    )
    return counts.withColumn("_one", F.lit(1)).join(totals, "_one").select(
        label, "n", (F.col("total") / (F.col("classes") * F.col("n"))).alias("weight")
    )


def _weighted(rows: DataFrame, mode: str | None) -> DataFrame:
    if mode is None:
        return rows.withColumn("weight", F.lit(1.0))
    if mode != "balanced":
        raise ValueError(f"unknown class_weight {mode!r}")
    return rows.join(broadcast_if_small(class_weights(rows).select("label", "weight")), "label")


# --- Fitted models -------------------------------------------------------------

@dataclass(frozen=True)
class Standardizer:
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    @classmethod
    def fit(cls, train: DataFrame) -> "Standardizer":
        if train.isEmpty():
            raise ValueError("no rows to fit on")
        row = feature_moments(train).first()
        return cls(tuple(row["mean"]), tuple(row["scale"]))

    def apply(self, vec: Column) -> Column:
        return standardize(vec, literal_vector(self.mean), literal_vector(self.scale))


@dataclass(frozen=True)
class LogisticModel:
    """Standardise, then a linear log-odds."""

    standardizer: Standardizer
    coefficients: tuple[float, ...]
    intercept: float
    name: str = "logistic"
    kind: str = "probability"

    def margin(self, vec: Column) -> Column:
        # Standardising is folded into the weights: one product and sum per row.
        scale = [s or 1.0 for s in self.standardizer.scale]
        weights = [c / s for c, s in zip(self.coefficients, scale)]
        shift = sum(w * m for w, m in zip(weights, self.standardizer.mean))
        return dot(vec, literal_vector(weights)) + F.lit(self.intercept - shift)

    def raw_score(self, vec: Column) -> Column:
        return sigmoid(self.margin(vec))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", self.raw_score(F.col("vec")))

    def describe(self) -> str:
        return json.dumps([self.standardizer.mean, self.standardizer.scale, self.coefficients, self.intercept])


@dataclass(frozen=True)
class MarginModel:
    """RBF-kernel margin: weighted kernel values at landmark rows."""

    standardizer: Standardizer
    landmarks: tuple[tuple[float, ...], ...]
    gamma: float
    coefficients: tuple[float, ...]
    intercept: float
    name: str = "svm"
    kind: str = "margin"

    def raw_score(self, vec: Column) -> Column:
        score, size = kernel_margins(self.landmarks, self.gamma, self.coefficients, self.intercept), len(self.standardizer.mean)
        fits = vec.isNotNull() & (F.size(vec) == size)
        return F.when(fits, score(self.standardizer.apply(F.when(fits, vec).otherwise(F.array_repeat(F.lit(0.0), size)))))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", self.raw_score(F.col("vec")))

    def describe(self) -> str:
        return json.dumps([self.standardizer.mean, self.standardizer.scale, self.landmarks, self.gamma, self.coefficients, self.intercept])


@dataclass(frozen=True)
class BoostedModel:
    """Gradient-boosted trees for the log-odds."""

    trees: tuple[boosting.Tree, ...]
    n_features: int
    name: str = "xgboost"
    kind: str = "probability"

    def margin(self, vec: Column) -> Column:
        """The log-odds, NULL where a vector does not fit the model."""
        fits = vec.isNotNull() & (F.size(vec) == self.n_features)
        return F.when(fits, tree_margins(self.trees)(F.when(fits, vec).otherwise(F.array_repeat(F.lit(0.0), self.n_features))))

    def raw_score(self, vec: Column) -> Column:
        return sigmoid(self.margin(vec))

    def score(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("score", self.raw_score(F.col("vec")))

    def describe(self) -> str:
        return json.dumps([self.n_features, [asdict(t) for t in self.trees]])


def kernel_margins(landmarks, gamma: float, coefficients, intercept: float) -> Callable[[Column], Column]:
    """Kernel values against all landmarks are one matrix product per Arrow batch; the landmarks travel with the tasks."""
    z, beta = np.asarray(landmarks, dtype=float), np.asarray(coefficients, dtype=float)

    @F.pandas_udf("double")
    def margins(vec: pd.Series) -> pd.Series:
        return pd.Series(rbf(np.stack(vec.to_numpy()), z, gamma) @ beta + intercept) if len(vec) else pd.Series([], dtype=float)

    return margins


def tree_margins(trees: tuple[boosting.Tree, ...]) -> Callable[[Column], Column]:
    """Log-odds of all trees, per Arrow batch; their nodes travel with the tasks."""

    @F.pandas_udf("double")
    def margins(vec: pd.Series) -> pd.Series:
        return pd.Series(boosting.margins(np.stack(vec.to_numpy()), trees)) if len(vec) else pd.Series([], dtype=float)

    return margins


def model_version(model, threshold: float) -> str:
    """Changes with the name, anything fitted, or the threshold."""
    text = "\x1f".join([model.name, model.describe(), repr(float(threshold))])
    return hashlib.sha256(text.encode()).hexdigest()


# --- Storing --------------------------------------------------------------------

def save_model(model, threshold: float, path: str, spark) -> None:
    """Write a fitted model and its threshold below ``path`` as one JSON row that keeps every digit, replacing what is there."""
    row = (model.name, float(threshold), model_version(model, threshold), json.dumps(asdict(model)))
    stored = spark.createDataFrame([row], "name string, threshold double, version string, numbers string")
    stored.coalesce(1).write.mode("overwrite").parquet(f"{path}/model")


def _tuples(value):
    return tuple(map(_tuples, value)) if isinstance(value, list) else value


def load_model(spark, path: str) -> tuple[object, float]:
    """A stored model and its threshold; one that differs from what was stored is an error."""
    row = spark.read.parquet(f"{path}/model").first()
    stored = json.loads(row["numbers"])
    numbers = {k: _tuples(v) for k, v in stored.items() if k not in ("standardizer", "trees")}
    if row["name"] == "xgboost":
        model = BoostedModel(tuple(boosting.Tree(**{k: _tuples(v) for k, v in t.items()}) for t in stored["trees"]), **numbers)
    else:
        scaler = Standardizer(**{k: _tuples(v) for k, v in stored["standardizer"].items()})
        model = {"logistic": LogisticModel, "svm": MarginModel}[row["name"]](standardizer=scaler, **numbers)
    if model_version(model, row["threshold"]) != row["version"]:
        raise ValueError(f"the model at {path} is not the one that was stored")
    return model, row["threshold"]


# --- Fitting -------------------------------------------------------------------

def _standardized(train: DataFrame, scaler: Standardizer, class_weight: str | None) -> DataFrame:
    """Weighted standardised rows as a written table, which each iteration reads once."""
    rows = _weighted(train, class_weight).select("label", "weight", scaler.apply(F.col("vec")).alias("vec"))
    return materialize(solvers.weighted_rows(rows), "standardized")


def with_constant(x: np.ndarray) -> np.ndarray:
    return np.column_stack([x, np.ones(len(x))])


def fit_logistic(train: DataFrame, *, C: float = 1.0, penalty: str = "l2", class_weight: str | None = None,
                 standardizer: Standardizer | None = None) -> LogisticModel:
    """Penalised logistic regression by proximal Newton; the intercept is the weight of a constant column and penalised like others."""
    scaler = standardizer or Standardizer.fit(train)
    rows = _standardized(train, scaler, class_weight)
    weights, _ = solvers.minimize(rows, with_constant, len(scaler.mean) + 1, solvers.logistic_loss, C, penalty=penalty)
    return LogisticModel(scaler, tuple(weights[:-1].tolist()), float(weights[-1]))


def landmark_rows(train: DataFrame, count: int, seed: int = S.DEFAULT_SEED) -> list[list[float]]:
    """At most ``count`` distinct vectors, those with the smallest seeded hashes."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), vector_hash(F.col("vec"))), 256)
    return [r["vec"] for r in train.select("vec", order.alias("_order")).dropDuplicates(["_order"]).orderBy("_order").limit(count).collect()]


def fit_margin(train: DataFrame, *, C: float = 1.0, gamma: float | str = "scale", class_weight: str | None = None,
               standardizer: Standardizer | None = None, landmarks: int = LANDMARKS, seed: int = S.DEFAULT_SEED) -> MarginModel:
    """RBF-kernel margin with squared hinge loss on Nystroem features (Williams and Seeger, 2001).

    Kernel values at ``landmarks`` training rows, whitened by their own kernel
    matrix, are the features; with every row a landmark this is the exact
    kernel model. The intercept is not penalised.
    """
    scaler = standardizer or Standardizer.fit(train)
    # 'scale' is 1 / (features * variance); standardised inputs have variance 1, constant ones 0.
    width = 1.0 / max(1, sum(s > 0 for s in scaler.scale)) if gamma == "scale" else float(gamma)
    scale = np.array([s or 1.0 for s in scaler.scale])
    chosen = (np.asarray(landmark_rows(train, landmarks, seed), dtype=float) - scaler.mean) / scale
    whiten = solvers.whitening(chosen, width)
    size = whiten.shape[1]

    def features(x: np.ndarray) -> np.ndarray:
        return with_constant(solvers.rbf(x, chosen, width) @ whiten)

    weights, _ = solvers.minimize(
        _standardized(train, scaler, class_weight), features, size + 1, solvers.squared_hinge_loss, C, penalised=np.append(np.ones(size), 0.0),
    )
    return MarginModel(scaler, tuple(map(tuple, chosen.tolist())), width, tuple((whiten @ weights[:-1]).tolist()), float(weights[-1]))


def fit_boosted(train: DataFrame, *, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1,
                subsample: float = 1.0, colsample_bytree: float = 1.0, min_child_weight: float = 1, max_bins: int = boosting.MAX_BINS,
                seed: int = S.DEFAULT_SEED) -> BoostedModel:
    """Second-order boosted trees; ``min_child_weight`` bounds a child's hessian sum."""
    return BoostedModel(*boosting.fit_trees(
        train, n_estimators=n_estimators, max_depth=max_depth, learning_rate=learning_rate, subsample=subsample,
        colsample_bytree=colsample_bytree, min_child_weight=min_child_weight, max_bins=max_bins, seed=seed,
    ))


FITTERS: dict[str, Callable] = {"logistic": fit_logistic, "svm": fit_margin, "xgboost": fit_boosted}
GRIDS = {"logistic": S.LOGISTIC_GRID, "svm": S.MARGIN_GRID, "xgboost": S.BOOSTED_GRID}


# --- Tuning --------------------------------------------------------------------

def sample_settings(grid: dict[str, list], n_iter: int, seed: int = S.DEFAULT_SEED) -> list[dict]:
    """``n_iter`` distinct settings of a grid in a seeded order."""
    settings = [dict(zip(grid, values)) for values in itertools.product(*grid.values())]

    def order(setting: dict) -> str:
        return hashlib.sha256(f"{seed}:{json.dumps(setting, sort_keys=True)}".encode()).hexdigest()

    return sorted(settings, key=order)[:n_iter]


@dataclass(frozen=True)
class Tuning:
    model: object
    best: dict
    score: float
    method: str
    results: list[dict] = field(default_factory=list)


def tune_and_fit(
    samples: DataFrame, name: str, *, n_iter: int = S.SEARCH_ITERATIONS, use_cv: bool = False,
    folds: int = S.CV_FOLDS, seed: int = S.DEFAULT_SEED, grid: dict | None = None,
) -> Tuning:
    """Score sampled settings by AUC and refit the best on the training split only.

    ``samples`` has assigned_split, label, vec and content_hash.  Holdout mode
    fits on train and scores on val once; k-fold mode stays inside train.  The
    loop runs over settings (a handful); each fit is a distributed job.
    """
    fit = FITTERS[name]
    train = samples.where(F.col("assigned_split") == "train")
    if use_cv:
        parts, method = stratified_folds(train, folds, seed), f"{folds}-fold CV on train"
        fold_ids = list(range(folds))
    else:
        parts, method = holdout_fold(samples), "holdout (train -> validation)"
        fold_ids = [0]
    parts = parts.select("label", "vec", "content_hash", "fold").persist()
    try:
        fixed = {}
        for fold in fold_ids:
            fitting = parts.where(F.col("fold") != fold)
            shared = {} if name == "xgboost" else {"standardizer": Standardizer.fit(fitting)}
            fixed[fold] = (fitting, parts.where(F.col("fold") == fold), shared)
        results = []
        for setting in sample_settings(grid or GRIDS[name], n_iter, seed):
            scores, seconds = [], []
            for fitting, scoring, shared in fixed.values():
                began = time.perf_counter()
                model = fit(fitting, **setting, **shared)
                seconds.append(time.perf_counter() - began)
                auc = auc_rank(model.score(scoring)).first()["auc"]  # NULL where a fold has one class
                scores.append(float("nan") if auc is None else auc)
            results.append({
                "setting": json.dumps(setting, sort_keys=True), "params": setting,
                "mean_test_score": float(np.mean(scores)), "std_test_score": float(np.std(scores)),
                "mean_fit_time": float(np.mean(seconds)),
            })
    finally:
        parts.unpersist()
    results.sort(key=lambda r: (np.isnan(r["mean_test_score"]), -r["mean_test_score"]))
    if np.isnan(results[0]["mean_test_score"]):
        raise ValueError("no setting can be scored: some scoring part is empty or has one class")
    best = results[0]["params"]
    return Tuning(fit(train, **best), best, results[0]["mean_test_score"], method, results)


def rank_candidates(candidates: DataFrame) -> DataFrame:
    """Tuning candidates (a handful of rows) ranked by mean score; equal scores share a rank."""
    by_score = Window.orderBy(F.col("mean_test_score").desc())
    return candidates.select(F.rank().over(by_score).alias("rank_test_score"), "*")


def search_results(spark, tuning: Tuning) -> DataFrame:
    """Every sampled setting with its rank, score and fit time."""
    columns = ["mean_test_score", "std_test_score", "mean_fit_time", "setting"]
    rows = [tuple(r[c] for c in columns) for r in tuning.results]
    return rank_candidates(spark.createDataFrame(
        rows, "mean_test_score double, std_test_score double, mean_fit_time double, setting string"
    )).orderBy("rank_test_score", "setting")


def evaluate(samples: DataFrame, model) -> DataFrame:
    """Threshold from validation, every other number from one pass over test."""
    val = model.score(samples.where(F.col("assigned_split") == "val"))
    test = model.score(samples.where(F.col("assigned_split") == "test"))
    chosen = select_threshold(val).first()
    if chosen is None or chosen["threshold"] is None:
        raise ValueError("the validation split is empty or has one class")
    return threshold_metrics(test, chosen["threshold"]).withColumns({
        "model": F.lit(model.name),
        "validation_youden_j": F.lit(chosen["youden_j"]),
    })
