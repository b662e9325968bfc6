"""Per-feature contributions to the log-odds of linear and tree models."""

from __future__ import annotations

from collections.abc import Iterator
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark.functions.labels import class_name, sigmoid
from sievemark.functions.vectors import dot, literal_vector, standardize, vec_sum
from sievemark.operators.boosting import LEAF, Tree, margins
from sievemark.operators.models import BoostedModel, LogisticModel, feature_moments


def linear_terms(vec: Column, mean: Column, scale: Column, coef: Column, intercept: Column,
                 reference: Column) -> dict[str, Column]:
    """phi_j = beta_j (z_j - r_j) and base = b + beta . r, all in standardised space.

    ``reference`` is the standardised mean of the background.  A constant
    feature standardises to 0 on both sides, so its contribution is 0.
    """
    z = standardize(vec, mean, scale)
    phi = F.zip_with(F.zip_with(z, reference, lambda a, b: a - b), coef, lambda d, c: d * c)
    return {"phi": phi, "base": dot(reference, coef) + intercept}


def background_mean(background: DataFrame, model: LogisticModel) -> list[float]:
    """Mean standardised vector of a background sample (one vector of numbers)."""
    if background.isEmpty():
        raise ValueError("background is empty")
    raw = feature_moments(background).first()["mean"]
    scaler = model.standardizer
    return [(m - c) / (s or 1.0) for m, c, s in zip(raw, scaler.mean, scaler.scale)]


def explain_linear(rows: DataFrame, model: LogisticModel, background: DataFrame | None = None) -> DataFrame:
    """Exact contributions; the reference is the training mean or an explicit background."""
    scaler = model.standardizer
    reference = [0.0] * len(scaler.mean) if background is None else background_mean(background, model)
    terms = linear_terms(
        F.col("vec"), literal_vector(scaler.mean), literal_vector(scaler.scale),
        literal_vector(model.coefficients), F.lit(model.intercept), literal_vector(reference),
    )
    # The margin comes from the scoring path, so the residual compares the two.
    margin = rows.withColumn("margin", model.margin(F.col("vec")))
    return with_residual(margin.select(
        *rows.columns, *[c.alias(n) for n, c in terms.items()], "margin", sigmoid(F.col("margin")).alias("probability")
    ))


def with_residual(explained: DataFrame) -> DataFrame:
    return explained.withColumn("residual", F.col("base") + vec_sum(F.col("phi")) - F.col("margin"))


# --- Trees ---------------------------------------------------------------------

def leaf_paths(trees: tuple[Tree, ...]) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """Leaves as (value, conditions); repeated features on a path are merged.

    A condition is (feature, low, high, share): low < x <= high, and the share
    of the training hessian that takes this way at the splits on that feature.
    """
    leaves = []
    for tree in trees:
        stack: list[tuple[int, dict]] = [(0, {})]
        while stack:
            node, conditions = stack.pop()
            feature, cut = tree.feature[node], tree.cut[node]
            if feature == LEAF:
                leaves.append((tree.value[node], [(f, *c) for f, c in conditions.items()]))
                continue
            for child, is_left in ((tree.left[node], True), (tree.right[node], False)):
                low, high, share = conditions.get(feature, (-math.inf, math.inf, 1.0))
                share *= tree.cover[child] / tree.cover[node]
                bounds = (low, min(high, cut), share) if is_left else (max(low, cut), high, share)
                stack.append((child, {**conditions, feature: bounds}))
    return leaves


def tree_contributions(x: np.ndarray, leaves) -> tuple[np.ndarray, float]:
    """(phi, base) of a batch of rows.

    Path-dependent Shapley values leaf by leaf.  For one leaf, a feature g in
    the coalition multiplies the leaf's weight by hit_g (does the row meet g's
    condition), outside it by share_g.  Coalitions of each size are summed as
    the coefficients of prod_g (share_g + hit_g t).
    """
    phi = np.zeros(x.shape)
    base = 0.0
    for value, conditions in leaves:
        base += value * math.prod(c[3] for c in conditions)
        hits = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi, _ in conditions]
        m = len(conditions)
        for i, (feature, _, _, share) in enumerate(conditions):
            sizes = np.zeros((m, len(x)))
            sizes[0] = 1.0
            for g, (hit, other) in enumerate(zip(hits, conditions)):
                if g != i:
                    moved = np.vstack([np.zeros((1, len(x))), sizes[:-1]]) * hit
                    sizes = sizes * other[3] + moved
            weights = [math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)]
            phi[:, feature] += value * (hits[i] - share) * (np.asarray(weights) @ sizes)
    return phi, base


def explain_trees(rows: DataFrame, model: BoostedModel, key: str = "record_id") -> DataFrame:
    """Tree contributions to the log-odds, computed in Arrow batches.

    The leaves are bounded by trees x 2^depth and travel with the task. The margin comes from walking the trees, so the
    residual compares the two.
    """
    leaves, trees = leaf_paths(model.trees), model.trees
    key_type = rows.schema[key].dataType.simpleString()

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            # Trees hold 64-bit cuts, so rows are compared in 64 bits.
            x = np.stack(batch["vec"]).astype(float)
            phi, base = tree_contributions(x, leaves)
            margin = margins(x, trees)
            yield pd.DataFrame({
                key: batch[key], "phi": list(phi), "base": base,
                "margin": margin, "probability": 1.0 / (1.0 + np.exp(-margin)),
            })

    schema = f"{key} {key_type}, phi array<double>, base double, margin double, probability double"
    return with_residual(rows.select(key, "vec").mapInPandas(explain, schema))


# --- Tables over explained rows --------------------------------------------------

def attribution_pixels(explained: DataFrame, width: int, key: str = "record_id") -> DataFrame:
    """One row per record and cell."""
    cells = explained.select(key, F.posexplode(F.arrays_zip("vec", "phi")).alias("pos", "cell"))
    return cells.select(
        key, F.floor(F.col("pos") / width).cast("int").alias("row"), (F.col("pos") % width).alias("column"),
        F.col("cell.vec").alias("intensity"), F.col("cell.phi").alias("attribution"),
    )


def attribution_scale(explained: DataFrame) -> DataFrame:
    """Largest absolute contribution per record, 1 where all are 0."""
    largest = F.array_max(F.transform("phi", lambda p: F.abs(p)))
    return explained.withColumn("scale", F.when(largest == 0, 1.0).otherwise(largest))


def attribution_summary(explained: DataFrame, threshold: Column, model: str) -> DataFrame:
    prediction = (F.col("probability") >= threshold).cast("int")
    return explained.select(
        "record_id", "split", "split_index", "label", F.lit(model).alias("model"),
        F.col("probability").alias("positive_probability"), threshold.alias("decision_threshold"),
        prediction.alias("prediction"), class_name(prediction).alias("predicted_label"),
    )
