"""Threshold, ranking and outcome metrics of binary scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.functions.labels import outcome_cell, split_rank
from sievemark.operators.ranking import running_totals
from sievemark.session import materialize


def score_steps(scored: DataFrame, group: Sequence[str], truth: str, score: str) -> DataFrame:
    """Positives and negatives per distinct score: ties are one row from here on."""
    return scored.groupBy(*group, F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(truth) == 1).alias("positives"),
        F.count_if(F.col(truth) == 0).alias("negatives"),
    )


def auc_of_steps(steps: DataFrame, group: Sequence[str], bounds: Sequence[float] | None = None) -> DataFrame:
    """Mann-Whitney AUC with average ranks for ties; NULL when a class is absent
    or a score is missing."""
    steps = materialize(steps, "steps")  # the scored rows are read once
    known = steps.where(F.col("score").isNotNull() & ~F.isnan("score"))
    before = running_totals(known, group, "score", ["negatives"], bounds=bounds)
    ordered_pairs = F.col("positives").cast("double") * (
        F.col("negatives_before").cast("double") + F.col("negatives").cast("double") / 2
    )
    wins = before.groupBy(*group).agg(F.sum(ordered_pairs).alias("_wins"))
    missing = F.col("score").isNull() | F.isnan("score")
    totals = steps.groupBy(*group).agg(
        F.sum("positives").alias("_pos"), F.sum("negatives").alias("_neg"),
        F.bool_or(missing).alias("_missing"),
    )
    auc = F.when(
        ~F.col("_missing"),
        F.try_divide(F.col("_wins"), F.col("_pos").cast("double") * F.col("_neg").cast("double")),
    )
    if group:
        joined = totals.join(wins, list(group), "left")
    else:
        joined = totals.withColumn("_one", F.lit(1)).join(wins.withColumn("_one", F.lit(1)), "_one", "left")
    return joined.select(*group, auc.alias("auc"))


def auc_rank(scored: DataFrame, group: Sequence[str] = (), truth: str = "label", score: str = "score") -> DataFrame:
    return auc_of_steps(score_steps(scored, group, truth, score), list(group))


def average_rank(scored: DataFrame, score: str = "score") -> DataFrame:
    """Every distinct score with the average rank its rows share."""
    counts = scored.groupBy(F.col(score).cast("double").alias("score")).agg(F.count(F.lit(1)).alias("ties"))
    return running_totals(materialize(counts, "steps"), [], "score", ["ties"]).select(
        "score", "ties", (F.col("ties_before") + (F.col("ties") + 1) / 2).alias("average_rank")
    )


def roc_points(scored: DataFrame, truth: str = "label", score: str = "score") -> DataFrame:
    """One point per distinct score, classifying ``score >= threshold`` as positive."""
    steps = materialize(score_steps(scored, [], truth, score).where(F.col("score").isNotNull()), "steps")
    before = running_totals(steps, [], "score", ["positives", "negatives"], descending=True)
    totals = F.broadcast(  # one row
        steps.agg(F.sum("positives").alias("_pos"), F.sum("negatives").alias("_neg")).withColumn("_one", F.lit(1))
    )
    tp = F.col("positives_before") + F.col("positives")
    fp = F.col("negatives_before") + F.col("negatives")
    return before.withColumn("_one", F.lit(1)).join(totals, "_one").select(
        F.col("score").alias("threshold"),
        tp.alias("tp"), fp.alias("fp"),
        F.try_divide(tp.cast("double"), F.col("_pos")).alias("tpr"),
        F.try_divide(fp.cast("double"), F.col("_neg")).alias("fpr"),
    )


def select_threshold(scored: DataFrame, truth: str = "label", score: str = "score") -> DataFrame:
    """Threshold with the largest Youden J; ties go to the highest, infinite ones are dropped."""
    j = (F.col("tpr") - F.col("fpr")).alias("youden_j")
    return (
        roc_points(scored, truth, score)
        .where(F.abs("threshold") != float("inf"))
        .select("threshold", j)
        .orderBy(F.col("youden_j").desc_nulls_last(), F.col("threshold").desc())
        .limit(1)
    )


def cell_counts(truth: Column, predicted: Column) -> list[Column]:
    def cell(t: int, p: int, name: str) -> Column:
        return F.count_if((truth == t) & (predicted == p)).alias(name)

    return [cell(1, 1, "tp"), cell(0, 0, "tn"), cell(0, 1, "fp"), cell(1, 0, "fn")]


def metric_columns() -> dict[str, Column]:
    """Metrics of tp, tn, fp, fn columns; undefined ones are NULL."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    sensitivity = F.try_divide(tp, tp + fn)
    specificity = F.try_divide(tn, tn + fp)
    precision = F.try_divide(tp, tp + fp)
    return {
        "accuracy": F.try_divide(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": (sensitivity + specificity) / 2,
        "sensitivity": sensitivity,
        "specificity": specificity,
        "precision": precision,
        "f1": F.try_divide(F.lit(2.0) * precision * sensitivity, precision + sensitivity),
    }


def _decided(scored: DataFrame, threshold, score: str) -> DataFrame:
    """0/1 decision, threshold inclusive.  ``threshold`` is a number or a one-row DataFrame."""
    if isinstance(threshold, DataFrame):
        one = F.broadcast(threshold.select(F.col("threshold").alias("_t")).withColumn("_one", F.lit(1)))
        scored = scored.withColumn("_one", F.lit(1)).join(one, "_one").drop("_one")
    else:
        scored = scored.withColumn("_t", F.lit(float(threshold)))
    return scored.withColumn("_p", (F.col(score) >= F.col("_t")).cast("int"))


def confusion_matrix(scored: DataFrame, threshold, truth: str = "label", score: str = "score") -> DataFrame:
    """Two rows (actual 0, 1) by two counts (predicted 0, 1), zero-filled."""
    counts = _decided(scored, threshold, score).agg(*cell_counts(F.col(truth), F.col("_p")))
    return counts.select(
        F.inline(F.array(
            F.struct(F.lit(0).alias("actual"), F.col("tn").alias("predicted_0"), F.col("fp").alias("predicted_1")),
            F.struct(F.lit(1).alias("actual"), F.col("fn").alias("predicted_0"), F.col("tp").alias("predicted_1")),
        ))
    )


def threshold_metrics(scored: DataFrame, threshold, truth: str = "label", score: str = "score") -> DataFrame:
    """One row of metrics at a fixed threshold."""
    decided = _decided(scored, threshold, score)
    counts = decided.agg(F.max("_t").alias("threshold"), *cell_counts(F.col(truth), F.col("_p")))
    wanted = {k: v for k, v in metric_columns().items() if k not in ("precision", "f1")}
    auc = F.broadcast(auc_rank(scored, [], truth, score).withColumn("_one", F.lit(1)))
    return (
        counts.withColumn("_one", F.lit(1)).join(auc, "_one")
        .select("threshold", *[c.alias(n) for n, c in wanted.items()], F.col("auc").alias("roc_auc"))
    )


def outcome_counts(scored: DataFrame, truth: str, predicted: str) -> DataFrame:
    return scored.groupBy(outcome_cell(F.col(truth), F.col(predicted)).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n")
    )


def model_metric_input(catalog: DataFrame, version: str | None = None) -> DataFrame:
    """Labelled, current-version rows of the model splits."""
    rows = catalog.where(F.col("outcome") != "unlabeled")
    if version is not None:
        rows = rows.where(F.col("model_version").eqNullSafe(F.lit(version)))
    return rows.where(F.col("split").isin(*S.MODEL_SPLITS))


def metric_input_report(catalog: DataFrame, version: str) -> DataFrame:
    """How many rows each rule keeps out of the metrics, in one aggregate."""
    labeled = F.col("outcome") != "unlabeled"
    current = F.col("model_version").eqNullSafe(F.lit(version))
    inside = F.coalesce(F.col("split").isin(*S.MODEL_SPLITS), F.lit(False))
    return catalog.agg(
        F.count_if(~labeled).alias("unlabeled"),
        F.count_if(labeled & ~current).alias("other_version"),
        F.count_if(labeled & current & ~inside).alias("outside_model_splits"),
        F.count_if(labeled & current & inside).alias("used"),
    )


def split_metrics(rows: DataFrame) -> DataFrame:
    """Metrics per split, plus ``all`` unless there is exactly one split.

    ``rows`` has split, true_class, predicted_class and positive_score.  Row
    data is aggregated once per (split, score); the total row and the AUC both
    come from that.
    """
    truth = F.col("true_class") == S.POSITIVE_CLASS
    predicted = F.lower("predicted_class") == S.POSITIVE_CLASS
    steps = rows.groupBy("split", F.col("positive_score").cast("double").alias("score")).agg(
        F.count_if(truth & predicted).alias("tp"),
        F.count_if(~truth & ~predicted).alias("tn"),
        F.count_if(~truth & predicted).alias("fp"),
        F.count_if(truth & ~predicted).alias("fn"),
    )
    steps = materialize(steps.withColumns({
        "positives": F.col("tp") + F.col("fn"), "negatives": F.col("tn") + F.col("fp"),
    }), "steps")
    sums = ["tp", "tn", "fp", "fn", "positives", "negatives"]
    overall = steps.groupBy("score").agg(*[F.sum(c).alias(c) for c in sums])
    groups = steps.withColumnRenamed("split", "group").unionByName(
        overall.withColumn("group", F.lit("all"))
    )
    cells = groups.groupBy("group").agg(*[F.sum(c).alias(c) for c in ["tp", "tn", "fp", "fn"]])
    n_splits = F.broadcast(  # one row
        steps.select("split").distinct().agg(F.count(F.lit(1)).alias("_splits")).withColumn("_one", F.lit(1))
    )
    return (
        cells.join(auc_of_steps(groups, ["group"]), "group")
        .withColumn("_one", F.lit(1)).join(n_splits, "_one")
        .where((F.col("group") != "all") | (F.col("_splits") != 1))
        .select(
            F.col("group").alias("split"),
            (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("records"),
            "tp", "fn", "fp", "tn",
            *[c.alias(n) for n, c in metric_columns().items()], "auc",
        )
    )


def metrics_order(split: Column) -> list[Column]:
    return [F.when(split == "all", 100).otherwise(split_rank(split)).asc(), split.asc()]
