"""Expressions over labels, scores and outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievemark import schemas as S


def class_name(label: Column) -> Column:
    return F.when(label == 0, S.NEGATIVE_CLASS).when(label == 1, S.POSITIVE_CLASS)


def rank_in(value: Column, order: Sequence[str], start: int = 1, unknown: int = 99) -> Column:
    expr = F.lit(unknown)
    for position, name in reversed(list(enumerate(order, start))):
        expr = F.when(value == name, F.lit(position)).otherwise(expr)
    return expr


def split_rank(split: Column) -> Column:
    """train 1, val 2, test 3, anything else last."""
    return rank_in(split, S.MODEL_SPLITS)


def menu_rank(split: Column) -> Column:
    return rank_in(split, S.SPLIT_MENU_ORDER, start=0)


def normalize_label(label: Column) -> Column:
    """Class name of a number or text label; other text stays, blank becomes NULL."""
    trimmed = F.regexp_replace(label.cast("string"), r"^\s+|\s+$", "")
    text = F.lower(trimmed)
    return (
        F.when(text.isin(*S.POSITIVE_SPELLINGS), S.POSITIVE_CLASS)
        .when(text.isin(*S.NEGATIVE_SPELLINGS), S.NEGATIVE_CLASS)
        .when(trimmed.isin("", "NaN"), F.lit(None).cast("string"))  # NaN: a missing number
        .otherwise(text)
    )


def outcome_cell(truth: Column, predicted: Column) -> Column:
    """TP / TN / FP / FN of two 0/1 columns, '' when either is unknown."""
    return (
        F.when((truth == 1) & (predicted == 1), "TP")
        .when((truth == 0) & (predicted == 0), "TN")
        .when((truth == 0) & (predicted == 1), "FP")
        .when((truth == 1) & (predicted == 0), "FN")
        .otherwise("")
    )


def outcome_text(true_class: Column, predicted_class: Column) -> Column:
    predicted = F.lower(predicted_class)
    return (
        F.when(true_class == predicted, "correct")
        .when((predicted == S.POSITIVE_CLASS) & (true_class == S.NEGATIVE_CLASS), "false positive")
        .when((predicted == S.NEGATIVE_CLASS) & (true_class == S.POSITIVE_CLASS), "false negative")
        .otherwise("unlabeled")
    )


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def score_and_decide(raw: Column, raw_threshold: Column, kind: str) -> dict[str, Column]:
    """0..1 score, decision and confidence of a raw model output.

    The decision compares the raw value (inclusive), so mapping a margin
    through the logistic curve cannot change it.
    """
    if kind not in ("probability", "margin"):
        raise ValueError(f"unknown score kind {kind!r}")
    score = sigmoid(raw) if kind == "margin" else raw
    positive = raw >= raw_threshold
    return {
        "positive_score": score,
        "predicted_class": F.when(positive, S.POSITIVE_CLASS).otherwise(S.NEGATIVE_CLASS),
        "confidence": F.when(positive, score).otherwise(F.lit(1.0) - score),
    }


def file_extension(filename: Column) -> Column:
    """Last suffix in lower case with its dot; '' when there is none."""
    return F.lower(F.regexp_extract(filename, r"(?s)^.+(\.[^./]+)$", 1))


def geometry(width: Column, height: Column) -> dict[str, Column]:
    return {
        "aspect_ratio": F.try_divide(width.cast("double"), height.cast("double")),
        "megapixels": width.cast("double") * height / F.lit(1_000_000.0),
    }


def limit_text(limit: int) -> str:
    return f"{limit / 2**20:g} MiB" if limit >= 1 << 20 else f"{limit} bytes"
