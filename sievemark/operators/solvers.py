"""Newton solvers for linear models: one distributed pass an iteration, a small dense problem on the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9
MAX_ITERATIONS = 100
ARMIJO = 1e-4

#: A design turns a batch of vectors into the columns that the weights multiply; it travels with the tasks.
Design = Callable[[np.ndarray], np.ndarray]
#: Loss, first and second derivative by the margin y f(x), y = -1 or 1.
Loss = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def logistic_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    miss = 1.0 / (1.0 + np.exp(np.minimum(margin, 700.0)))
    return np.logaddexp(0.0, -margin), -miss, miss * (1.0 - miss)


def squared_hinge_loss(margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    short = np.maximum(0.0, 1.0 - margin)
    return short * short, -2.0 * short, 2.0 * (short > 0)


def stacked(column: pa.Array) -> np.ndarray:
    """A list column as a matrix; rows of unequal length or with a NULL are an error."""
    if column.null_count:
        raise ValueError("a vector is NULL")
    values = column.flatten()
    if values.null_count or len(values) % max(len(column), 1):
        raise ValueError("vectors are incomplete or of unequal length")
    return values.to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def summed(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """The sum of ``part`` over all batches.

    A task passes on one array; arrays are added in about the square root of
    as many tasks before the driver adds the rest.
    """
    out = pa.schema([("total", pa.binary())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            if batch.num_rows:
                total, seen = total + part(batch), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], schema=out)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(size), False
        for batch in batches:
            for x in batch.column(0):
                total, seen = total + np.frombuffer(x.as_py()), True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], schema=out)

    totals = rows.mapInArrow(add, "total binary")
    tasks = len(rows.inputFiles()) or 1     # rows lie in files
    if tasks > 64:
        totals = totals.repartition(math.isqrt(tasks)).mapInArrow(again, "total binary")
    return sum((np.frombuffer(r["total"]) for r in totals.collect()), np.zeros(size))


@dataclass(frozen=True)
class Quadratic:
    """Loss at some weights with its gradient and weighted Gram matrix."""

    value: float
    gradient: np.ndarray
    hessian: np.ndarray


def quadratic(rows: DataFrame, design: Design, loss: Loss, weights: np.ndarray) -> Quadratic:
    """One pass over (label, weight, vec)."""
    k = weights.size

    def part(batch: pa.RecordBatch) -> np.ndarray:
        at = batch.schema.get_field_index
        a = design(stacked(batch.column(at("vec"))))
        y = 2.0 * batch.column(at("label")).to_numpy(zero_copy_only=False) - 1.0
        s = batch.column(at("weight")).to_numpy(zero_copy_only=False)
        value, first, second = loss(y * (a @ weights))
        gram = (a * (s * second)[:, None]).T @ a
        return np.concatenate([[float(s @ value)], a.T @ (s * first * y), gram.ravel()])

    total = summed(rows.select("label", "weight", "vec"), part, 1 + k + k * k)
    return Quadratic(float(total[0]), total[1 : 1 + k], total[1 + k :].reshape(k, k))


def l1_step(gradient: np.ndarray, hessian: np.ndarray, weights: np.ndarray, penalised: np.ndarray, rounds: int = 1000) -> np.ndarray:
    """The step that minimises the quadratic model plus the sum of penalised absolute weights, by coordinate descent."""
    step, slope = np.zeros_like(weights), gradient.copy()
    curve = hessian.diagonal()
    for _ in range(rounds):
        largest = 0.0
        for j in np.flatnonzero(curve > 0):
            now = weights[j] + step[j]
            free = now - slope[j] / curve[j]
            new = math.copysign(max(abs(free) - penalised[j] / curve[j], 0.0), free)
            if new != now:
                step[j] += new - now
                slope += hessian[:, j] * (new - now)
                largest = max(largest, abs(new - now) * curve[j])
        if largest < TOLERANCE / 10:
            break
    return step


def stationarity(gradient: np.ndarray, weights: np.ndarray, penalised: np.ndarray, l1: bool) -> float:
    """How far the weights are from the optimality conditions; ``gradient`` is the loss's alone."""
    if not l1:
        return float(np.abs(gradient + penalised * weights).max(initial=0.0))
    at_zero = np.maximum(np.abs(gradient) - penalised, 0.0)
    return float(np.where(weights == 0, at_zero, np.abs(gradient + penalised * np.sign(weights))).max(initial=0.0))


def minimize(
    rows: DataFrame, design: Design, size: int, loss: Loss, C: float, *, penalty: str = "l2", penalised: np.ndarray | None = None,
    tolerance: float = TOLERANCE, rounds: int = MAX_ITERATIONS,
) -> tuple[np.ndarray, float]:
    """Weights that minimise C * (weighted loss) + penalty, and how far they are from optimality.

    The penalty is half the sum of squares (``l2``) or the sum of absolute
    values (``l1``) of the ``penalised`` weights, all by default. ``rows`` has label (0 or 1), weight and
    vec and is read once an iteration; pass a written table. A step that
    does not lower the objective is halved. ``tolerance`` counts in units of C times the weighted rows.
    """
    if penalty not in ("l1", "l2"):
        raise ValueError(f"unknown penalty {penalty!r}")
    l1, mask = penalty == "l1", np.ones(size) if penalised is None else np.asarray(penalised, dtype=float)

    def cost(weights: np.ndarray) -> float:
        return float(mask @ np.abs(weights)) if l1 else 0.5 * float(mask @ (weights * weights))

    weights = np.zeros(size)
    here = quadratic(rows, design, loss, weights)
    scale = max(1.0, C * here.value)
    for _ in range(rounds):
        gradient = C * here.gradient
        far = stationarity(gradient, weights, mask, l1)
        if far <= tolerance * scale:
            break
        hessian = C * here.hessian
        if l1:
            hessian = hessian + 1e-12 * scale * np.eye(size)
            step = l1_step(gradient, hessian, weights, mask)
            fall = float(gradient @ step) + cost(weights + step) - cost(weights)
        else:
            whole = gradient + mask * weights
            step = np.linalg.solve(hessian + np.diag(np.maximum(mask, 1e-12 * scale)), -whole)
            fall = float(whole @ step)
        now, t = C * here.value + cost(weights), 1.0
        while True:
            there = quadratic(rows, design, loss, weights + t * step)
            if C * there.value + cost(weights + t * step) <= now + ARMIJO * t * fall or t < 1e-10:
                break
            t /= 2
        if t < 1e-10:
            break       # no lower value can be told apart in double precision
        weights, here = weights + t * step, there
    return weights, stationarity(C * here.gradient, weights, mask, l1)


def rbf(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """exp(-gamma |x - z|^2) of every row against every landmark."""
    squares = (x * x).sum(axis=1)[:, None] + (landmarks * landmarks).sum(axis=1) - 2.0 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(squares, 0.0))


def whitening(landmarks: np.ndarray, gamma: float, smallest: float = 1e-12) -> np.ndarray:
    """The map from kernel values at the landmarks to Nystroem features: k(x) times this has k(x, y) as products there."""
    values, vectors = np.linalg.eigh(rbf(landmarks, landmarks, gamma))
    kept = values > smallest * values.max()
    return vectors[:, kept] / np.sqrt(values[kept])


def weighted_rows(rows: DataFrame) -> DataFrame:
    """label, weight and vec as doubles."""
    return rows.select(F.col("label").cast("double").alias("label"), F.col("weight").cast("double").alias("weight"), F.col("vec").cast("array<double>").alias("vec"))
