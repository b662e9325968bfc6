"""Second-order gradient-boosted trees: distributed histograms of gradient and hessian, one aggregation a level."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemark import schemas as S
from sievemark.operators.solvers import stacked
from sievemark.session import materialize

MAX_BINS = 256
EXACT_RANKS = 100_000     # quantiles of a feature are exact up to this many rows, and off by a row in so many beyond
KEEP_EVERY = 10           # margins are written after this many trees
LEAF = -1


@dataclass(frozen=True)
class Tree:
    """Nodes in breadth order; a row goes left where ``x[feature] <= cut``, right for NaN. ``cover`` is the hessian sum."""

    feature: tuple[int, ...]
    cut: tuple[float, ...]
    left: tuple[int, ...]
    right: tuple[int, ...]
    value: tuple[float, ...]
    cover: tuple[float, ...]
    gain: tuple[float, ...]


def walk(columns: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The node that each row of ``columns`` ends in."""
    node = np.zeros(len(columns), dtype=np.int64)
    rows = np.arange(len(columns))
    while True:
        f = feature[node]
        inner = f != LEAF
        if not inner.any():
            return node
        below = columns[rows, np.where(inner, f, 0)] <= cut[node]
        node = np.where(inner, np.where(below, left[node], right[node]), node)


def margins(x: np.ndarray, trees: tuple[Tree, ...], base: float = 0.0) -> np.ndarray:
    """Log-odds of raw vectors."""
    total = np.full(len(x), base)
    for t in trees:
        total += np.asarray(t.value)[walk(x, *(np.asarray(a) for a in (t.feature, t.cut, t.left, t.right)))]
    return total


def draws(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """A number from 0 to 1 for each row and tree, by the row's own hash."""
    salt = int.from_bytes(hashlib.sha256(f"{seed}:{tree}".encode()).digest()[:8], "little")
    h = keys.astype(np.uint64) ^ np.uint64(salt)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h / 2.0**64


def drawn_features(d: int, share: float, seed: int, tree: int) -> np.ndarray:
    """The features a tree may split on, by a seeded hash of their numbers."""
    order = sorted(range(d), key=lambda f: hashlib.sha256(f"{seed}:{tree}:{f}".encode()).digest())
    return np.sort(np.asarray(order[: max(1, int(share * d))]))


def bin_cuts(rows: DataFrame, max_bins: int) -> list[np.ndarray]:
    """Where each feature may be cut: its quantiles at every ``1 / max_bins``, below the largest value.

    The vectors are summarised by one sketch per feature and task; features x bins numbers reach the driver.
    """
    cells = rows.select(F.posexplode("vec").alias("f", "x")).filter(~F.isnan("x"))
    probabilities = [i / max_bins for i in range(1, max_bins)]
    found = cells.groupBy("f").agg(F.percentile_approx("x", probabilities, EXACT_RANKS).alias("q"), F.max("x").alias("top")).collect()
    cuts = {r["f"]: np.unique([q for q in r["q"] if q < r["top"]]) for r in found}
    return [cuts.get(f, np.zeros(0)) for f in range(max(cuts, default=-1) + 1)]


def split_gain(gl: np.ndarray, hl: np.ndarray, g: float, h: float, reg_lambda: float) -> np.ndarray:
    """Fall of the second-order objective when a node with sums (g, h) is split into (gl, hl) and the rest."""
    gr, hr = g - gl, h - hl
    return 0.5 * (gl * gl / (hl + reg_lambda) + gr * gr / (hr + reg_lambda) - g * g / (h + reg_lambda))


@dataclass
class _Growing:
    """A tree under construction; cuts are bin numbers."""

    feature: list[int] = field(default_factory=lambda: [LEAF])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])
    gain: list[float] = field(default_factory=lambda: [0.0])

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.asarray(a) for a in (self.feature, self.bin, self.left, self.right))

    def split(self, node: int, feature: int, cut: int, gain: float, left: tuple[float, float]) -> tuple[int, int]:
        g, h = self.sums[node]
        children = len(self.feature), len(self.feature) + 1
        self.feature[node], self.bin[node], self.gain[node] = feature, cut, gain
        self.left[node], self.right[node] = children
        for s in (left, (g - left[0], h - left[1])):
            self.feature.append(LEAF)
            self.bin.append(0)
            self.left.append(0)
            self.right.append(0)
            self.sums.append(s)
            self.gain.append(0.0)
        return children


_BINNED = pa.schema([("label", pa.float64()), ("key", pa.int64()), ("margin", pa.float64()), ("bins", pa.binary())])
_HISTOGRAM = pa.schema([("feature", pa.int32()), ("total", pa.binary())])
_BEST = pa.schema([
    ("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("gain", pa.float64()), ("gl", pa.float64()), ("hl", pa.float64()),
    ("g", pa.float64()), ("h", pa.float64()),
])
_BEST_DDL = "node int, feature int, bin int, gain double, gl double, hl double, g double, h double"


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def binned_rows(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """label, key, margin 0 and each feature's bin number: how many of its cuts lie below the value (NaN: all)."""
    kind = np.dtype("<u1" if max((c.size for c in cuts), default=0) < 256 else "<u2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = stacked(_column(batch, "vec"))
                if x.shape[1] != len(cuts):
                    raise ValueError("vectors are of unequal length")
                bins = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], axis=1).astype(kind)
                yield pa.RecordBatch.from_arrays([
                    _column(batch, "label"), _column(batch, "key"), pa.array(np.zeros(len(x))), pa.array([b.tobytes() for b in bins]),
                ], schema=_BINNED)

    return rows.mapInArrow(cut, "label double, key long, margin double, bins binary")


@dataclass(frozen=True)
class Level:
    """What the tasks of one pass need: how rows are binned, the trees not yet in the margins, and the open nodes."""

    cuts: list[np.ndarray]
    pending: list[tuple[tuple[np.ndarray, ...], np.ndarray]]
    bits: int
    reg_lambda: float
    gamma: float
    least: float
    subsample: float
    seed: int

    @property
    def n_bins(self) -> int:
        return max((c.size for c in self.cuts), default=0) + 1

    def matrix(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Bin numbers, and margins with the pending trees."""
        data = b"".join(_column(batch, "bins").to_pylist())
        bins = np.frombuffer(data, dtype="<u1" if self.n_bins <= 256 else "<u2").reshape(batch.num_rows, len(self.cuts))
        margin = _column(batch, "margin").to_numpy(zero_copy_only=False).copy()
        for arrays, values in self.pending:
            margin += values[walk(bins, *arrays)]
        return bins, margin

    def histograms(self, tree: tuple[np.ndarray, ...], nodes: list[int], used: np.ndarray, number: int):
        """A task's sums of gradient and hessian per (open node, bin), one row a feature."""
        place = np.full(tree[0].size, -1)
        place[nodes] = np.arange(len(nodes))
        unit = 2.0**self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((used.size, 2, len(nodes) * self.n_bins), dtype=np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                bins, margin = self.matrix(batch)
                at = place[walk(bins, *tree)]
                mine = at >= 0
                if self.subsample < 1:
                    mine &= draws(_column(batch, "key").to_numpy(zero_copy_only=False), self.seed, number) < self.subsample
                y = _column(batch, "label").to_numpy(zero_copy_only=False)[mine]
                p = 1.0 / (1.0 + np.exp(-margin[mine]))
                sums = [np.rint(v * unit) for v in (p - y, p * (1.0 - p))]
                bins, at = bins[mine], at[mine] * self.n_bins
                for k, f in enumerate(used):
                    cell = at + bins[:, f]
                    for which, v in enumerate(sums):
                        total[k, which] += np.bincount(cell, weights=v, minlength=total.shape[2]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(used, type=pa.int32()), pa.array([t.tobytes() for t in total])], schema=_HISTOGRAM)

        return run

    def best(self, nodes: list[int]):
        """The best cut of each feature, per open node, from the histograms of all tasks."""
        unit = 2.0**self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            totals: dict[int, np.ndarray] = {}
            for batch in batches:
                for f, data in zip(_column(batch, "feature").to_pylist(), _column(batch, "total").to_pylist(), strict=True):
                    totals[f] = totals.get(f, 0) + np.frombuffer(data, dtype=np.int64)
            out = []
            for f, total in sorted(totals.items()):
                below = np.cumsum(total.reshape(2, len(nodes), self.n_bins), axis=2) / unit
                for k, node in enumerate(nodes):
                    (gl, hl), (g, h) = below[:, k, : self.cuts[f].size], below[:, k, -1]
                    b, top, left = -1, -np.inf, (0.0, 0.0)
                    if gl.size:
                        with np.errstate(invalid="ignore"):
                            gain = split_gain(gl, hl, g, h, self.reg_lambda) - self.gamma
                        gain[(hl < self.least) | (h - hl < self.least) | np.isnan(gain)] = -np.inf
                        b = int(np.argmax(gain))
                        top, left = gain[b], (gl[b], hl[b])
                    out.append((node, f, b, top, *left, g, h))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(zip(*out, strict=True), _BEST, strict=True)], schema=_BEST)

        return run

    def moved(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with the pending trees in their margins."""
        for batch in batches:
            if batch.num_rows:
                margin = self.matrix(batch)[1]
                yield pa.RecordBatch.from_arrays([_column(batch, "label"), _column(batch, "key"), pa.array(margin), _column(batch, "bins")], schema=_BINNED)


class Booster:
    """Grows trees on binned rows, which it rewrites with new margins from time to time."""

    def __init__(self, binned: DataFrame, level: Level, learning_rate: float, colsample: float, max_depth: int):
        self.binned, self.level, self.learning_rate, self.colsample, self.max_depth = binned, level, learning_rate, colsample, max_depth

    def best_splits(self, tree: _Growing, nodes: list[int], number: int) -> dict[int, tuple]:
        """For each open node its best split and sums, as (gain, feature, bin, gl, hl, g, h)."""
        level = self.level
        used = drawn_features(len(level.cuts), self.colsample, level.seed, number)
        # Every task passes on one histogram a feature; they meet by feature, and a row a node and feature is left.
        partitions = min(used.size, int(self.binned.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        parts = self.binned.mapInArrow(level.histograms(tree.arrays(), nodes, used, number), "feature int, total binary")
        merged = parts.repartition(partitions, "feature").mapInArrow(level.best(nodes), _BEST_DDL)
        order = F.struct("gain", (-F.col("feature")).alias("first"), (-F.col("bin")).alias("low"))
        winners = merged.groupBy("node").agg(F.max_by(F.struct("gain", "feature", "bin", "gl", "hl", "g", "h"), order).alias("w"))
        return {r["node"]: tuple(r["w"]) for r in winners.collect()}

    def grow(self, number: int) -> Tree:
        tree, open_ = _Growing(), [0]
        for depth in range(self.max_depth):
            found = self.best_splits(tree, open_, number)
            following = []
            for node in open_:
                gain, feature, cut, gl, hl, g, h = found[node]
                if depth == 0:
                    tree.sums[0] = (g, h)
                if gain > 0 and math.isfinite(gain):
                    following += tree.split(node, feature, cut, gain, (gl, hl))
            open_ = following
            if not open_:
                break
        lam, cuts = self.level.reg_lambda, self.level.cuts
        values = np.array([-self.learning_rate * g / (h + lam) if f == LEAF else 0.0 for f, (g, h) in zip(tree.feature, tree.sums, strict=True)])
        self.level.pending.append((tree.arrays(), values))
        cut = tuple(float(cuts[f][b]) if f != LEAF else 0.0 for f, b in zip(tree.feature, tree.bin, strict=True))
        return Tree(tuple(tree.feature), cut, tuple(tree.left), tuple(tree.right), tuple(values.tolist()), tuple(h for _, h in tree.sums), tuple(tree.gain))

    def keep_margins(self) -> None:
        """Write the margins with all trees so far, so that a row is not walked through every earlier tree again."""
        self.binned = materialize(self.binned.mapInArrow(self.level.moved, self.binned.schema), "margins")
        self.level.pending.clear()


def fit_trees(
    train: DataFrame, *, n_estimators: int = 100, max_depth: int = 3, learning_rate: float = 0.1, subsample: float = 1.0,
    colsample_bytree: float = 1.0, min_child_weight: float = 1, reg_lambda: float = 1.0, gamma: float = 0.0, max_bins: int = MAX_BINS,
    seed: int = S.DEFAULT_SEED,
) -> tuple[tuple[Tree, ...], int]:
    """Trees for the log-odds of ``label`` = 1, from margin 0, and the number of features.

    Each level is one pass: tasks add gradients and hessians into histograms
    per (node, feature, bin), histograms meet by feature, and one best split
    a node comes back. A split must gain and leave a hessian sum of
    ``min_child_weight`` on both sides; equal gains go to the smaller feature,
    then the smaller cut. Row and feature draws hang on hashes of the row and
    of the feature's number, so a refit gives the same trees at any parallelism. A task
    holds features x bins x open nodes sums.
    """
    rows = train.select(F.col("label").cast("double").alias("label"), F.xxhash64("vec").alias("key"), F.col("vec").cast("array<double>").alias("vec"))
    cuts = bin_cuts(rows, max_bins)
    if not cuts:
        raise ValueError("no rows to fit on")
    binned = materialize(binned_rows(rows, cuts), "binned")
    # Gradients are added as whole multiples of 2^-bits: sums are exact, so trees do not hang on the order of rows.
    bits = min(36, 61 - max(1, binned.count()).bit_length())
    level = Level(cuts, [], bits, reg_lambda, gamma, min_child_weight, subsample, seed)
    booster, trees = Booster(binned, level, learning_rate, colsample_bytree, max_depth), []
    for number in range(n_estimators):
        trees.append(booster.grow(number))
        if len(level.pending) == KEEP_EVERY and number + 1 < n_estimators:
            booster.keep_margins()
    return tuple(trees), len(cuts)
