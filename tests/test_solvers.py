"""Solvers against brute force: second-order trees, kernel margin, penalised logistic regression."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from sievemark.operators import boosting, models, solvers
from sievemark.session import materialize


@pytest.fixture(scope="module")
def given(spark):
    """200 of the given vectors with a label that their first three elements decide, mostly."""
    e = spark.read.parquet(f"{SMALL}/embeddings.parquet").where("vec_id < 200")
    vec = F.col("embedding").cast("array<double>")
    noise = (F.pmod(F.xxhash64("vec_id"), F.lit(100)) / 400.0).cast("double")
    label = (vec[0] + F.abs(vec[1]) * 2 - vec[2] + noise > 0.2).cast("int")
    return materialize(e.select("vec_id", label.alias("label"), F.slice(vec, 1, 8).alias("vec")).orderBy("vec_id"))


@pytest.fixture(scope="module")
def arrays(given):
    got = given.orderBy("vec_id").collect()
    return np.array([r["vec"] for r in got]), np.array([r["label"] for r in got])


# --- boosted trees


def grown(x, y, margin, depth, rate, least, lam=1.0, cuts=None):
    """A tree by trying every cut of every feature; returns (nested splits, margin after it)."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)

    def node(rows, level):
        top = (0.0, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        if level < depth:
            for f in range(x.shape[1]):
                for cut in (np.unique(x[:, f])[:-1] if cuts is None else cuts[f]):
                    left = rows[x[rows, f] <= cut]
                    gl, hl = g[left].sum(), h[left].sum()
                    if hl < least or total_h - hl < least:
                        continue
                    gain = 0.5 * (gl**2 / (hl + lam) + (total_g - gl) ** 2 / (total_h - hl + lam) - total_g**2 / (total_h + lam))
                    if gain > top[0] + 1e-9:
                        top = (gain, (f, cut, left))
        if top[1] is None:
            out[rows] += -rate * total_g / (total_h + lam)
            return -rate * total_g / (total_h + lam)
        f, cut, left = top[1]
        return (f, cut, node(left, level + 1), node(np.setdiff1d(rows, left), level + 1))

    out = margin.copy()
    return node(np.arange(len(x)), 0), out


def nested(tree, node=0):
    if tree.feature[node] < 0:
        return tree.value[node]
    return tree.feature[node], tree.cut[node], nested(tree, tree.left[node]), nested(tree, tree.right[node])


def same(a, b):
    if isinstance(a, tuple):
        return isinstance(b, tuple) and a[:2] == b[:2] and same(a[2], b[2]) and same(a[3], b[3])
    return not isinstance(b, tuple) and a == pytest.approx(b, abs=1e-8)


@pytest.mark.parametrize("least", [1, 3, 5])
def test_trees_equal_exhaustive_search(given, arrays, least):
    x, y = arrays
    trees, size = boosting.fit_trees(given, n_estimators=3, max_depth=2, learning_rate=0.3, min_child_weight=least)
    assert size == 8 and len(trees) == 3
    margin = np.zeros(len(x))
    for tree in trees:
        expected, margin = grown(x, y, margin, 2, 0.3, least)
        assert same(nested(tree), expected)
    assert boosting.margins(x, trees) == pytest.approx(margin, abs=1e-8)
    scored = models.BoostedModel(trees, size).score(given).orderBy("vec_id").collect()
    assert [r["score"] for r in scored] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-9)


def test_child_weight_changes_trees(given):
    trees = [boosting.fit_trees(given, n_estimators=3, max_depth=4, min_child_weight=w)[0] for w in (1, 3, 5)]
    assert len(set(trees)) == 3
    for w, ensemble in zip((1, 3, 5), trees):
        assert min(c for t in ensemble for c in t.cover) >= w


def test_few_bins_and_written_margins(given, arrays, monkeypatch):
    """Cuts at quantiles only; margins written after every tree give the same trees."""
    x, y = arrays
    cuts = boosting.bin_cuts(given, 8)
    for f, c in enumerate(cuts):
        values = np.sort(x[:, f])
        assert c.tolist() == sorted({values[int(np.ceil(len(x) * k / 8)) - 1] for k in range(1, 8)})
    once = boosting.fit_trees(given, n_estimators=3, max_depth=2, max_bins=8)[0]
    monkeypatch.setattr(boosting, "KEEP_EVERY", 1)
    assert boosting.fit_trees(given.repartition(7), n_estimators=3, max_depth=2, max_bins=8)[0] == once
    assert same(nested(once[0]), grown(x, y, np.zeros(len(x)), 2, 0.1, 1, cuts=cuts)[0])


def test_draws_of_rows_and_features(given, arrays):
    a = boosting.fit_trees(given, n_estimators=4, max_depth=2, subsample=0.5, colsample_bytree=0.25)[0]
    assert a == boosting.fit_trees(given.repartition(5), n_estimators=4, max_depth=2, subsample=0.5, colsample_bytree=0.25)[0]
    for number, tree in enumerate(a):
        allowed = set(boosting.drawn_features(8, 0.25, 42, number).tolist())
        assert len(allowed) == 2 and {f for f in tree.feature if f >= 0} <= allowed
        assert 0.3 * 50 < tree.cover[0] < 0.7 * 50
    keys = np.arange(20_000, dtype=np.int64) * 7
    assert abs((boosting.draws(keys, 1, 2) < 0.3).mean() - 0.3) < 0.02


def test_trees_of_odd_rows(spark):
    """Constant and missing values, one class, one row, no row."""
    nan = float("nan")
    rows = spark.createDataFrame([(k % 2, [1.0, float(k % 2) if k % 3 else nan]) for k in range(40)], "label int, vec array<double>")
    (tree,), _ = boosting.fit_trees(rows, n_estimators=1, max_depth=2)
    assert set(tree.feature) <= {-1, 1} and tree.feature[0] == 1
    for labels in ([1, 1, 1], [0]):
        (tree,), _ = boosting.fit_trees(spark.createDataFrame([(y, [float(k)]) for k, y in enumerate(labels)], "label int, vec array<double>"), n_estimators=1)
        assert tree.feature == (-1,) and (tree.value[0] > 0) == (labels[0] == 1)
    with pytest.raises(ValueError):
        boosting.fit_trees(rows.limit(0), n_estimators=1)


# --- logistic regression


def logistic_objective(z, y, w, C, penalty, s):
    value = C * (s * np.logaddexp(0, -(2 * y - 1) * (z @ w))).sum()
    return value + (np.abs(w).sum() if penalty == "l1" else 0.5 * w @ w)


def designed(x):
    scale = np.where(x.std(axis=0) == 0, 1, x.std(axis=0))
    return np.column_stack([(x - x.mean(axis=0)) / scale, np.ones(len(x))])


@pytest.mark.parametrize("penalty, C, weight", [("l2", 0.1, None), ("l2", 3.0, "balanced"), ("l1", 0.03, None), ("l1", 1.0, "balanced")])
def test_logistic_is_optimal(given, arrays, penalty, C, weight):
    x, y = arrays
    model = models.fit_logistic(given, C=C, penalty=penalty, class_weight=weight)
    w, z = np.append(model.coefficients, model.intercept), designed(x)
    s = np.ones(len(y)) if weight is None else np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    margin = (2 * y - 1) * (z @ w)
    gradient = -C * z.T @ (s * (2 * y - 1) / (1 + np.exp(margin)))
    if penalty == "l2":
        assert np.abs(gradient + w).max() < 1e-6
    else:
        assert np.abs(gradient[w != 0] + np.sign(w[w != 0])).max(initial=0) < 1e-6
        assert (np.abs(gradient[w == 0]) <= 1 + 1e-6).all()
        assert C > 0.1 or (w == 0).any()
    best = logistic_objective(z, y, w, C, penalty, s)
    rng = np.random.default_rng(3)
    for size in (1e-1, 1e-3):
        assert all(logistic_objective(z, y, w + rng.normal(0, size, w.size), C, penalty, s) >= best for _ in range(200))


@pytest.mark.parametrize("penalty, C", [("l2", 0.5), ("l1", 0.05), ("l1", 2.0)])
def test_logistic_of_two_features_against_a_grid(given, arrays, penalty, C):
    x, y = arrays
    two = given.withColumn("vec", F.slice("vec", 1, 2))
    model = models.fit_logistic(two, C=C, penalty=penalty)
    w, z, centre, width = np.append(model.coefficients, model.intercept), designed(x[:, :2]), np.zeros(3), 4.0
    for _ in range(40):     # a shrinking grid search
        points = [centre + width * np.array(p) for p in itertools.product((-1, -0.5, 0, 0.5, 1), repeat=3)]
        centre = min(points, key=lambda p: logistic_objective(z, y, p, C, penalty, 1.0))
        width *= 0.6
    assert w == pytest.approx(centre, abs=1e-5)


def test_logistic_constant_feature_one_class_and_separable(spark):
    rows = spark.createDataFrame([(int(k >= 10), [5.0, float(k)]) for k in range(20)], "label int, vec array<double>")
    for penalty in ("l1", "l2"):
        model = models.fit_logistic(rows, C=1.0, penalty=penalty)
        assert model.coefficients[0] == pytest.approx(0.0, abs=1e-9) and model.coefficients[1] > 0
    single = models.fit_logistic(rows.where("label = 1"), C=1.0)
    assert single.intercept > 0
    with pytest.raises(ValueError):
        models.fit_logistic(rows, penalty="l3")
    with pytest.raises(ValueError):
        models.fit_logistic(rows.limit(0))


# --- kernel margin


def exact_kernel(k, y, C, s, rounds=500):
    """Squared-hinge kernel machine with an unpenalised intercept: Newton on the whole kernel matrix, over active rows."""
    n, sign = len(y), 2.0 * y - 1
    active = np.ones(n, dtype=bool)
    for _ in range(rounds):
        m = int(active.sum())
        system = np.zeros((m + 1, m + 1))
        system[:m, :m] = k[np.ix_(active, active)] + np.diag(1 / (2 * C * s[active]))
        system[:m, m] = system[m, :m] = 1
        solved = np.linalg.solve(system, np.append(sign[active], 0))
        alpha = np.zeros(n)
        alpha[active] = solved[:m]
        f = k @ alpha + solved[m]
        now = sign * f < 1
        if (now == active).all():
            return f
        active = now
    raise AssertionError("no fixed point")


@pytest.mark.parametrize("weight", [None, "balanced"])
def test_margin_with_every_row_a_landmark_is_exact(given, arrays, weight):
    x, y = arrays
    model = models.fit_margin(given, C=1.0, gamma=0.05, landmarks=200, class_weight=weight)
    z = designed(x)[:, :-1]
    k = np.exp(-0.05 * ((z[:, None] - z[None]) ** 2).sum(axis=2))
    s = np.ones(len(y)) if weight is None else np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    got = np.array([r["score"] for r in model.score(given).orderBy("vec_id").collect()])
    assert got == pytest.approx(exact_kernel(k, y, 1.0, s), abs=1e-6)


def test_fewer_landmarks_come_closer_as_they_grow(given, arrays):
    x, y = arrays
    z = designed(x)[:, :-1]
    exact = exact_kernel(np.exp(-0.05 * ((z[:, None] - z[None]) ** 2).sum(axis=2)), y, 1.0, np.ones(len(y)))
    gaps = []
    for count in (20, 50, 100):
        got = [r["score"] for r in models.fit_margin(given, C=1.0, gamma=0.05, landmarks=count).score(given).orderBy("vec_id").collect()]
        gaps.append(float(np.sqrt(np.mean((np.array(got) - exact) ** 2))))
    assert gaps == sorted(gaps, reverse=True) and gaps[-1] < 0.2


def test_landmarks_are_distinct_and_reproducible(given):
    twice = given.unionByName(given)
    chosen = models.landmark_rows(twice, 50)
    assert len({tuple(v) for v in chosen}) == 50 and chosen == models.landmark_rows(given.repartition(5), 50)
    assert len(models.landmark_rows(twice, 1000)) == 200


def test_sums_of_many_parts(spark):
    """More tasks than the driver adds by itself."""
    rows = materialize(spark.createDataFrame([(k % 2, 1.0, [float(k), 1.0]) for k in range(2000)], "label int, weight double, vec array<double>").repartition(80))
    q = solvers.quadratic(solvers.weighted_rows(rows), lambda x: x, solvers.squared_hinge_loss, np.zeros(2))
    assert q.value == 2000 and q.hessian[0, 0] == 2 * sum(k * k for k in range(2000)) and q.gradient[1] == 0
