"""Trees from histograms against a NumPy version; planted effects and their intervals."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.boosting import Growth, best_cut, boost, causal_forest, logistic, squared


def numpy_trees(x, y, edges, growth, rounds, step):
    """The same boosting of squared errors by recursion over rows, without sums by bin of other nodes."""
    bins = np.stack([np.searchsorted(e, v) for v, e in zip(x.T, edges, strict=True)], 1)
    f, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        cuts, leaf = {}, np.zeros(len(y), int)
        frontier, splits = [0], 0
        for _ in range(growth.depth):
            found = []
            for node in frontier:
                own = leaf == node
                sums = np.zeros((x.shape[1], growth.bins, 3))
                for k in range(x.shape[1]):
                    for j, w in enumerate((f - y, np.ones(len(y)), np.ones(len(y)))):
                        np.add.at(sums[k, :, j], bins[own, k], w[own])
                gain, k, b, _ = best_cut(sums, np.ones(x.shape[1], bool), growth)
                found.append((-gain, node, k, b))
            frontier = []
            for gain, node, k, b in sorted(found):
                if gain < 0 and splits < growth.leaves - 1:
                    splits += 1
                    cuts[node] = (k, b)
                    own = leaf == node
                    leaf[own] = 2 * node + 1 + (bins[own, k] > b)
                    frontier += [2 * node + 1, 2 * node + 2]
        value = {n: -(f - y)[leaf == n].sum() / ((leaf == n).sum() + growth.l2) for n in np.unique(leaf)}
        f = f + step * np.array([value[n] for n in leaf])
        trees.append(cuts)
    return trees, f


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    n = 5000
    x = np.round(rng.normal(size=(n, 3)), 2)
    x[:, 2] = rng.integers(0, 4, n)
    y = np.sin(2 * x[:, 0]) + (x[:, 1] > 0.3) * x[:, 2] + 0.1 * rng.normal(size=n)
    data = [(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(data, "row_id long, a double, b double, c double, y double").repartition(4)


def test_trees_equal_numpy(rows):
    x, y, df = rows
    g = Growth(depth=3, leaves=6, min_rows=30, bins=32)
    made = boost(df, ["a", "b", "c"], ["y"], squared("y"), rounds=4, step=0.3, growth=g, keep=2)
    want, f = numpy_trees(x, y, made.edges, g, 4, 0.3)
    got = [{i: (int(t.feature[i]), int(t.cut[i])) for i in np.flatnonzero(t.feature >= 0)} for t in made.trees]
    assert got == want and max(len(t) for t in got) == 5
    scored = {r.row_id: r.score for r in made.score(df).collect()}
    assert np.allclose([scored[i] for i in range(len(y))], f)


def test_early_stop_and_logistic(rows, spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 2))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    data = [(i, float(a), float(b), float(rng.random() < q)) for i, ((a, b), q) in enumerate(zip(x, p, strict=True))]
    df = spark.createDataFrame(data, "row_id long, a double, b double, y double")
    value = lambda b, f: np.logaddexp(0, f) - b["y"] * f
    made = boost(df, ["a", "b"], ["y"], logistic("y"), rounds=60, step=0.5, growth=Growth(depth=3, leaves=8), keep=5, held_out=F.col("row_id") % 4 == 0, value=value, patience=1)
    assert len(made.trees) < 60 and made.history[len(made.trees) // 5 - 1] == min(made.history)
    got = {r.row_id: 1 / (1 + math.exp(-r.score)) for r in made.score(df).collect()}
    assert abs(np.array([got[i] for i in range(4000)]) - p).mean() < 0.05


def test_nulls_constants_and_empty_nodes(spark):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i % 5), 1.0, float(i % 3 == 0)) for i in range(300)], "row_id long, a double, k double, y double")
    made = boost(df, ["a", "k"], ["y"], squared("y"), rounds=2, step=1.0, growth=Growth(depth=2, leaves=4, l2=0.0))
    assert all(abs(r.score - r.y) < 1e-9 for r in made.score(df).collect())
    none = boost(df.withColumn("y", F.lit(1.0)), ["k"], ["y"], squared("y"), rounds=1, step=1.0, growth=Growth(l2=0.0))
    assert {round(r.score, 9) for r in none.score(df).collect()} == {1.0}


def test_causal_forest(spark):
    """A planted effect of two steps is recovered within 0.05, cut where it changes, and intervals hold it as often as they say."""
    rng = np.random.default_rng(11)
    n = 6000
    x = rng.random((n, 3))
    tau = np.where(x[:, 0] > 0.5, 0.8, 0.2)
    t = rng.random(n) < 0.5
    y = x[:, 1] + tau * t + 0.3 * rng.normal(size=n)
    m = x[:, 1] + 0.5 * tau  # the outcome's mean, whatever the arm
    data = [(i, *map(float, r), float(v), float(u)) for i, (r, v, u) in enumerate(zip(x, y - m, t - 0.5, strict=True))]
    df = spark.createDataFrame(data, "row_id long, a double, b double, c double, y double, t double").repartition(4)
    forest = causal_forest(df, ["a", "b", "c"], "row_id", "y", "t", trees=200, growth=Growth(depth=3, leaves=8, min_rows=50, min_curvature=1e-6, l2=0.0, bins=32))
    roots = [tree.feature[0] for tree in forest.trees]
    assert np.mean(np.array(roots)[[f != -1 for f in roots]] == 0) > 0.6
    for own in (None, "row_id"):
        got = {r.row_id: r for r in forest.score(df, own).collect()}
        away = [i for i in range(n) if abs(x[i, 0] - 0.5) > 0.05]
        effect = np.array([got[i].score for i in away])
        high = tau[away] > 0.5
        assert abs(effect[high].mean() - 0.8) < 0.05 and abs(effect[~high].mean() - 0.2) < 0.05
        inside = np.mean([got[i].lower <= tau[i] <= got[i].upper for i in away])
        assert inside >= 0.9  # the effect is flat beside its step, so nearby trees agree and intervals are wide
