"""Learners recover a planted effect, undersampling is undone, nuisances and the rank learner's labels are as defined."""

import math

import numpy as np
import pytest
from lodestone.operators import learners as L
from lodestone.operators import reporting as T
from lodestone.operators import sampling as N
from pyspark.sql import functions as F

P = L.Params(["x0", "x1"], trees=10, depth=3, step=0.2, propensity=0.5)


def planted(spark, n=4000, base=0.15, seed=1):
    """The effect is 0.4 where x0 is over a half, else 0; x1 moves the outcome in both arms."""
    rng = np.random.default_rng(seed)
    x = rng.random((n, 2))
    t = rng.random(n) < 0.5
    p = base + 0.2 * (x[:, 1] > 0.5) + 0.4 * t * (x[:, 0] > 0.5)
    y = rng.random(n) < p
    rows = [(i, float(a), float(b), int(c), int(d), int(e)) for i, (a, b, c, d, e) in enumerate(zip(x[:, 0], x[:, 1], t, y, y, strict=True))]
    return spark.createDataFrame(rows, "row_id long, x0 double, x1 double, treatment int, conversion int, visit int").repartition(2).cache()


@pytest.fixture(scope="module")
def data(spark):
    return planted(spark)


def contrast(scored):
    """Mean score where there is an effect, and where there is none."""
    r = scored.agg(F.avg(F.when(F.col("x0") > 0.5, F.col("score"))), F.avg(F.when(F.col("x0") <= 0.5, F.col("score")))).first()
    return r[0], r[1]


@pytest.mark.parametrize("name", ["t_learner", "x_learner", "dr_learner", "r_learner", "dina", "honest_forest"])
def test_effects_are_recovered(data, name):
    hi, lo = contrast(L.BUILDERS[name](data, P)(data))
    assert abs(hi - 0.4) < 0.12 and abs(lo) < 0.12


@pytest.mark.parametrize("name", ["s_learner", "anchored_r", "hybrid_logit", "rank_learner"])
def test_effects_are_ranked(data, name):
    build = L.BUILDERS[name] if name != "hybrid_logit" else lambda d, p: L.hybrid_logit(d, p, terms=6)
    scored = build(data, P)(data)
    hi, lo = contrast(scored)
    assert hi > lo
    auc = L.exact_auc(scored.withColumn("label", (F.col("x0") > 0.5).cast("int")), "score", "label").first()[0]
    assert auc > 0.8


def test_undersampling_is_undone(spark):
    full = planted(spark, 12_000, 0.03, 2)
    sample = N.undersample(full, 2.0, 7).cache()
    keep = {r["treatment"]: r["keep_rate"] for r in T.keep_rates(full, sample).collect()}
    assert 0 < keep[0] < 0.8 and sample.count() < full.count()
    for name in ("t_learner", "x_learner"):
        hi, lo = contrast(getattr(L, name)(sample, P, (keep[0], keep[1]))(full))
        assert abs(hi - 0.4) < 0.12 and abs(lo) < 0.12


def test_cross_fitted_models_have_not_seen_their_rows(spark, data):
    """A feature that is the row's own id lets a model know its rows by heart; models of other folds know nothing."""
    own = L.Params(["row_id"], trees=10, depth=5, step=0.5, propensity=0.5)
    d = L.cross_base(data, own)
    seen = L._classifier(own, data)(data, "_m")
    loss = lambda x: x.agg(F.avg(F.pow(F.col("conversion") - F.col("_m"), 2))).first()[0]
    assert d.count() == data.count() and loss(seen) < loss(d)


def test_pair_labels():
    """By the formula: soft order, its slope times what the signals say beyond the effects, clipped."""
    rows = [(0.3, 1.2, 0.1, (0.1, -0.4, 0.3)), (0.0, -9.0, 0.0, (0.1, 9.0, 0.0)), (0.1, 0.1, 0.0, (0.1, 0.1, 0.0))]
    columns = lambda rows: {c: np.array([r[k] for r in rows]) for k, c in enumerate(("effect", "tau", "f"))}
    got = list(zip(*L.pair_gradient(columns(rows), columns([r[3] for r in rows]), 0.5), strict=True))
    for (e, tau, f, (e2, tau2, f2)), r in zip(rows, got, strict=True):
        soft = 1 / (1 + math.exp(-(e - e2) / 0.5))
        label = min(max(soft + soft * (1 - soft) / 0.5 * ((tau - tau2) - (e - e2)), 1e-6), 1 - 1e-6)
        q = 1 / (1 + math.exp(-(f - f2)))
        assert math.isclose(r[0], q - label, abs_tol=1e-12) and math.isclose(r[1], q * (1 - q))


def test_propensity_auc_of_a_fair_trial(data):
    split = N.holdout_split(data, 0.3, 1).cache()
    for tree in (False, True):
        auc = L.propensity_auc(split.where("split = 'train'"), split.where("split = 'test'"), ["x0", "x1"], tree).first()["auc"]
        assert 0.42 < auc < 0.58


def test_pattern_scores(spark):
    """By plain sums over the rows of the other folds; a pattern of one fold alone has no residual."""
    rng = np.random.default_rng(4)
    rows = [(i, float(rng.integers(0, 2)), 5.0 if i == 7 else 0.0, int(rng.random() < 0.5), int(rng.random() < 0.3), 0.1 + 0.2 * float(rng.random()), i % 3) for i in range(600)]
    df = spark.createDataFrame(rows, "row_id long, x0 double, x1 double, treatment int, conversion int, m double, fold int").repartition(3)
    got = {r.row_id: r for r in L.pattern_scores(df, ["x0", "x1"], "conversion", "m", 0.5, "fold", 20.0).collect()}
    assert len(got) == 600 and got[7].residual == 0.0
    kind = {i: (got[i].pattern,) for i, *_ in rows}
    for i, _, _, _, _, m, k in rows[::37] + [rows[7]]:
        rest = [(t - 0.5, y, b, kind[j]) for j, _, _, t, y, b, f in rows if f != k]
        alpha = sum(r * b * (y - b) for r, y, b, _ in rest) / sum((r * b) ** 2 for r, y, b, _ in rest)
        same = [(r, y, b) for r, y, b, p in rest if p == kind[i]]
        residual = sum(r * r * ((y - b) - r * alpha * b) / r for r, y, b in same) / (sum(r * r for r, _, _ in same) + 20.0)
        assert math.isclose(got[i].residual, residual, abs_tol=1e-9)
        assert math.isclose(got[i].score, min(max(alpha * m + residual, -1), 1), abs_tol=1e-9)


@pytest.mark.parametrize("name", ["dina", "rank_learner", "hybrid_logit", "honest_forest"])
def test_rows_are_made_once(spark, name):
    """A learner makes its rows once, however many fits read them; lazily each fit made them some five times."""
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        made.add(1)
        return x

    n = 400
    df = spark.range(n).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("treatment"), (F.col("id") % 3 == 0).cast("int").alias("conversion"), counted((F.col("id") % 7).cast("double")).alias("f0"), (F.col("id") % 5).cast("double").alias("f1"))
    L.BUILDERS[name](df, L.Params(["f0", "f1"], trees=4 if name == "honest_forest" else 2, depth=2))
    assert made.value == n
