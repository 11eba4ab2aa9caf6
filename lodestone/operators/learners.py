"""Response and effect learners: cell means (plain aggregation) and ``pyspark.ml`` trees.

A fit never sees the rows it predicts where a fold column is given. Outcomes after treatment are no features.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.signals import dr_signal, hybrid_effect, hybrid_transforms, pattern_id, restore_probability, sigmoid, uniform
from lodestone.operators.boosting import Batch, Growth, boost, causal_forest
from lodestone.operators.diagnostics import average_ranks, sentinel_flags
from lodestone.session import materialize


# Cell means: a table of group means, joined back.


def cell_nuisance(df: DataFrame, cells: list[str], outcome: str, fold: str | None = None) -> DataFrame:
    """``df`` with mu0 and mu1: each arm's mean outcome in the row's cell, in other folds only if ``fold`` is given.

    A cell without rows of an arm takes that arm's mean over all cells.
    """
    t, y = F.col("treatment"), F.col(outcome)
    sums = [F.sum(t).alias("_n1"), F.sum(1 - t).alias("_n0"), F.sum(t * y).alias("_y1"), F.sum((1 - t) * y).alias("_y0")]
    names = ("_n1", "_n0", "_y1", "_y0")
    all_ = df.groupBy(*cells).agg(*sums)
    if fold:
        own = df.groupBy(*cells, fold).agg(*sums)
        rest = own.join(all_.withColumnsRenamed({n: f"{n}a" for n in names}), cells)
        table = rest.select(*cells, fold, *[(F.col(f"{n}a") - F.col(n)).alias(n) for n in names])
    else:
        table = all_
    g = df.agg(*[s.alias(f"_g{n}") for s, n in zip((F.sum(t), F.sum(1 - t), F.sum(t * y), F.sum((1 - t) * y)), names, strict=True)])
    mean = lambda a: F.coalesce(F.try_divide(f"_y{a}", f"_n{a}"), F.try_divide(f"_g_y{a}", f"_g_n{a}"))
    d = df.join(table, [*cells, *([fold] if fold else [])]).join(g)
    return d.withColumns({"mu0": mean(0), "mu1": mean(1)}).drop(*names, *[f"_g{n}" for n in names])


def cell_t_learner(df: DataFrame, cells: list[str], outcome: str, fold: str | None = None) -> DataFrame:
    return cell_nuisance(df, cells, outcome, fold).withColumn("score", F.col("mu1") - F.col("mu0"))


def cell_scorer(df: DataFrame, cells: list[str], outcome: str, prior: float = 0.0) -> Scorer:
    """A scorer of the difference of both arms' mean outcomes in a row's cell, nulls being a cell of their own.

    Each mean is shrunk by ``prior`` rows to its arm's mean over all cells, which a cell without rows of the arm takes.
    """
    t, y = F.col("treatment"), F.col(outcome)
    sums = {"_n1": F.sum(t), "_n0": F.sum(1 - t), "_y1": F.sum(t * y), "_y0": F.sum((1 - t) * y)}
    key = [f"_k{i}" for i in range(len(cells))]
    keyed = lambda d: d.withColumns({k: F.col(c) for k, c in zip(key, cells, strict=True)})
    table = materialize(keyed(df).groupBy(*key).agg(*[c.alias(n) for n, c in sums.items()]))
    total = table.agg(*[F.sum(n).alias(n) for n in sums]).first()
    overall = {a: float(total[f"_y{a}"] or 0) / float(total[f"_n{a}"] or 1) for a in (0, 1)}
    mean = lambda a: F.coalesce(F.try_divide(F.col(f"_y{a}") + F.lit(prior * overall[a]), F.col(f"_n{a}") + F.lit(float(prior))), F.lit(overall[a]))
    table = table.select(*[F.col(k).alias(f"{k}r") for k in key], (mean(1) - mean(0)).alias("_effect"))

    def score(d: DataFrame) -> DataFrame:
        on = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in key])
        joined = keyed(d.drop("score")).join(table, on, "left")
        return joined.withColumn("score", F.coalesce("_effect", F.lit(overall[1] - overall[0]))).drop("_effect", *key, *[f"{k}r" for k in key])

    return score


def cell_funnel(df: DataFrame, cells: list[str]) -> DataFrame:
    """P(visit) * P(conversion given visit) by arm and cell, and their difference."""
    t, v, y = F.col("treatment"), F.col("visit"), F.col("conversion")
    arm = lambda a: (t == a).cast("int")
    sums = [x for a in (0, 1) for x in (F.sum(arm(a)).alias(f"n{a}"), F.sum(arm(a) * v).alias(f"v{a}"), F.sum(arm(a) * v * y).alias(f"c{a}"))]
    p = lambda a: F.coalesce(F.try_divide(f"v{a}", f"n{a}") * F.try_divide(f"c{a}", f"v{a}"), F.lit(0.0))
    return df.groupBy(*cells).agg(*sums).select(*cells, p(0).alias("p0"), p(1).alias("p1"), (p(1) - p(0)).alias("score"))


def pattern_shrinkage(df: DataFrame, features: list[str], outcome: str, m: str, e: float, prior: float = 1000.0) -> DataFrame:
    """(pattern, residual): weighted mean of the residual target by pattern of mode flags, shrunk to 0."""
    d, flags = sentinel_flags(df, features)
    r = F.col("treatment") - F.lit(e)
    w = F.pow(r, 2)
    alpha = F.try_divide(F.sum(r * F.col(m) * (F.col(outcome) - F.col(m))), F.sum(F.pow(r * F.col(m), 2)))
    d = d.withColumn("pattern", pattern_id([F.col(f) for f in flags])).join(d.agg(alpha.alias("_a")))
    target = ((F.col(outcome) - F.col(m)) - r * F.col("_a") * F.col(m)) / r
    return d.groupBy("pattern").agg(F.count("*").alias("n"), (F.sum(w * target) / (F.sum(w) + F.lit(prior))).alias("residual"))


def pattern_scores(df: DataFrame, features: list[str], outcome: str, m: str, e: float, fold: str, prior: float = 1000.0) -> DataFrame:
    """``df`` with pattern, residual and score: alpha * m and the residual of the row's pattern of mode flags, in [-1, 1].

    alpha and residuals are of the other folds: sums by (pattern, fold), from which a fold's own are subtracted. A pattern
    that no other fold holds has the residual 0.
    """
    d, flags = sentinel_flags(df, features)
    d = d.withColumn("pattern", pattern_id([F.col(f) for f in flags])).drop(*flags)
    r, rest = F.col("treatment") - F.lit(e), F.col(outcome) - F.col(m)
    sums = {"_a": F.sum(r * F.col(m) * rest), "_b": F.sum(F.pow(r * F.col(m), 2)), "_x": F.sum(r * rest), "_y": F.sum(F.pow(r, 2) * F.col(m)), "_z": F.sum(F.pow(r, 2))}
    own = materialize(d.groupBy("pattern", fold).agg(*[v.alias(k) for k, v in sums.items()]))
    folds = own.groupBy(fold).agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    all_ = own.agg(F.sum("_a").alias("_aa"), F.sum("_b").alias("_bb"))
    alpha = folds.join(all_).select(fold, F.coalesce(F.try_divide(F.col("_aa") - F.col("_a"), F.col("_bb") - F.col("_b")), F.lit(0.0)).alias("_alpha"))
    total = own.groupBy("pattern").agg(*[F.sum(c).alias(f"{c}{c[1]}") for c in ("_x", "_y", "_z")])
    left = own.join(total, "pattern").join(alpha, fold)
    residual = (F.col("_xx") - F.col("_x") - F.col("_alpha") * (F.col("_yy") - F.col("_y"))) / (F.col("_zz") - F.col("_z") + F.lit(prior))
    table = left.select("pattern", fold, residual.alias("residual"))
    out = d.join(table, ["pattern", fold], "left").join(F.broadcast(alpha), fold).withColumn("residual", F.coalesce("residual", F.lit(0.0)))
    score = F.col("_alpha") * F.col(m) + F.col("residual")
    return out.withColumn("score", F.greatest(F.least(score, F.lit(1.0)), F.lit(-1.0))).drop("_alpha")


# pyspark.ml learners: fit(df) gives a function that adds ``score`` to any table with the features.


@dataclass(frozen=True)
class Params:
    features: list[str]
    outcome: str = "conversion"
    propensity: float = 0.85
    trees: int = 20
    depth: int = 3
    step: float = 0.1
    seed: int = 7
    extra: dict = field(default_factory=dict)


Scorer = Callable[[DataFrame], DataFrame]


def with_mean_propensity(df: DataFrame, p: Params) -> Params:
    """``p`` with the share of treated rows in ``df`` as propensity; a table of one arm raises."""
    share = df.agg(F.avg("treatment")).first()[0]
    if share is None or not 0 < share < 1:
        raise ValueError("a propensity needs rows of both arms")
    return replace(p, propensity=float(share))


def _growth(p: Params) -> Growth:
    return Growth(depth=p.depth, leaves=1 << p.depth, seed=p.seed, **p.extra)


def probability_model(p: Params, df: DataFrame, features: list[str] | None = None, label: str | None = None) -> PipelineModel | float:
    """Trees for P(label = 1); without both classes the base rate."""
    label = label or p.outcome
    features = features or p.features
    facts = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.avg(label).alias("m")).first()
    if facts["lo"] == facts["hi"]:
        return float(facts["m"] or 0.0)
    trees = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=p.trees, maxDepth=p.depth, stepSize=p.step, seed=p.seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), trees]).fit(df.withColumn("_y", F.col(label).cast("double")))


def add_probability(model: PipelineModel | float, d: DataFrame, out: str) -> DataFrame:
    if isinstance(model, float):
        return d.withColumn(out, F.lit(model))
    return model.transform(d).withColumn(out, vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability", "prediction")


def _classifier(p: Params, df: DataFrame, features: list[str] | None = None, label: str | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds P(label = 1) as a column."""
    model = probability_model(p, df, features, label)
    return lambda d, out: add_probability(model, d, out)


def _regressor(p: Params, df: DataFrame, target: Column, weight: Column | None = None) -> Callable[[DataFrame, str], DataFrame]:
    d = df.withColumn("_y", target.cast("double")).withColumn("_w", (F.lit(1.0) if weight is None else weight).cast("double"))
    model = Pipeline(stages=[VectorAssembler(inputCols=p.features, outputCol="_x"), GBTRegressor(featuresCol="_x", labelCol="_y", weightCol="_w", maxIter=p.trees, maxDepth=p.depth, stepSize=p.step, seed=p.seed)]).fit(d)
    return lambda d, out: model.transform(d).withColumnRenamed("prediction", out).drop("_x")


def _arms(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where("treatment = 0"), df.where("treatment = 1")


def response(df: DataFrame, p: Params) -> Scorer:
    m = _classifier(p, df)
    return lambda d: m(d, "score")


def s_learner(df: DataFrame, p: Params, k: float = 1.0) -> Scorer:
    """``k``: by how much undersampling of negatives raised the base rate of ``df``; the effect is divided by it."""
    m = _classifier(p, df, [*p.features, "treatment"])

    def score(d: DataFrame) -> DataFrame:
        two = m(m(d.withColumn("_t", F.col("treatment")).withColumn("treatment", F.lit(1)), "_p1").withColumn("treatment", F.lit(0)), "_p0")
        return two.withColumn("score", (F.col("_p1") - F.col("_p0")) / F.lit(float(k))).withColumn("treatment", F.col("_t")).drop("_t", "_p1", "_p0")

    return score


def t_learner(df: DataFrame, p: Params, keep: tuple[float, float] | None = None) -> Scorer:
    """``keep``: shares of negatives kept in the control and treated arm, undone before the difference."""
    m0, m1 = (_classifier(p, a) for a in _arms(df))

    def score(d: DataFrame) -> DataFrame:
        two = m1(m0(d, "_p0"), "_p1")
        if keep:
            two = two.withColumns({"_p0": restore_probability("_p0", F.lit(keep[0])), "_p1": restore_probability("_p1", F.lit(keep[1]))})
        return two.withColumn("score", F.col("_p1") - F.col("_p0")).drop("_p0", "_p1")

    return score


def x_learner(df: DataFrame, p: Params, keep: tuple[float, float] | None = None) -> Scorer:
    c, t = _arms(df)
    m0, m1 = _classifier(p, c), _classifier(p, t)
    fix = lambda q, k: restore_probability(q, F.lit(keep[k])) if keep else F.col(q)
    d1 = _regressor(p, m0(t, "_q"), F.col(p.outcome) - fix("_q", 0))
    d0 = _regressor(p, m1(c, "_q"), fix("_q", 1) - F.col(p.outcome))
    return lambda d: d1(d0(d, "_e0"), "_e1").withColumn("score", F.lit(p.propensity) * F.col("_e0") + F.lit(1 - p.propensity) * F.col("_e1")).drop("_e0", "_e1")


def cross_nuisance(df: DataFrame, p: Params, fold: str, folds: int) -> DataFrame:
    """``df`` with mu0 and mu1 from models of the other folds."""
    out = None
    for k in range(folds):
        rest = df.where(F.col(fold) != k)
        m0, m1 = (_classifier(p, a) for a in _arms(rest))
        part = m1(m0(df.where(F.col(fold) == k), "mu0"), "mu1")
        out = part if out is None else out.unionByName(part)
    return out


def _with_fold(df: DataFrame, folds: int, seed: int) -> DataFrame:
    return df.withColumn("_fold", F.floor(uniform("row_id", 0, seed) * folds).cast("int"))


def _dealt(df: DataFrame, folds: int, seed: int) -> DataFrame:
    """``df`` with its folds, written once: a fit reads its rows several times, and would make rows and hashes anew each time."""
    return materialize(_with_fold(df, folds, seed))


def cross_base(df: DataFrame, p: Params, folds: int = 2, out: str = "_m") -> DataFrame:
    """``df`` with the outcome's probability, whatever the arm, from models of the other folds."""
    d, parts = _dealt(df, folds, p.seed), []
    for k in range(folds):
        parts.append(_classifier(p, d.where(F.col("_fold") != k))(d.where(F.col("_fold") == k), out))
    return materialize(reduce(DataFrame.unionByName, parts).drop("_fold"))


def averaged_nuisance(df: DataFrame, p: Params, folds: int = 2, mc_iters: int = 1) -> DataFrame:
    """``df`` with mu0 and mu1, each the mean over ``mc_iters`` partitions into folds of models that have not seen the row.

    A partition adds to sums that stand in the row, so rows are never shuffled or joined back.
    """
    if mc_iters < 1:
        raise ValueError("mc_iters must be at least 1")
    d = df.withColumns({"_s0": F.lit(0.0), "_s1": F.lit(0.0)})
    for i in range(mc_iters):
        one = cross_nuisance(_dealt(d, folds, p.seed + i), p, "_fold", folds)
        d = materialize(one.withColumns({"_s0": F.col("_s0") + F.col("mu0"), "_s1": F.col("_s1") + F.col("mu1")}).drop("mu0", "mu1", "_fold"))
    return d.withColumns({"mu0": F.col("_s0") / mc_iters, "mu1": F.col("_s1") / mc_iters}).drop("_s0", "_s1")


def dr_learner(df: DataFrame, p: Params, folds: int = 2, mc_iters: int = 1) -> Scorer:
    d = averaged_nuisance(df, p, folds, mc_iters)
    m = _regressor(p, d, dr_signal(p.outcome, "treatment", "mu0", "mu1", p.propensity))
    return lambda d: m(d, "score")


def r_learner(df: DataFrame, p: Params) -> Scorer:
    r = F.col("treatment") - F.lit(p.propensity)
    m = _regressor(p, cross_base(df, p), (F.col(p.outcome) - F.col("_m")) / r, F.pow(r, 2))
    return lambda d: m(d, "score")


def anchored_r(df: DataFrame, p: Params, share: float = 0.25) -> Scorer:
    """alpha * m(x) + share * residual, in [-1, 1]; rows are corrected by models that have not seen them."""
    base, d = _classifier(p, df), cross_base(df, p)
    r, y = F.col("treatment") - F.lit(p.propensity), F.col(p.outcome)
    a = float(d.agg(F.try_divide(F.sum(r * F.col("_m") * (y - F.col("_m"))), F.sum(F.pow(r * F.col("_m"), 2)))).first()[0] or 0.0)
    m = _regressor(p, d, ((y - F.col("_m")) - r * a * F.col("_m")) / r, F.pow(r, 2))
    return lambda d: m(base(d, "_m"), "_r").withColumn("score", F.greatest(F.least(F.lit(a) * F.col("_m") + F.lit(share) * F.col("_r"), F.lit(1.0)), F.lit(-1.0))).drop("_m", "_r")


def funnel_s(df: DataFrame, p: Params) -> Scorer:
    x = [*p.features, "treatment"]
    visit, buy = _classifier(p, df, x, "visit"), _classifier(p, df.where("visit = 1"), x, "conversion")

    def score(d: DataFrame) -> DataFrame:
        d = d.withColumn("_t", F.col("treatment"))
        for a in (0, 1):
            d = buy(visit(d.withColumn("treatment", F.lit(a)), f"_v{a}"), f"_c{a}")
        return d.withColumn("score", F.col("_v1") * F.col("_c1") - F.col("_v0") * F.col("_c0")).withColumn("treatment", F.col("_t")).drop("_t", "_v0", "_v1", "_c0", "_c1")

    return score


def dina(df: DataFrame, p: Params, rounds: int | None = None, clip: float = 1e-5, limit: float = 3.0, folds: int = 2) -> Scorer:
    """Boosted effect on log-odds beside an offset, with a modified propensity; the score is a difference of probabilities."""
    df = _dealt(df, folds, p.seed)
    m0, m1 = (_classifier(p, a) for a in _arms(df))
    both = lambda d: m1(m0(d, "_p0"), "_p1").withColumns({c: F.least(F.greatest(F.col(c), F.lit(clip)), F.lit(1 - clip)) for c in ("_p0", "_p1")})
    v1, v0, e = F.col("_p1") * (1 - F.col("_p1")), F.col("_p0") * (1 - F.col("_p0")), F.lit(p.propensity)
    a = e * v1 / (e * v1 + (1 - e) * v0)
    eta = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    clipped = {f"_p{k}": F.least(F.greatest(F.col(f"mu{k}"), F.lit(clip)), F.lit(1 - clip)) for k in (0, 1)}
    d = cross_nuisance(df, p, "_fold", folds).withColumns(clipped).drop("mu0", "mu1", "_fold").withColumn("_a", a).withColumn("_o", F.col("_a") * eta("_p1") + (1 - F.col("_a")) * eta("_p0"))

    d = d.select(*p.features, F.col("treatment").cast("double").alias("_t"), F.col(p.outcome).cast("double").alias("_y"), "_a", "_o")

    def loss(x: Batch, f: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        r = x["_t"] - x["_a"]
        q = 1 / (1 + np.exp(-(x["_o"] + r * f)))
        return r * (q - x["_y"]), r**2 * q * (1 - q)

    made = boost(d, p.features, ["_t", "_y", "_a", "_o"], loss, rounds or p.trees, p.step, _growth(p))

    def score(x: DataFrame) -> DataFrame:
        x = made.score(both(x), "_f")
        delta = F.least(F.greatest(F.col("_f"), F.lit(-limit)), F.lit(limit))
        return x.withColumn("score", sigmoid(eta("_p0") + delta) - F.col("_p0")).drop("_f", "_p0", "_p1")

    return score


def pair_gradient(own: Batch, other: Batch, kappa: float, clip: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of rows beside their partners, each with effect, tau and f.

    The soft order of a pair is the logistic of the gap in cross-fitted effects over kappa. Its orthogonal correction
    adds, at the soft order's slope, what the pair's doubly robust signals say beyond these effects; the sum, clipped,
    is the label that the logistic of the gap in predictions is pushed to. Curvature is that of the logistic loss.
    """
    gap = own["effect"] - other["effect"]
    soft = 1 / (1 + np.exp(-gap / kappa))
    label = np.clip(soft + soft * (1 - soft) / kappa * ((own["tau"] - other["tau"]) - gap), clip, 1 - clip)
    q = 1 / (1 + np.exp(-(own["f"] - other["f"])))
    return q - label, q * (1 - q)


def rank_learner(df: DataFrame, p: Params, rounds: int | None = None, scale: float = 1.0, folds: int = 2) -> Scorer:
    """Pairwise ranking of effects: each round matches rows anew at random and pushes pairs to their corrected order.

    Rows are dealt to tasks by a hash and matched inside a batch, so no row is sent for a round; of an odd number the
    last sits out.
    """
    tau = dr_signal(p.outcome, "treatment", "mu0", "mu1", p.propensity)
    d = cross_nuisance(_dealt(df, folds, p.seed), p, "_fold", folds).withColumns({"_effect": F.col("mu1") - F.col("mu0"), "_tau": tau})
    d = d.select(*p.features, F.col("row_id").cast("long").alias("_id"), F.col("_effect").cast("double").alias("_effect"), F.col("_tau").cast("double").alias("_tau"))
    d = materialize(d.repartition(F.xxhash64("_id")).sortWithinPartitions(F.xxhash64("_id", F.lit(p.seed))))
    kappa = scale * float(d.agg(F.stddev_pop("_effect")).first()[0] or 1.0) or 1.0

    def loss(x: Batch, f: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        order = np.random.default_rng([p.seed, turn, len(f), int(x["_id"][0]) & 0xFFFFFFFF]).permutation(len(f))
        half = len(f) // 2
        partner = np.arange(len(f))
        partner[order[:half]], partner[order[half : 2 * half]] = order[half : 2 * half], order[:half]
        own = {"effect": x["_effect"], "tau": x["_tau"], "f": f}
        g, h = pair_gradient(own, {k: v[partner] for k, v in own.items()}, kappa)
        return g, np.where(partner == np.arange(len(f)), 0.0, h)

    made = boost(d, p.features, ["_id", "_effect", "_tau"], loss, rounds or p.trees, p.step, _growth(p))
    return lambda x: made.score(x, "score")


def hybrid_logit(df: DataFrame, p: Params, terms: int = 3, folds: int = 2) -> Scorer:
    """Unpenalised logistic regression on cross-fitted logits: effect from three or six coefficients."""
    def inputs(x: DataFrame) -> DataFrame:
        a, b = hybrid_transforms("mu0", F.col("mu1") - F.col("mu0"))
        x = x.withColumns({"_a": a, "_b": b, "_t": F.col("treatment").cast("double")})
        return x.withColumns({"_ta": F.col("_t") * F.col("_a"), "_tb": F.col("_t") * F.col("_b")})

    columns = ["_a", "_t"] if terms == 3 else ["_a", "_b", "_t", "_ta", "_tb"]
    df = _dealt(df, folds, p.seed)
    d = materialize(inputs(cross_nuisance(df, p, "_fold", folds)).select(*columns, F.col(p.outcome).cast("double").alias("_y")))
    fit = Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="_x"), LogisticRegression(featuresCol="_x", labelCol="_y", regParam=0.0, tol=1e-8, standardization=False)]).fit(d).stages[-1]
    c = [float(fit.intercept), *map(float, fit.coefficients)]
    m0, m1 = (_classifier(p, a) for a in _arms(df))
    return lambda x: inputs(m1(m0(x, "mu0"), "mu1")).withColumn("score", hybrid_effect("_a", "_b", c)).drop("_a", "_b", "_t", "_ta", "_tb", "mu0", "mu1")


#: Sizes of a causal forest: trees, and how a tree grows.
FORESTS: dict[str, tuple[int, Growth]] = {
    "quick": (100, Growth(depth=4, leaves=16, min_rows=50, min_curvature=1e-6, l2=0.0, features=0.7)),
    "safe": (200, Growth(depth=6, leaves=64, min_rows=500, min_curvature=1e-6, l2=0.0, features=0.7)),
    "research": (500, Growth(depth=7, leaves=128, min_rows=200, min_curvature=1e-6, l2=0.0, features=0.7)),
    "rare_outcome": (500, Growth(depth=5, leaves=32, min_rows=10_000, min_curvature=1e-6, l2=0.0, features=0.7)),
}


def honest_forest(df: DataFrame, p: Params, trees: int | None = None, profile: str = "quick", intervals: bool = False) -> Scorer:
    """A causal forest on residuals: of the outcome by models that have not seen the row, of treatment by the known propensity.

    With ``intervals`` the scorer adds variance, lower and upper as well.
    """
    d = cross_base(df, p)
    d = d.select(*p.features, "row_id", (F.col(p.outcome) - F.col("_m")).cast("double").alias("_yr"), (F.col("treatment") - F.lit(p.propensity)).cast("double").alias("_tr"))
    count, growth = FORESTS[profile]
    forest = causal_forest(d, p.features, "row_id", "_yr", "_tr", trees or count, growth=replace(growth, seed=p.seed))
    return lambda x: forest.score(x) if intervals else forest.score(x).drop("variance", "lower", "upper")


def isotonic_calibration(df: DataFrame, score: str, target: str, out: str = "calibrated") -> Scorer:
    """Monotone map of a score to an effect target, in [-1, 1]."""
    m = IsotonicRegression(featuresCol=score, labelCol=target, predictionCol="_c").fit(df)
    return lambda d: m.transform(d).withColumn(out, F.greatest(F.least(F.col("_c"), F.lit(1.0)), F.lit(-1.0))).drop("_c")


BUILDERS: dict[str, Callable[[DataFrame, Params], Scorer]] = {
    "response": response, "s_learner": s_learner, "t_learner": t_learner, "x_learner": x_learner, "dr_learner": dr_learner, "r_learner": r_learner, "anchored_r": anchored_r, "funnel_s": funnel_s,
    "dina": dina, "rank_learner": rank_learner, "hybrid_logit": hybrid_logit, "honest_forest": honest_forest,
}
#: Scores of these are on the scale of effects.
EFFECT_SCALE = set(BUILDERS) - {"response", "rank_learner"}


def cross_fit(df: DataFrame, builder: str, p: Params, fold: str, folds: int) -> DataFrame:
    """(row_id, model, score): each fold scored by a learner of the others. Scores that are not finite raise."""
    out = None
    for k in range(folds):
        part = BUILDERS[builder](df.where(F.col(fold) != k), p)(df.where(F.col(fold) == k)).select("row_id", F.lit(builder).alias("model"), "score")
        out = part if out is None else out.unionByName(part)
    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
    return out.withColumn("score", F.when(bad, F.raise_error("a score is not finite").cast("double")).otherwise(F.col("score")))


def propensity_auc(train: DataFrame, test: DataFrame, features: list[str], tree: bool = False, label: str = "treatment") -> DataFrame:
    """(auc): how well features tell the arms apart on rows that the model, logistic or boosted trees, has not seen; 0.5 in a fair trial."""
    kind = GBTClassifier(featuresCol="_x", labelCol="_y", maxIter=20, maxDepth=3, seed=7) if tree else LogisticRegression(featuresCol="_x", labelCol="_y")
    model = Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_x"), kind]).fit(train.withColumn("_y", F.col(label).cast("double")))
    scored = model.transform(test).select(F.col(label), vector_to_array("probability")[1].alias("_p"))
    return exact_auc(scored, "_p", label)


def exact_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks."""
    d = average_ranks(df.select(F.col(score).alias("s"), F.col(label).alias("y")), "s", "r")
    o = d.agg(F.sum(F.col("r") * F.col("y")).alias("r1"), F.sum("y").alias("n1"), F.count("*").alias("n"))
    return o.select(F.try_divide(F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2, F.col("n1") * (F.col("n") - F.col("n1"))).alias("auc"))
