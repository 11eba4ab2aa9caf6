"""The registered queries of the experiment operators over the trial view of ``events``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import signals as S
from lodestone.operators import curves as C
from lodestone.operators import diagnostics as D
from lodestone.operators import ensemble as E
from lodestone.operators import learners as L
from lodestone.operators import policy as P
from lodestone.operators import registry as R
from lodestone.operators import resample as B
from lodestone.operators import sampling as N
from lodestone.operators.ranking import random_matching as pair_rows
from lodestone.session import materialize, ship_package, table
from lodestone.sources.trial import events_trial

FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5"]
BINARIES = ["treatment", "conversion", "visit", "exposure"]
BUDGETS = [0.01, 0.05, 0.1, 0.2, 0.3]
PROPENSITY = 0.85
#: Replicates of the bootstraps, and seeds of random rankings.
QINI_DRAWS, POLICY_DRAWS, RANDOM_SEEDS = 500, 300, 20
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zeros; nulls stay."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if t in ("double", "float") else F.col(c).cast("bigint").alias(c) if t in ("int", "tinyint", "bigint", "smallint") or t.startswith("decimal") else F.col(c) for c, t in df.dtypes])


def trial(spark: SparkSession, d: str) -> DataFrame:
    return events_trial(spark, d)


def celled(spark: SparkSession, d: str) -> DataFrame:
    """The trial with a cell of two coarse features."""
    return trial(spark, d).withColumn("cell", F.least(F.floor(F.col("f0") / 10), F.lit(5)) * 10 + F.floor(F.col("f3") / 25))


def signalled(spark: SparkSession, d: str) -> DataFrame:
    """The trial with mu0, mu1 by cell and the effect signals."""
    m = L.cell_nuisance(celled(spark, d), ["cell"], "conversion")
    return m.withColumns({"ipw": S.ipw_signal("conversion", "treatment", PROPENSITY), "dr": S.dr_signal("conversion", "treatment", "mu0", "mu1", PROPENSITY)})


def scored(spark: SparkSession, d: str) -> DataFrame:
    """One score with many ties: the value in steps of five."""
    s = signalled(spark, d)
    return s.select("row_id", "treatment", F.col("conversion").alias("outcome"), (F.floor(F.col("f0") / 5) * 5).cast("double").alias("score"), "dr", "ipw", "mu0", "mu1")


def long_scores(spark: SparkSession, d: str) -> DataFrame:
    """Three models' scores, one row for each row and model."""
    s = signalled(spark, d).select("row_id", "treatment", F.col("conversion").alias("outcome"), "dr", (F.floor(F.col("f0") / 5) * 5).cast("double").alias("tied"), F.col("f3").alias("level"), F.round(F.col("mu1") - F.col("mu0"), 9).alias("effect"))
    return s.unpivot(["row_id", "treatment", "outcome", "dr"], ["tied", "level", "effect"], "model", "score")


# data checks and diagnostics


@query
def contract_check(spark, d):
    return rounded(D.contract_check(trial(spark, d), FEATURES, BINARIES))


@query
def ate_risk_ratio(spark, d):
    return rounded(D.ate(trial(spark, d), "conversion"))


@query
def ate_sample_variance(spark, d):
    return rounded(D.ate_sample_variance(trial(spark, d), "conversion"))


@query
def arm_outcomes(spark, d):
    return rounded(D.arm_outcomes(trial(spark, d), ["conversion", "visit", "exposure"]))


@query
def arm_summary_wide(spark, d):
    return rounded(D.arm_summary(trial(spark, d), ["conversion", "visit", "exposure"]))


@query
def feature_profile(spark, d):
    return rounded(D.feature_profile(trial(spark, d), FEATURES), 5)


@query
def smd_ks_balance(spark, d):
    return rounded(D.balance(trial(spark, d), FEATURES))


@query
def sentinel_agreement(spark, d):
    return rounded(D.sentinel_agreement(trial(spark, d), FEATURES))


@query
def sentinel_patterns(spark, d):
    return rounded(D.sentinel_patterns(trial(spark, d), FEATURES, 8))


@query
def duplicate_profile(spark, d):
    return rounded(D.duplicate_profile(trial(spark, d), ["f1", "f3", "f4"]))


@query
def overlap_bins(spark, d):
    return rounded(D.overlap_bins(trial(spark, d), "f0", 20))


@query
def leakage_report(spark, d):
    return rounded(D.leakage_report(trial(spark, d), ["visit", "exposure"], "conversion"))


@query
def effect_by_bin(spark, d):
    return rounded(D.effect_by_bin(trial(spark, d).withColumn("bin", F.col("f1").cast("int")), "conversion", ["bin"]))


@query
def effect_by_feature_bin(spark, d):
    return rounded(D.effect_by_feature_bin(trial(spark, d), ["f0", "f3", "f4"], "conversion"))


@query
def cochran_q(spark, d):
    s = D.effect_by_bin(trial(spark, d).withColumn("bin", F.floor(F.col("f3") / 10)), "conversion", ["bin"])
    return rounded(D.cochran_q(s, "effect", "se"))


@query
def prognostic_dominance(spark, d):
    s = D.effect_by_bin(trial(spark, d).withColumn("bin", F.floor(F.col("f3") / 10)), "conversion", ["bin"])
    return rounded(D.prognostic_dominance(s), 5)


@query
def representativity(spark, d):
    t = trial(spark, d)
    return rounded(D.representativity(t, N.stratified_sample(t, 0.05, 42), ["f0", "f3", "f4"]))


@query
def power_table(spark, d):
    return rounded(D.power_table(trial(spark, d), "conversion"))


# sampling


@query
def stratified_sample(spark, d):
    return N.stratified_sample(trial(spark, d), 0.05, 42).select("row_id")


@query
def stratified_complement(spark, d):
    return N.stratified_complement(trial(spark, d), 0.05, 42).select("row_id")


@query
def holdout_split(spark, d):
    return N.holdout_split(trial(spark, d), 0.3, 42).select("row_id", "split")


@query
def folds(spark, d):
    return rounded(N.folds(trial(spark, d), 3, 101).select("row_id", "fold"))


@query
def undersample(spark, d):
    return N.undersample(trial(spark, d), 2.0, 7).select("row_id")


@query
def split_roles(spark, d):
    return rounded(N.roles(trial(spark, d), 42).groupBy("split", "treatment", "conversion").agg(F.count("*").alias("n"), F.sum("row_id").alias("id_sum")))


# signals and policies


@query
def effect_signals(spark, d):
    s = signalled(spark, d).withColumn("m", F.lit(PROPENSITY) * F.col("mu1") + F.lit(1 - PROPENSITY) * F.col("mu0"))
    return rounded(s.select("row_id", S.transformed_outcome("conversion", "treatment", PROPENSITY).alias("transformed"), S.adjusted_transformed_outcome("conversion", "treatment", "m", PROPENSITY).alias("adjusted"), "ipw", "dr"))


@query
def probability_maps(spark, d):
    p = F.col("f3") / 200 + 0.001
    t = trial(spark, d).select("row_id", p.alias("p"))
    q = S.sampled_probability("p", F.lit(0.12))
    return rounded(t.select("row_id", q.alias("sampled"), S.restore_probability(q, F.lit(0.12)).alias("restored"), S.logit("p").alias("logit"), S.sigmoid(S.logit("p")).alias("back")))


@query
def top_budget_policy(spark, d):
    return rounded(P.top_budget(scored(spark, d), "score", 0.1).select("row_id", "target"))


@query
def cost_aware_policy(spark, d):
    t = signalled(spark, d).withColumn("effect", F.round(F.col("mu1") - F.col("mu0"), 9))
    return rounded(P.cost_aware(t, "effect", 0.2, 1.0, 0.02).select("row_id", "target"))


@query
def policy_value(spark, d):
    t = P.top_budget(scored(spark, d), "score", 0.1)
    return rounded(P.policy_value(t, "target", "dr", 1.0, 0.0005))


@query
def policy_sensitivity_grid(spark, d):
    return rounded(P.sensitivity_grid(scored(spark, d), "score", "dr", BUDGETS, [0.0, 0.0005, 0.01]))


@query
def top_tail_support(spark, d):
    return rounded(P.tail_support(scored(spark, d), "score", BUDGETS, outcome="outcome"))


@query
def top_tail_overlap(spark, d):
    return rounded(P.tail_overlap(trial(spark, d), "f0", "f3", BUDGETS))


@query
def ordering_condition(spark, d):
    t = signalled(spark, d).withColumn("beta", F.abs(F.col("mu1") - F.col("mu0")))
    return rounded(P.ordering_condition(t, "f0", "mu0", "beta", BUDGETS))


@query
def percentile_grid(spark, d):
    return rounded(P.percentile_grid(trial(spark, d), "f3"))


@query
def batch_target(spark, d):
    t = trial(spark, d)
    return rounded(P.batch_target(t, "f3", 0.1, P.percentile_grid(t, "f3")).select("row_id", "target", "percentile"))


@query
def simulate_scenario(spark, d):
    c = C.policy_curve(scored(spark, d), "dr", BUDGETS).withColumns({"ci_low": F.col("value") * 0.8, "ci_high": F.col("value") * 1.2})
    return rounded(P.simulate(c, 0.15, 1_000_000, 1.0, 0.0005))


# curves and ranking metrics


@query
def qini_curve(spark, d):
    return rounded(C.qini_curve(scored(spark, d)))


@query
def uplift_curve(spark, d):
    return rounded(C.uplift_curve(scored(spark, d)))


@query
def qini_score(spark, d):
    return rounded(C.normalised_area(long_scores(spark, d), "qini", ["model"]))


@query
def auuc_score(spark, d):
    return rounded(C.normalised_area(long_scores(spark, d), "uplift", ["model"]))


@query
def toc_curve(spark, d):
    return rounded(C.toc_curve(scored(spark, d), "dr"))


@query
def rate_scores(spark, d):
    return rounded(C.rate(long_scores(spark, d), "dr", ["model"]))


@query
def policy_value_curve(spark, d):
    return rounded(C.policy_curve(long_scores(spark, d), "dr", BUDGETS, ["model"]))


@query
def policy_area(spark, d):
    return rounded(C.policy_area(C.policy_curve(long_scores(spark, d), "dr", BUDGETS, ["model"]), ["model"]))


@query
def expected_random(spark, d):
    m = signalled(spark, d).agg(F.avg("dr").alias("m"))
    return rounded(m.select(F.explode(F.array(*[F.lit(b) for b in BUDGETS])).alias("budget"), "m").select("budget", (F.col("budget") * F.col("m")).alias("value")))


@query
def random_topk_sensitivity(spark, d):
    return rounded(B.random_policy_sensitivity(scored(spark, d).select("row_id", "dr"), "dr", BUDGETS, RANDOM_SEEDS, 3))


@query
def euce(spark, d):
    s = signalled(spark, d).select("row_id", "treatment", F.col("conversion").alias("outcome"), F.round(F.col("mu1") - F.col("mu0"), 9).alias("score"))
    return rounded(C.euce(s, 10))


@query
def decile_policy(spark, d):
    return rounded(C.decile_table(scored(spark, d), 10))


@query
def transformed_outcome_mse(spark, d):
    s = signalled(spark, d)
    return rounded(s.agg(F.avg(F.pow(S.transformed_outcome("conversion", "treatment", PROPENSITY) - (F.col("mu1") - F.col("mu0")), 2)).alias("mse")))


@query
def score_diagnostics(spark, d):
    return rounded(C.score_diagnostics(long_scores(spark, d), ["model"]))


@query
def score_histogram(spark, d):
    return rounded(C.score_histogram(long_scores(spark, d).where("model <> 'effect'"), 10, ["model"]))


@query
def spearman_matrix(spark, d):
    return rounded(E.spearman(trial(spark, d), ["f0", "f3", "f4"]))


@query
def rank_average(spark, d):
    return rounded(E.rank_average(trial(spark, d), ["f0", "f3"]).select("row_id", "rank_average"))


@query
def propensity_rank_auc(spark, d):
    return rounded(L.exact_auc(trial(spark, d), "f3", "treatment"))


# bootstraps


@query
def bootstrap_policy_value(spark, d):
    t = P.top_budget(P.top_budget(scored(spark, d), "score", 0.1, out="t10"), "score", 0.3, out="t30")
    c = t.select("row_id", (F.col("t10") * F.col("dr")).alias("top10"), (F.col("t30") * F.col("dr")).alias("top30"))
    return rounded(B.bootstrap_mean(c, ["top10", "top30"], POLICY_DRAWS, 5))


@query
def bootstrap_policy_area(spark, d):
    return rounded(B.bootstrap_policy_area(B.bootstrap_policy(long_scores(spark, d), "dr", BUDGETS, POLICY_DRAWS, 5)))


@query
def bootstrap_rate(spark, d):
    return rounded(B.bootstrap_rate(long_scores(spark, d), "dr", POLICY_DRAWS, 5))


@query
def bootstrap_qini(spark, d):
    return rounded(B.bootstrap_qini(long_scores(spark, d), QINI_DRAWS, 5))


@query
def bootstrap_qini_interval(spark, d):
    return rounded(B.intervals(B.bootstrap_qini(long_scores(spark, d), QINI_DRAWS, 5), "qini_score", ["model"]))


@query
def paired_difference(spark, d):
    draws = B.bootstrap_policy_area(B.bootstrap_policy(long_scores(spark, d), "dr", BUDGETS, POLICY_DRAWS, 5))
    return rounded(B.difference_summary(B.differences(draws, "policy_area", "tied"), ["model"]))


@query
def pairwise_comparison(spark, d):
    draws = B.bootstrap_qini(long_scores(spark, d), QINI_DRAWS, 5)
    return rounded(B.difference_summary(B.pairwise_differences(draws, "qini_score"), ["a", "b"]))


@query
def simultaneous_band(spark, d):
    s = materialize(long_scores(spark, d))
    diffs = B.differences(B.bootstrap_policy(s, "dr", BUDGETS, POLICY_DRAWS, 5), "value", "tied", on=["budget"])
    c = C.policy_curve(s, "dr", BUDGETS, ["model"])
    seen = B.differences(c.withColumn("replicate", F.lit(0)), "value", "tied", on=["budget"]).select("model", "budget", F.col("diff").alias("observed"))
    return rounded(B.simultaneous_band(diffs, seen, ["model", "budget"]), 5)


# cell-mean learners and ensembles


@query
def cell_mean_nuisance(spark, d):
    f = N.folds(celled(spark, d), 3, 101)
    return rounded(L.cell_nuisance(f, ["cell"], "conversion", "fold").select("row_id", "mu0", "mu1"))


@query
def cell_mean_t_learner(spark, d):
    return rounded(L.cell_t_learner(celled(spark, d), ["cell"], "conversion").groupBy("cell").agg(F.count("*").alias("n"), F.avg("score").alias("score")))


@query
def funnel_cell_mean(spark, d):
    return rounded(L.cell_funnel(celled(spark, d), ["cell"]))


@query
def pattern_r_shrinkage(spark, d):
    t = signalled(spark, d).withColumn("m", F.lit(PROPENSITY) * F.col("mu1") + F.lit(1 - PROPENSITY) * F.col("mu0"))
    return rounded(L.pattern_shrinkage(t, ["f4", "f5"], "conversion", "m", PROPENSITY))


@query
def dr_risk(spark, d):
    t = signalled(spark, d).select("dr", (F.col("mu1") - F.col("mu0")).alias("effect"), (F.col("f3") / 1000).alias("level"))
    return rounded(E.softmax_weights(E.dr_risk(t, ["effect", "level"], "dr")))


@query
def best_single(spark, d):
    t = signalled(spark, d).select("dr", (F.col("mu1") - F.col("mu0")).alias("effect"), (F.col("f3") / 1000).alias("level"))
    return rounded(E.best_single(E.dr_risk(t, ["effect", "level"], "dr")))


@query
def gram_matrix(spark, d):
    t = signalled(spark, d).select("dr", (F.col("mu1") - F.col("mu0")).alias("effect"), (F.col("f3") / 1000).alias("level"))
    return rounded(E.gram(t, ["effect", "level"], "dr"))


@query
def q_aggregation(spark, d):
    t = signalled(spark, d).select("dr", (F.col("mu1") - F.col("mu0")).alias("effect"), (F.col("f3") / 1000).alias("level"), (F.col("f0") / 10000).alias("value"))
    w = E.q_aggregation(t, ["effect", "level", "value"], "dr")
    return rounded(spark.createDataFrame(list(w.items()), "model string, weight double"), 4)


# registry and decisions, over results derived from the tables


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of four models on three fold seeds, made from order totals."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 4).alias("m"), (F.lit(101) * (F.col("o_orderkey") % 3 + 1)).alias("fold_seed"), "o_totalprice")
    return o.groupBy("m", "fold_seed").agg(F.round(F.avg("o_totalprice") / 1e6, 6).alias("qini_score")).select(F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "fold_seed", "qini_score")


@query
def seed_summary(spark, d):
    r = _results(spark, d).select(F.lit("x").alias("model"), F.col("model").alias("candidate"), F.col("fold_seed").alias("validation_seed"), "qini_score", F.lit(1.5).alias("fit_seconds"))
    return rounded(R.seed_summary(r, r.where("candidate = 'm0'")))


@query
def select_winners(spark, d):
    r = _results(spark, d).select(F.lit("x").alias("model"), F.col("model").alias("candidate"), F.col("fold_seed").alias("validation_seed"), "qini_score", F.lit(1.5).alias("fit_seconds"))
    return R.select_winners(R.seed_summary(r, r.where("candidate = 'm0'")), 0.0, 2)


@query
def advancement_table(spark, d):
    return rounded(R.advancement(_results(spark, d), "m0", [101, 202, 303]))


@query
def stability_labels(spark, d):
    r = _results(spark, d)
    ref = r.where("model = 'm0'").select("fold_seed", F.col("qini_score").alias("q"))
    return R.stability(r.where("model <> 'm0'").join(ref, "fold_seed").withColumn("delta", F.col("qini_score") - F.col("q")), ["model"])


@query
def promotion_rule(spark, d):
    r = _results(spark, d).groupBy("model").agg(F.avg("qini_score").alias("q"), F.min("qini_score").alias("lo"))
    yes = F.lit(True)
    return R.promotion(r.select("model", F.substring("model", 2, 1).cast("int").alias("position"), (F.col("q") > 0.25).alias("policy_area_gain"), (F.col("lo") > 0.2).alias("interval_above_zero"), yes.alias("autoc_not_worse"), (F.col("model") != "m0").alias("guardrail")), "m0")


@query
def registry_upsert(spark, d):
    r = _results(spark, d).select(F.col("model").alias("run_id"), F.col("fold_seed").cast("double").alias("fold_seed"), F.lit("conversion").alias("outcome"), "qini_score", F.lit(0).alias("position"))
    new = r.where("fold_seed = 101").select("run_id", "fold_seed", "outcome", (F.col("qini_score") * 2).alias("qini_score"), F.lit(1).alias("position"))
    return rounded(R.upsert(r, new.unionByName(new.withColumns({"position": F.lit(2), "qini_score": F.col("qini_score") + 1}))))


@query
def merge_scores(spark, d):
    t = trial(spark, d)
    a, b = t.select("row_id", "treatment", F.col("f0").alias("a")), t.select("row_id", "treatment", F.col("f3").alias("b"))
    return rounded(R.merge_scores([a, b], ["treatment"]))


@query
def ensemble_entries(spark, d):
    e = _results(spark, d).select(F.col("model").alias("member"), "fold_seed", F.col("qini_score").alias("weight"))
    return rounded(R.ensemble_entries(e))


@query
def latest_per_identity(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return rounded(R.latest(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice"))


@query
def dominated_models(spark, d):
    return rounded(R.dominated(C.policy_curve(long_scores(spark, d), "dr", BUDGETS, ["model"]), "tied"))


@query
def random_matching(spark, d):
    return pair_rows(trial(spark, d), 9)


# learners of pyspark.ml: rows only


def _learner(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = L.Params(FEATURES, trees=10, propensity=PROPENSITY)
        return L.BUILDERS[name](trial(spark, d), p)(trial(spark, d)).select("row_id", F.round("score", 6).alias("score"))

    return run


for _name in ("response", "s_learner", "t_learner", "x_learner", "dr_learner", "r_learner", "anchored_r", "funnel_s", "hybrid_logit"):
    QUERIES[f"{_name}_gbt"] = _learner(_name)


@query
def hybrid_dina_gbt(spark, d):
    """The hybrid of six coefficients."""
    p = L.Params(FEATURES, trees=10, propensity=PROPENSITY)
    return L.hybrid_logit(trial(spark, d), p, terms=6)(trial(spark, d)).select("row_id", F.round("score", 6).alias("score"))


def _few(name: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship_package(spark)
        p = L.Params(FEATURES, trees=10, propensity=PROPENSITY)
        t = trial(spark, d)
        score = L.honest_forest(t, p, 200) if name == "honest_forest" else getattr(L, name)(t, p, rounds=30)
        return score(t).select("row_id", F.round("score", 6).alias("score"))

    return run


for _name in ("dina", "rank_learner", "honest_forest"):
    QUERIES[f"{_name}_boosted"] = _few(_name)


@query
def isotonic_tau(spark, d):
    t = signalled(spark, d).withColumn("s", F.col("mu1") - F.col("mu0"))
    return L.isotonic_calibration(t, "s", "ipw")(t).select("row_id", F.round("calibrated", 6).alias("calibrated"))
