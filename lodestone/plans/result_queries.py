"""Registered queries of result tables, tests, contracts and service tables, with their DuckDB statements."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from lodestone.functions import signals as S
from lodestone.operators import curves as C
from lodestone.operators import diagnostics as D
from lodestone.operators import ensemble as E
from lodestone.operators import learners as L
from lodestone.operators import policy as P
from lodestone.operators import registry as R
from lodestone.operators import reporting as T
from lodestone.operators import resample as B
from lodestone.operators import sampling as N
from lodestone.operators.scorer import SavedScorer
from lodestone.operators.search import Race
from lodestone.plans import oracles as O
from lodestone.plans import queries as Q
from lodestone.plans.oracles import ORACLES
from lodestone.plans.queries import query, rounded
from lodestone.session import shared_dir
from lodestone.sources import artifacts as A

BUDGETS, PROPENSITY = Q.BUDGETS, Q.PROPENSITY


def sql(name: str, parts: str, select: str, doubles: str = "", digits: int = 6, more: str = "") -> None:
    """Registers a statement over the named parts of ``oracles``, its doubles rounded."""
    with_ = [f"{n} AS ({O.PARTS[n][1]})" for n in O._ordered(parts.split(), [])] + ([more] if more else [])
    inner = ("WITH " + ",\n".join(with_) + "\n" if with_ else "") + select
    replaced = f" REPLACE ({', '.join(f'round({O.quoted(c)}::DOUBLE, {digits}) + 0.0 AS {O.quoted(c)}' for c in doubles.split())})" if doubles else ""
    ORACLES[name] = f"SELECT *{replaced} FROM ({inner}) AS result"


def of(name: str) -> str:
    return f"({ORACLES[name]})"


@query
def metric_row(spark, d):
    return rounded(T.metric_rows(Q.long_scores(spark, d), "dr", BUDGETS, ["effect"], PROPENSITY))


sql("metric_row", "", f"""
SELECT model, qini_score, auuc_score, autoc, rate_qini, policy_area, CASE WHEN model = 'effect' THEN (SELECT mse FROM {of('transformed_outcome_mse')} t) END AS mse,
  CASE WHEN model = 'effect' THEN (SELECT euce FROM {of('euce')} e) END AS euce
FROM {of('qini_score')} a JOIN {of('auuc_score')} b USING (model) JOIN {of('rate_scores')} c USING (model) JOIN {of('policy_area')} d USING (model)""")  # fmt: skip


@query
def ks_balance_test(spark, d):
    b = Q.QUERIES["smd_ks_balance"](spark, d)
    return rounded(b.select("feature", "ks", T.ks_p(F.col("ks"), F.col("n1"), F.col("n0")).alias("ks_p")))


sql("ks_balance_test", "", f"""
SELECT feature, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE least(greatest(2 * list_sum(list_transform(range(1, 101), lambda k: (-1.0) ** (k - 1) * exp(-2 * k * k * x * x))), 0), 1) END AS ks_p
FROM (SELECT *, ks * sqrt(n1 * n0 / (n1 + n0)) AS x FROM {of('smd_ks_balance')} b)""", "ks_p")  # fmt: skip


@query
def cochran_test(spark, d):
    return rounded(T.cochran_test(Q.QUERIES["cochran_q"](spark, d)))


sql("cochran_test", "", f"""
SELECT *, 1 - list_sum(list_transform(range(0, 400), lambda n: exp((df / 2.0 + n) * ln(q / 2.0) - q / 2.0 - lgamma(df / 2.0 + n + 1)))) AS p FROM {of('cochran_q')} c""", "p")  # fmt: skip


@query
def dominance_test(spark, d):
    return rounded(T.dominance_test(Q.QUERIES["prognostic_dominance"](spark, d)), 5)


def _student(r: str) -> str:
    """Two-sided p of a correlation, by Simpson's rule over the angle whose tangent is t / sqrt(df)."""
    lo = f"atan(abs({r}) / sqrt(1 - {r} * {r}))"
    f = f"cos({lo} + i * (pi() / 2 - {lo}) / 2000) ** (n_strata - 3)"
    weight = "CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    scale = "exp(lgamma((n_strata - 1) / 2.0) - lgamma((n_strata - 2) / 2.0)) / sqrt(pi())"
    return f"2 * {scale} * (pi() / 2 - {lo}) / 6000 * list_sum(list_transform(range(0, 2001), lambda i: {weight} * {f}))"


sql("dominance_test", "", f"SELECT *, {_student('pearson')} AS pearson_p, {_student('spearman')} AS spearman_p FROM {of('prognostic_dominance')} c", "pearson_p spearman_p", 5)


@query
def negative_keep_rates(spark, d):
    t = Q.trial(spark, d)
    return rounded(T.keep_rates(t, N.undersample(t, 2.0, 7)))


sql("negative_keep_rates", "trial", f"""
SELECT treatment, avg(conversion) AS base_rate, count(*) FILTER (conversion = 0 AND row_id IN (SELECT row_id FROM {of('undersample')} u)) / count(*) FILTER (conversion = 0) AS keep_rate FROM trial GROUP BY 1""", "base_rate keep_rate")  # fmt: skip


def _contributions(spark, d):
    s = Q.scored(spark, d)
    t = P.top_budget(P.top_budget(s, "score", 0.1, out="top"), "lottery", 0.1, out="drawn") if "lottery" in s.columns else None
    t = t or P.top_budget(P.top_budget(s, "score", 0.1, out="top").withColumn("lottery", Q.S.uniform("row_id", 0, 3)), "lottery", 0.1, out="drawn")
    return t.select("row_id", (F.col("top") * F.col("dr")).alias("top"), F.col("dr").alias("all"), (F.col("drawn") * F.col("dr")).alias("random"))


@query
def scenario_comparison(spark, d):
    """Value of each policy, its interval, and the difference to a random policy of the same size."""
    c = _contributions(spark, d)
    names = ["top", "all", "random"]
    draws = B.bootstrap_mean(c, names, Q.POLICY_DRAWS, 5)
    seen = c.agg(*[F.avg(n).alias(n) for n in names]).unpivot([], names, "policy", "observed")
    own = B.intervals(draws, "value", ["policy"]).select("policy", "ci_low", "ci_high")
    diff = B.intervals(B.differences(draws, "value", "random", "policy"), "diff", ["policy"]).select("policy", F.col("ci_low").alias("delta_low"), F.col("ci_high").alias("delta_high"))
    return rounded(seen.join(own, "policy").join(diff, "policy", "left"))


sql("scenario_comparison", "scored", """
SELECT policy, observed, ci_low, ci_high, delta_low, delta_high FROM seen JOIN (SELECT policy, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high FROM draws GROUP BY 1) o USING (policy)
LEFT JOIN (SELECT a.policy, quantile_cont(a.value - b.value, 0.025) AS delta_low, quantile_cont(a.value - b.value, 0.975) AS delta_high FROM draws a JOIN draws b ON b.replicate = a.replicate AND b.policy = 'random' WHERE a.policy <> 'random' GROUP BY 1) x USING (policy)""",
    "observed ci_low ci_high delta_low delta_high", more=f"""
r AS (SELECT row_id, dr, (row_number() OVER (ORDER BY score DESC, row_id) <= floor(count(*) OVER () * 0.1::DOUBLE))::INT * dr AS top,
  (row_number() OVER (ORDER BY ('0x' || substr(md5(row_id || ':0:3'), 1, 8))::BIGINT DESC, row_id) <= floor(count(*) OVER () * 0.1::DOUBLE))::INT * dr AS drawn FROM scored),
long AS (SELECT row_id, 'top' AS policy, top AS v FROM r UNION ALL SELECT row_id, 'all', dr FROM r UNION ALL SELECT row_id, 'random', drawn FROM r),
seen AS (SELECT policy, avg(v) AS observed FROM long GROUP BY 1),
draws AS (SELECT replicate, policy, sum(w * v) / (SELECT count(*) FROM r) AS value FROM long JOIN ({O.weights('SELECT row_id FROM r', Q.POLICY_DRAWS)}) ws USING (row_id) GROUP BY 1, 2)""")  # fmt: skip


@query
def budget_curve_break_even(spark, d):
    """Each model's value at each budget with its interval, and the cost of a contact at which nothing is left."""
    s = Q.materialize(Q.long_scores(spark, d))
    own = B.intervals(B.bootstrap_policy(s, "dr", BUDGETS, Q.POLICY_DRAWS, 5), "value", ["model", "budget"]).select("model", "budget", "ci_low", "ci_high")
    seen = rounded(C.policy_curve(s, "dr", BUDGETS, ["model"]))
    return rounded(seen.join(own, ["model", "budget"]).withColumn("break_even_cost", F.try_divide("value", "budget")))


sql("budget_curve_break_even", "boot grid", f"""
SELECT model, budget, value, ci_low, ci_high, value / budget AS break_even_cost FROM {of('policy_value_curve')} p
JOIN (SELECT split_part(m, ':', 2) AS model, budget, quantile_cont(value, 0.025) AS ci_low, quantile_cont(value, 0.975) AS ci_high FROM pol GROUP BY 1, 2) o USING (model, budget)""",
    "ci_low ci_high break_even_cost", more=f"{O.tie_groups('boot')}, {O._POLICY}")


def _curve(spark, d):
    return Q.QUERIES["policy_value_curve"](spark, d)


@query
def curve_against_reference(spark, d):
    return rounded(T.against_reference(_curve(spark, d), "tied", ["budget"], "value"))


sql("curve_against_reference", "", f"SELECT p.budget, p.model, p.value, r.value AS reference_value, p.value - r.value AS delta FROM {of('policy_value_curve')} p JOIN {of('policy_value_curve')} r ON r.budget = p.budget AND r.model = 'tied' WHERE p.model <> 'tied'", "delta")


@query
def seeds_against_reference(spark, d):
    return rounded(T.against_reference(Q._results(spark, d), "m0", ["fold_seed"], "qini_score"))


sql("seeds_against_reference", "results", "SELECT p.fold_seed, p.model, p.qini_score, r.qini_score AS reference_value, p.qini_score - r.qini_score AS delta FROM results p JOIN results r ON r.fold_seed = p.fold_seed AND r.model = 'm0' WHERE p.model <> 'm0'", "qini_score reference_value delta")


@query
def recovered_ranges(spark, d):
    """Missing limits of a curve taken from a table with the same three keys."""
    c = _curve(spark, d).withColumn("split", F.lit("test"))
    gaps = c.select("model", "budget", "split", "value", F.when(F.col("budget") > 0.05, F.col("value") * 0.9).alias("low"))
    return rounded(T.fill_from(gaps, c.where("model <> 'level'").select("model", "budget", "split", (F.col("value") * 0.5).alias("low")), ["model", "budget", "split"], ["low"]))


sql("recovered_ranges", "", f"SELECT model, budget, 'test' AS split, value, CASE WHEN budget > 0.05 THEN value * 0.9 WHEN model <> 'level' THEN value * 0.5 END AS low FROM {of('policy_value_curve')} p", "low")


@query
def hypothesis_outcomes(spark, d):
    return rounded(T.hypothesis_outcomes(_curve(spark, d), "tied"))


sql("hypothesis_outcomes", "", f"SELECT model, count(*) AS n_budgets, count(*) FILTER (delta > 0) AS wins, count(*) FILTER (delta > 0 AND budget <= 0.1) AS low_wins, count(*) FILTER (budget <= 0.1) AS n_low, (count(*) FILTER (delta > 0 AND budget <= 0.1) = count(*) FILTER (budget <= 0.1))::BIGINT AS supported FROM {of('curve_against_reference')} c GROUP BY 1")


@query
def early_stop_reasons(spark, d):
    s = Q.long_scores(spark, d)
    return T.early_stop(s, _curve(spark, d), "tied", 20)


sql("early_stop_reasons", "long", f"""
SELECT model, CASE WHEN n < 20 THEN 'too_few_values' WHEN below THEN 'dominated' END AS reason FROM (SELECT model, count(DISTINCT score) AS n FROM long GROUP BY 1) a
LEFT JOIN (SELECT model, bool_and(delta < 0) AS below FROM {of('curve_against_reference')} c WHERE budget BETWEEN 0.05 AND 0.2 GROUP BY 1) b USING (model)""")  # fmt: skip


@query
def score_sign_segments(spark, d):
    t = Q.signalled(spark, d).withColumn("effect", F.round(F.col("mu1") - F.col("mu0"), 9))
    return rounded(T.sign_segments(t, "effect", "conversion"))


sql("score_sign_segments", "effect", "SELECT CASE WHEN score > 1e-4 THEN 'positive' WHEN score < -1e-4 THEN 'negative' ELSE 'near_zero' END AS segment, count(*) AS n, avg(outcome) AS rate, avg(score) AS mean_score FROM effect GROUP BY 1", "rate mean_score")


@query
def score_quantiles(spark, d):
    return rounded(T.score_quantiles(Q.long_scores(spark, d), [0.01, 0.05, 0.5, 0.95, 0.99]))


sql("score_quantiles", "long", "SELECT model, " + ", ".join(f"quantile_cont(score, {p}) AS p{round(p * 1000):03d}" for p in (0.01, 0.05, 0.5, 0.95, 0.99)) + " FROM long GROUP BY 1", "p010 p050 p500 p950 p990")


@query
def candidates_over_seeds(spark, d):
    r = Q._results(spark, d).groupBy("model").agg(F.avg("qini_score").alias("mean"), F.min("qini_score").alias("min"), F.count_distinct("fold_seed").alias("n_seeds"))
    return rounded(r)


sql("candidates_over_seeds", "results", "SELECT model, avg(qini_score) AS mean, min(qini_score) AS min, count(DISTINCT fold_seed) AS n_seeds FROM results GROUP BY 1", "mean min")


@query
def order_status_counts(spark, d):
    return R.status_counts(Q.table(spark, d, "orders"), "o_orderstatus")


sql("order_status_counts", "", "SELECT coalesce(o_orderstatus, 'unknown') AS status, count(*) AS n FROM orders GROUP BY 1")


@query
def resource_trend(spark, d):
    o = Q.table(spark, d, "orders").groupBy(F.month("o_orderdate").cast("double").alias("m")).agg(F.sum("o_totalprice").cast("double").alias("s"))
    return rounded(T.linear_trend(o, "m", "s", 24.0), 0)


sql("resource_trend", "", "SELECT slope, intercept, intercept + slope * 24 AS extrapolated FROM (SELECT regr_slope(s, m) AS slope, regr_intercept(s, m) AS intercept FROM (SELECT month(o_orderdate)::DOUBLE AS m, sum(o_totalprice)::DOUBLE AS s FROM orders GROUP BY 1))", "slope intercept extrapolated", 0)


@query
def sentinel_augmentation(spark, d):
    out = T.sentinel_augmentation(Q.trial(spark, d), Q.FEATURES)
    return rounded(T.present(out, ["row_id", *[f"is_{f}" for f in Q.FEATURES], "n_sentinels"]).select("row_id", "n_sentinels"))


def _flag(f: str) -> str:
    return f"coalesce((SELECT CASE WHEN c >= 0.05 * n THEN (t.{f} = v)::INT ELSE 0 END FROM (SELECT {f} AS v, count(*) AS c, (SELECT count(*) FROM trial) AS n FROM trial WHERE {f} IS NOT NULL GROUP BY 1 ORDER BY c DESC, v LIMIT 1)), 0)"


#: For trials of at most as many rows as the operator samples.
sql("sentinel_augmentation", "trial", f"SELECT row_id, ({' + '.join(map(_flag, Q.FEATURES))})::BIGINT AS n_sentinels FROM trial t")


@query
def toc_on_grid(spark, d):
    return rounded(T.toc_on_grid(Q.scored(spark, d).withColumn("w", 1 + F.col("row_id") % 3), "dr", BUDGETS, "w"))


sql("toc_on_grid", "scored grid", """
SELECT budget, lo.y + CASE WHEN hi.x > lo.x THEN (hi.y - lo.y) / (hi.x - lo.x) ELSE 0 END * (budget - lo.x) AS value FROM (
  SELECT budget, coalesce(max({'x': x, 'y': y}) FILTER (x <= budget), min({'x': x, 'y': y}) FILTER (x >= budget)) AS lo, coalesce(min({'x': x, 'y': y}) FILTER (x >= budget), max({'x': x, 'y': y}) FILTER (x <= budget)) AS hi FROM pts, grid GROUP BY 1)""",
    "value", more="""g AS (SELECT score, sum(1 + row_id % 3)::DOUBLE AS n, sum((1 + row_id % 3) * dr) AS s FROM scored GROUP BY 1), c AS (SELECT sum(n) OVER d AS cn, sum(s) OVER d AS cs FROM g WINDOW d AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
pts AS (SELECT cn / (SELECT sum(n) FROM g) AS x, cs / cn - (SELECT sum(s) / sum(n) FROM g) AS y FROM c)""")  # fmt: skip


@query
def random_topk_areas(spark, d):
    """Mean and spread over seeds of the area under random policies' curves."""
    curves = B.random_policy_curves(Q.scored(spark, d), "dr", BUDGETS, Q.RANDOM_SEEDS, 3)
    a = C.policy_area(curves, ["draw"])
    return rounded(a.agg(F.avg("policy_area").alias("mean"), F.stddev_samp("policy_area").alias("std"), F.count("*").alias("n_seeds")))


sql("random_topk_areas", "scored grid", "SELECT avg(policy_area) AS mean, stddev_samp(policy_area) AS std, count(*) AS n_seeds FROM parea", "mean std", more=f"rnd AS (SELECT draw AS m, 1 AS w, row_id, 0 AS treatment, 0 AS outcome, dr, ('0x' || substr(md5(row_id || ':' || draw || ':3'), 1, 8))::BIGINT / 4294967296.0 AS score FROM scored, unnest(range(0, {Q.RANDOM_SEEDS})) AS t(draw)), {O.tie_groups('rnd')}, {O._POLICY}, {O._PAREA}")


@query
def proxy_rank_agreement(spark, d):
    s = Q.signalled(spark, d).select("row_id", F.col("f3").alias("proxy"), F.round(F.col("mu1") - F.col("mu0"), 9).alias("effect"), F.col("f0").alias("value"))
    s = s.orderBy(F.xxhash64("row_id"), "row_id").limit(200_000)
    return rounded(E.spearman(s, ["proxy", "effect", "value"]).where("a = 'proxy'").select(F.col("b").alias("model"), "spearman"))


sql("proxy_rank_agreement", "signalled", f"SELECT 'effect' AS model, corr(p, e) AS spearman FROM r UNION ALL SELECT 'value', corr(p, v) FROM r", "spearman", more=f"s AS (SELECT f3, round(mu1 - mu0, 9) AS effect, f0 FROM signalled), r AS (SELECT {O.rank_of('f3', 's')} AS p, {O.rank_of('effect', 's')} AS e, {O.rank_of('f0', 's')} AS v FROM s)")


@query
def historical_split(spark, d):
    """A stratified tenth, then a hold-out of it."""
    return N.holdout_split(N.stratified_sample(Q.trial(spark, d), 0.1, 42), 0.3, 43).select("row_id", "split")


sql("historical_split", "trial", f"SELECT row_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split FROM {O.held(0.3, 43, 'h')} r", more=f"h AS (SELECT row_id, treatment, conversion FROM {O.sized(0.1, 42)} z WHERE rn <= size)")


@query
def upgraded_cache(spark, d):
    """A cached split that lacks a column gets it by row_id from its source."""
    cached = N.stratified_sample(Q.trial(spark, d), 0.05, 42).drop("visit")
    return T.many_to_one(cached, Q.trial(spark, d).select("row_id", "visit"), ["row_id"], "left").select("row_id", F.col("visit").cast("bigint").alias("visit"))


sql("upgraded_cache", "trial", f"SELECT row_id, visit::BIGINT AS visit FROM {of('stratified_sample')} s JOIN trial USING (row_id)")


@query
def config_hashes(spark, d):
    return Q._results(spark, d).select("model", "fold_seed", T.config_hash("model", "fold_seed").alias("config_hash"))


sql("config_hashes", "results", """SELECT model, fold_seed, left(sha256('{"fold_seed":' || fold_seed || ',"model":"' || model || '"}'), 16) AS config_hash FROM results""")


@query
def index_hash(spark, d):
    return T.index_hash(N.stratified_sample(Q.trial(spark, d), 0.05, 42))


sql("index_hash", "", f"SELECT count(*) AS n_rows, sum(('0x' || substr(md5(row_id::VARCHAR), 1, 12))::BIGINT)::HUGEINT::VARCHAR AS index_hash FROM {of('stratified_sample')} s")


def _runs(spark, d):
    r = Q._results(spark, d)
    k = F.substring("model", 2, 1).cast("int")
    return r.select(F.concat_ws("-", "model", "fold_seed").alias("run_id"), F.when(k == 3, "trial").when(k == 2, "confirm").otherwise("screen").alias("stage"), (k % 2 * 2 + 3).alias("folds"), F.col("fold_seed").cast("int").alias("seed"), F.lit("conversion").alias("outcome"), F.when(k == 1, "legacy").otherwise("registered").alias("mode"))


_RUNS = "SELECT model || '-' || fold_seed AS run_id, CASE substr(model, 2, 1)::INT WHEN 3 THEN 'trial' WHEN 2 THEN 'confirm' ELSE 'screen' END AS stage, substr(model, 2, 1)::INT % 2 * 2 + 3 AS folds, fold_seed AS seed, 'conversion' AS outcome, CASE WHEN model = 'm1' THEN 'legacy' ELSE 'registered' END AS mode FROM results"


@query
def execution_contract(spark, d):
    protocol = spark.createDataFrame([("screen", 3, 101, "conversion"), ("confirm", 5, 202, "conversion")], "stage string, folds int, seed int, outcome string")
    return T.execution_contract(_runs(spark, d), protocol, ["folds", "seed", "outcome"])


sql("execution_contract", "results", f"SELECT run_id, CASE WHEN stage = 'trial' THEN 'unknown_stage' ELSE concat_ws(',', CASE WHEN folds <> CASE stage WHEN 'screen' THEN 3 ELSE 5 END THEN 'folds' END, CASE WHEN seed <> CASE stage WHEN 'screen' THEN 101 ELSE 202 END THEN 'seed' END) END AS violations FROM ({_RUNS})")


@query
def comparable_runs(spark, d):
    return rounded(T.comparable_runs(_runs(spark, d), "m0-101", ["stage", "folds", "seed", "outcome"]))


sql("comparable_runs", "results", f"SELECT run_id, differing, (differing = '' AND mode <> 'legacy')::BIGINT AS may_advance FROM (SELECT run_id, mode, concat_ws(',', CASE WHEN folds <> 3 THEN 'folds' END, CASE WHEN seed <> 101 THEN 'seed' END, CASE WHEN stage <> 'screen' THEN 'stage' END) AS differing FROM ({_RUNS}) WHERE run_id <> 'm0-101')")


@query
def latest_orders(spark, d):
    return rounded(T.latest_rows(Q.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 25))


sql("latest_orders", "", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25", "o_totalprice")


@query
def model_table(spark, d):
    r = Q._results(spark, d).withColumn("split", F.when(F.col("fold_seed") == 101, "confirmation").otherwise("development"))
    return rounded(T.model_table(r, "confirmation", "qini_score").select("model", "qini_score", "place"))


sql("model_table", "results", "SELECT model, qini_score, rank() OVER (ORDER BY qini_score DESC) + (count(*) OVER (PARTITION BY qini_score) - 1) / 2.0 AS place FROM results WHERE fold_seed = 101", "qini_score place")


@query
def pairwise_table(spark, d):
    a = T.against_reference(Q._results(spark, d), "m0", ["fold_seed"], "qini_score").select("model", "delta")
    b = T.against_reference(_curve(spark, d), "tied", ["budget"], "value").select("model", "budget", "delta")
    return rounded(T.pairwise_table({"seeds": a, "curve": b}))


sql("pairwise_table", "", f"SELECT model, delta, NULL::DOUBLE AS budget, 'seeds' AS source FROM {of('seeds_against_reference')} s UNION ALL SELECT model, delta, budget, 'curve' FROM {of('curve_against_reference')} c")


@query
def current_curve(spark, d):
    c = _curve(spark, d)
    return T.current_curve([c.where("false"), c.withColumnsRenamed({"budget": "budget_fraction", "value": "gross"})], {"budget_fraction": "budget", "gross": "value"}).orderBy("model", "budget")


sql("current_curve", "", f"SELECT * FROM {of('policy_value_curve')} c")


@query
def champion_by_precedence(spark, d):
    best = Q._results(spark, d).agg(F.max_by("model", "qini_score").alias("champion"))
    sources = spark.createDataFrame([("promotion", 1, None), ("default", 3, "m0")], "source string, precedence int, champion string")
    return T.champion(sources.unionByName(best.select(F.lit("ranking").alias("source"), F.lit(2).alias("precedence"), "champion")))


sql("champion_by_precedence", "results", "SELECT max_by(model, qini_score) AS champion, 'ranking' AS source FROM results")


@query
def artifact_health(spark, d):
    r = Q._results(spark, d)
    return rounded(T.health({"results": r, "curve": _curve(spark, d), "panel": r.where("model = 'none'")}, ["results", "panel"]))


sql("artifact_health", "", "SELECT * FROM (VALUES ('results', 1::BIGINT, 1::BIGINT), ('curve', 1, 1), ('panel', 0, 1)) AS t(artifact, available, degraded)")


@query
def exported_results(spark, d):
    return rounded(T.export_table(Q._results(spark, d), "run-1", '{"value":1}'))


sql("exported_results", "results", """SELECT *, 'run-1' AS run_id, 0::BIGINT AS monetary_outcome_available, '{"value":1}' AS assumptions_json FROM results""", "qini_score")


@query
def export_bundle(spark, d):
    r = Q._results(spark, d).select(T.slug(F.concat(F.lit(" Model/"), F.col("model"), F.lit(" (A)"))).alias("name"), F.when(F.col("fold_seed") == 101, F.lit(float("nan"))).alias("gap"), "fold_seed")
    return T.bundle({"results": r, "latest": T.latest_rows(r, "fold_seed", 0)})


sql("export_bundle", "results", """SELECT 'results' AS dataset, '{"name":"model_' || model || '_a","gap":null,"fold_seed":' || fold_seed || '}' AS json FROM results""")


def _auc_of_holdout(spark, d, tree: bool):
    t = N.holdout_split(Q.trial(spark, d), 0.3, 42)
    return rounded(L.propensity_auc(t.where("split = 'train'"), t.where("split <> 'train'"), ["f0", "f1", "f2", "f3", "f4", "f5"], tree=tree), 4)


@query
def propensity_auc_logistic(spark, d):
    return _auc_of_holdout(spark, d, False)


@query
def propensity_auc_tree(spark, d):
    return _auc_of_holdout(spark, d, True)


def _undersampled(name: str):
    def run(spark, d):
        t = Q.trial(spark, d)
        sample = Q.materialize(N.undersample(t, 2.0, 7))
        keep = {r["treatment"]: r["keep_rate"] for r in T.keep_rates(t, sample).collect()}  # a row an arm
        p = L.Params(Q.FEATURES, trees=10, propensity=PROPENSITY)
        return getattr(L, name)(sample, p, (keep[0], keep[1]))(t).select("row_id", F.round("score", 6).alias("score"))

    return run


for _name in ("t_learner", "x_learner"):
    Q.QUERIES[f"{_name}_undersampled"] = _undersampled(_name)


@query
def cross_fitted_scores(spark, d):
    """Each fold scored by a learner of the other, as payload rows of an out-of-fold experiment."""
    t = Q.materialize(N.folds(Q.trial(spark, d), 2, 101))
    out = L.cross_fit(t, "t_learner", L.Params(Q.FEATURES, trees=10, propensity=PROPENSITY), "fold", 2)
    return out.select("row_id", "model", F.round("score", 6).alias("score"))


@query
def order_times(spark, d):
    """Dates to ISO text and back, with a text that is no time."""
    o = Q.table(spark, d, "orders").select("o_orderkey", A.utc_iso(F.col("o_orderdate").cast("timestamp")).alias("iso"))
    back = A.parse_iso(F.when(F.col("o_orderkey") % 7 == 0, "soon").otherwise(F.col("iso")))
    return o.withColumn("parsed", A.utc_iso(back))


sql("order_times", "", "SELECT o_orderkey, iso, CASE WHEN o_orderkey % 7 <> 0 THEN iso END AS parsed FROM (SELECT o_orderkey, strftime(o_orderdate::TIMESTAMP, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders)")


@query
def registry_rows(spark, d):
    """Results with base fields, brought to a schema with defaults for what old rows lack."""
    schema = Y.StructType().add("run_id", Y.StringType()).add("outcome", Y.StringType()).add("n_boot", Y.LongType())
    r = Q._results(spark, d).withColumn("run_id", F.concat_ws("-", "model", "fold_seed"))
    return rounded(R.migrate(A.base_fields(r, schema_version=2, outcome="conversion"), schema, {"n_boot": 500}))


sql("registry_rows", "results", "SELECT model || '-' || fold_seed AS run_id, 'conversion' AS outcome, 500::BIGINT AS n_boot, 2::BIGINT AS schema_version, model, fold_seed, qini_score FROM results", "qini_score")


@query
def order_prefix_counts(spark, d):
    """Urgent and other orders by the prefix of their priority."""
    o = Q.table(spark, d, "orders").withColumn("urgent", F.col("o_orderpriority").startswith("1-").cast("bigint"))
    return o.groupBy("urgent").agg(F.count("*").alias("n"))


sql("order_prefix_counts", "", "SELECT starts_with(o_orderpriority, '1-')::BIGINT AS urgent, count(*) AS n FROM orders GROUP BY 1")


@query
def candidate_search(spark, d):
    """Cell learners of three cuts on two validation seeds: Qini scores against the coarsest, and the winner."""
    t = Q.materialize(Q.trial(spark, d).select("row_id", "treatment", "conversion", "f3"))
    cuts = {"coarse": [F.floor(F.col("f3") / 50)], "middle": [F.floor(F.col("f3") / 25)], "fine": [F.floor(F.col("f3") / 10)]}
    found = None
    for seed in (101, 202):
        dealt = Q.materialize(N.folds(t, 3, seed))  # rows are ranked once a seed, for all cuts
        for name, (cut,) in cuts.items():
            m = L.cell_nuisance(dealt.withColumn("cell", cut), ["cell"], "conversion", "fold")
            s = m.select("treatment", F.col("conversion").alias("outcome"), F.round(F.col("mu1") - F.col("mu0"), 9).alias("score"))
            part = C.normalised_area(s, "qini").select(F.lit("cells").alias("model"), F.lit(name).alias("candidate"), F.lit(seed).alias("validation_seed"), "qini_score", F.lit(0.0).alias("fit_seconds"))
            found = part if found is None else found.unionByName(part)
    found = Q.materialize(found)
    summary = R.seed_summary(found, found.where("candidate = 'coarse'"))
    return rounded(summary.join(R.select_winners(summary, 0.0, 1, "coarse"), "model").drop("total_seconds"))


@query
def candidate_race(spark, d):
    """A race of cell learners over two rungs and two validation seeds: where each candidate ended, and whether it won."""
    cut = lambda c, width: F.floor(F.col(c) / width)
    t = Q.trial(spark, d).withColumns({"coarse": cut("f3", 50), "middle": cut("f3", 25), "fine": cut("f3", 10), "other": cut("f0", 10)})
    builders = {c: lambda train, c=c: L.cell_scorer(train, [c], "conversion", prior=10) for c in ("coarse", "middle", "fine", "other")}
    got = Race(shares=(0.3, 1.0)).run(t, builders, "coarse", S.ipw_signal("conversion", "treatment", PROPENSITY))
    fits = got.fits.groupBy("candidate").agg(F.count("*").alias("n_fits"), F.max_by("qini_score", F.struct("rung", "validation_seed")).alias("qini_score"))
    won = (F.col("candidate") == got.winner).cast("int").alias("won")
    return rounded(got.dropped.join(fits, "candidate").select("candidate", "rung", "reason", "n_fits", "qini_score", won))


@query
def saved_scorer(spark, d):
    """A scorer fitted, saved in the shared folder, read back and asked for the top tenth of the trial."""
    t, path = Q.trial(spark, d), f"{shared_dir(spark)}/lodestone-scorer-{uuid.uuid4().hex}"
    SavedScorer.fit(t, L.Params(Q.FEATURES, trees=10)).save(path)
    batch = SavedScorer.load(spark, path, Q.FEATURES).target(t, 0.1)
    return rounded(batch.select("row_id", "score", "target", "percentile"))


@query
def dr_learner_averaged(spark, d):
    """The doubly robust learner with nuisances of three partitions into folds and the share of treated rows as propensity."""
    t = Q.trial(spark, d)
    p = L.with_mean_propensity(t, L.Params(Q.FEATURES, trees=5))
    return L.dr_learner(t, p, mc_iters=3)(t).select("row_id", F.round("score", 6).alias("score"))
