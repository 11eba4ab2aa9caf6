"""DuckDB statements for the registered queries, over the same tables."""

from __future__ import annotations

from lodestone.functions.signals import POISSON
from lodestone.functions.stats import z
from lodestone.operators.resample import HIGH, LOW, ROUND, SEED, TURN

Z95, ZPOWER = z(0.975), z(0.975) + z(0.8)
FEATURES = ["f0", "f1", "f2", "f3", "f4", "f5"]
BUDGETS = [0.01, 0.05, 0.1, 0.2, 0.3]
_GRID = ", ".join(f"({b}::DOUBLE)" for b in BUDGETS)

QINI_DRAWS, POLICY_DRAWS, RANDOM_SEEDS = 500, 300, 20


def weights(rows: str, replicates: int, seed: int = 5) -> str:
    """(row_id, replicate, w): the bootstrap's hashed Poisson counts."""
    m = 4294967296
    turn = "SELECT replicate, xor(b, b >> 16) AS turn FROM (SELECT replicate, xor(a, a >> 16) * %d %% %d AS b FROM (SELECT replicate, xor(k, k >> 16) * %d %% %d AS a FROM (SELECT t.replicate, (t.replicate * %d + %d) %% %d AS k FROM range(0, %d) AS t(replicate))))" % (ROUND, m, ROUND, m, TURN, seed * SEED, m, replicates)
    x = f"SELECT row_id, replicate, xor(xor((row_id % {m}) * {LOW} % {m}, (row_id // {m}) * {HIGH} % {m}), turn) AS x FROM ({rows}), ({turn})"
    u = f"SELECT row_id, replicate, xor(z, z >> 16) / {m}.0 AS u FROM (SELECT row_id, replicate, xor(y, y >> 16) * {ROUND} % {m} AS z FROM (SELECT row_id, replicate, xor(x, x >> 16) * {ROUND} % {m} AS y FROM ({x})))"
    return f"SELECT row_id, replicate, {' + '.join(f'(u >= {c})::INT' for c in POISSON)} AS w FROM ({u})"


# Common table expressions; a statement names those it needs in its first line.
PARTS: dict[str, tuple[list[str], str]] = {
    "trial": ([], """
      SELECT event_id AS row_id, CASE WHEN (event_id * 7919 + 13) % 100 < 85 THEN 1 ELSE 0 END AS treatment, (event_type = 'purchase')::INT AS conversion,
        (event_type IN ('purchase', 'click', 'view'))::INT AS visit, ((event_id * 7919 + 13) % 100 < 85 AND event_type IN ('click', 'view'))::INT AS exposure,
        value AS f0, hour(ts)::DOUBLE AS f1, day(ts)::DOUBLE AS f2, json_extract_string(props, '$.k')::DOUBLE AS f3, least(value, 25.0) AS f4,
        CASE WHEN json_extract_string(props, '$.k')::DOUBLE < 40 THEN 0.0 ELSE json_extract_string(props, '$.k')::DOUBLE END AS f5 FROM events"""),
    "celled": (["trial"], "SELECT *, least(floor(f0 / 10), 5) * 10 + floor(f3 / 25) AS cell FROM trial"),
    "cells": (["celled"], "SELECT cell, avg(conversion) FILTER (treatment = 0) AS m0, avg(conversion) FILTER (treatment = 1) AS m1 FROM celled GROUP BY cell"),
    "arms": (["trial"], "SELECT avg(conversion) FILTER (treatment = 0) AS a0, avg(conversion) FILTER (treatment = 1) AS a1 FROM trial"),
    "nuisance": (["cells", "arms"], "SELECT c.*, coalesce(m0, a0) AS mu0, coalesce(m1, a1) AS mu1 FROM celled c JOIN cells USING (cell), arms"),
    "signalled": (["nuisance"], """
      SELECT *, treatment * conversion / 0.85 - (1 - treatment) * conversion / (1 - 0.85) AS ipw,
        mu1 - mu0 + treatment * (conversion - mu1) / 0.85 - (1 - treatment) * (conversion - mu0) / (1 - 0.85) AS dr FROM nuisance"""),
    "scored": (["signalled"], "SELECT row_id, treatment, conversion AS outcome, floor(f0 / 5) * 5 AS score, dr, ipw, mu0, mu1 FROM signalled"),
    "effect": (["signalled"], "SELECT row_id, treatment, conversion AS outcome, round(mu1 - mu0, 9) AS score, dr FROM signalled"),
    "long": (["signalled"], """
      SELECT row_id, treatment, conversion AS outcome, dr, 'tied' AS model, floor(f0 / 5) * 5 AS score FROM signalled
      UNION ALL SELECT row_id, treatment, conversion, dr, 'level', f3 FROM signalled UNION ALL SELECT row_id, treatment, conversion, dr, 'effect', round(mu1 - mu0, 9) FROM signalled"""),
    "one": (["scored"], "SELECT 0 AS m, 1 AS w, * FROM scored"),
    "many": (["long"], "SELECT model AS m, 1 AS w, * FROM long"),
    "boot": (["long"], "SELECT replicate || ':' || model AS m, replicate, model, w, row_id, treatment, outcome, dr, score FROM long JOIN (" + weights("SELECT DISTINCT row_id FROM long", POLICY_DRAWS) + ") AS ws USING (row_id)"),
    "bootq": (["long"], "SELECT replicate || ':' || model AS m, replicate, model, w, row_id, treatment, outcome, dr, score FROM long JOIN (" + weights("SELECT DISTINCT row_id FROM long", QINI_DRAWS) + ") AS ws USING (row_id)"),
    "grid": ([], f"SELECT * FROM (VALUES {_GRID}) AS g(budget)"),
    "results": ([], "SELECT 'm' || (o_orderkey % 4) AS model, 101 * (o_orderkey % 3 + 1) AS fold_seed, round(avg(o_totalprice) / 1e6, 6) AS qini_score FROM orders GROUP BY 1, 2"),
}


def tie_groups(source: str) -> str:
    """Tie groups with running sums for each m of a source."""
    return f"""
      tg AS (SELECT m, score, sum(w) AS n, sum(w * treatment) AS n1, sum(w * treatment * outcome) AS y1, sum(w * (1 - treatment) * outcome) AS y0, sum(w * dr) AS g FROM {source} WHERE w > 0 GROUP BY m, score),
      cum AS (SELECT m, score, n AS gn, sum(n) OVER d AS cn, sum(n1) OVER d AS cn1, sum(y1) OVER d AS cy1, sum(y0) OVER d AS cy0, sum(g) OVER d AS cg FROM tg WINDOW d AS (PARTITION BY m ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      tot AS (SELECT m, sum(n) AS tn, sum(n1) AS tn1, sum(y1) AS ty1, sum(y0) AS ty0, sum(g) AS tg FROM tg GROUP BY m)"""


_QINI = "cy1 - CASE WHEN cn > cn1 THEN cy0 * cn1 / (cn - cn1)::DOUBLE ELSE 0 END"
_UPLIFT = "(CASE WHEN cn1 > 0 THEN cy1 / cn1::DOUBLE ELSE 0 END - CASE WHEN cn > cn1 THEN cy0 / (cn - cn1)::DOUBLE ELSE 0 END) * cn"


def curve(value: str) -> str:
    return f"pts AS (SELECT m, cn::DOUBLE AS x, {value} AS y FROM cum UNION ALL SELECT m, 0, 0 FROM tot)"


def areas(value: str, best: str) -> str:
    """Areas of the curve and of the best ranking, whose groups ``best`` lists (score, n, n1, y1, y0)."""
    return f"""{curve(value)},
      bg AS (SELECT * FROM ({best}) WHERE n > 0),
      bc AS (SELECT m, sum(n) OVER d AS cn, sum(n1) OVER d AS cn1, sum(y1) OVER d AS cy1, sum(y0) OVER d AS cy0 FROM bg WINDOW d AS (PARTITION BY m ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
      bp AS (SELECT m, cn::DOUBLE AS x, {value} AS y FROM bc UNION ALL SELECT m, 0, 0 FROM tot),
      area AS (SELECT m, sum(s) AS a FROM (SELECT m, (x - lag(x) OVER d) * (y + lag(y) OVER d) / 2 AS s FROM pts WINDOW d AS (PARTITION BY m ORDER BY x)) GROUP BY m),
      barea AS (SELECT m, sum(s) AS b, max_by(x, x) * max_by(y, x) / 2 AS line FROM (SELECT m, x, y, (x - lag(x) OVER d) * (y + lag(y) OVER d) / 2 AS s FROM bp WINDOW d AS (PARTITION BY m ORDER BY x)) GROUP BY m)"""


_BEST_QINI = "SELECT m, 1 AS score, ty1 AS n, ty1 AS n1, ty1 AS y1, 0 AS y0 FROM tot UNION ALL SELECT m, 0, tn - ty1 - ty0, tn1 - ty1, 0, 0 FROM tot UNION ALL SELECT m, -1, ty0, 0, 0, ty0 FROM tot"
_BEST_UPLIFT = """SELECT m, 3 AS score, ty1 AS n, ty1 AS n1, ty1 AS y1, 0 AS y0 FROM tot UNION ALL SELECT m, 2, tn - tn1 - ty0, 0, 0, 0 FROM tot
  UNION ALL SELECT m, CASE WHEN ty0 > tn1 - ty1 THEN 0 ELSE 1 END, tn1 - ty1, tn1 - ty1, 0, 0 FROM tot UNION ALL SELECT m, CASE WHEN ty0 > tn1 - ty1 THEN 1 ELSE 0 END, ty0, 0, 0, ty0 FROM tot"""
_NORMAL = "CASE WHEN abs(b - line) > 0 THEN (a - line) / (b - line) END"
_RATE = "sum((cg / cn - tg / tn) * gn / tn) AS autoc, sum(cn / tn * (cg / cn - tg / tn) * gn / tn) AS rate_qini"
_POLICY = """pp AS (SELECT m, cn / tn::DOUBLE AS x, cg / tn AS y FROM cum JOIN tot USING (m) UNION ALL SELECT m, 0, 0 FROM tot),
      ends AS (SELECT m, budget, max({'x': x, 'y': y}) FILTER (x <= budget) AS lo, min({'x': x, 'y': y}) FILTER (x >= budget) AS hi FROM pp, grid GROUP BY m, budget),
      pol AS (SELECT m, budget, lo.y + CASE WHEN hi.x > lo.x THEN (hi.y - lo.y) / (hi.x - lo.x) ELSE 0 END * (budget - lo.x) AS value FROM ends)"""
_PAREA = "parea AS (SELECT m, sum(s) / (max(budget) - min(budget)) AS policy_area FROM (SELECT m, budget, (budget - lag(budget) OVER d) * (value + lag(value) OVER d) / 2 AS s FROM pol WINDOW d AS (PARTITION BY m ORDER BY budget)) GROUP BY m)"
_EFFECT = f"""n1, n0, y1, y0, y1 / n1 AS treated_rate, y0 / n0 AS control_rate, y1 / n1 - y0 / n0 AS effect, sqrt(y1 / n1 * (1 - y1 / n1) / n1 + y0 / n0 * (1 - y0 / n0) / n0) AS se,
  CASE WHEN y1 > 0 AND y0 > 0 THEN ln((y1 / n1) / (y0 / n0)) END AS log_rr, CASE WHEN y1 > 0 AND y0 > 0 THEN sqrt(1 / y1 - 1 / n1 + 1 / y0 - 1 / n0) END AS se_log_rr"""
_CI = f"effect - {Z95} * se AS ci_low, effect + {Z95} * se AS ci_high, exp(log_rr) AS risk_ratio, exp(log_rr - {Z95} * se_log_rr) AS rr_low, exp(log_rr + {Z95} * se_log_rr) AS rr_high"
_COUNTS = "sum(treatment)::DOUBLE AS n1, sum(1 - treatment)::DOUBLE AS n0, sum(treatment * conversion)::DOUBLE AS y1, sum((1 - treatment) * conversion)::DOUBLE AS y0"
_DECADES = f"""bins AS (SELECT floor(f3 / 10) AS bin, {_COUNTS} FROM trial GROUP BY 1), strata AS (SELECT {_EFFECT} FROM bins WHERE n1 > 0 AND n0 > 0 AND least(y1, y0) >= 1)"""


def sized(fraction: float, seed: int, table: str = "trial", floor: int = 1) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY treatment, conversion ORDER BY md5(row_id || ':{seed}'), row_id) AS rn, greatest({floor}, round_even(count(*) OVER (PARTITION BY treatment, conversion) * {fraction}::DOUBLE, 0)) AS size FROM {table})"


def held(share: float, seed: int, table: str) -> str:
    """Rows with their place and the test size of their stratum by largest remainder."""
    return f"""(SELECT r.*, rn <= test AS is_test FROM (SELECT *, row_number() OVER (PARTITION BY treatment, conversion ORDER BY md5(row_id || ':{seed}'), row_id) AS rn FROM {table}) r
      JOIN (SELECT treatment, conversion, fl + (row_number() OVER (ORDER BY rest DESC, treatment, conversion) <= total - sum(fl) OVER ())::INT AS test FROM (
        SELECT treatment, conversion, floor(count(*) * {share}::DOUBLE) AS fl, count(*) * {share}::DOUBLE - floor(count(*) * {share}::DOUBLE) AS rest, ceil(sum(count(*)) OVER () * {share}::DOUBLE) AS total FROM {table} GROUP BY 1, 2)) s USING (treatment, conversion))"""


def long_features(features: list[str], keep: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {keep}'{f}' AS feature, {f}::DOUBLE AS value FROM trial" for f in features)


def rank_of(column: str, table: str = "trial") -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0"


_TOP = "SELECT *, row_number() OVER (ORDER BY score DESC, row_id) AS rn, count(*) OVER () AS n FROM scored"
_DIFF = "quantile_cont(diff, 0.025) AS ci_low, quantile_cont(diff, 0.975) AS ci_high, avg(diff) AS mean, count(*) AS n_replicates, avg((diff > 0)::INT) AS share_positive, least(1.0, 2 * least(avg((diff <= 0)::INT), avg((diff >= 0)::INT))) AS two_sided"
_X = "SELECT 'x' AS model, model AS candidate, fold_seed AS validation_seed, qini_score, 1.5 AS fit_seconds FROM results"
_SEED = f"""x AS ({_X}), s AS (SELECT x.model, x.candidate, count(DISTINCT x.validation_seed) AS n_seeds, median(x.qini_score) AS median, avg(x.qini_score) AS mean, stddev_samp(x.qini_score) AS std, min(x.qini_score) AS min, max(x.qini_score) AS max,
  median(x.qini_score - b.qini_score) AS median_delta, avg(x.qini_score - b.qini_score) AS mean_delta, count(*) FILTER (x.qini_score > b.qini_score) AS wins, sum(x.fit_seconds) AS total_seconds
  FROM x LEFT JOIN x b ON b.candidate = 'm0' AND b.validation_seed = x.validation_seed GROUP BY 1, 2)"""
_TENTHS = ", ".join(str(i / 10) for i in range(11))
_PCT = ", ".join(str(i / 1000) for i in range(1001))
_MODES = "modes AS (SELECT " + ", ".join(f"(SELECT {f} FROM trial GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1) AS m{i}" for i, f in enumerate(FEATURES)) + ")"
_FLAGS = "flags AS (SELECT " + ", ".join(f"(f{i} = m{i})::INT AS s{i}" for i in range(6)) + ", trial.* FROM trial, modes)"
_SELECT_DR = "SELECT dr, mu1 - mu0 AS effect, f3 / 1000 AS level FROM signalled"
_HIST = "h AS (SELECT * FROM long WHERE model <> 'effect'), e AS (SELECT min(lo) AS lo, max(hi) AS hi FROM (SELECT quantile_cont(score, 0.005) AS lo, quantile_cont(score, 0.995) AS hi FROM h GROUP BY model)), i AS (SELECT model, lo, (hi - lo) / 10 AS width, least(floor((score - lo) / ((hi - lo) / 10)), 9) AS bin FROM h, e WHERE score BETWEEN lo AND hi)"

#: name: (parts, common table expressions of its own, select, digits)
STATEMENTS: dict[str, tuple[str, str, str, int]] = {
    "contract_check": ("trial", "", "SELECT 0 AS n_missing_columns, 0 AS n_extra_columns, count(*) AS n_rows, " + " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in [*FEATURES, "treatment", "conversion", "visit", "exposure"]) + " AS n_null, " + " + ".join(f"count(*) FILTER ({c} NOT IN (0, 1))" for c in ["treatment", "conversion", "visit", "exposure"]) + " AS n_not_binary, " + " + ".join(f"count(*) FILTER (NOT isfinite({c}))" for c in FEATURES) + " AS n_not_finite, 1 AS valid FROM trial", 6),
    "ate_risk_ratio": ("trial", f"c AS (SELECT {_COUNTS} FROM trial), e AS (SELECT {_EFFECT} FROM c)", f"SELECT n1::BIGINT AS n1, n0::BIGINT AS n0, y1::BIGINT AS y1, y0::BIGINT AS y0, treated_rate, control_rate, effect, se, log_rr, se_log_rr, {_CI} FROM e", 6),
    "ate_sample_variance": ("trial", "v AS (SELECT avg(conversion) FILTER (treatment = 1) - avg(conversion) FILTER (treatment = 0) AS effect, sqrt(var_samp(conversion) FILTER (treatment = 1) / sum(treatment) + var_samp(conversion) FILTER (treatment = 0) / sum(1 - treatment)) AS se FROM trial)", "SELECT effect, se, effect - 1.96 * se AS ci_low, effect + 1.96 * se AS ci_high FROM v", 6),
    "arm_outcomes": ("trial", "l AS (UNPIVOT (SELECT treatment, conversion, visit, exposure FROM trial) ON conversion, visit, exposure INTO NAME outcome VALUE y)", "SELECT treatment, outcome, count(*) AS n, sum(y)::BIGINT AS events, avg(y) AS rate FROM l GROUP BY 1, 2", 6),
    "arm_summary_wide": ("trial", "", "SELECT treatment, count(*) AS n, " + ", ".join(f"avg({o}) AS mean_{o}, sum({o})::BIGINT AS sum_{o}" for o in ("conversion", "visit", "exposure")) + " FROM trial GROUP BY 1", 6),
    "feature_profile": ("trial", f"l AS ({long_features(FEATURES)}), c AS (SELECT feature, value, count(*) AS c, row_number() OVER (PARTITION BY feature ORDER BY count(*) DESC, value) AS r FROM l GROUP BY 1, 2), t AS (SELECT feature, max(value) FILTER (r = 1) AS mode, max(c) AS mode_n, sum(c) FILTER (r <= 3) AS top3, count(*) AS n_distinct FROM c GROUP BY 1), b AS (SELECT feature, count(value) AS n, count(*) - count(value) AS n_null, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, skewness(value) AS skew, kurtosis(value) AS kurtosis, len(list_distinct(quantile_cont(value, [{_TENTHS}]))) - 1 AS n_bins FROM l GROUP BY 1)", "SELECT feature, n, n_null, n_distinct, mode, mode_n / n AS mode_share, top3 / n AS top3_share, mean, std, min, max, q25, q50, q75, skew, kurtosis, n_bins FROM b JOIN t USING (feature)", 5),
    "smd_ks_balance": ("trial", f"l AS ({long_features(FEATURES, 'treatment, ')}), m AS (SELECT feature, avg(value) FILTER (treatment = 1) AS mean1, avg(value) FILTER (treatment = 0) AS mean0, var_samp(value) FILTER (treatment = 1) AS s1, var_samp(value) FILTER (treatment = 0) AS s0, sum(treatment) AS n1, sum(1 - treatment) AS n0 FROM l GROUP BY 1), g AS (SELECT feature, value, sum(treatment) AS c1, sum(1 - treatment) AS c0 FROM l GROUP BY 1, 2), k AS (SELECT feature, sum(c1) OVER d AS c1, sum(c0) OVER d AS c0 FROM g WINDOW d AS (PARTITION BY feature ORDER BY value ROWS UNBOUNDED PRECEDING)), ks AS (SELECT feature, max(abs(c1 / n1 - c0 / n0)) AS ks FROM k JOIN m USING (feature) GROUP BY 1)", "SELECT feature, mean1, mean0, CASE WHEN s1 + s0 > 0 THEN (mean1 - mean0) / sqrt((s1 + s0) / 2) WHEN mean1 = mean0 THEN 0 ELSE sign(mean1 - mean0) * 'inf'::DOUBLE END AS smd, ks, n1::BIGINT AS n1, n0::BIGINT AS n0 FROM m JOIN ks USING (feature)", 6),
    "sentinel_agreement": ("trial", f"{_MODES}, {_FLAGS}", " UNION ALL ".join(f"SELECT 'f{i}' AS a, 'f{j}' AS b, avg((s{i} = s{j})::INT) AS agreement FROM flags" for i in range(6) for j in range(i + 1, 6)), 6),
    "sentinel_patterns": ("trial", f"{_MODES}, {_FLAGS}, p AS (SELECT " + " + ".join(f"(s{i} << {i})" for i in range(6)) + " AS key, count(*) AS n FROM flags GROUP BY 1)", "SELECT key::BIGINT AS key, " + " || ".join(f"CASE WHEN (key >> {i}) & 1 = 1 THEN '.' ELSE 'O' END" for i in range(6)) + " AS pattern, n, n / (SELECT count(*) FROM trial) AS share FROM p ORDER BY n DESC, key LIMIT 8", 6),
    "duplicate_profile": ("trial", "g AS (SELECT count(*) AS c FROM trial GROUP BY f1, f3, f4), s AS (SELECT sum(c) AS n, count(*) AS k, sum(c) FILTER (c > 1) AS r, max(c) AS m, avg(c) AS a FROM g)", "SELECT n::BIGINT AS n_rows, k AS n_distinct, (n - k)::BIGINT AS n_duplicates, 1 - k / n AS duplicate_share, coalesce(r, 0)::BIGINT AS rows_in_repeated, coalesce(r, 0) / n AS repeated_share, m AS max_size, a AS mean_size FROM s", 6),
    "overlap_bins": ("trial", "e AS (SELECT min(f0) AS lo, max(f0) AS hi FROM trial), b AS (SELECT len(list_filter(list_transform(range(1, 20), lambda i: lo + (hi - lo) * i / 20), lambda c: c <= f0)) AS bin, treatment FROM trial, e), c AS (SELECT bin, sum(treatment) AS n1, sum(1 - treatment) AS n0 FROM b GROUP BY 1)", "SELECT g.bin, coalesce(n1, 0)::BIGINT AS n1, coalesce(n0, 0)::BIGINT AS n0, ((coalesce(n1, 0) = 0) <> (coalesce(n0, 0) = 0))::BIGINT AS single_arm FROM (SELECT unnest(range(0, 20)) AS bin) g LEFT JOIN c ON c.bin = g.bin", 6),
    "leakage_report": ("trial", "l AS (SELECT treatment, conversion, 'visit' AS feature, visit AS v FROM trial UNION ALL SELECT treatment, conversion, 'exposure', exposure FROM trial), m AS (SELECT feature, avg(v) FILTER (treatment = 1) AS rate1, avg(v) FILTER (treatment = 0) AS rate0, var_samp(v) FILTER (treatment = 1) AS s1, var_samp(v) FILTER (treatment = 0) AS s0, avg(conversion) FILTER (v > 0) AS p, avg(conversion) FILTER (v = 0) AS z FROM l GROUP BY 1)", "SELECT feature, rate1, rate0, (rate1 - rate0) / sqrt((s1 + s0) / 2) AS smd, p AS outcome_if_positive, z AS outcome_if_zero, (rate0 = 0 AND rate1 > 0)::BIGINT AS treatment_only, coalesce(z = 0 AND p > 0, false)::BIGINT AS necessary_for_outcome FROM m", 6),
    "effect_by_bin": ("trial", f"c AS (SELECT f1::INT AS bin, {_COUNTS} FROM trial GROUP BY 1), e AS (SELECT bin, {_EFFECT} FROM c WHERE n1 > 0 AND n0 > 0 AND least(y1, y0) >= 1)", f"SELECT bin, n1::BIGINT AS n1, n0::BIGINT AS n0, y1::BIGINT AS y1, y0::BIGINT AS y0, treated_rate, control_rate, effect, se, log_rr, se_log_rr, {_CI} FROM e", 6),
    "effect_by_feature_bin": ("trial", f"l AS ({long_features(['f0', 'f3', 'f4'], 'treatment, conversion, ')}), q AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.2, 0.4, 0.6, 0.8, 1]))) AS e FROM l GROUP BY 1), b AS (SELECT l.*, CASE WHEN len(e) > 1 THEN len(list_filter(e[2:len(e) - 1], lambda c: c < value)) END AS bin FROM l JOIN q USING (feature)), c AS (SELECT feature, bin, {_COUNTS} FROM b WHERE bin IS NOT NULL GROUP BY 1, 2), x AS (SELECT feature, bin, {_EFFECT} FROM c WHERE n1 > 0 AND n0 > 0 AND least(y1, y0) >= 1)", f"SELECT feature, bin, n1::BIGINT AS n1, n0::BIGINT AS n0, y1::BIGINT AS y1, y0::BIGINT AS y0, treated_rate, control_rate, effect, se, log_rr, se_log_rr, {_CI} FROM x", 6),
    "cochran_q": ("trial", f"{_DECADES}, s AS (SELECT sum(1 / se ** 2) AS w, sum(effect / se ** 2) AS we, sum(effect ** 2 / se ** 2) AS wee, count(*) AS k FROM strata WHERE se > 0), q AS (SELECT we / w AS pooled, sqrt(1 / w) AS pooled_se, greatest(wee - we * we / w, 0) AS q, k - 1 AS df FROM s)", "SELECT pooled, pooled_se, q, df, CASE WHEN q > df THEN (q - df) / q ELSE 0 END AS i2 FROM q", 6),
    "prognostic_dominance": ("trial", f"{_DECADES}, r AS (SELECT *, {rank_of('control_rate')} AS rb, {rank_of('effect')} AS re FROM strata), o AS (SELECT count(*) AS n_strata, corr(control_rate, effect) AS pearson, corr(rb, re) AS spearman, quantile_cont(effect / control_rate, 0.5) AS median_ratio, quantile_cont(effect / control_rate, 0.75) - quantile_cont(effect / control_rate, 0.25) AS iqr_ratio FROM r), a AS (SELECT sum(effect ** 2 / se ** 2) - sum(effect / se ** 2) ** 2 / sum(1 / se ** 2) AS q_additive FROM strata), m AS (SELECT sum(log_rr ** 2 / se_log_rr ** 2) - sum(log_rr / se_log_rr ** 2) ** 2 / sum(1 / se_log_rr ** 2) AS q_multiplicative FROM strata WHERE log_rr IS NOT NULL)", "SELECT * FROM o, a, m", 5),
    "representativity": ("trial", f"p AS (SELECT * FROM {sized(0.05, 42)} WHERE rn <= size)", " UNION ALL ".join(f"SELECT '{f}' AS feature, a.m AS mean_full, b.m AS mean_sample, (b.m - a.m) / sqrt((a.v + b.v) / 2) AS smd FROM (SELECT avg({f}) AS m, var_samp({f}) AS v FROM trial) a, (SELECT avg({f}) AS m, var_samp({f}) AS v FROM p) b" for f in ("f0", "f3", "f4")), 6),
    "power_table": ("trial", f"c AS (SELECT {_COUNTS} FROM trial), p AS (SELECT y1 / n1 - y0 / n0 AS e, {ZPOWER} * sqrt(y0 / n0 * (1 - y0 / n0) * (1 / n1 + 1 / n0)) AS mde, y0 / n0 AS b, n1 / (n1 + n0) AS s FROM c)", f"SELECT fraction, abs(e * fraction) AS target_effect, mde, ceil({ZPOWER * ZPOWER} * b * (1 - b) * (1 / s + 1 / (1 - s)) / (e * fraction) ** 2)::BIGINT AS required_n FROM p, (VALUES (1.0::DOUBLE), (0.5), (0.1), (0.01)) AS f(fraction)", 6),
    "stratified_sample": ("trial", "", f"SELECT row_id FROM {sized(0.05, 42)} WHERE rn <= size", 6),
    "stratified_complement": ("trial", "", f"SELECT row_id FROM {sized(0.05, 42)} WHERE rn > size", 6),
    "holdout_split": ("trial", "", f"SELECT row_id, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split FROM {held(0.3, 42, 'trial')}", 6),
    "folds": ("trial", "", "SELECT row_id, (row_number() OVER (PARTITION BY treatment, conversion ORDER BY md5(row_id || ':101'), row_id) - 1) % 3 AS fold FROM trial", 6),
    "undersample": ("trial", "a AS (SELECT treatment, round_even((count(*) - sum(conversion)) * (1 / 2.0::DOUBLE - avg(conversion)) / (1 - avg(conversion)), 0) AS keep FROM trial GROUP BY 1), r AS (SELECT *, row_number() OVER (PARTITION BY treatment ORDER BY md5(row_id || ':7'), row_id) AS rn FROM trial WHERE conversion = 0)", "SELECT row_id FROM trial WHERE conversion = 1 UNION ALL SELECT row_id FROM r JOIN a USING (treatment) WHERE rn <= keep", 6),
    "split_roles": ("trial", f"s AS (SELECT * FROM {sized(0.5, 42)}), rest AS (SELECT * EXCLUDE (rn, size) FROM s WHERE rn > size), h AS (SELECT * EXCLUDE (rn) FROM {held(0.4, 43, 'rest')}), tail AS (SELECT * EXCLUDE (is_test) FROM h WHERE is_test), u AS (SELECT 'seen' AS split, treatment, conversion, row_id FROM s WHERE rn <= size UNION ALL SELECT 'fit', treatment, conversion, row_id FROM h WHERE NOT is_test UNION ALL SELECT CASE WHEN is_test THEN 'confirmation' ELSE 'validation' END, treatment, conversion, row_id FROM {held(0.5, 44, 'tail')})", "SELECT split, treatment, conversion, count(*) AS n, sum(row_id)::BIGINT AS id_sum FROM u GROUP BY 1, 2, 3", 6),
    "effect_signals": ("signalled", "", "SELECT row_id, conversion * (treatment - 0.85) / (0.85 * 0.15) AS transformed, (conversion - (0.85 * mu1 + 0.15 * mu0)) * (treatment - 0.85) / (0.85 * 0.15) AS adjusted, ipw, dr FROM signalled", 6),
    "probability_maps": ("trial", "p AS (SELECT row_id, f3 / 200 + 0.001 AS p FROM trial)", "SELECT row_id, p / (p + 0.12 * (1 - p)) AS sampled, p AS restored, ln(p / (1 - p)) AS logit, p AS back FROM p", 6),
    "top_budget_policy": ("scored", "", f"SELECT row_id, (rn <= floor(n * 0.1::DOUBLE))::BIGINT AS target FROM ({_TOP})", 6),
    "cost_aware_policy": ("signalled", "e AS (SELECT row_id, round(mu1 - mu0, 9) - 0.02::DOUBLE AS net FROM signalled), r AS (SELECT *, row_number() OVER (ORDER BY (net > 0)::INT DESC, net DESC, row_id) AS rn, count(*) OVER () AS n FROM e)", "SELECT row_id, (rn <= floor(n * 0.2::DOUBLE) AND net > 0)::BIGINT AS target FROM r", 6),
    "policy_value": ("scored", f"r AS ({_TOP})", "SELECT avg((rn <= floor(n * 0.1::DOUBLE))::INT * (dr - 0.0005)) AS policy_value, avg((rn <= floor(n * 0.1::DOUBLE))::INT) AS target_share FROM r", 6),
    "policy_sensitivity_grid": ("scored grid", f"r AS ({_TOP}), g AS (SELECT budget, sum(dr) / max(n) AS gross, count(*) / max(n)::DOUBLE AS target_share FROM r, grid WHERE rn <= floor(n * budget) GROUP BY 1)", "SELECT budget, cost, gross, target_share, gross - cost * target_share AS net, gross / target_share AS break_even_cost FROM g, (VALUES (0.0::DOUBLE), (0.0005), (0.01)) AS c(cost)", 6),
    "top_tail_support": ("scored grid", f"r AS ({_TOP}), t AS (SELECT budget, count(*) AS n_target, sum(treatment) AS n_treated, sum(1 - treatment) AS n_control, sum(treatment * outcome) AS events_treated, sum((1 - treatment) * outcome) AS events_control, min(score) AS s FROM r, grid WHERE rn <= floor(n * budget) GROUP BY 1)", "SELECT budget, n_target, n_treated::BIGINT AS n_treated, n_control::BIGINT AS n_control, events_treated::BIGINT AS events_treated, events_control::BIGINT AS events_control, (SELECT count(*) FROM scored WHERE score = s) AS boundary_tie_size FROM t", 6),
    "top_tail_overlap": ("trial grid", "r AS (SELECT row_number() OVER (ORDER BY f0 DESC, row_id) AS ra, row_number() OVER (ORDER BY f3 DESC, row_id) AS rb, count(*) OVER () AS n FROM trial), o AS (SELECT budget, floor(max(n) * budget) AS k, count(*) FILTER (greatest(ra, rb) <= floor(n * budget)) AS \"both\", count(*) FILTER (least(ra, rb) <= floor(n * budget)) AS either FROM r, grid GROUP BY 1)", 'SELECT budget, "both", either, CASE WHEN k > 0 THEN "both" / k ELSE 1 END AS overlap, CASE WHEN either > 0 THEN "both" / either ELSE 1 END AS jaccard FROM o', 6),
    "ordering_condition": ("signalled grid", "r AS (SELECT mu0, abs(mu1 - mu0) AS beta, row_number() OVER (ORDER BY f0 DESC, row_id DESC) AS rn, count(*) OVER () AS n FROM signalled), o AS (SELECT budget, max(mu0) AS theta_max, max(beta) AS beta_max FROM r, grid WHERE rn <= greatest(1, floor(n * budget)) GROUP BY 1)", "SELECT budget, theta_max, beta_max, (theta_max < (1 - beta_max) / 2)::BIGINT AS holds FROM o", 6),
    "percentile_grid": ("trial", f"q AS (SELECT quantile_cont(f3, [{_PCT}]) AS v FROM trial), p AS (SELECT unnest(v) AS value, unnest(range(0, 1001)) AS i FROM q)", "SELECT value, min(i) / 1000 AS quantile FROM p GROUP BY value", 6),
    "batch_target": ("trial", f"q AS (SELECT quantile_cont(f3, [{_PCT}]) AS v FROM trial), p AS (SELECT unnest(v) AS value, unnest(range(0, 1001)) AS i FROM q), g AS (SELECT value, min(i) / 1000 AS quantile FROM p GROUP BY value), b AS (SELECT row_id, f3, row_number() OVER (ORDER BY f3 DESC, row_id) AS rn, count(*) OVER () AS n FROM trial), e AS (SELECT row_id, f3, rn, n, max({{'v': value, 'q': quantile}}) FILTER (value <= f3) AS lo, min({{'v': value, 'q': quantile}}) FILTER (value >= f3) AS hi FROM b, g GROUP BY ALL)", "SELECT row_id, (rn <= floor(n * 0.1::DOUBLE))::BIGINT AS target, coalesce(lo.q, hi.q) + CASE WHEN hi.v > lo.v THEN (f3 - lo.v) / (hi.v - lo.v) * (hi.q - lo.q) ELSE 0 END AS percentile FROM e", 6),
    "simulate_scenario": ("one grid", f"{tie_groups('one')}, {_POLICY}, a AS (SELECT max(value) FILTER (budget = 0.1) AS x, max(value) FILTER (budget = 0.2) AS y FROM pol), v AS (SELECT x + (y - x) * 0.5 AS v FROM a)", "SELECT 0.15::DOUBLE AS budget, v AS gross_per_customer, v - 0.0005 * 0.15 AS net_per_customer, (v - 0.0005 * 0.15) * 1000000 AS net_total, 150000 AS n_targeted, v * 0.8 - 0.0005 * 0.15 AS net_low, v * 1.2 - 0.0005 * 0.15 AS net_high, v / 0.15 AS break_even_cost, 0 AS guardrail FROM v", 6),
    "qini_curve": ("one", f"{tie_groups('one')}, {curve(_QINI)}", "SELECT x, y FROM pts", 6),
    "uplift_curve": ("one", f"{tie_groups('one')}, {curve(_UPLIFT)}", "SELECT x, y FROM pts", 6),
    "qini_score": ("many", f"{tie_groups('many')}, {areas(_QINI, _BEST_QINI)}", f"SELECT m AS model, {_NORMAL} AS qini_score FROM area JOIN barea USING (m)", 6),
    "auuc_score": ("many", f"{tie_groups('many')}, {areas(_UPLIFT, _BEST_UPLIFT)}", f"SELECT m AS model, {_NORMAL} AS auuc_score FROM area JOIN barea USING (m)", 6),
    "toc_curve": ("one", tie_groups("one"), "SELECT cn / tn AS q, cg / cn - tg / tn AS toc, gn / tn AS share FROM cum JOIN tot USING (m)", 6),
    "rate_scores": ("many", tie_groups("many"), f"SELECT m AS model, {_RATE} FROM cum JOIN tot USING (m) GROUP BY m", 6),
    "policy_value_curve": ("many grid", f"{tie_groups('many')}, {_POLICY}", "SELECT m AS model, budget, value FROM pol", 6),
    "policy_area": ("many grid", f"{tie_groups('many')}, {_POLICY}, {_PAREA}", "SELECT m AS model, policy_area FROM parea", 6),
    "expected_random": ("signalled grid", "", "SELECT budget, budget * (SELECT avg(dr) FROM signalled) AS value FROM grid", 6),
    "random_topk_sensitivity": ("scored grid", f"rnd AS (SELECT draw AS m, 1 AS w, row_id, 0 AS treatment, 0 AS outcome, dr, ('0x' || substr(md5(row_id || ':' || draw || ':3'), 1, 8))::BIGINT / 4294967296.0 AS score FROM scored, unnest(range(0, {RANDOM_SEEDS})) AS t(draw)), {tie_groups('rnd')}, {_POLICY}", "SELECT budget, avg(value) AS mean, min(value) AS min, max(value) AS max FROM pol GROUP BY 1", 6),
    "euce": ("effect", "c AS (SELECT *, ntile(10) OVER (ORDER BY score, row_id) AS k FROM effect), b AS (SELECT count(*) AS n, avg(outcome) FILTER (treatment = 1) AS r1, avg(outcome) FILTER (treatment = 0) AS r0, avg(score) AS s FROM c GROUP BY k)", "SELECT sum(n * abs(r1 - r0 - s)) / sum(n) AS euce FROM b WHERE r1 IS NOT NULL AND r0 IS NOT NULL", 6),
    "decile_policy": ("scored", "c AS (SELECT *, ntile(10) OVER (ORDER BY score DESC, row_id DESC) AS decile FROM scored), b AS (SELECT decile, sum(treatment)::DOUBLE AS n1, sum(1 - treatment)::DOUBLE AS n0, sum(treatment * outcome)::DOUBLE AS y1, sum((1 - treatment) * outcome)::DOUBLE AS y0 FROM c GROUP BY 1), u AS (SELECT *, y1 / n1 - y0 / n0 AS uplift, sqrt(y1 / n1 * (1 - y1 / n1) / n1 + y0 / n0 * (1 - y0 / n0) / n0) AS se, sum(y1) OVER d / sum(n1) OVER d - sum(y0) OVER d / sum(n0) OVER d AS cumulative_uplift FROM b WINDOW d AS (ORDER BY decile))", "SELECT decile, n1::BIGINT AS n1, n0::BIGINT AS n0, uplift, uplift - 1.96 * se AS ci_low, uplift + 1.96 * se AS ci_high, cumulative_uplift, uplift * (n1 + n0) AS incremental FROM u", 6),
    "transformed_outcome_mse": ("signalled", "", "SELECT avg((conversion * (treatment - 0.85) / (0.85 * 0.15) - (mu1 - mu0)) ** 2) AS mse FROM signalled", 6),
    "score_diagnostics": ("long", "", "SELECT model, avg(score) AS mean, stddev_pop(score) AS std, min(score) AS min, max(score) AS max, avg((score < 0)::INT) AS negative_share, avg((abs(score) < 1e-4)::INT) AS near_zero_share, count(DISTINCT score) AS n_distinct, quantile_cont(score, 0.01) AS p01, quantile_cont(score, 0.5) AS p50, quantile_cont(score, 0.99) AS p99 FROM long GROUP BY 1", 6),
    "score_histogram": ("long", f"{_HIST}, n AS (SELECT model, count(*) AS n FROM i GROUP BY 1)", "SELECT model, i.bin::BIGINT AS bin, max(lo) + i.bin * max(width) AS \"left\", count(*) / (max(n) * max(width)) AS density FROM i JOIN n USING (model) GROUP BY model, i.bin", 6),
    "spearman_matrix": ("trial", f"r AS (SELECT *, {rank_of('f0')} AS r0, {rank_of('f3')} AS r3, {rank_of('f4')} AS r4 FROM trial)", " UNION ALL ".join(f"SELECT 'f{a}' AS a, 'f{b}' AS b, corr(f{a}, f{b}) AS pearson, corr(r{a}, r{b}) AS spearman FROM r" for a, b in ((0, 3), (0, 4), (3, 4))), 6),
    "rank_average": ("trial", "", f"SELECT row_id, ({rank_of('f0')} + {rank_of('f3')}) / 2 / count(*) OVER () AS rank_average FROM trial", 6),
    "propensity_rank_auc": ("trial", f"r AS (SELECT treatment, {rank_of('f3')} AS r FROM trial)", "SELECT (sum(r * treatment) - sum(treatment) * (sum(treatment) + 1) / 2) / (sum(treatment) * sum(1 - treatment)) AS auc FROM r", 6),
    "bootstrap_policy_value": ("scored", f"r AS ({_TOP}), b AS (SELECT * FROM r JOIN ({weights('SELECT row_id FROM scored', POLICY_DRAWS)}) AS ws USING (row_id))", "SELECT replicate, 'top10' AS policy, sum(w * (rn <= floor(n * 0.1::DOUBLE))::INT * dr) / max(n) AS value FROM b GROUP BY 1 UNION ALL SELECT replicate, 'top30', sum(w * (rn <= floor(n * 0.3::DOUBLE))::INT * dr) / max(n) FROM b GROUP BY 1", 6),
    "bootstrap_policy_area": ("boot grid", f"{tie_groups('boot')}, {_POLICY}, {_PAREA}", "SELECT split_part(m, ':', 1)::BIGINT AS replicate, split_part(m, ':', 2) AS model, policy_area FROM parea", 6),
    "bootstrap_rate": ("boot", tie_groups("boot"), f"SELECT split_part(m, ':', 1)::BIGINT AS replicate, split_part(m, ':', 2) AS model, {_RATE} FROM cum JOIN tot USING (m) GROUP BY m", 6),
    "bootstrap_qini": ("bootq", f"{tie_groups('bootq')}, {areas(_QINI, _BEST_QINI)}", f"SELECT split_part(m, ':', 1)::BIGINT AS replicate, split_part(m, ':', 2) AS model, {_NORMAL} AS qini_score FROM area JOIN barea USING (m)", 6),
    "bootstrap_qini_interval": ("bootq", f"{tie_groups('bootq')}, {areas(_QINI, _BEST_QINI)}, s AS (SELECT split_part(m, ':', 2) AS model, {_NORMAL} AS q FROM area JOIN barea USING (m))", "SELECT model, avg(q) AS mean, quantile_cont(q, 0.025) AS ci_low, quantile_cont(q, 0.975) AS ci_high, count(*) AS n_replicates FROM s WHERE q IS NOT NULL GROUP BY 1", 6),
    "paired_difference": ("boot grid", f"{tie_groups('boot')}, {_POLICY}, {_PAREA}, s AS (SELECT split_part(m, ':', 1) AS r, split_part(m, ':', 2) AS model, policy_area AS v FROM parea), f AS (SELECT s.model, s.v - b.v AS diff FROM s JOIN s b ON b.r = s.r AND b.model = 'tied' WHERE s.model <> 'tied')", f"SELECT model, {_DIFF} FROM f GROUP BY 1", 6),
    "pairwise_comparison": ("bootq", f"{tie_groups('bootq')}, {areas(_QINI, _BEST_QINI)}, s AS (SELECT split_part(m, ':', 1) AS r, split_part(m, ':', 2) AS model, {_NORMAL} AS v FROM area JOIN barea USING (m)), f AS (SELECT s.model AS a, t.model AS b, s.v - t.v AS diff FROM s JOIN s t ON t.r = s.r AND s.model < t.model)", f"SELECT a, b, {_DIFF} FROM f GROUP BY 1, 2", 6),
    "simultaneous_band": ("boot grid", f"""{tie_groups('boot')}, {_POLICY}, d AS (SELECT split_part(p.m, ':', 1) AS r, split_part(p.m, ':', 2) AS model, p.budget, p.value - q.value AS diff FROM pol p JOIN pol q ON q.budget = p.budget AND q.m = split_part(p.m, ':', 1) || ':tied' WHERE split_part(p.m, ':', 2) <> 'tied'),
      otg AS (SELECT model, score, count(*) AS n, sum(dr) AS g FROM long GROUP BY 1, 2), oc AS (SELECT model, sum(n) OVER w / (SELECT count(*) FROM trial) AS x, sum(g) OVER w / (SELECT count(*) FROM trial) AS y FROM otg WINDOW w AS (PARTITION BY model ORDER BY score DESC ROWS UNBOUNDED PRECEDING)), op AS (SELECT * FROM oc UNION ALL SELECT DISTINCT model, 0.0, 0.0 FROM otg), oe AS (SELECT model, budget, max({{'x': x, 'y': y}}) FILTER (x <= budget) AS lo, min({{'x': x, 'y': y}}) FILTER (x >= budget) AS hi FROM op, grid GROUP BY 1, 2), ov AS (SELECT model, budget, lo.y + CASE WHEN hi.x > lo.x THEN (hi.y - lo.y) / (hi.x - lo.x) ELSE 0 END * (budget - lo.x) AS value FROM oe),
      ob AS (SELECT a.model, a.budget, a.value - b.value AS observed FROM ov a JOIN ov b ON b.model = 'tied' AND b.budget = a.budget WHERE a.model <> 'tied'), se AS (SELECT model, budget, stddev_samp(diff) AS se FROM d GROUP BY 1, 2), cr AS (SELECT quantile_cont(t, 0.95) AS critical FROM (SELECT r, max(CASE WHEN se > 0 THEN abs(diff - observed) / se ELSE 0 END) AS t FROM d JOIN ob USING (model, budget) JOIN se USING (model, budget) GROUP BY r))""", "SELECT model, budget, observed, se, critical, observed - critical * se AS low, observed + critical * se AS high FROM ob JOIN se USING (model, budget), cr", 5),
    "cell_mean_nuisance": ("celled arms", "f AS (SELECT *, (row_number() OVER (PARTITION BY treatment, conversion ORDER BY md5(row_id || ':101'), row_id) - 1) % 3 AS fold FROM celled), c AS (SELECT cell, sum(treatment) AS n1, sum(1 - treatment) AS n0, sum(treatment * conversion) AS y1, sum((1 - treatment) * conversion) AS y0 FROM f GROUP BY 1), k AS (SELECT cell, fold, sum(treatment) AS n1, sum(1 - treatment) AS n0, sum(treatment * conversion) AS y1, sum((1 - treatment) * conversion) AS y0 FROM f GROUP BY 1, 2)", "SELECT row_id, CASE WHEN c.n0 > k.n0 THEN (c.y0 - k.y0) / (c.n0 - k.n0) ELSE a0 END AS mu0, CASE WHEN c.n1 > k.n1 THEN (c.y1 - k.y1) / (c.n1 - k.n1) ELSE a1 END AS mu1 FROM f JOIN c USING (cell) JOIN k USING (cell, fold), arms", 6),
    "cell_mean_t_learner": ("nuisance", "", "SELECT cell::BIGINT AS cell, count(*) AS n, avg(mu1 - mu0) AS score FROM nuisance GROUP BY 1", 6),
    "funnel_cell_mean": ("celled", "p AS (SELECT cell, coalesce(avg(visit) FILTER (treatment = 0) * avg(conversion) FILTER (treatment = 0 AND visit = 1), 0) AS p0, coalesce(avg(visit) FILTER (treatment = 1) * avg(conversion) FILTER (treatment = 1 AND visit = 1), 0) AS p1 FROM celled GROUP BY 1)", "SELECT cell::BIGINT AS cell, p0, p1, p1 - p0 AS score FROM p", 6),
    "pattern_r_shrinkage": ("signalled", "mm AS (SELECT (SELECT f4 FROM signalled GROUP BY f4 ORDER BY count(*) DESC, f4 LIMIT 1) AS a, (SELECT f5 FROM signalled GROUP BY f5 ORDER BY count(*) DESC, f5 LIMIT 1) AS b), t AS (SELECT (f4 = a)::INT + 2 * (f5 = b)::INT AS pattern, treatment - 0.85 AS r, conversion AS y, 0.85 * mu1 + 0.15 * mu0 AS m FROM signalled, mm), al AS (SELECT sum(r * m * (y - m)) / sum((r * m) ** 2) AS alpha FROM t)", "SELECT pattern::BIGINT AS pattern, count(*) AS n, sum(r * r * ((y - m) - r * alpha * m) / r) / (sum(r * r) + 1000) AS residual FROM t, al GROUP BY 1", 6),
    "dr_risk": ("signalled", f"t AS ({_SELECT_DR}), r AS (SELECT 'effect' AS model, avg((dr - effect) ** 2) AS risk FROM t UNION ALL SELECT 'level', avg((dr - level) ** 2) FROM t), e AS (SELECT model, risk, exp(-(risk - min(risk) OVER ()) / stddev_pop(risk) OVER ()) AS e FROM r)", "SELECT model, risk, e / sum(e) OVER () AS weight FROM e", 6),
    "best_single": ("signalled", f"t AS ({_SELECT_DR}), r AS (SELECT 'effect' AS model, avg((dr - effect) ** 2) AS risk FROM t UNION ALL SELECT 'level', avg((dr - level) ** 2) FROM t)", "SELECT model, risk, (model = (SELECT min_by(model, risk) FROM r))::INT::DOUBLE AS weight FROM r", 6),
    "gram_matrix": ("signalled", f"t AS ({_SELECT_DR})", " UNION ALL ".join(f"SELECT '{a}' AS a, '{'signal' if b == 'dr' else b}' AS b, avg({a} * {b}) AS value FROM t" for a, b in (("effect", "effect"), ("effect", "level"), ("level", "level"), ("effect", "dr"), ("level", "dr"))), 6),
    "seed_summary": ("results", _SEED, "SELECT * FROM s", 6),
    "select_winners": ("results", f"{_SEED}, k AS (SELECT *, (median_delta >= 0 AND wins >= 2) AS fine, row_number() OVER (PARTITION BY model ORDER BY (median_delta >= 0 AND wins >= 2)::INT DESC, median DESC, candidate) AS rn FROM s)", "SELECT model, CASE WHEN fine THEN candidate ELSE 'baseline' END AS winner FROM k WHERE rn = 1", 6),
    "advancement_table": ("results", "d AS (SELECT r.model, count(DISTINCT r.fold_seed) AS n_seeds, min(r.qini_score - b.qini_score) AS min_delta, avg(r.qini_score - b.qini_score) AS mean_delta, bool_and(r.qini_score > b.qini_score) AS won FROM results r JOIN results b ON b.model = 'm0' AND b.fold_seed = r.fold_seed WHERE r.model <> 'm0' GROUP BY 1)", "SELECT model, n_seeds, min_delta, mean_delta, (won AND n_seeds = 3)::BIGINT AS advance, CASE WHEN n_seeds <> 3 THEN 'missing_fold_seed' WHEN won THEN 'advance' WHEN mean_delta > 0 THEN 'mean_only' ELSE 'no_gain' END AS reason FROM d", 6),
    "stability_labels": ("results", "", "SELECT r.model, CASE WHEN bool_and(r.qini_score > b.qini_score) THEN 'wins_all' WHEN bool_and(r.qini_score <= b.qini_score) THEN 'loses_all' ELSE 'unstable' END AS label FROM results r JOIN results b ON b.model = 'm0' AND b.fold_seed = r.fold_seed WHERE r.model <> 'm0' GROUP BY 1", 6),
    "promotion_rule": ("results", "m AS (SELECT model, avg(qini_score) AS q, min(qini_score) AS lo FROM results GROUP BY 1)", "SELECT coalesce(min(model) FILTER (q > 0.25 AND lo > 0.2 AND model <> 'm0'), 'm0') AS champion FROM m", 6),
    "registry_upsert": ("results", "", "SELECT model AS run_id, fold_seed::DOUBLE AS fold_seed, 'conversion' AS outcome, CASE WHEN fold_seed = 101 THEN qini_score * 2 + 1 ELSE qini_score END AS qini_score, CASE WHEN fold_seed = 101 THEN 2 ELSE 0 END AS position FROM results", 6),
    "merge_scores": ("trial", "", "SELECT row_id, treatment, f0 AS a, f3 AS b FROM trial", 6),
    "ensemble_entries": ("results", "", "SELECT model AS member, avg(qini_score) / sum(avg(qini_score)) OVER () AS weight FROM results GROUP BY 1", 6),
    "latest_per_identity": ("", "", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1", 6),
    "dominated_models": ("many grid", f"{tie_groups('many')}, {_POLICY}", "SELECT p.m AS model, bool_and(p.value < q.value)::BIGINT AS dominated FROM pol p JOIN pol q ON q.m = 'tied' AND q.budget = p.budget WHERE p.m <> 'tied' AND p.budget BETWEEN 0.05 AND 0.2 GROUP BY 1", 6),
    "random_matching": ("trial", "r AS (SELECT row_id, row_number() OVER (ORDER BY ('0x' || substr(md5(row_id || ':0:9'), 1, 8))::BIGINT, row_id) AS rn, count(*) OVER () AS n FROM trial)", "SELECT a.row_id AS left_id, b.row_id AS right_id FROM r a JOIN r b ON b.rn = a.rn + floor(a.n / 2) WHERE a.rn <= floor(a.n / 2)", 6),
}


#: Columns of each result that are doubles, and so are rounded.
DOUBLES: dict[str, str] = {
    "contract_check": "",
    "ate_risk_ratio": "treated_rate control_rate effect se log_rr se_log_rr ci_low ci_high risk_ratio rr_low rr_high",
    "ate_sample_variance": "effect se ci_low ci_high",
    "arm_outcomes": "rate",
    "arm_summary_wide": "mean_conversion mean_visit mean_exposure",
    "feature_profile": "mode mode_share top3_share mean std min max q25 q50 q75 skew kurtosis",
    "smd_ks_balance": "mean1 mean0 smd ks",
    "sentinel_agreement": "agreement",
    "sentinel_patterns": "share",
    "duplicate_profile": "duplicate_share repeated_share mean_size",
    "overlap_bins": "",
    "leakage_report": "rate1 rate0 smd outcome_if_positive outcome_if_zero",
    "effect_by_bin": "treated_rate control_rate effect se log_rr se_log_rr ci_low ci_high risk_ratio rr_low rr_high",
    "effect_by_feature_bin": "treated_rate control_rate effect se log_rr se_log_rr ci_low ci_high risk_ratio rr_low rr_high",
    "cochran_q": "pooled pooled_se q i2",
    "prognostic_dominance": "pearson spearman median_ratio iqr_ratio q_additive q_multiplicative",
    "representativity": "mean_full mean_sample smd",
    "power_table": "fraction target_effect mde",
    "stratified_sample": "",
    "stratified_complement": "",
    "holdout_split": "",
    "folds": "",
    "undersample": "",
    "split_roles": "",
    "effect_signals": "transformed adjusted ipw dr",
    "probability_maps": "sampled restored logit back",
    "top_budget_policy": "",
    "cost_aware_policy": "",
    "policy_value": "policy_value target_share",
    "policy_sensitivity_grid": "budget cost gross target_share net break_even_cost",
    "top_tail_support": "budget",
    "top_tail_overlap": "budget overlap jaccard",
    "ordering_condition": "budget theta_max beta_max",
    "percentile_grid": "value quantile",
    "batch_target": "percentile",
    "simulate_scenario": "budget gross_per_customer net_per_customer net_total net_low net_high break_even_cost",
    "qini_curve": "x y",
    "uplift_curve": "x y",
    "qini_score": "qini_score",
    "auuc_score": "auuc_score",
    "toc_curve": "q toc share",
    "rate_scores": "autoc rate_qini",
    "policy_value_curve": "budget value",
    "policy_area": "policy_area",
    "expected_random": "budget value",
    "random_topk_sensitivity": "budget mean min max",
    "euce": "euce",
    "decile_policy": "uplift ci_low ci_high cumulative_uplift incremental",
    "transformed_outcome_mse": "mse",
    "score_diagnostics": "mean std min max negative_share near_zero_share p01 p50 p99",
    "score_histogram": "left density",
    "spearman_matrix": "pearson spearman",
    "rank_average": "rank_average",
    "propensity_rank_auc": "auc",
    "bootstrap_policy_value": "value",
    "bootstrap_policy_area": "policy_area",
    "bootstrap_rate": "autoc rate_qini",
    "bootstrap_qini": "qini_score",
    "bootstrap_qini_interval": "mean ci_low ci_high",
    "paired_difference": "mean ci_low ci_high share_positive two_sided",
    "pairwise_comparison": "mean ci_low ci_high share_positive two_sided",
    "simultaneous_band": "budget observed se critical low high",
    "cell_mean_nuisance": "mu0 mu1",
    "cell_mean_t_learner": "score",
    "funnel_cell_mean": "p0 p1 score",
    "pattern_r_shrinkage": "residual",
    "dr_risk": "risk weight",
    "best_single": "risk weight",
    "gram_matrix": "value",
    "seed_summary": "median mean std min max median_delta mean_delta total_seconds",
    "select_winners": "",
    "advancement_table": "min_delta mean_delta",
    "stability_labels": "",
    "promotion_rule": "",
    "registry_upsert": "fold_seed qini_score",
    "merge_scores": "a b",
    "ensemble_entries": "weight",
    "latest_per_identity": "o_totalprice",
    "dominated_models": "",
    "random_matching": "",
}


def _ordered(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        _ordered(PARTS[n][0], seen)
        if n not in seen:
            seen.append(n)
    return seen


def statement(name: str) -> str:
    parts, own, select, digits = STATEMENTS[name]
    with_ = [f"{n} AS ({PARTS[n][1]})" for n in _ordered(parts.split(), [])] + ([own] if own else [])
    inner = ("WITH " + ",\n".join(with_) + "\n" if with_ else "") + select
    doubles = DOUBLES[name].split()
    replaced = f" REPLACE ({', '.join(f'round({c}::DOUBLE, {digits}) + 0.0 AS {c}' for c in (quoted(d) for d in doubles))})" if doubles else ""
    return f"SELECT *{replaced} FROM ({inner}) AS result"


def quoted(column: str) -> str:
    return f'"{column}"'


ORACLES: dict[str, str] = {name: statement(name) for name in STATEMENTS}
