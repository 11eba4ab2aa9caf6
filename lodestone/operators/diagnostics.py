"""Data checks and design diagnostics of a randomised experiment table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.signals import pattern_id, render_pattern
from lodestone.functions.stats import z
from lodestone.operators.order_statistics import quantiles
from lodestone.operators.ranking import running_sums

Z95 = z(0.975)


def unpivot(df: DataFrame, keep: list[str], columns: list[str], name: str = "feature", value: str = "value") -> DataFrame:
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keep, columns, name, value)


def contract_check(df: DataFrame, features: list[str], binaries: list[str]) -> DataFrame:
    """One row: counts of rows, missing and extra columns, nulls, values that are not binary or not finite; valid."""
    known = set(features) | set(binaries) | {"row_id"}
    missing, extra = sorted(known - set(df.columns)), sorted(set(df.columns) - known)
    count = lambda c: F.count_if(c) if isinstance(c, Column) else F.lit(0)
    total = lambda cs: reduce(lambda a, b: a + b, cs, F.lit(0).cast("bigint"))
    here = [c for c in [*features, *binaries] if c in df.columns]
    f = [F.col(c).cast("double") for c in features if c in df.columns]
    out = df.agg(
        F.count("*").alias("n_rows"), total([count(F.col(c).isNull()) for c in here]).alias("n_null"),
        total([count(~F.col(c).isin(0, 1)) for c in binaries if c in df.columns]).alias("n_not_binary"), total([count(F.isnan(c) | (F.abs(c) == float("inf"))) for c in f]).alias("n_not_finite"),
    )
    fine = (F.col("n_null") + F.col("n_not_binary") + F.col("n_not_finite") == 0) & F.lit(not missing and not extra)
    return out.select(F.lit(len(missing)).alias("n_missing_columns"), F.lit(len(extra)).alias("n_extra_columns"), "*", fine.cast("int").alias("valid"))


def arm_outcomes(df: DataFrame, outcomes: list[str], treatment: str = "treatment") -> DataFrame:
    long = unpivot(df, [treatment], outcomes, "outcome", "y")
    return long.groupBy(treatment, "outcome").agg(F.count("*").alias("n"), F.sum("y").cast("bigint").alias("events"), F.avg("y").alias("rate"))


def arm_summary(df: DataFrame, outcomes: list[str], treatment: str = "treatment") -> DataFrame:
    return df.groupBy(treatment).agg(F.count("*").alias("n"), *[x for o in outcomes for x in (F.avg(o).alias(f"mean_{o}"), F.sum(o).cast("bigint").alias(f"sum_{o}"))])


def effect_columns(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """From n1, n0, y1, y0: rates, difference with a binomial interval, risk ratio with an interval on its logarithm."""
    q = z(1 - alpha / 2)
    c = {k: F.col(k).cast("double") for k in ("n1", "n0", "y1", "y0")}
    r1, r0 = F.try_divide(c["y1"], c["n1"]), F.try_divide(c["y0"], c["n0"])
    se = F.sqrt(F.try_divide(r1 * (1 - r1), c["n1"]) + F.try_divide(r0 * (1 - r0), c["n0"]))
    some = (c["y1"] > 0) & (c["y0"] > 0)
    log_rr = F.when(some, F.log(F.try_divide(r1, r0)))
    se_log = F.when(some, F.sqrt(F.try_divide(F.lit(1.0), c["y1"]) - F.try_divide(F.lit(1.0), c["n1"]) + F.try_divide(F.lit(1.0), c["y0"]) - F.try_divide(F.lit(1.0), c["n0"])))
    return df.withColumns({"treated_rate": r1, "control_rate": r0}).withColumns({"effect": r1 - r0, "se": se, "log_rr": log_rr, "se_log_rr": se_log}).withColumns(
        {"ci_low": F.col("effect") - q * F.col("se"), "ci_high": F.col("effect") + q * F.col("se"), "risk_ratio": F.exp("log_rr"), "rr_low": F.exp(F.col("log_rr") - q * F.col("se_log_rr")), "rr_high": F.exp(F.col("log_rr") + q * F.col("se_log_rr"))}
    )


def arm_counts(df: DataFrame, outcome: str, by: list[str] | None = None, treatment: str = "treatment") -> DataFrame:
    t, y = F.col(treatment), F.col(outcome)
    cells = [F.sum(t).alias("n1"), F.sum(1 - t).alias("n0"), F.sum(t * y).alias("y1"), F.sum((1 - t) * y).alias("y0")]
    return df.groupBy(*by).agg(*cells) if by else df.agg(*cells)


def ate(df: DataFrame, outcome: str, alpha: float = 0.05) -> DataFrame:
    """Difference in means and risk ratio of an outcome, one row."""
    return effect_columns(arm_counts(df, outcome), alpha)


def ate_sample_variance(df: DataFrame, outcome: str, treatment: str = "treatment") -> DataFrame:
    """Difference in means with a standard error from sample variances, and the 1.96 interval."""
    y1, y0 = F.when(F.col(treatment) == 1, F.col(outcome)), F.when(F.col(treatment) == 0, F.col(outcome))
    d = df.agg(F.avg(y1).alias("m1"), F.avg(y0).alias("m0"), F.var_samp(y1).alias("v1"), F.var_samp(y0).alias("v0"), F.count(y1).alias("n1"), F.count(y0).alias("n0"))
    se = F.sqrt(F.try_divide("v1", "n1") + F.try_divide("v0", "n0"))
    effect = F.col("m1") - F.col("m0")
    return d.select(effect.alias("effect"), se.alias("se"), (effect - 1.96 * se).alias("ci_low"), (effect + 1.96 * se).alias("ci_high"))


def quantile_edges(long: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """Distinct quantile cuts of value for each group (duplicates merged)."""
    q = quantiles(long, "value", [i / bins for i in range(bins + 1)], by)
    return q.select(*by, F.array_distinct("q").alias("edges"))


def quantile_bins(long: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """``long`` with bin: right-closed quantile bins, the lowest value in the first; null where there is one edge."""
    edges = quantile_edges(long, bins, by)
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    at = F.size(F.filter(inner, lambda e: e < F.col("value")))
    return long.join(edges, by, "left").withColumn("bin", F.when(F.size("edges") > 1, at)).drop("edges")


def feature_profile(df: DataFrame, features: list[str], bins: int = 10) -> DataFrame:
    """A row for each feature: nulls, distinct values, mode and top-3 share, moments (bias-corrected), quartiles, bins."""
    long = unpivot(df, [], features)
    counts = long.where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("c"))
    # the first three of each of 64 parts of a feature's values, then of those
    part, rank = (Window.partitionBy("feature", *own).orderBy(F.desc("c"), "value") for own in ([F.pmod(F.xxhash64("value"), F.lit(64))], []))
    top = counts.withColumn("r", F.row_number().over(part)).where("r <= 3").withColumn("r", F.row_number().over(rank)).where("r <= 3").groupBy("feature").agg(F.max(F.when(F.col("r") == 1, F.col("value"))).alias("mode"), F.max("c").alias("mode_n"), F.sum("c").alias("top3_n"))
    distinct = counts.groupBy("feature").agg(F.count("*").alias("n_distinct"))
    n = F.col("n").cast("double")
    base = long.groupBy("feature").agg(
        F.count("value").alias("n"), F.count_if(F.col("value").isNull()).alias("n_null"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.skewness("value").alias("g1"), F.kurtosis("value").alias("g2"),
    )
    q = quantiles(long, "value", [0.25, 0.5, 0.75, *[i / bins for i in range(bins + 1)]], ["feature"])
    q = q.select("feature", F.slice("q", 1, 3).alias("q"), F.size(F.array_distinct(F.slice("q", 4, bins + 1))).alias("edges"))
    base = base.join(q, "feature", "left")
    skew = F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3))
    return base.join(top, "feature").join(distinct, "feature").select(
        "feature", "n", "n_null", "n_distinct", "mode", (F.col("mode_n") / n).alias("mode_share"), (F.col("top3_n") / n).alias("top3_share"), "mean", "std", "min", "max",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), skew.alias("skew"), kurt.alias("kurtosis"), (F.col("edges") - 1).cast("bigint").alias("n_bins"),
    )


def balance(df: DataFrame, features: list[str], treatment: str = "treatment") -> DataFrame:
    """Standardised mean difference and Kolmogorov-Smirnov distance of each feature between the arms."""
    long = unpivot(df, [treatment], features)
    v1, v0 = F.when(F.col(treatment) == 1, F.col("value")), F.when(F.col(treatment) == 0, F.col("value"))
    m = long.groupBy("feature").agg(F.avg(v1).alias("mean1"), F.avg(v0).alias("mean0"), F.var_samp(v1).alias("s1"), F.var_samp(v0).alias("s0"), F.count(v1).alias("n1"), F.count(v0).alias("n0"))
    pooled, diff = F.sqrt((F.col("s1") + F.col("s0")) / 2), F.col("mean1") - F.col("mean0")
    smd = F.when(pooled > 0, F.try_divide(diff, pooled)).when(diff == 0, 0.0).otherwise(F.signum(diff) * float("inf"))
    groups = long.groupBy("feature", "value").agg(F.count(v1).alias("c1"), F.count(v0).alias("c0"))
    cum = running_sums(groups.where("value is not null"), [F.col("value")], {"k1": "c1", "k0": "c0"}, ["feature"])
    d = cum.select("feature", F.col("k1").alias("c1"), F.col("k0").alias("c0")).join(m.select("feature", "n1", "n0"), "feature")
    d = d.groupBy("feature").agg(F.max(F.abs(F.try_divide("c1", "n1") - F.try_divide("c0", "n0"))).alias("ks"))
    return m.join(d, "feature").select("feature", "mean1", "mean0", smd.alias("smd"), "ks", "n1", "n0")


def sentinel_flags(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns is_<feature>: the value is the feature's mode (the lowest of equals). Null values have no mode."""
    counts = unpivot(df, [], features).where("value is not null").groupBy("feature", "value").agg(F.count("*").alias("c"))
    top = counts.groupBy("feature").agg(F.max_by("value", F.struct("c", -F.col("value"))).alias("mode"))
    modes = {r["feature"]: r["mode"] for r in top.collect()}  # a row a feature
    flags = {f"is_{f}": F.coalesce(F.col(f).cast("double") == F.lit(modes.get(f)), F.lit(False)).cast("int") for f in features}
    return df.withColumns(flags), list(flags)


def sentinel_agreement(df: DataFrame, features: list[str]) -> DataFrame:
    """Share of rows on which each pair of flags agrees."""
    d, flags = sentinel_flags(df, features)
    pairs = [(a, b) for i, a in enumerate(flags) for b in flags[i + 1 :]]
    one = d.agg(*[F.avg((F.col(a) == F.col(b)).cast("int")).alias(f"{a[3:]}~{b[3:]}") for a, b in pairs])
    long = one.unpivot([], one.columns, "pair", "agreement")
    return long.select(F.split("pair", "~")[0].alias("a"), F.split("pair", "~")[1].alias("b"), "agreement")


def sentinel_patterns(df: DataFrame, features: list[str], top: int = 20) -> DataFrame:
    """The most frequent patterns of flags."""
    d, flags = sentinel_flags(df, features)
    p = d.groupBy(pattern_id([F.col(f) for f in flags]).alias("key")).agg(F.count("*").alias("n"))
    share = F.col("n") / d.count()
    out = p.orderBy(F.desc("n"), "key").limit(top)
    return out.select("key", render_pattern("key", len(flags)).alias("pattern"), "n", share.alias("share"))


def duplicate_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    g = df.groupBy(*columns).agg(F.count("*").alias("c"))
    o = g.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_distinct"), F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)).alias("rows_in_repeated"), F.max("c").alias("max_size"), F.avg("c").alias("mean_size"))
    return o.select("n_rows", "n_distinct", (F.col("n_rows") - F.col("n_distinct")).alias("n_duplicates"), (1 - F.try_divide("n_distinct", "n_rows")).alias("duplicate_share"), "rows_in_repeated", F.try_divide("rows_in_repeated", "n_rows").alias("repeated_share"), "max_size", "mean_size")


def overlap_bins(df: DataFrame, score: str, bins: int = 20, treatment: str = "treatment") -> DataFrame:
    """Arms in equal-width bins of a score, empty ones too; a constant score is in the last bin."""
    lo, hi = df.agg(F.min(score), F.max(score)).first()
    edges = [lo + (hi - lo) * i / bins for i in range(1, bins)]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= F.col(score)))
    counts = df.groupBy(at.alias("bin")).agg(F.sum(treatment).alias("n1"), F.sum(1 - F.col(treatment)).alias("n0"))
    all_bins = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    out = all_bins.join(counts, "bin", "left").select("bin", F.coalesce("n1", F.lit(0)).cast("bigint").alias("n1"), F.coalesce("n0", F.lit(0)).cast("bigint").alias("n0"))
    return out.withColumn("single_arm", ((F.col("n1") == 0) != (F.col("n0") == 0)).cast("int"))


def leakage_report(df: DataFrame, columns: list[str], outcome: str, treatment: str = "treatment") -> DataFrame:
    """Signs that a binary column is decided after treatment."""
    long = unpivot(df, [treatment, outcome], columns)
    t, y, v = F.col(treatment), F.col(outcome), F.col("value")
    when = lambda c, x: F.avg(F.when(c, x))
    o = long.groupBy("feature").agg(when(t == 1, v).alias("rate1"), when(t == 0, v).alias("rate0"), F.var_samp(F.when(t == 1, v)).alias("s1"), F.var_samp(F.when(t == 0, v)).alias("s0"), when(v > 0, y).alias("outcome_if_positive"), when(v == 0, y).alias("outcome_if_zero"))
    smd = F.try_divide(F.col("rate1") - F.col("rate0"), F.sqrt((F.col("s1") + F.col("s0")) / 2))
    return o.select(
        "feature", "rate1", "rate0", smd.alias("smd"), "outcome_if_positive", "outcome_if_zero",
        ((F.col("rate0") == 0) & (F.col("rate1") > 0)).cast("int").alias("treatment_only"), F.coalesce((F.col("outcome_if_zero") == 0) & (F.col("outcome_if_positive") > 0), F.lit(False)).cast("int").alias("necessary_for_outcome"),
    )


def effect_by_bin(long: DataFrame, outcome: str, by: list[str], least_events: int = 1) -> DataFrame:
    """Effects in strata (``by``); strata that lack an arm or have too few events in one are left out."""
    counts = arm_counts(long.where(" and ".join(f"{c} is not null" for c in by)), outcome, by)
    counts = counts.where((F.col("n1") > 0) & (F.col("n0") > 0) & (F.least("y1", "y0") >= least_events))
    return effect_columns(counts)


def effect_by_feature_bin(df: DataFrame, features: list[str], outcome: str, bins: int = 5) -> DataFrame:
    long = quantile_bins(unpivot(df, ["treatment", outcome], features), bins, ["feature"])
    return effect_by_bin(long, outcome, ["feature", "bin"])


def cochran_q(strata: DataFrame, estimate: str, se: str, by: list[str] | None = None) -> DataFrame:
    """Pooled estimate, Q, degrees of freedom and I2 of strata."""
    w = 1 / F.pow(F.col(se), 2)
    d = strata.where(F.col(se) > 0).groupBy(*(by or [])).agg(F.sum(w).alias("w"), F.sum(w * F.col(estimate)).alias("we"), F.sum(w * F.pow(F.col(estimate), 2)).alias("wee"), F.count("*").alias("k"))
    pooled = F.col("we") / F.col("w")
    q = F.greatest(F.col("wee") - F.col("we") * pooled, F.lit(0.0))
    df_ = F.col("k") - 1
    return d.select(*(by or []), pooled.alias("pooled"), F.sqrt(1 / F.col("w")).alias("pooled_se"), q.alias("q"), df_.alias("df"), F.when(q > df_, (q - df_) / q).otherwise(0.0).alias("i2"))


def average_ranks(df: DataFrame, column: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Ranks from 1, ties averaged, by way of the counts of distinct values."""
    groups = df.groupBy(*(by or []), column).agg(F.count("*").alias("_c"))
    cum = running_sums(groups, [F.col(column)], {"_upto": "_c"}, by)
    return df.join(cum.select(*(by or []), column, (F.col("_upto") - (F.col("_c") - 1) / 2).alias(out)), [*(by or []), column])


def prognostic_dominance(strata: DataFrame) -> DataFrame:
    """How effects go with baseline rates over strata: correlations, effect over baseline, both Q."""
    s = average_ranks(average_ranks(strata, "control_rate", "_rb"), "effect", "_re")
    ratio = F.try_divide("effect", "control_rate")
    one = s.agg(F.corr("control_rate", "effect").alias("pearson"), F.corr("_rb", "_re").alias("spearman"), F.percentile(ratio, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count("*").alias("n_strata"))
    add = cochran_q(strata, "effect", "se").select(F.col("q").alias("q_additive"))
    mul = cochran_q(strata.where("log_rr is not null"), "log_rr", "se_log_rr").select(F.col("q").alias("q_multiplicative"))
    return one.join(add).join(mul).select("n_strata", "pearson", "spearman", F.col("q")[1].alias("median_ratio"), (F.col("q")[2] - F.col("q")[0]).alias("iqr_ratio"), "q_additive", "q_multiplicative")


def representativity(full: DataFrame, sample: DataFrame, features: list[str]) -> DataFrame:
    stats = lambda d, k: unpivot(d, [], features).groupBy("feature").agg(F.avg("value").alias(f"mean_{k}"), F.var_samp("value").alias(f"var_{k}"))
    d = stats(full, "full").join(stats(sample, "sample"), "feature")
    return d.select("feature", "mean_full", "mean_sample", F.try_divide(F.col("mean_sample") - F.col("mean_full"), F.sqrt((F.col("var_full") + F.col("var_sample")) / 2)).alias("smd"))


def power_table(df: DataFrame, outcome: str, alpha: float = 0.05, power: float = 0.8) -> DataFrame:
    """Detectable effect at this size, and rows needed for the effect and its half, tenth and hundredth."""
    k = z(1 - alpha / 2) + z(power)
    d = arm_counts(df, outcome)
    n = F.col("n1") + F.col("n0")
    base, share = F.col("y0") / F.col("n0"), F.col("n1") / n
    se = F.sqrt(base * (1 - base) * (1 / F.col("n1") + 1 / F.col("n0")))
    effect = F.col("y1") / F.col("n1") - base
    parts = F.explode(F.array(*[F.lit(x) for x in (1.0, 0.5, 0.1, 0.01)]))
    d = d.select(effect.alias("e"), (k * se).alias("mde"), base.alias("b"), share.alias("s"), parts.alias("fraction"))
    target = F.abs(F.col("e") * F.col("fraction"))
    need = F.ceil(F.try_divide(F.lit(k * k) * F.col("b") * (1 - F.col("b")) * (1 / F.col("s") + 1 / (1 - F.col("s"))), F.pow(target, 2)))
    return d.select("fraction", target.alias("target_effect"), "mde", need.alias("required_n"))
