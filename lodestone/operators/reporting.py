"""Result tables: metric rows, tests, comparisons of policies and runs, and the tables that a service shows."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.order_statistics import quantiles
from lodestone.functions.signals import transformed_outcome
from lodestone.functions.stats import chi2_sf, student_p
from lodestone.operators import curves as C
from lodestone.session import ship_package


def metric_rows(scored: DataFrame, signal: str, budgets: list[float], effect_scale: list[str], propensity: float) -> DataFrame:
    """A row a model of long scores: all metrics; those that need a score on the effect scale are null for other models."""
    by = ["model"]
    own = scored.where(F.col("model").isin(effect_scale))
    error = F.pow(transformed_outcome("outcome", "treatment", propensity) - F.col("score"), 2)
    mse = own.groupBy(*by).agg(F.avg(error).alias("mse"))
    tables = [C.normalised_area(scored, "qini", by), C.normalised_area(scored, "uplift", by), C.rate(scored, signal, by), C.policy_area(C.policy_curve(scored, signal, budgets, by), by)]
    out = reduce(lambda a, b: a.join(b, by), tables)
    for m in effect_scale:
        part = C.euce(own.where(F.col("model") == m)).select(F.lit(m).alias("model"), "euce")
        mse = mse.join(part, by, "left") if m == effect_scale[0] else mse.join(part.withColumnRenamed("euce", "_e"), by, "left").withColumn("euce", F.coalesce("euce", "_e")).drop("_e")
    return out.join(mse, by, "left")


def ks_p(distance: Column, n1: Column, n0: Column) -> Column:
    """Asymptotic p of a two-sample Kolmogorov-Smirnov distance."""
    x = distance * F.sqrt(n1 * n0 / (n1 + n0))
    terms = F.transform(F.sequence(F.lit(1), F.lit(100)), lambda k: F.pow(F.lit(-1.0), k - 1) * F.exp(-2 * k * k * x * x))
    total = 2 * F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)
    return F.when(x < 0.2, 1.0).otherwise(F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))


def _with_p(df: DataFrame, columns: dict[str, tuple]) -> DataFrame:
    """A summary with p-values: name -> (function, column, column)."""
    ship_package(df.sparkSession)

    def rows(it):
        for batch in it:
            new = [pa.array([f(x, y) if x is not None and y is not None else None for x, y in zip(batch.column(a).to_pylist(), batch.column(b).to_pylist(), strict=True)], pa.float64()) for f, a, b in columns.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *columns])

    return df.mapInArrow(rows, ", ".join([f"`{c}` {t}" for c, t in df.dtypes] + [f"`{c}` double" for c in columns]))


def cochran_test(pooled: DataFrame) -> DataFrame:
    """``cochran_q`` with the chi-square p of Q."""
    return _with_p(pooled, {"p": (chi2_sf, "q", "df")})


def dominance_test(summary: DataFrame) -> DataFrame:
    """``prognostic_dominance`` with two-sided p-values of both correlations."""
    return _with_p(summary, {"pearson_p": (student_p, "pearson", "n_strata"), "spearman_p": (student_p, "spearman", "n_strata")})


def keep_rates(full: DataFrame, sample: DataFrame, outcome: str = "conversion") -> DataFrame:
    """(treatment, base_rate, keep_rate): an arm's event rate, and the share of its rows without event that a sample kept."""
    negatives = lambda d: d.groupBy("treatment").agg(F.count_if(F.col(outcome) == 0).alias("k"))
    base = full.groupBy("treatment").agg(F.avg(outcome).alias("base_rate"), F.count_if(F.col(outcome) == 0).alias("n"))
    return base.join(negatives(sample), "treatment", "left").select("treatment", "base_rate", F.coalesce(F.try_divide("k", "n"), F.lit(0.0)).alias("keep_rate"))


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join whose right side must hold each key once; a key that repeats raises."""
    checked = right.withColumn("_n", F.count("*").over(Window.partitionBy(*on)))
    fine = F.when(F.col("_n") > 1, F.raise_error("the right side of a many-to-one join repeats a key").cast("int")).otherwise(1)
    return left.join(checked.withColumn("_n", fine).where("_n = 1").drop("_n"), on, how)


def against_reference(curve: DataFrame, reference: str, on: list[str], value: str) -> DataFrame:
    """Rows of other models with the reference's value on the same keys and the difference."""
    ref = curve.where(F.col("model") == reference).select(*on, F.col(value).alias("reference_value"))
    d = many_to_one(curve.where(F.col("model") != reference), ref, on)
    return d.withColumn("delta", F.col(value) - F.col("reference_value"))


def fill_from(df: DataFrame, source: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``df`` with nulls of some columns filled from a table with the same keys."""
    found = source.select(*keys, *[F.col(c).alias(f"_{c}") for c in columns])
    return many_to_one(df, found, keys, "left").withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def hypothesis_outcomes(curve: DataFrame, reference: str, low: float = 0.1) -> DataFrame:
    """Each candidate's wins against the reference: at all budgets, at low ones, and whether it wins at every low one."""
    d = against_reference(curve, reference, ["budget"], "value")
    o = d.groupBy("model").agg(F.count("*").alias("n_budgets"), F.count_if(F.col("delta") > 0).alias("wins"), F.count_if((F.col("delta") > 0) & (F.col("budget") <= low)).alias("low_wins"), F.count_if(F.col("budget") <= low).alias("n_low"))
    return o.withColumn("supported", ((F.col("low_wins") == F.col("n_low")) & (F.col("n_low") > 0)).cast("int"))


def early_stop(scored: DataFrame, curve: DataFrame, reference: str, least_distinct: int, lo: float = 0.05, hi: float = 0.2) -> DataFrame:
    """(model, reason): not_finite, too_few_values, dominated at every budget in [lo, hi], or null to go on."""
    s = F.col("score").cast("double")
    bad = F.count_if(s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))
    facts = scored.groupBy("model").agg(bad.alias("bad"), F.count_distinct("score").alias("values"))
    d = against_reference(curve.where(F.col("budget").between(lo, hi)), reference, ["budget"], "value")
    facts = facts.join(d.groupBy("model").agg(F.bool_and(F.col("delta") < 0).alias("below")), "model", "left")
    reason = F.when(F.col("bad") > 0, "not_finite").when(F.col("values") < least_distinct, "too_few_values").when(F.col("below"), "dominated")
    return facts.select("model", reason.alias("reason"))


def sign_segments(df: DataFrame, score: str, outcome: str, near: float = 1e-4) -> DataFrame:
    """Rows, events and mean score of positive, negative and near-zero scores."""
    s = F.col(score)
    segment = F.when(s > near, "positive").when(s < -near, "negative").otherwise("near_zero")
    return df.groupBy(segment.alias("segment")).agg(F.count("*").alias("n"), F.avg(outcome).alias("rate"), F.avg(s).alias("mean_score"))


def score_quantiles(scored: DataFrame, points: list[float]) -> DataFrame:
    """A row a model with its score at each quantile."""
    q = quantiles(scored, "score", points, ["model"])
    return q.select("model", *[F.col("q")[i].alias(f"p{round(p * 1000):03d}") for i, p in enumerate(points)])


def linear_trend(df: DataFrame, x: str, y: str, at: float) -> DataFrame:
    """Least-squares line of y over x, and its value at a point beyond."""
    d = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return d.withColumn("extrapolated", F.col("intercept") + F.col("slope") * F.lit(float(at)))


def sentinel_augmentation(df: DataFrame, features: list[str], most_rows: int = 200_000, least_share: float = 0.05, flags: bool = True) -> DataFrame:
    """``df`` with a flag for each feature whose mode is frequent, and how many flags a row has.

    Modes come from at most ``most_rows`` rows, those of the smallest hashes; a mode under ``least_share`` of them
    makes no flag. Without ``flags`` only the count is added. Of equally frequent values the lowest is the mode.
    """
    sample = df.orderBy(F.xxhash64("row_id"), "row_id").limit(most_rows)
    n = sample.agg(F.count("*").alias("n"))
    long = sample.select(*[F.col(f).cast("double").alias(f) for f in features]).unpivot([], features, "feature", "value").where("value is not null")
    counts = long.groupBy("feature", "value").agg(F.count("*").alias("c"))
    top = counts.groupBy("feature").agg(F.max_by("value", F.struct("c", -F.col("value"))).alias("mode"), F.max("c").alias("c")).join(n)
    modes = {r["feature"]: r["mode"] for r in top.where(F.col("c") >= F.lit(least_share) * F.col("n")).collect()}  # a row a feature
    own = {f"is_{f}": F.coalesce((F.col(f) == F.lit(modes[f])).cast("int"), F.lit(0)) for f in features if f in modes}
    count = reduce(lambda a, b: a + b, own.values(), F.lit(0)).alias("n_sentinels")
    return df.select("*", *([c.alias(k) for k, c in own.items()] if flags else []), count)


def toc_on_grid(scored: DataFrame, signal: str, grid: list[float], weight: str) -> DataFrame:
    """(budget, value): the TOC of weighted rows by straight lines between points, its ends held beyond them."""
    from lodestone.operators.ranking import cumulate, tie_groups

    c = cumulate(tie_groups(scored, signal=signal, weight=F.col(weight)))
    c = c.join(c.agg(F.max(F.struct("N", "G")).alias("_t")))
    points = c.select((F.col("N") / F.col("_t.N")).alias("x"), (F.col("G") / F.col("N") - F.col("_t.G") / F.col("_t.N")).alias("y"))
    return C.interpolate(points, grid, [])


# Contracts of runs


def config_hash(*columns: str) -> Column:
    """Sixteen hexadecimal digits of the SHA-256 of a canonical JSON object: keys sorted, no blanks."""
    return F.left(F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(columns)])), 256), F.lit(16))


def index_hash(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """(n_rows, index_hash): the same for the same set of ids, in whatever order and number of tasks."""
    part = F.conv(F.substring(F.md5(F.col(row_id).cast("string")), 1, 12), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("n_rows"), F.sum(part).cast("string").alias("index_hash"))


def execution_contract(runs: DataFrame, protocol: DataFrame, fields: list[str]) -> DataFrame:
    """(run_id, violations): fields in which a run departs from its stage's protocol, in order; unknown_stage without one."""
    right = protocol.select("stage", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(1).alias("_known"))
    d = many_to_one(runs, right, ["stage"], "left")
    wrong = [F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in sorted(fields)]
    return d.select("run_id", F.when(F.col("_known").isNull(), "unknown_stage").otherwise(F.concat_ws(",", *wrong)).alias("violations"))


def comparable_runs(manifests: DataFrame, reference: str, fields: list[str]) -> DataFrame:
    """(run_id, differing, may_advance): manifest fields that differ from the reference run's; legacy runs never advance."""
    ref = manifests.where(F.col("run_id") == reference).select(*[F.col(f).alias(f"_{f}") for f in fields]).limit(1)
    d = manifests.where(F.col("run_id") != reference).join(ref)
    wrong = F.concat_ws(",", *[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f) for f in sorted(fields)])
    return d.select("run_id", wrong.alias("differing"), ((wrong == "") & (F.col("mode") != "legacy")).cast("int").alias("may_advance"))


# Tables of the service


def latest_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    """The last n rows, the newest first."""
    return df.orderBy(F.desc(position)).limit(n)


def present(df: DataFrame, columns: list[str]) -> DataFrame:
    """Of the columns asked for those that there are."""
    return df.select(*[c for c in columns if c in df.columns])


def clean_json(df: DataFrame) -> DataFrame:
    """Rows as JSON objects (column ``json``) in which NaN and infinities are null and stand as such."""
    fix = lambda c, t: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) if t in ("double", "float") else F.col(c)
    return df.select(F.to_json(F.struct(*[fix(c, t).alias(c) for c, t in df.dtypes]), {"ignoreNullFields": "false"}).alias("json"))


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def model_table(metrics: DataFrame, split: str, metric: str) -> DataFrame:
    """One split's models with their place by a metric; equal metrics share the mean place."""
    d = metrics.where(F.col("split") == split)
    w, same = Window.orderBy(F.desc(metric)), Window.partitionBy(metric)  # a row a model
    return d.withColumn("place", F.rank().over(w) + (F.count("*").over(same) - 1) / 2)


def pairwise_table(sources: dict[str, DataFrame]) -> DataFrame:
    """Comparison tables of several sources, one under the other, with what columns each has."""
    parts = [d.withColumn("source", F.lit(s)) for s, d in sources.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def current_curve(curves: list[DataFrame], renames: dict[str, str]) -> DataFrame:
    """The newest table that has rows, under today's column names."""
    for d in curves:
        if not d.isEmpty():
            return d.withColumnsRenamed({a: b for a, b in renames.items() if a in d.columns and b not in d.columns})
    return curves[-1]


def champion(sources: DataFrame) -> DataFrame:
    """(champion, source): the entry of the first source, by precedence, that names one."""
    return sources.where("champion is not null").agg(F.min_by("champion", "precedence").alias("champion"), F.min_by("source", "precedence").alias("source"))


def health(tables: dict[str, DataFrame], needed: list[str]) -> DataFrame:
    """(artifact, available, degraded): whether each table has rows; degraded if a needed one has none."""
    parts = [d.limit(1).agg(F.count("*").cast("int").alias("available")).select(F.lit(n).alias("artifact"), "available") for n, d in tables.items()]
    d = reduce(DataFrame.unionByName, parts)
    missing = d.agg(F.max(F.when(F.col("artifact").isin(needed), 1 - F.col("available")).otherwise(0)).alias("degraded"))
    return d.join(missing)


def export_table(df: DataFrame, run_id: str, assumptions: str) -> DataFrame:
    """``df`` with the columns that every export carries, where it lacks them."""
    extra = {"run_id": F.lit(run_id), "monetary_outcome_available": F.lit(0), "assumptions_json": F.lit(assumptions)}
    return df.withColumns({k: c for k, c in extra.items() if k not in df.columns})


def bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """(dataset, json) of all rows of several tables."""
    return reduce(DataFrame.unionByName, [clean_json(d).select(F.lit(n).alias("dataset"), "json") for n, d in tables.items()])
