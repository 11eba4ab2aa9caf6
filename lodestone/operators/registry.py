"""Run registry and decisions: upserts, schema migration, merges, advancement, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _seed_key(c: str = "fold_seed") -> Column:
    """101 and 101.0 are one key, null is one too."""
    return F.coalesce(F.expr(f"cast(cast(cast({c} as double) as bigint) as string)"), F.lit("<none>"))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*keys).orderBy(*[c.desc() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(existing: DataFrame, incoming: DataFrame, position: str = "position") -> DataFrame:
    """Incoming rows replace those of the same run, fold seed and outcome; of incoming equals the last position stays."""
    keys = ["run_id", "_seed", "_outcome"]
    keyed = lambda d: d.withColumns({"_seed": _seed_key(), "_outcome": F.coalesce("outcome", F.lit("<none>"))})
    new = latest(keyed(incoming), keys, [F.col(position)])
    return keyed(existing).join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True).drop("_seed", "_outcome")


def migrate(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with all columns of ``schema`` first, missing ones with their default, and others after them."""
    defaults = defaults or {}
    own = [F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.fields]
    return df.select(*own, *[c for c in df.columns if c not in schema.names])


def status_counts(registry: DataFrame, column: str = "status") -> DataFrame:
    """(status, n) of a registry's rows; rows without a status are counted under ``unknown``."""
    return registry.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("status")).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def merge_scores(runs: list[DataFrame], core: list[str], row_id: str = "row_id") -> DataFrame:
    """Score columns of several runs on one key; runs must hold the same rows and core columns, and no score twice."""
    out = runs[0]
    for run in runs[1:]:
        scores = [c for c in run.columns if c not in (row_id, *core)]
        if twice := set(scores) & set(out.columns):
            raise ValueError(f"scores stand in two runs: {sorted(twice)}")
        right = run.select(row_id, *[F.col(c).alias(f"_{c}") for c in core], *scores)
        both = out.join(right, row_id, "full_outer")
        same = F.lit(True)
        for c in core:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        facts = both.agg(F.count("*").alias("n"), F.count_if(~same).alias("bad")).first()
        if facts["bad"]:
            raise ValueError(f"{facts['bad']} of {facts['n']} rows differ")
        out = both.drop(*[f"_{c}" for c in core])
    return out


def seed_summary(results: DataFrame, baseline: DataFrame) -> DataFrame:
    """Candidates over validation seeds: means, medians, spread and wins against the baseline of the same seed."""
    d = results.join(baseline.select("model", "validation_seed", F.col("qini_score").alias("_b")), ["model", "validation_seed"], "left")
    delta = F.col("qini_score") - F.col("_b")
    return d.groupBy("model", "candidate").agg(
        F.count_distinct("validation_seed").alias("n_seeds"), F.median("qini_score").alias("median"), F.avg("qini_score").alias("mean"), F.stddev_samp("qini_score").alias("std"), F.min("qini_score").alias("min"), F.max("qini_score").alias("max"),
        F.median(delta).alias("median_delta"), F.avg(delta).alias("mean_delta"), F.count_if(delta > 0).alias("wins"), F.sum("fit_seconds").alias("total_seconds"),
    )


def select_winners(summary: DataFrame, least_delta: float, least_wins: int, fallback: str = "baseline") -> DataFrame:
    """The best candidate of each model that clears both limits, else the fallback."""
    fine = (F.col("median_delta") >= least_delta) & (F.col("wins") >= least_wins)
    w = Window.partitionBy("model").orderBy(F.desc("_fine"), F.desc("median"), "candidate")
    d = summary.withColumn("_fine", F.coalesce(fine, F.lit(False)).cast("int")).withColumn("_rn", F.row_number().over(w)).where("_rn = 1")
    return d.select("model", F.when(F.col("_fine") == 1, F.col("candidate")).otherwise(F.lit(fallback)).alias("winner"))


def advancement(ranking: DataFrame, reference: str, seeds: list[int], metric: str = "qini_score", strict: bool = True) -> DataFrame:
    """Challengers against the reference on each registered fold seed: advance on a win at every one (strict), or on average."""
    ranking = ranking.where(F.col("fold_seed").isin(seeds))
    ref = ranking.where(F.col("model") == reference).select("fold_seed", F.col(metric).alias("_r"))
    d = ranking.where(F.col("model") != reference).join(ref, "fold_seed").withColumn("delta", F.col(metric) - F.col("_r"))
    o = d.groupBy("model").agg(F.min("delta").alias("min_delta"), F.avg("delta").alias("mean_delta"), F.bool_and(F.col("delta") > 0).alias("_all"), F.count_distinct("fold_seed").alias("n_seeds"))
    complete = F.col("n_seeds") == len(set(seeds))
    won = F.col("_all") if strict else F.col("mean_delta") > 0
    reason = F.when(~complete, "missing_fold_seed").when(won, "advance").when(F.col("mean_delta") > 0, "mean_only").otherwise("no_gain")
    return o.select("model", "n_seeds", "min_delta", "mean_delta", (complete & won).cast("int").alias("advance"), reason.alias("reason"))


def stability(deltas: DataFrame, by: list[str]) -> DataFrame:
    d = deltas.groupBy(*by).agg(F.bool_and(F.col("delta") > 0).alias("_w"), F.bool_and(F.col("delta") <= 0).alias("_l"))
    return d.select(*by, F.when(F.col("_w"), "wins_all").when(F.col("_l"), "loses_all").otherwise("unstable").alias("label"))


def promotion(candidates: DataFrame, incumbent: str) -> DataFrame:
    """(champion): the first candidate in order for which all conditions hold, else the incumbent."""
    fine = F.col("policy_area_gain") & F.col("interval_above_zero") & F.col("autoc_not_worse") & F.col("guardrail")
    return candidates.agg(F.coalesce(F.min_by(F.when(fine, F.col("model")), F.when(fine, F.col("position"))), F.lit(incumbent)).alias("champion"))


def ensemble_entries(entries: DataFrame) -> DataFrame:
    """Mean weight of each member over seeds, renormalised; seeds must have the same members."""
    n = entries.agg(F.count_distinct("fold_seed").alias("_n"))
    d = entries.groupBy("member").agg(F.sum("weight").alias("_w"), F.count_distinct("fold_seed").alias("_k")).join(n)
    d = d.withColumn("_w", F.when(F.col("_k") == F.col("_n"), F.col("_w") / F.col("_n")).otherwise(F.raise_error("seeds differ in members").cast("double")))
    return d.join(d.agg(F.sum("_w").alias("_s"))).select("member", (F.col("_w") / F.col("_s")).alias("weight"))


def conflicting_configs(configs: DataFrame) -> DataFrame:
    """Names that stand with more than one hash."""
    return configs.groupBy("name").agg(F.count_distinct("hash").alias("n_hashes")).where("n_hashes > 1")


def shortlist(ranking: DataFrame, references: list[str], n: int, metric: str = "mean_metric") -> DataFrame:
    """References and the first n eligible challengers by the metric."""
    top = ranking.where(F.col("eligible") & ~F.col("model").isin(references)).orderBy(F.desc(metric), "model").limit(n)
    return ranking.where(F.col("model").isin(references)).unionByName(top)


def dominated(curves: DataFrame, reference: str, lo: float = 0.05, hi: float = 0.2) -> DataFrame:
    """Models below the reference at every budget in [lo, hi]."""
    c = curves.where(F.col("budget").between(lo, hi))
    ref = c.where(F.col("model") == reference).select("budget", F.col("value").alias("_r"))
    d = c.where(F.col("model") != reference).join(F.broadcast(ref), "budget")  # a row a budget
    return d.groupBy("model").agg(F.bool_and(F.col("value") < F.col("_r")).cast("int").alias("dominated"))
