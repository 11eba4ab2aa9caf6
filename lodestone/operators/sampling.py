"""Exact, deterministic sampling, splits, folds and undersampling, by the order of a hash within strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import hash_rank

STRATA = ["treatment", "conversion"]


def _sized(df: DataFrame, fraction: float, seed: int, strata: list[str], floor: int) -> DataFrame:
    """``df`` with its rank in its stratum and the stratum's sample size (half to even, at least ``floor``)."""
    size = df.groupBy(*strata).agg(F.greatest(F.bround(F.count("*") * F.lit(fraction)), F.lit(floor)).cast("bigint").alias("_size"))
    return hash_rank(df, strata, seed).join(size, strata)


def stratified_sample(df: DataFrame, fraction: float, seed: int, strata: list[str] = STRATA) -> DataFrame:
    return _sized(df, fraction, seed, strata, 1).where("rn <= _size").drop("rn", "_size").select(*df.columns)


def stratified_complement(df: DataFrame, fraction: float, seed: int, strata: list[str] = STRATA) -> DataFrame:
    """All rows that ``stratified_sample`` with the same arguments leaves."""
    return _sized(df, fraction, seed, strata, 1).where("rn > _size").drop("rn", "_size").select(*df.columns)


def holdout_split(df: DataFrame, test_share: float, seed: int, strata: list[str] = STRATA, out: str = "split") -> DataFrame:
    """``df`` with split test or train; the test size ceil(n * share) is dealt out by largest remainder."""
    per = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    total = F.ceil(F.sum("_n").over(Window.partitionBy(F.lit(0))) * F.lit(test_share))
    exact = F.col("_n") * F.lit(test_share)
    per = per.select(*strata, "_n", F.floor(exact).alias("_floor"), (exact - F.floor(exact)).alias("_rest"), total.alias("_total"))
    left = F.col("_total") - F.sum("_floor").over(Window.partitionBy(F.lit(0)))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("_rest"), *strata))
    per = per.select(*strata, (F.col("_floor") + (place <= left).cast("bigint")).alias("_size"))  # a row a stratum
    d = hash_rank(df, strata, seed).join(per, strata)
    return d.withColumn(out, F.when(F.col("rn") <= F.col("_size"), "test").otherwise("train")).select(*df.columns, out)


def folds(df: DataFrame, k: int, seed: int, strata: list[str] = STRATA, out: str = "fold") -> DataFrame:
    d = hash_rank(df, strata, seed)
    return d.withColumn(out, ((F.col("rn") - 1) % k).cast("int")).select(*df.columns, out)


def undersample(df: DataFrame, factor: float, seed: int, outcome: str = "conversion", treatment: str = "treatment") -> DataFrame:
    """All positives, and of each arm's negatives the share that multiplies its prevalence by ``factor``.

    An arm without positives, or a factor that prevalence does not allow, raises.
    """
    arms = df.groupBy(treatment).agg(F.sum(outcome).alias("y"), F.count("*").alias("n"))
    p = F.col("y") / F.col("n")
    keep = F.when((F.col("y") > 0) & (F.lit(float(factor)) * p < 1), F.bround((F.col("n") - F.col("y")) * (1 / F.lit(float(factor)) - p) / (1 - p))).otherwise(F.raise_error("no positives, or the factor is too large").cast("double"))
    arms = arms.select(treatment, keep.cast("bigint").alias("_keep"))
    negatives = hash_rank(df.where(F.col(outcome) == 0), [treatment], seed).join(arms, treatment).where("rn <= _keep")
    return df.where(F.col(outcome) == 1).unionByName(negatives.select(*df.columns))


def roles(df: DataFrame, seed: int = 42) -> DataFrame:
    """``df`` with split: seen (a half), and of the rest fit, validation and confirmation (60 / 20 / 20)."""
    seen = stratified_sample(df, 0.5, seed).withColumn("split", F.lit("seen"))
    rest = holdout_split(stratified_complement(df, 0.5, seed), 0.4, seed + 1, out="_a")
    tail = holdout_split(rest.where("_a = 'test'").drop("_a"), 0.5, seed + 2, out="_b").withColumn("split", F.when(F.col("_b") == "test", "confirmation").otherwise("validation")).drop("_b")
    return seen.unionByName(rest.where("_a = 'train'").drop("_a").withColumn("split", F.lit("fit"))).unionByName(tail)
