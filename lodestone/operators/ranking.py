"""Ranks and running sums over a whole table, without a task that holds it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.signals import uniform
from lodestone.session import materialize


def running_sums(df: DataFrame, order: list[Column], sums: dict[str, str], by: list[str] | None = None) -> DataFrame:
    """``df`` with the sum of each column up to and including its row, in ``order`` within ``by``.

    Rows are dealt out by range; the ranges' totals (one row a range) give each its start. The order must be total.
    """
    by = by or []
    parted = materialize(df.repartitionByRange(*by, *order).withColumn("_range", F.spark_partition_id()))
    totals = parted.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*by, *([] if by else [F.lit(0)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = parted.join(starts, [*by, "_range"])
    return out.withColumns({n: F.sum(c).over(inside) + F.col(f"_{n}") for n, c in sums.items()}).drop("_range", *[f"_{n}" for n in sums])


def row_numbers(df: DataFrame, order: list[Column], by: list[str] | None = None, out: str = "rn") -> DataFrame:
    """``df`` with its row number in a total ``order`` within ``by``."""
    return running_sums(df.withColumn("_one", F.lit(1).cast("bigint")), order, {out: "_one"}, by).drop("_one")


def hash_rank(df: DataFrame, strata: list[str], seed: int, row_id: str = "row_id", out: str = "rn") -> DataFrame:
    """``df`` with each row's place in its stratum in the order of md5(row_id:seed).

    Strata are cut by the first hexadecimal digits of the hash, so that a large stratum is ranked by many tasks.
    """
    d = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(row_id).cast("string"), F.lit(str(seed))))).withColumn("_b", F.substring("_h", 1, 3))
    count = d.groupBy(*strata, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*strata, *([] if strata else [F.lit(0)])).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    start = count.select(*strata, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy(*strata, "_b").orderBy("_h", row_id))
    return d.join(start, [*strata, "_b"]).withColumn(out, F.col("_start") + place).drop("_h", "_b", "_start")


def random_matching(df: DataFrame, seed: int) -> DataFrame:
    """(left_id, right_id): pairs of rows by a hash order, row k with row k + n / 2; of an odd number one row is left out."""
    r = row_numbers(df.select("row_id", uniform("row_id", 0, seed).alias("h")), [F.asc("h"), F.asc("row_id")])
    half = r.agg(F.floor(F.count("*") / 2).alias("half"))
    a, b = r.join(half).select("rn", "half", F.col("row_id").alias("left_id")), r.select(F.col("rn").alias("rb"), F.col("row_id").alias("right_id"))
    return a.where("rn <= half").join(b, F.col("rb") == F.col("rn") + F.col("half")).select("left_id", "right_id")


def tie_groups(scored: DataFrame, score: str = "score", by: list[str] | None = None, treatment: str = "treatment", outcome: str = "outcome", signal: str | None = None, weight: Column | None = None) -> DataFrame:
    """One row for each distinct score: weights of rows, of arms, of arms' events, and of the signal.

    Rows with equal scores enter a ranking together, so everything below works on this smaller table.
    """
    w = F.lit(1) if weight is None else weight
    t, y = F.col(treatment), F.col(outcome)
    sums = {"n": w, "n1": w * t, "y1": w * t * y, "y0": w * (1 - t) * y} | ({"g": w * F.col(signal)} if signal else {})
    return scored.groupBy(*(by or []), F.col(score).alias("score")).agg(*[F.sum(c).alias(k) for k, c in sums.items()])


def cumulate(groups: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tie groups with running sums N, N1, Y1, Y0 (and G) from the highest score down."""
    sums = {"N": "n", "N1": "n1", "Y1": "y1", "Y0": "y0"} | ({"G": "g"} if "g" in groups.columns else {})
    renamed = groups.withColumnsRenamed({v: f"g_{v}" for v in sums.values()})
    return running_sums(renamed, [F.desc("score")], {k: f"g_{v}" for k, v in sums.items()}, by)
