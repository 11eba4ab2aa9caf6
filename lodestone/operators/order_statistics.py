"""Exact quantiles of any number of groups by counts of ranges: no task holds a group, no buffer more than the answers.

Distinct values with their counts are dealt out by range once. One row a range tells how many values stand before it,
so each asked rank is known to be in one range; only these ranges are looked into.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialize


def quantiles(df: DataFrame, value: str, points: list[float], by: list[str] | None = None, out: str = "q") -> DataFrame:
    """(by, out): the quantiles of ``value`` at ``points``, by straight lines between neighbours, as an array in their order.

    Nulls do not count; groups of nothing else, and groups whose key is null, have no row. Equal to ``percentile`` and
    ``quantile_cont``.
    """
    by = by or []
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(len(keys))]
    d = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null").groupBy(*names, "_v").agg(F.count("*").alias("_c"))
    d = materialize(d.repartitionByRange(*names, "_v").withColumn("_range", F.spark_partition_id()))
    held = materialize(d.groupBy(*names, "_range").agg(F.sum("_c").alias("_held")))  # a row a group and range
    before = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = held.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))

    at = F.col("_p") * (F.col("_n") - 1)
    asked = held.groupBy(*names).agg(F.sum("_held").alias("_n")).select(*names, "_n", F.posexplode(F.array(*[F.lit(float(p)) for p in points])).alias("_i", "_p"))
    asked = asked.select(*names, "_i", at.alias("_at"), F.explode(F.array_distinct(F.array(F.floor(at), F.ceil(at)))).alias("_rank"))
    asked = asked.join(ranges, names).where("_rank >= _before and _rank < _before + _held").drop("_held")

    wanted = asked.groupBy(*names, "_range", "_before").agg(F.collect_set("_rank").alias("_ranks"))
    inside = Window.partitionBy(*names, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = d.join(wanted, [*names, "_range"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    found = found.select(*names, "_v", F.explode(F.filter("_ranks", lambda r: (r < F.col("_upto")) & (r >= F.col("_upto") - F.col("_c")))).alias("_rank"))

    part = asked.select(*names, "_i", "_at", "_rank").join(found, [*names, "_rank"])
    weight = F.when(F.floor("_at") == F.ceil("_at"), F.lit(1.0)).when(F.col("_rank") == F.floor("_at"), F.ceil("_at") - F.col("_at")).otherwise(F.col("_at") - F.floor("_at"))
    one = part.groupBy(*names, "_i").agg(F.sum(weight * F.col("_v")).alias("_q"))
    row = one.groupBy(*names).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_q"))), lambda x: x["_q"]).alias(out))
    return row.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], out)
