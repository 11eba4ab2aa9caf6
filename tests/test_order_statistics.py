"""Quantiles by range counts equal those of Spark's own exact aggregate, whatever the groups, ties and ranges."""

import numpy as np
from pyspark.sql import functions as F

from lodestone.operators.order_statistics import quantiles

POINTS = [0.0, 0.003, 0.25, 0.5, 0.5, 0.75, 0.999, 1.0]


def test_equal_to_the_aggregate(spark):
    rng = np.random.default_rng(6)
    rows = [(g, None if rng.random() < 0.1 else float(v)) for g, n, kind in (("a", 3000, 0), ("b", 2500, 1), ("c", 1, 0), ("d", 2, 0), ("tie", 4000, 2)) for v in (rng.normal(size=n) if kind == 0 else rng.integers(0, 5, n) if kind == 1 else np.ones(n))]
    rows += [("none", None)] * 5 + [("inf", float("inf")), ("inf", 1.0), ("inf", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    want = df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, POINTS))).alias("q"))
    got = {r.g: r.q for r in quantiles(df, "v", POINTS, ["g"]).collect()}
    want = {r.g: r.q for r in want.collect()}
    assert got.keys() == want.keys()
    for g in want:
        assert np.allclose(got[g], want[g], rtol=1e-12, atol=1e-12, equal_nan=True), g


def test_whole_tables_and_empty_ones(spark):
    df = spark.range(10_001).select(F.col("id").alias("_v"), F.lit(1).alias("_c"))
    (row,) = quantiles(df, "_v", [0.1, 0.55555]).collect()
    assert np.allclose(row.q, [1000.0, 5555.5])
    assert quantiles(df.where("false"), "_v", [0.5]).count() == 0
