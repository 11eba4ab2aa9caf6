"""Curves of random rankings against a ranking of every row, and what is sent for them."""

import numpy as np
import pytest
from lodestone.functions.signals import uniform
from lodestone.operators import resample as B
from pyspark.sql import functions as F


@pytest.mark.parametrize("digits", [0, 1, 3])
def test_random_rankings(spark, digits):
    n, budgets = 501, [0.0, 0.013, 0.25, 1.0, 1.5]
    rng = np.random.default_rng(2)
    rows = [(i, float(g)) for i, g in enumerate(rng.normal(size=n))]
    df = spark.createDataFrame(rows, "row_id long, g double").repartition(3)
    got = {(r["draw"], r["budget"]): r["value"] for r in B.random_policy_curves(df, "g", budgets, 4, 3, digits).collect()}
    assert len(got) == 4 * len(budgets)
    for draw in range(4):
        score = {r["row_id"]: r["s"] for r in df.select("row_id", uniform("row_id", draw, 3).alias("s")).collect()}
        top = [0.0, *np.cumsum([g for i, g in sorted(rows, key=lambda r: -score[r[0]])])]
        for b in budgets:
            assert got[draw, b] == pytest.approx(np.interp(b, np.arange(n + 1) / n, np.array(top) / n), abs=1e-12)


def test_random_rankings_send_no_rows(spark):
    """What the second pass ranks is a small part of all (row, draw): one that ranked every row would hold 400,000."""
    df = spark.range(100_000).select(F.col("id").alias("row_id"), F.lit(1.0).alias("g"))
    kept = []
    before = B.materialize
    B.materialize = lambda d: kept.append(before(d)) or kept[-1]
    try:
        got = B.random_policy_curves(df, "g", [0.1, 0.3], 4, 3).collect()
    finally:
        B.materialize = before
    assert all(r["value"] == pytest.approx(r["budget"], abs=1e-4) for r in got) and len(got) == 8
    assert [d.count() for d in kept][0] == 100_000 and max(d.count() for d in kept[1:]) <= 4 * 4096
