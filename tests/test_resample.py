"""Bootstraps against plain Python that repeats rows by their weights."""

import numpy as np
import pytest
from lodestone.functions.signals import POISSON
from lodestone.operators import resample as B


def fixture(spark, n, values, parts):
    rng = np.random.default_rng(n)
    rows = [(i + 2**33 * (i % 2), m, float(rng.integers(0, values)), int(rng.random() < 0.6), int(rng.random() < 0.4), float(rng.normal())) for i in range(n) for m in ("a", "b")]
    rows.append((5, None, 1.0, 1, 1, 0.0))
    rows.append((6, "a", None, 1, 1, 0.0))
    return rows, spark.createDataFrame(rows, "row_id long, model string, score double, treatment int, outcome int, dr double").repartition(parts)


def expanded(rows, model, weights):
    out = {}
    for i, m, s, t, y, g in rows:
        if m == model and s is not None and weights[i]:
            out.setdefault(s, []).extend([(t, y, g)] * int(weights[i]))
    return [out[s] for s in sorted(out, reverse=True)]


def area(points):
    return sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False))


def qini_points(groups):
    n = n1 = y1 = y0 = 0
    out = [(0.0, 0.0)]
    for g in groups:
        n, n1, y1, y0 = n + len(g), n1 + sum(t for t, *_ in g), y1 + sum(t * y for t, y, _ in g), y0 + sum((1 - t) * y for t, y, _ in g)
        out.append((n, y1 - (y0 * n1 / (n - n1) if n > n1 else 0)))
    return out


def qini(groups):
    flat = [r for g in groups for r in g]
    best = [[r for r in flat if r[1] * (2 * r[0] - 1) == k] for k in (1, 0, -1)]
    a, b = qini_points(groups), qini_points([g for g in best if g])
    line = a[-1][0] * a[-1][1] / 2
    return (area(a) - line) / (area(b) - line)


@pytest.mark.parametrize("values,parts", [(5, 1), (1000, 4), (1, 3)])
def test_weights_are_repeated_rows(spark, values, parts):
    rows, df = fixture(spark, 300, values, parts)
    ids = sorted({i for i, *_ in rows})
    w = B.weights(np.array(ids), 7, 3)
    by = [dict(zip(ids, w[:, r], strict=True)) for r in range(7)]
    spark.conf.set("spark.sql.shuffle.partitions", "5")  # ranges cut ties
    try:
        got = {(r["replicate"], r["model"]): r["qini_score"] for r in B.bootstrap_qini(df, 7, 3).collect()}
        policy = {(r["replicate"], r["model"], r["budget"]): r["value"] for r in B.bootstrap_policy(df, "dr", [0.0, 0.1, 0.5, 1.0], 7, 3).collect()}
        rates = {(r["replicate"], r["model"]): (r["autoc"], r["rate_qini"]) for r in B.bootstrap_rate(df, "dr", 7, 3).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(got) == 14
    for (r, m), value in got.items():
        groups = expanded(rows, m, by[r])
        assert value == pytest.approx(qini(groups), abs=1e-9)
        n, x, points, autoc, rq = sum(map(len, groups)), 0, [(0.0, 0.0)], 0.0, 0.0
        mean = sum(g for group in groups for *_, g in group) / n
        total = 0.0
        for group in groups:
            x, total = x + len(group), total + sum(g for *_, g in group)
            points.append((x / n, total / n))
            autoc += (total / x - mean) * len(group) / n
            rq += x / n * (total / x - mean) * len(group) / n
        assert rates[r, m] == pytest.approx((autoc, rq), abs=1e-9)
        for b in (0.0, 0.1, 0.5, 1.0):
            assert policy[r, m, b] == pytest.approx(np.interp(b, *zip(*points, strict=True)), abs=1e-9)


def test_weights_are_poisson(spark):
    w = B.weights(np.arange(20_000) * 7919, 40, 5)
    share = [(w <= k).mean() for k in range(3)]
    assert np.allclose(share, POISSON[:3], atol=0.003) and abs(np.corrcoef(w.T)[~np.eye(40, dtype=bool)]).max() < 0.04
    assert abs(np.corrcoef(w[:-1].ravel(), w[1:].ravel())[0, 1]) < 0.01


def test_mean_draws(spark):
    rows, df = fixture(spark, 200, 3, 3)
    one = df.where("model = 'a'")
    ids = sorted(i for i, m, *_ in rows if m == "a")
    w = dict(zip(ids, B.weights(np.array(ids), 4, 1), strict=True))
    got = {r["replicate"]: r["value"] for r in B.bootstrap_mean(one, ["dr"], 4, 1).collect()}
    for k in range(4):
        assert got[k] == pytest.approx(sum(w[i][k] * g for i, m, *_, g in rows if m == "a") / len(ids))


def test_ranges_do_not_grow_with_the_table(spark):
    """Ranges have about as many rows in a larger table: by the number of cores alone there would be 8, ties of them cut."""
    n, kept = 4000, []
    rows, df = fixture(spark, n, 3, 2)
    before, whole = B.materialize, B._RANGE
    B.materialize, B._RANGE = lambda d: kept.append(before(d)) or kept[-1], 200
    try:
        got = {(r["replicate"], r["model"]): r["qini_score"] for r in B.bootstrap_qini(df, 3, 3).collect()}
    finally:
        B.materialize, B._RANGE = before, whole
    sizes = [r["count"] for r in kept[1].groupBy("model", "_range").count().collect()]
    assert sum(sizes) == 2 * n and len(sizes) >= 30 and max(sizes) < 1000
    ids = sorted({i for i, *_ in rows})
    w = B.weights(np.array(ids), 3, 3)
    for (r, m), value in got.items():
        assert value == pytest.approx(qini(expanded(rows, m, dict(zip(ids, w[:, r], strict=True)))), abs=1e-9)
