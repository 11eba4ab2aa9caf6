"""A saved scorer gives the same after reload, refuses what was changed, and scores uploads; averaged nuisances; priors."""

import json

import numpy as np
import pytest
from lodestone.operators import learners as L
from lodestone.operators import policy as P
from lodestone.operators import registry as R
from lodestone.operators.scorer import SavedScorer
from lodestone.sources import trial as S
from pyspark.sql import functions as F
from test_learners import P as PARAMS
from test_learners import planted


@pytest.fixture(scope="module")
def data(spark):
    return planted(spark, 2000)


@pytest.fixture(scope="module")
def made(data):
    return SavedScorer.fit(data, PARAMS)


def test_reload_is_equal_to_the_bit(spark, data, made, tmp_path):
    path = f"{tmp_path}/scorer"
    assert made.save(path, seed=7) == 1 and made.save(path) == 2
    again = SavedScorer.load(spark, path, ["x0", "x1"])
    read = lambda s: s.target(data.select("row_id", "x0", "x1"), 0.1).orderBy("row_id").select("row_id", "score", "target", "percentile").collect()
    assert read(again) == read(made)
    assert sum(r["target"] for r in read(again)) == 200


def test_changed_scorer_is_refused(spark, made, tmp_path):
    path = f"{tmp_path}/scorer"
    made.save(path)
    with pytest.raises(ValueError, match="made for"):
        SavedScorer.load(spark, path, ["x1", "x0"])
    part = next(p for p in (tmp_path / "scorer" / "models").rglob("part-*") if p.suffix == ".parquet")
    part.write_bytes(part.read_bytes() + b"x")
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="does not hold"):
        SavedScorer.load(spark, path)


def test_failed_save_leaves_the_one_before(spark, made, tmp_path, monkeypatch):
    path = f"{tmp_path}/scorer"
    made.save(path)
    other = SavedScorer(["x0"], (0.25, 0.5), made.grid)
    monkeypatch.setattr("lodestone.operators.scorer.Snapshots.publish", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        other.save(path)
    monkeypatch.undo()
    assert SavedScorer.load(spark, path).features == ["x0", "x1"]


def test_constant_arms(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), i % 2, i % 2) for i in range(40)], "row_id long, x0 double, treatment int, conversion int")
    SavedScorer.fit(df, L.Params(["x0"])).save(f"{tmp_path}/s")
    again = SavedScorer.load(spark, f"{tmp_path}/s")
    assert {r["score"] for r in again.score(df).collect()} == {1.0}
    assert {r["percentile"] for r in again.target(df, 0.5).collect()} == {0.0}  # equal values have their lowest quantile


def test_percentiles_by_halving(spark):
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 1001):
        values = np.unique(np.round(rng.normal(size=n), 3))
        q = np.linspace(0, 1, len(values)) if len(values) > 1 else np.zeros(1)
        grid = spark.createDataFrame(list(zip(values.tolist(), q.tolist(), strict=True)), "value double, quantile double")
        xs = np.concatenate((values, rng.normal(size=50), [-9.0, 9.0]))
        df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)] + [(-1, None)], "row_id long, score double")
        got = {r["row_id"]: r["percentile"] for r in P.percentiles(df, "score", grid).collect()}
        assert got.pop(-1) is None
        assert np.allclose([got[i] for i in range(len(xs))], np.interp(xs, values, q))
    empty = spark.createDataFrame([], "value double, quantile double")
    assert [r["percentile"] for r in P.percentiles(df.limit(2), "score", empty).collect()] == [None, None]


@pytest.mark.parametrize("layout", ["lines", "array", "pretty"])
def test_json_batch(spark, made, tmp_path, layout):
    rows = [{"x0": i / 10, "x1": 0.5, "name": f"r{i}"} for i in range(10)]
    text = {"lines": "\n".join(map(json.dumps, rows)), "array": json.dumps(rows), "pretty": json.dumps(rows, indent=2)}[layout]
    (tmp_path / "b.json").write_text(text)
    got = made.target(S.read_scoring_json(spark, f"{tmp_path}/b.json", ["x0", "x1"]), 0.35)
    assert got.agg(F.sum("target")).first()[0] == 3 and got.count() == 10 and "name" in got.columns


@pytest.mark.parametrize("text", ['{"x0": 1}', '{"x0": 1, "x1": null}', '{"x0": 1, "x1": "a"}', '{"x0": 1, "x1": "NaN"}'])
def test_json_batch_is_refused(spark, tmp_path, text):
    (tmp_path / "b.json").write_text(text)
    with pytest.raises(ValueError):
        S.read_scoring_json(spark, f"{tmp_path}/b.json", ["x0", "x1"])


def test_limits_of_uploads(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"a": 1}\n{"a": 2}')
    (tmp_path / "b.csv").write_text("a\n1\n2\n")
    for read, name in ((S.read_scoring_json, "b.json"), (S.read_scoring_csv, "b.csv")):
        assert read(spark, f"{tmp_path}/{name}", ["a"], 2, 100).count() == 2
        for most, size in ((1, 100), (2, 4)):
            with pytest.raises(ValueError):
                read(spark, f"{tmp_path}/{name}", ["a"], most, size)


def test_averaged_nuisances(data):
    """Means over partitions of cross-fitted nuisances, whose spread over seeds falls with their number."""
    from dataclasses import replace

    p = replace(PARAMS, trees=3)
    one, two = (L.cross_nuisance(L._with_fold(data, 2, p.seed + i), p, "_fold", 2) for i in (0, 1))
    both = one.select("row_id", F.col("mu1").alias("a")).join(two.select("row_id", F.col("mu1").alias("b")), "row_id").join(L.averaged_nuisance(data, p, 2, 2), "row_id")
    assert both.count() == 2000 and both.where("abs((a + b) / 2 - mu1) > 1e-12").isEmpty()
    spread = {}
    for iters in (1, 4):
        m = [L.averaged_nuisance(data, replace(p, seed=s), 2, iters).select("row_id", F.col("mu1").alias(f"m{s}")) for s in (100, 200)]
        spread[iters] = m[0].join(m[1], "row_id").agg(F.sqrt(F.avg((F.col("m100") - F.col("m200")) ** 2))).first()[0]
    assert spread[4] < 0.7 * spread[1]
    with pytest.raises(ValueError):
        L.averaged_nuisance(data, p, 2, 0)


def test_propensity_and_undersampled_s(spark, data):
    share = data.agg(F.avg("treatment")).first()[0]
    assert L.with_mean_propensity(data, PARAMS).propensity == share
    with pytest.raises(ValueError):
        L.with_mean_propensity(data.where("treatment = 1"), PARAMS)
    whole, halved = (L.s_learner(data, PARAMS, k)(data).agg(F.sum(F.abs("score"))).first()[0] for k in (1.0, 2.0))
    assert np.isclose(whole, 2 * halved)


def test_status_counts(spark):
    got = R.status_counts(spark.createDataFrame([("ok",), ("ok",), (None,)], "status string"))
    assert {r["status"]: r["n"] for r in got.collect()} == {"ok": 2, "unknown": 1}
