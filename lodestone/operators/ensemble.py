"""Combining scores: losses to an effect signal, weights, rank averages."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.diagnostics import average_ranks


def dr_risk(df: DataFrame, models: list[str], signal: str) -> DataFrame:
    one = df.agg(*[F.avg(F.pow(F.col(signal) - F.col(m), 2)).alias(m) for m in models])
    return one.unpivot([], models, "model", "risk")


def best_single(risks: DataFrame) -> DataFrame:
    return risks.withColumn("weight", (F.col("model") == risks.agg(F.min_by("model", F.struct("risk", "model"))).scalar()).cast("double"))


def softmax_weights(risks: DataFrame, temperature: float | None = None) -> DataFrame:
    """exp(-risk / temperature), normalised; the temperature defaults to the population deviation, without any weights are equal."""
    t = F.lit(float(temperature)) if temperature else F.col("_t")
    d = risks.join(risks.agg(F.stddev_pop("risk").alias("_t"), F.min("risk").alias("_m")))
    d = d.withColumn("_e", F.when(t > 0, F.exp(-F.try_divide(F.col("risk") - F.col("_m"), t))).otherwise(1.0))
    return d.join(d.agg(F.sum("_e").alias("_s"))).select("model", "risk", (F.col("_e") / F.col("_s")).alias("weight"))


def gram(df: DataFrame, models: list[str], signal: str) -> DataFrame:
    """(a, b, value): mean products of scores, and of scores with the signal (b = 'signal'); one pass."""
    cells = [(a, b) for i, a in enumerate(models) for b in models[i:]] + [(m, "signal") for m in models]
    one = df.agg(*[F.avg(F.col(a) * F.col(signal if b == "signal" else b)).alias(f"{a}~{b}") for a, b in cells])
    long = one.unpivot([], one.columns, "cell", "value")
    return long.select(F.split("cell", "~")[0].alias("a"), F.split("cell", "~")[1].alias("b"), "value")


def q_aggregation(df: DataFrame, models: list[str], signal: str, nu: float = 0.5, steps: int = 20_000) -> dict[str, float]:
    """Weights on the simplex that minimise -2 w.b + (1 - nu) w.A w + nu w.diag(A), from ``gram`` by projected gradient."""
    rows = gram(df, models, signal).collect()  # a few cells a model
    at = {m: i for i, m in enumerate(models)}
    a, b = np.zeros((len(models),) * 2), np.zeros(len(models))
    for r in rows:
        if r["b"] == "signal":
            b[at[r["a"]]] = r["value"]
        else:
            a[at[r["a"]], at[r["b"]]] = a[at[r["b"]], at[r["a"]]] = r["value"]
    w = np.full(len(models), 1 / len(models))
    rate = 1 / (2 * max(np.linalg.eigvalsh(a).max(), 1e-300) + 1e-300)
    for _ in range(steps):
        new = _simplex(w - rate * (-2 * b + 2 * (1 - nu) * a @ w + nu * np.diag(a)))
        if np.abs(new - w).max() < 1e-12:
            break
        w = new
    return dict(zip(models, w.tolist(), strict=True))


def _simplex(v: np.ndarray) -> np.ndarray:
    """The nearest point with parts of at least 0 that sum to 1."""
    u = np.sort(v)[::-1]
    c = (np.cumsum(u) - 1) / np.arange(1, len(v) + 1)
    return np.maximum(v - c[np.flatnonzero(u > c)[-1]], 0)


def apply_weights(df: DataFrame, weights: dict[str, float], out: str = "ensemble") -> DataFrame:
    return df.withColumn(out, sum((F.col(m) * F.lit(float(w)) for m, w in weights.items()), F.lit(0.0)))


def rank_average(df: DataFrame, models: list[str], weights: dict[str, float] | None = None, out: str = "rank_average") -> DataFrame:
    """``df`` with the weighted mean of average ranks over n."""
    w = weights or {m: 1 / len(models) for m in models}
    total = sum(w.values())
    d = df
    for m in models:
        d = average_ranks(d, m, f"_r_{m}")
    d = d.join(df.agg(F.count("*").alias("_n")))
    return d.withColumn(out, sum((F.col(f"_r_{m}") * F.lit(w[m] / total) for m in models), F.lit(0.0)) / F.col("_n")).drop("_n", *[f"_r_{m}" for m in models])


def spearman(df: DataFrame, models: list[str]) -> DataFrame:
    """(a, b, pearson, spearman) for each pair."""
    d = df
    for m in models:
        d = average_ranks(d, m, f"r_{m}")
    pairs = [(a, b) for i, a in enumerate(models) for b in models[i + 1 :]]
    one = d.agg(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("pearson"), F.corr(f"r_{a}", f"r_{b}").alias("spearman")).alias(f"{a}~{b}") for a, b in pairs])
    return one.select(F.explode(F.array(*[F.col(f"`{a}~{b}`") for a, b in pairs])).alias("x")).select("x.*")


def cross_fitted_ensemble(df: DataFrame, models: list[str], signal: str, fold: str) -> DataFrame:
    """``df`` with ensemble: each half (fold 0 or 1) weighted as learnt on the other."""
    parts = [apply_weights(df.where(F.col(fold) == k), q_aggregation(df.where(F.col(fold) != k), models, signal)) for k in (0, 1)]
    return parts[0].unionByName(parts[1])
