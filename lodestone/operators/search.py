"""Search over candidates by racing: rungs of growing samples, from which beaten candidates drop, and the winner's release."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.signals import uniform
from lodestone.operators.curves import normalised_area, policy_curve
from lodestone.operators.learners import Scorer
from lodestone.operators.registry import seed_summary, select_winners
from lodestone.operators.reporting import early_stop
from lodestone.operators.sampling import holdout_split
from lodestone.session import materialize
from lodestone.sources.snapshots import Snapshots

Builder = Callable[[DataFrame], Scorer]


@dataclass(frozen=True)
class Outcome:
    """A race's winner, its fits and why candidates dropped.

    ``fits``: (rung, share, candidate, validation_seed, qini_score, fit_seconds), one row a fit. ``dropped``: (candidate,
    rung, reason), reason null for those of the last rung. ``summary``: the last rung's candidates over seeds.
    """

    winner: str
    fits: DataFrame
    dropped: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Race:
    """Fits every candidate on a small share of the training rows, and on larger ones only those that may still win.

    A rung's share is a part of the next one's. All candidates of a rung are scored on the same held-out rows, for each
    validation seed anew, and compared over the seeds. One drops that has a score that is not finite, fewer than
    ``least_distinct`` values, or less policy value than the rung's best at every one of ``budgets``; of the others, the
    first 1 / ``keep`` by mean Qini score go on, ties to the smaller name. ``baseline`` always goes on, since the winner
    has to beat it; it wins where none does.

    ``signal`` is a row's effect signal, ``held_out`` the share of rows that each seed holds out. Rows of a seed are
    dealt once and written; a fit is a job of its own, and only one number a fit comes to the driver.
    """

    shares: tuple[float, ...] = (0.1, 0.3, 1.0)
    seeds: tuple[int, ...] = (101, 202)
    keep: float = 2.0
    held_out: float = 0.25
    budgets: tuple[float, ...] = (0.05, 0.1, 0.15, 0.2)
    least_distinct: int = 2
    least_delta: float = 0.0

    def __post_init__(self):
        if not self.shares or list(self.shares) != sorted(set(self.shares)) or not 0 < self.shares[0] or self.shares[-1] != 1:
            raise ValueError("shares must grow and end with 1")
        if self.keep <= 1:
            raise ValueError("keep must be over 1, or nothing drops")

    def run(self, df: DataFrame, candidates: dict[str, Builder], baseline: str, signal: Column, outcome: str = "conversion") -> Outcome:
        """``df`` has row_id, treatment and ``outcome``; ids must be unique, since they say which rung a row is of."""
        if baseline not in candidates:
            raise ValueError(f"no candidate {baseline}")
        spark = df.sparkSession
        splits = {s: materialize(holdout_split(df, self.held_out, s).withColumns({"_lot": uniform("row_id", 1, s), "_signal": signal})) for s in self.seeds}
        left, fits, gone = sorted(candidates), [], []
        for rung, share in enumerate(self.shares):
            scored, seconds = self._scored(splits, {c: candidates[c] for c in left}, share, outcome)
            qini = {(r["candidate"], r["validation_seed"]): r["qini_score"] for r in normalised_area(scored, "qini", ["candidate", "validation_seed"]).collect()}
            fits += [(rung, float(share), c, s, qini.get((c, s)), seconds[c, s]) for c in left for s in self.seeds]
            if share == 1:
                break
            mean = {c: sum(qini.get((c, s)) if qini.get((c, s)) is not None else -math.inf for s in self.seeds) / len(self.seeds) for c in left}
            order = sorted(left, key=lambda c: (-mean[c], c))
            reasons = self._reasons(scored, order[0])
            able = [c for c in order if not reasons.get(c)]
            on = set(able[: math.ceil(len(left) / self.keep)]) | {baseline}
            gone += [(c, rung, reasons.get(c) or "outranked") for c in left if c not in on]
            left = sorted(on)
        last = len(self.shares) - 1
        table = spark.createDataFrame(fits, "rung int, share double, candidate string, validation_seed long, qini_score double, fit_seconds double")
        whole = table.where(F.col("rung") == last).withColumn("model", F.lit("race"))
        summary = seed_summary(whole, whole.where(F.col("candidate") == baseline)).drop("model")
        challengers = summary.where(F.col("candidate") != baseline).withColumn("model", F.lit("race"))
        found = select_winners(challengers, self.least_delta, 1 + len(self.seeds) // 2, baseline).first()
        dropped = spark.createDataFrame([*gone, *((c, last, None) for c in left)], "candidate string, rung int, reason string")
        return Outcome(found["winner"] if found else baseline, table, dropped, summary)

    def _scored(self, splits: dict[int, DataFrame], candidates: dict[str, Builder], share: float, outcome: str) -> tuple[DataFrame, dict]:
        """(candidate, validation_seed, treatment, outcome, _signal, score) of held-out rows, and the seconds of each fit."""
        parts, seconds = [], {}
        for seed, rows in splits.items():
            train = rows.where((F.col("split") == "train") & (F.col("_lot") < share)).drop("split", "_lot", "_signal")
            test = rows.where("split = 'test'").drop("split", "_lot")
            for name, build in candidates.items():
                began = time.perf_counter()
                part = build(train)(test).select(
                    F.lit(name).alias("candidate"), F.lit(seed).cast("long").alias("validation_seed"), "treatment", F.col(outcome).alias("outcome"), "_signal", F.col("score").cast("double").alias("score")
                )
                parts.append(materialize(part))
                seconds[name, seed] = time.perf_counter() - began
        return reduce(DataFrame.unionByName, parts), seconds

    def _reasons(self, scored: DataFrame, best: str) -> dict[str, str | None]:
        """Why a candidate drops, if it does: by all its scores and by its policy values, averaged over seeds."""
        by_seed = policy_curve(scored.where(F.col("score").isNotNull()), "_signal", list(self.budgets), ["candidate", "validation_seed"])
        curve = by_seed.groupBy(F.col("candidate").alias("model"), "budget").agg(F.avg("value").alias("value"))
        # a score that is constant for each seed has as many values as there are seeds
        least = self.least_distinct + len(self.seeds) - 1
        found = early_stop(scored.withColumnRenamed("candidate", "model"), curve, best, least, min(self.budgets), max(self.budgets))
        return {r["model"]: r["reason"] for r in found.collect()}  # one row a candidate


def release(spark: SparkSession, path: str, df: DataFrame, name: str, build: Builder, signal: Column, budgets: list[float], outcome: str = "conversion") -> int:
    """Fits ``name`` on rows of ``df`` whose split is fit or validation and keeps its scores of the confirmation rows.

    A version of the snapshots at ``path`` holds (row_id, model, score); its record holds row counts, the Qini score and
    the value of each budget. A split without rows, or a score that is not finite, raises and keeps nothing.
    """
    counts = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    seen = sum(counts.get(s, 0) for s in ("fit", "validation"))
    if not seen or not counts.get("confirmation"):
        raise ValueError("a release needs rows to fit and rows to confirm")
    test = df.where("split = 'confirmation'").withColumn("_signal", signal)
    score = F.col("score").cast("double")
    bad = score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))
    checked = F.when(bad, F.raise_error("a score is not finite").cast("double")).otherwise(score)
    scored = build(df.where("split in ('fit', 'validation')").drop("split"))(test.drop("split"))
    scored = materialize(scored.select("row_id", F.lit(name).alias("model"), checked.alias("score"), "treatment", F.col(outcome).alias("outcome"), "_signal"))
    values = {f"{r['budget']:g}": r["value"] for r in policy_curve(scored, "_signal", budgets).collect()}
    qini = normalised_area(scored, "qini").first()["qini_score"]
    facts = {"model": name, "rows_fit": seen, "rows_confirmed": counts["confirmation"], "qini_score": qini, "policy_value": values}
    return Snapshots(spark, path).publish(scored.select("row_id", "model", "score"), facts=facts)
