"""Out-of-fold experiments: every candidate fitted on the other folds, kept as it is done, resumed where it stopped."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.learners import Scorer
from lodestone.sources.snapshots import Snapshots, content_hash


class OutOfFold:
    """Scores by (candidate, fold, hash of configuration and rows) under ``path``.

    A fold's scores are a version of a table, with its row count and content hash. What is there for the same
    configuration and the same rows is not fitted again; a changed row, parameter or fold is another hash.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def run(self, df: DataFrame, candidates: dict[str, Callable[[DataFrame], Scorer]], config: dict, fold: str = "fold") -> DataFrame:
        """(row_id, fold, model, score) of all candidates; ``config`` says what the candidates are made with.

        A fold that a fit has not scored whole, with finite numbers, raises and is not kept.
        """
        folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # one row a fold
        key = self.key(df, config)
        for name, build in candidates.items():
            for k in folds:
                table = self._table(key, name, k)
                if table.current() is None:
                    began = time.perf_counter()
                    held = df.where(F.col(fold) == k)
                    scores = build(df.where(F.col(fold) != k))(held).select("row_id", F.lit(k).alias("fold"), F.lit(name).alias("model"), F.col("score").cast("double").alias("score"))
                    bad = F.col("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))
                    scores = scores.withColumn("score", F.when(bad, F.raise_error("a score is not finite").cast("double")).otherwise(F.col("score")))
                    table.publish(scores, facts={"seconds": time.perf_counter() - began, "rows": held.count(), "config": config})
        return self.read(key, list(candidates), folds)

    def key(self, df: DataFrame, config: dict) -> str:
        return hashlib.sha256(json.dumps([config, content_hash(df)], sort_keys=True).encode()).hexdigest()[:16]

    def _table(self, key: str, name: str, k) -> Snapshots:
        return Snapshots(self.spark, f"{self.path}/{key}/{name}/{k}")

    def read(self, key: str, names: list[str], folds: list) -> DataFrame:
        """The kept scores; files other than were written, missing folds and rows in two folds are refused."""
        parts = [(name, k, self._table(key, name, k)) for name in names for k in folds]
        lacking = [(name, k) for name, k, t in parts if t.current() is None]
        if lacking:
            raise FileNotFoundError(f"not fitted yet: {lacking}")
        out = reduce(DataFrame.unionByName, [t.read(verify=True) for _, _, t in parts])
        twice = out.groupBy("model", "row_id").agg(F.count("*").alias("n")).where("n > 1")
        if not twice.isEmpty():
            raise ValueError("folds are not disjoint: a row has two scores of one model")
        wanted = sum(t.current()["facts"]["rows"] for _, _, t in parts)
        if out.count() != wanted:
            raise ValueError("a fold was not scored whole")
        return out

    def timings(self, key: str, names: list[str], folds: list) -> DataFrame:
        """(model, fold, seconds, n_rows) of the fits that made the kept scores."""
        facts = [(name, str(k), self._table(key, name, k).current()["facts"]) for name in names for k in folds]
        return self.spark.createDataFrame([(n, k, f["seconds"], f["rows"]) for n, k, f in facts], "model string, fold string, seconds double, n_rows long")


def common_seeds(results: DataFrame, key: str = "candidate", seed: str = "validation_seed") -> DataFrame:
    """(seed) that every candidate has results of: what a fair comparison may use."""
    n = results.agg(F.count_distinct(key).alias("_all"))
    return results.groupBy(seed).agg(F.count_distinct(key).alias("_n")).join(n, F.col("_n") == F.col("_all")).select(seed)
