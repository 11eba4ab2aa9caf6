"""A scorer that outlives its session: models of both arms, the population's percentile grid, and a record that binds them.

Models are written to a folder of their own first; the grid is then published as a version of a table whose record names
that folder, the features and the hash of the model files. A writer that stops at any point leaves the scorer before.
"""

from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.learners import Params, add_probability, probability_model
from lodestone.operators.policy import batch_target, percentile_grid
from lodestone.session import materialize
from lodestone.sources.snapshots import Snapshots

_ARMS = ("control", "treated")


def folder_hash(spark: SparkSession, path: str) -> str:
    """One hash over the contents and relative names of all files under ``path``; meant for models, not for data."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", path.rstrip("/").rsplit("/", 1)[-1], 2), 2)
    one = files.select(name.alias("name"), F.sha2("content", 256).alias("own"))
    whole = one.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("name", "own")))), 256).alias("h"))
    return whole.first()["h"]


class SavedScorer:
    """Effect scores as the difference of both arms' probabilities, with percentiles in the population it was made on."""

    def __init__(self, features: list[str], models: tuple[PipelineModel | float, PipelineModel | float], grid: DataFrame):
        self.features, self.models, self.grid = features, models, grid

    @classmethod
    def fit(cls, df: DataFrame, p: Params, population: DataFrame | None = None, points: int = 1001) -> SavedScorer:
        """Models of ``df``; the grid is of ``population``'s scores (``df``'s without one)."""
        made = cls(p.features, tuple(probability_model(p, df.where(F.col("treatment") == a)) for a in (0, 1)), None)
        scored = made.score((df if population is None else population).select(*p.features))
        made.grid = materialize(percentile_grid(scored, "score", points))
        return made

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with score; a missing feature raises."""
        if missing := [c for c in self.features if c not in df.columns]:
            raise ValueError(f"features are missing: {missing}")
        two = add_probability(self.models[1], add_probability(self.models[0], df, "_p0"), "_p1")
        return two.withColumn("score", F.col("_p1") - F.col("_p0")).drop("_p0", "_p1")

    def target(self, batch: DataFrame, budget: float) -> DataFrame:
        """``batch`` with score, target (the floor(n * budget) highest) and percentile; rows without row_id are numbered as read."""
        if not 0 <= budget <= 1:
            raise ValueError("a budget is a share from 0 to 1")
        numbered = batch if "row_id" in batch.columns else batch.withColumn("row_id", F.monotonically_increasing_id())
        return batch_target(self.score(numbered), "score", budget, self.grid)

    def save(self, path: str, **facts) -> int:
        """Makes this the current scorer at ``path`` and gives its number."""
        spark = self.grid.sparkSession
        folder, constant = f"{path.rstrip('/')}/models/{uuid.uuid4().hex}", {}
        for arm, model in zip(_ARMS, self.models, strict=True):
            if isinstance(model, float):
                constant[arm] = model
            else:
                model.save(f"{folder}/{arm}")
        kept = {"features": self.features, "constant": constant, "models": folder, "hash": folder_hash(spark, folder) if len(constant) < 2 else None}
        return Snapshots(spark, path).publish(self.grid, facts=kept | {"given": facts})

    @classmethod
    def load(cls, spark: SparkSession, path: str, features: list[str] | None = None) -> SavedScorer:
        """The current scorer; changed files, and features other than ``features``, are refused."""
        table = Snapshots(spark, path)
        grid, facts = table.read(verify=True), table.current()["facts"]
        if features is not None and list(features) != facts["features"]:
            raise ValueError(f"the scorer was made for {facts['features']}")
        if facts["hash"] is not None and folder_hash(spark, facts["models"]) != facts["hash"]:
            raise ValueError(f"{facts['models']} does not hold what was written")
        models = tuple(facts["constant"][a] if a in facts["constant"] else PipelineModel.load(f"{facts['models']}/{a}") for a in _ARMS)
        return cls(facts["features"], models, grid)
