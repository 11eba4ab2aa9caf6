"""The corpus pipeline: five stages, one after another, over the documents table.

Each stage takes (spark, docs, sf_dir), works on every row that the stage before kept and returns a DataFrame;
all but the last return the columns of documents. Rows that repeat, nulls and empty texts are as the operators
define them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontamination import Decontamination
from lodestone.llm.near_dedup import NearDedup
from lodestone.llm.quality import QualityClassifier
from lodestone.llm.queries import encoded
from lodestone.llm.secrets import SecretScan
from lodestone.session import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts as good."""
    return QualityClassifier().keep(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return NearDedup().keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return Decontamination().clean(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked in their texts."""
    return SecretScan().redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document's text."""
    return encoded(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

#: The classifier, the forest and the ranked merges cannot be said in SQL. Tests hold each stage against plain Python on
#: what the stage before it kept; the classifier's and the forest's decisions against their operators' own rows.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
