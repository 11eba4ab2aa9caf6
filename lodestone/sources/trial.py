"""Sources: the experiment table from CSV or Parquet, and deterministic trial views over other tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.session import table

FEATURES = [f"f{i}" for i in range(12)]
BINARIES = ["treatment", "conversion", "visit", "exposure"]
SCHEMA = T.StructType([T.StructField(c, T.FloatType()) for c in FEATURES] + [T.StructField(c, T.ByteType()) for c in BINARIES])


def read_trial_csv(spark: SparkSession, path: str) -> DataFrame:
    """The experiment table from (gzip) CSV with declared types; ``row_id`` is the row's place in the file.

    A gzip file is one split, so this runs once and its result belongs in Parquet.
    """
    rows = spark.read.schema(SCHEMA).option("header", True).csv(path)
    numbered = rows.rdd.zipWithIndex().map(lambda r: (r[1], *r[0]))
    return spark.createDataFrame(numbered, T.StructType([T.StructField("row_id", T.LongType(), False), *SCHEMA.fields]))


def read_binary_column(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(row_id, column) alone - only they are read - after a check that every value is 0 or 1."""
    one = spark.read.parquet(path).select("row_id", column)
    if not one.where(f"{column} is null or {column} not in (0, 1)").isEmpty():
        raise ValueError(f"{column} must be 0 or 1")
    return one


def write_with_manifest(df: DataFrame, path: str, **facts) -> dict:
    """Parquet, and beside it a manifest of the row count, an order-free hash of row_id and given facts."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    spark = df.sparkSession
    manifest = facts | index_hash(spark.read.parquet(f"{path}/data")) | {"columns": sorted(df.columns)}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return manifest


def read_with_manifest(spark: SparkSession, path: str, **facts) -> DataFrame | None:
    """The table, or None if the manifest does not hold for it or lacks a given fact: then it is to be built anew."""
    manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    df = spark.read.parquet(f"{path}/data")
    expected = {k: manifest.get(k) for k in ("n_rows", "row_hash")}
    same = index_hash(df) == expected and sorted(df.columns) == manifest["columns"]
    return df if same and all(manifest.get(k) == v for k, v in facts.items()) else None


def index_hash(df: DataFrame) -> dict:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("row_id").cast("decimal(38,0)")).alias("h")).first()
    return {"n_rows": row["n"], "row_hash": str(row["h"])}


def _within(spark: SparkSession, path: str, max_bytes: int) -> None:
    """Raises where the files of an upload are larger than allowed; only their lengths are read."""
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    if size > max_bytes:
        raise ValueError(f"{size} bytes, at most {max_bytes} are allowed")


def _checked(df: DataFrame, required: list[str], max_rows: int) -> DataFrame:
    """``df`` with its required columns as finite doubles, or an error that says what is wrong."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    df = df.withColumns({c: F.expr(f"try_cast(`{c}` as double)") for c in required})
    unfit = [F.col(f"`{c}`").isNull() | F.isnan(f"`{c}`") | (F.abs(f"`{c}`") == float("inf")) for c in required]
    facts = df.agg(F.count("*").alias("n"), F.count_if(F.greatest(*unfit, F.lit(False), F.lit(False))).alias("bad")).first()
    if not facts["n"] or facts["n"] > max_rows or facts["bad"]:
        raise ValueError(f"{facts['n']} rows (1 to {max_rows} are allowed), {facts['bad']} with missing or unreadable values")
    return df


def read_scoring_csv(spark: SparkSession, path: str, required: list[str], max_rows: int = 200_000, max_bytes: int = 25 << 20) -> DataFrame:
    """An uploaded batch: required columns of finite numbers, other columns allowed, limits on rows and bytes."""
    _within(spark, path, max_bytes)
    return _checked(spark.read.option("header", True).csv(path), required, max_rows)


def read_scoring_json(spark: SparkSession, path: str, required: list[str], max_rows: int = 200_000, max_bytes: int = 25 << 20) -> DataFrame:
    """The same from JSON: one object a line, or an array of objects on one or many lines; text that is no JSON raises."""
    _within(spark, path, max_bytes)
    many_lines = not spark.read.text(path).where(F.trim("value").rlike(r"^\[\s*$")).isEmpty()
    return _checked(spark.read.json(path, mode="FAILFAST", multiLine=many_lines), required, max_rows)


def events_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic trial over ``events``: arm by arithmetic on the id, outcomes by type, features by value and time."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    treated = (F.col("event_id") * 7919 + 13) % 100 < 85
    kind = lambda *names: F.col("event_type").isin(*names)
    return e.select(
        F.col("event_id").alias("row_id"), treated.cast("int").alias("treatment"), kind("purchase").cast("int").alias("conversion"), kind("purchase", "click", "view").cast("int").alias("visit"),
        (treated & kind("click", "view")).cast("int").alias("exposure"), F.col("value").alias("f0"), F.hour("ts").cast("double").alias("f1"), F.dayofmonth("ts").cast("double").alias("f2"),
        k.alias("f3"), F.least("value", F.lit(25.0)).alias("f4"), F.when(k < 40, 0.0).otherwise(k).alias("f5"),
    )


def orders_trial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over ``orders``, for timing."""
    o = table(spark, sf_dir, "orders")
    treated = (F.col("o_orderkey") * 7919 + 13) % 100 < 85
    done, urgent = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "1-URGENT"
    c = (F.col("o_custkey") % 97).cast("double")
    return o.select(
        F.col("o_orderkey").alias("row_id"), treated.cast("int").alias("treatment"), (done & urgent).cast("int").alias("conversion"), done.cast("int").alias("visit"),
        (treated & (F.col("o_orderpriority") == "2-HIGH")).cast("int").alias("exposure"), F.col("o_totalprice").alias("f0"), F.month("o_orderdate").cast("double").alias("f1"), F.dayofmonth("o_orderdate").cast("double").alias("f2"),
        c.alias("f3"), F.least("o_totalprice", F.lit(100000.0)).alias("f4"), F.when(c < 40, 0.0).otherwise(c).alias("f5"),
    )
