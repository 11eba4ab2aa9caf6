"""Artifacts of runs: predictions by model, CSV and JSON tables, file hashes, logs."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyarrow.fs import FileSystem, LocalFileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import ship_package
from lodestone.sources.snapshots import Snapshots

HASHES = pa.schema([("path", pa.string()), ("length", pa.int64()), ("sha256", pa.string())])


def write_predictions(scores: DataFrame, path: str) -> None:
    """Long scores (row_id, model, score), a folder a model; writing one model again leaves the others."""
    scores.select("row_id", "score", "model").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(path)


def read_predictions(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    """The scores of some models; folders of others are not read."""
    d = spark.read.parquet(path)
    return d if models is None else d.where(F.col("model").isin(models))


def replace_csv(df: DataFrame, path: str) -> int:
    """One table as CSV with a header, as the next version of the snapshots at ``path``; see ``read_csv``.

    Nothing is overwritten: readers see the old version whole until the new one's record is there, and a failed job
    leaves the old one. Versions but the newest two go.
    """
    table = Snapshots(df.sparkSession, path)
    number = table.publish(df, "csv")
    table.expire(keep=2)
    return number


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return Snapshots(spark, path).read()


def write_json(spark: SparkSession, facts: dict, path: str) -> None:
    """A manifest, protocol or summary: one JSON object with sorted keys."""
    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()))


def file_hashes(spark: SparkSession, path: str, chunk: int = 8 << 20) -> DataFrame:
    """(path, length, sha256) of each file, of whatever size: executors read it in pieces of ``chunk`` bytes.

    Only names and sizes are listed as rows; files are dealt out evenly and must be open to all executors. Empty files,
    which Spark's listing leaves out, have no row.
    """
    ship_package(spark)
    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    return listed.repartition(spark.sparkContext.defaultParallelism).mapInArrow(partial(_hashed, chunk=chunk), "path string, length long, sha256 string")


def _hashed(it: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        sums = []
        for path in batch.column("path").to_pylist():
            place = urlsplit(path)
            # a URI is escaped; a plain path is not a URI to Arrow
            files, name = (LocalFileSystem(), unquote(place.path)) if place.scheme in ("", "file") else FileSystem.from_uri(path)
            state = hashlib.sha256()
            with files.open_input_stream(name, buffer_size=0) as stream:
                while piece := stream.read(chunk):
                    state.update(piece)
            sums.append(state.hexdigest())
        yield pa.RecordBatch.from_pydict({"path": batch.column("path"), "length": batch.column("length"), "sha256": sums}, schema=HASHES)


def scrape_log(spark: SparkSession, path: str, seconds: str = r"fit[^0-9]*([0-9.]+) ?s", rows: str = r"([0-9,]+) rows") -> DataFrame:
    """(file, fit_seconds, n_rows): the last numbers that two patterns find in each log; null where there is none."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    found = lambda p: F.nullif(F.regexp_extract("value", p, 1), F.lit(""))
    last = lambda p: F.max_by(found(p), F.when(found(p).isNotNull(), F.col("at")))
    out = lines.groupBy("file").agg(last(seconds).alias("s"), last(rows).alias("n"))
    return out.select(F.element_at(F.split("file", "/"), -1).alias("file"), F.col("s").cast("double").alias("fit_seconds"), F.regexp_replace("n", ",", "").cast("long").alias("n_rows"))


def utc_iso(time: Column) -> Column:
    """A time as text like 2024-01-31T23:59:00Z, in UTC."""
    return F.date_format(F.to_utc_timestamp(time, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso(text: Column) -> Column:
    """The time of such a text; null if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ssX"))


def base_fields(df: DataFrame, **facts) -> DataFrame:
    """``df`` with a run's provenance, counts and versions before its own columns, which win where names meet."""
    extra = {k: F.lit(v) for k, v in sorted(facts.items()) if k not in df.columns}
    return df.select(*[c.alias(k) for k, c in extra.items()], "*")
