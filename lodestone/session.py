"""Session helpers shared by every operator: the shared folder and lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (a local session, as in tests) a temporary folder takes its place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    found = tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def narrow(df: DataFrame) -> DataFrame:
    """``df`` by one task a core, each of which takes several shuffle partitions one after another.

    For tables of few columns between two shuffles, where hundreds of tasks would cost more than their rows.
    """
    return df.coalesce(df.sparkSession.sparkContext.defaultParallelism)


def discard(df: DataFrame) -> None:
    """Deletes the files of a materialized table that no later plan reads."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/lodestone-" in path:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark's context cleaner drop the shuffles and broadcasts of plans that are gone.

    It acts only after a collection in the driver, which by default is asked for every half hour; a loop of many
    small jobs should not keep its files for as long.
    """
    spark._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors' Python once a session, so that functions of it can run there."""
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    zipped = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="lodestone-package-"), "lodestone_package"), "zip", os.path.dirname(here), os.path.basename(here))
    context.addPyFile(zipped)
    context._lodestone_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
