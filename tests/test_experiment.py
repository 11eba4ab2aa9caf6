"""Versions survive writers that stop anywhere; experiments resume, and refuse what was changed."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestone.operators.experiment import OutOfFold, common_seeds
from lodestone.sources.snapshots import Snapshots, content_hash


def test_a_reader_in_a_loop_never_fails(spark, tmp_path):
    table, stop, seen, failed = Snapshots(spark, f"{tmp_path}/t"), threading.Event(), [], []
    table.publish(spark.range(10).toDF("x"))

    def look():
        while not stop.is_set():
            try:
                seen.append(table.read().count())
            except Exception as error:  # noqa: BLE001
                failed.append(error)

    reader = threading.Thread(target=look)
    reader.start()
    for n in range(11, 19):
        table.publish(spark.range(n).toDF("x"))
    stop.set()
    reader.join()
    assert not failed and seen == sorted(seen) and table.read().count() == 18
    assert table.expire(keep=1) == 8 and table.read(verify=True).count() == 18


def test_a_writer_that_stops_leaves_the_version_before(spark, tmp_path, monkeypatch):
    table = Snapshots(spark, f"{tmp_path}/t")
    with pytest.raises(FileNotFoundError):
        table.read()
    table.publish(spark.range(3).toDF("x"))
    with pytest.raises(Exception, match="stop"):  # while rows are written
        table.publish(spark.range(9).select(F.when(F.col("id") > 7, F.raise_error("stop").cast("long")).otherwise(F.col("id")).alias("x")))
    assert table.read(verify=True).count() == 3

    def stop(record):
        raise RuntimeError("stop")

    with monkeypatch.context() as m:  # after the rows, before the record
        m.setattr(table, "_commit", stop)
        with pytest.raises(RuntimeError):
            table.publish(spark.range(9).toDF("x"))
    assert table.read(verify=True).count() == 3 and table.publish(spark.range(4).toDF("x")) == 2


def test_content_hash(spark):
    a = spark.createDataFrame([(1, None), (None, 1), (2, 2)], "x int, y int")
    assert content_hash(a) == content_hash(a.select("y", "x").orderBy("x").repartition(3))
    others = [a.select(F.col("x").alias("y"), F.col("y").alias("x")).where("x = 2"), a.union(a), a.withColumn("x", F.coalesce("x", F.lit(0))), a.withColumn("x", F.col("x").cast("long")), a.where("false")]
    assert len({content_hash(d) for d in [a, *others]}) == 6


def test_stopped_runs_resume_and_changes_are_refused(spark, tmp_path):
    df = spark.range(90).select(F.col("id").alias("row_id"), (F.col("id") % 3).cast("int").alias("fold"), (F.col("id") * 0.5).alias("x"))
    store, fits = OutOfFold(spark, f"{tmp_path}/oof"), []

    def mean(stop_at=None):
        def build(train):
            fits.append(1)
            if len(fits) == stop_at:
                raise RuntimeError("killed")
            m = train.agg(F.avg("x")).first()[0]
            return lambda d: d.withColumn("score", F.col("x") - F.lit(m))

        return build

    with pytest.raises(RuntimeError, match="killed"):
        store.run(df, {"mean": mean(2)}, {"trees": 1})
    resumed = store.run(df, {"mean": mean()}, {"trees": 1})
    assert len(fits) == 4  # the first fold was kept
    whole = OutOfFold(spark, f"{tmp_path}/other").run(df, {"mean": mean()}, {"trees": 1})
    assert content_hash(resumed) == content_hash(whole) and resumed.count() == 90
    key = store.key(df, {"trees": 1})
    assert store.timings(key, ["mean"], [0, 1, 2]).agg(F.sum("n_rows")).first()[0] == 90

    n = len(fits)
    store.run(df, {"mean": mean()}, {"trees": 1})
    assert len(fits) == n
    store.run(df.withColumn("x", F.when(F.col("row_id") == 5, 7.0).otherwise(F.col("x"))), {"mean": mean()}, {"trees": 1})
    store.run(df, {"mean": mean()}, {"trees": 2})
    assert len(fits) == n + 6  # a changed row and a changed parameter fit anew

    with pytest.raises(Exception, match="not finite"):
        store.run(df, {"bad": lambda train: lambda d: d.withColumn("score", F.lit(float("nan")))}, {"trees": 1})
    (folder,) = (Path(tmp_path) / "oof" / key / "mean" / "1" / "versions").iterdir()
    spark.range(30).select(F.col("id").alias("row_id"), F.lit(1).alias("fold"), F.lit("mean").alias("model"), F.lit(0.0).alias("score")).write.mode("overwrite").parquet(str(folder))
    with pytest.raises(ValueError, match="does not hold"):
        store.read(key, ["mean"], [0, 1, 2])


def test_folds_must_be_disjoint(spark, tmp_path):
    df = spark.range(8).select(F.col("id").alias("row_id"), (F.col("id") % 2).cast("int").alias("fold"))
    df = df.unionByName(df.where("row_id = 3").withColumn("fold", F.lit(0)))
    with pytest.raises(ValueError, match="disjoint"):
        OutOfFold(spark, f"{tmp_path}/oof").run(df, {"one": lambda train: lambda d: d.withColumn("score", F.lit(1.0))}, {})


def test_common_seeds(spark):
    results = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2), ("b", 2), ("b", 3)], "candidate string, validation_seed int")
    assert [r[0] for r in common_seeds(results).collect()] == [2]
