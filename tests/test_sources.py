"""Sources, sinks, registry helpers, streams and contracts on small tables."""

import gzip
import hashlib
import json
import tracemalloc

import pyarrow as pa
import pytest
from lodestone.operators import ensemble as E
from lodestone.operators import registry as R
from lodestone.operators import reporting as T
from lodestone.plans.queries import trial
from lodestone.sources import artifacts as A
from lodestone.sources import trial as S
from lodestone.streaming.arm_counts import stream_arm_counts
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as K


def test_trial_csv(spark, tmp_path):
    names = [*S.FEATURES, *S.BINARIES]
    lines = [",".join(names)] + [",".join([str(i / 2)] * 12 + [str(i % 2), "0", "1", "0"]) for i in range(50)]
    with gzip.open(f"{tmp_path}/t.csv.gz", "wt") as f:
        f.write("\n".join(lines))
    got = S.read_trial_csv(spark, f"{tmp_path}/t.csv.gz").orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == list(range(50)) and got[3]["f0"] == 1.5 and got[3]["treatment"] == 1


def test_binary_column(spark, tmp_path):
    spark.createDataFrame([(1, 0, 7), (2, 1, 7)], "row_id long, treatment int, other int").write.parquet(f"{tmp_path}/b")
    assert S.read_binary_column(spark, f"{tmp_path}/b", "treatment").columns == ["row_id", "treatment"]
    with pytest.raises(ValueError, match="0 or 1"):
        S.read_binary_column(spark, f"{tmp_path}/b", "other")


def test_manifest(spark, tmp_path):
    df = spark.range(20).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("x"))
    S.write_with_manifest(df, f"{tmp_path}/m", role="fit", outcome="conversion")
    assert S.read_with_manifest(spark, f"{tmp_path}/m", role="fit").count() == 20
    assert S.read_with_manifest(spark, f"{tmp_path}/m", role="test") is None
    df.where("row_id < 19").write.mode("overwrite").parquet(f"{tmp_path}/m/data")
    assert S.read_with_manifest(spark, f"{tmp_path}/m") is None


def test_scoring_csv(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text("a,b,c\n1,2,x\n3,4,y\n")
    assert S.read_scoring_csv(spark, str(path), ["a", "b"]).agg(F.sum("b")).first()[0] == 6
    for required, most in ((["z"], 10), (["c"], 10), (["a"], 1)):
        with pytest.raises(ValueError):
            S.read_scoring_csv(spark, str(path), required, most)


def test_orders_trial(spark, sf_dir):
    assert S.orders_trial(spark, sf_dir).columns == trial(spark, sf_dir).columns
    assert S.orders_trial(spark, sf_dir).where("treatment not in (0, 1) or conversion > visit").isEmpty()


def test_stream(spark, tmp_path):
    spark.sql("select timestamp'2024-01-01 00:10:00' + make_interval(0, 0, 0, 0, id div 10, 0, 0) ts, cast(id % 2 as int) treatment, cast(id % 5 = 0 as int) conversion from range(40)").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    q = stream_arm_counts(stream).writeStream.format("memory").queryName("arms").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(tuple(r)[1:] for r in spark.table("arms").collect()) == [(5, 5, 1, 1)] * 4


def test_registry_helpers(spark):
    old = spark.createDataFrame([("r1", 0.5)], "run_id string, qini double")
    schema = K.StructType().add("run_id", K.StringType()).add("outcome", K.StringType()).add("n", K.IntegerType())
    assert R.migrate(old, schema, {"outcome": "visit"}).collect() == [("r1", "visit", None, 0.5)]
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1)], "k string, s int")
    assert [tuple(r) for r in R.duplicate_keys(rows, ["k", "s"]).collect()] == [("a", 1, 2)]
    configs = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "name string, hash string")
    assert [r["name"] for r in R.conflicting_configs(configs).collect()] == ["a"]
    ranking = spark.createDataFrame([("ref", 0.1, True), ("a", 0.5, True), ("b", 0.6, False), ("c", 0.4, True), ("d", 0.3, True)], "model string, mean_metric double, eligible boolean")
    assert {r["model"] for r in R.shortlist(ranking, ["ref"], 2).collect()} == {"ref", "a", "c"}


def test_ensembles(spark):
    rows = [(i, i % 2, i / 100, 1 - i / 100, i / 100) for i in range(100)]
    df = spark.createDataFrame(rows, "row_id long, fold int, good double, bad double, dr double")
    w = E.q_aggregation(df, ["good", "bad"], "dr")
    assert w["good"] > 0.9 and abs(sum(w.values()) - 1) < 1e-6
    assert E.apply_weights(df, {"good": 0.25, "bad": 0.75}).where("row_id = 20").first()["ensemble"] == pytest.approx(0.65)
    out = E.cross_fitted_ensemble(df, ["good", "bad"], "dr", "fold")
    assert out.count() == 100 and out.agg(F.corr("ensemble", "dr")).first()[0] > 0.9


def test_contracts(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    twice = spark.createDataFrame([(1, 0.1), (1, 0.2)], "k int, w double")
    with pytest.raises(PySparkException, match="repeats a key"):
        T.many_to_one(left, twice, ["k"]).collect()
    odd = spark.createDataFrame([(float("nan"), None), (1.5, "x")], "a double, b string")
    assert [json.loads(r["json"]) for r in T.clean_json(odd).collect()] == [{"a": None, "b": None}, {"a": 1.5, "b": "x"}]
    scored = spark.createDataFrame([("a", float("nan")), ("b", 1.0), ("b", 2.0), ("c", 1.0)], "model string, score double")
    curve = spark.createDataFrame([(m, 0.1, v) for m, v in (("ref", 1.0), ("a", 2.0), ("b", 0.5), ("c", 2.0))], "model string, budget double, value double")
    assert dict(T.early_stop(scored, curve, "ref", 2).collect()) == {"a": "not_finite", "b": "dominated", "c": "too_few_values"}


def test_predictions(spark, tmp_path):
    rows = lambda m, v: spark.createDataFrame([(i, m, v) for i in range(3)], "row_id long, model string, score double")
    A.write_predictions(rows("a", 1.0).unionByName(rows("b", 2.0)), f"{tmp_path}/p")
    A.write_predictions(rows("b", 3.0), f"{tmp_path}/p")
    assert A.read_predictions(spark, f"{tmp_path}/p").agg(F.sum("score")).first()[0] == 12
    assert A.read_predictions(spark, f"{tmp_path}/p", ["b"]).count() == 3


def test_tables_and_manifests(spark, tmp_path):
    for n in (5, 3):
        A.replace_csv(spark.range(n), f"{tmp_path}/t.csv")
        assert A.read_csv(spark, f"{tmp_path}/t.csv").count() == n
    A.write_json(spark, {"b": 1, "a": [1, None]}, f"{tmp_path}/m")
    assert A.read_json(spark, f"{tmp_path}/m") == {"a": [1, None], "b": 1}
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert A.file_hashes(spark, f"{tmp_path}/x.bin").first()["sha256"] == hashlib.sha256(b"abc").hexdigest()


def test_logs(spark, tmp_path):
    (tmp_path / "a.log").write_text("read 1,200 rows\nfit in 3.5 s\nfit took 4.25 s\n")
    (tmp_path / "b.log").write_text("nothing\n")
    assert sorted(map(tuple, A.scrape_log(spark, f"{tmp_path}/*.log").collect())) == [("a.log", 4.25, 1200), ("b.log", None, None)]


def test_hashes_of_files_larger_than_a_chunk(spark, tmp_path):
    """Sizes around the chunk's edge, a name that is escaped and an empty file, which has no row."""
    sizes = {"a": 0, "b": 1023, "c": 1024, "d": 1025, "e f%": 70_001}
    for name, size in sizes.items():
        (tmp_path / name).write_bytes(bytes(i * 7 % 251 for i in range(size)))
    got = {r["sha256"]: r["length"] for r in A.file_hashes(spark, str(tmp_path), chunk=1024).collect()}
    assert got == {hashlib.sha256((tmp_path / name).read_bytes()).hexdigest(): size for name, size in sizes.items() if size}


def test_hashing_reads_in_pieces(tmp_path):
    big, piece = tmp_path / "big", b"\x00" * (1 << 20)
    with open(big, "wb") as f:
        f.truncate(400 << 20)
    want = hashlib.sha256()
    for _ in range(400):
        want.update(piece)
    batch = pa.RecordBatch.from_pydict({"path": [f"file:{big}"], "length": [400 << 20]})
    tracemalloc.start()
    (out,) = A._hashed(iter([batch]), 1 << 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.column("sha256")[0].as_py() == want.hexdigest()
    assert peak < 20 << 20
