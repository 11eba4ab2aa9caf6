"""Connected components: what they find, and how much they write for it."""

from pyspark.sql import functions as F

from lodestone.llm import components


def test_flat_edges_are_written_once_by_few_tasks(spark, monkeypatch):
    """Stars need no round; whatever the number of shuffle partitions, a core writes one file."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    written, materialize = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda df: written.append(materialize(df)) or written[-1])
    hubs = [spark.range(at + 1, at + 200).select(F.lit(at).cast("long").alias("src"), F.col("id").alias("dst")) for at in (0, 5000)]
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = {r.node: r.component for r in components.connected_components(hubs[0].unionByName(hubs[1]).coalesce(1)).collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert got == {i: i // 5000 * 5000 for i in [*range(200), *range(5000, 5200)]}
    assert len(written) == 1 and len(written[0].inputFiles()) <= spark.sparkContext.defaultParallelism
