"""Connected components by alternating large-star and small-star contraction, each task's edges first made a forest."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.session import collect_garbage, discard, materialize, narrow, ship_package


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) for every node that an edge touches; component is the smallest node reachable.

    Nulls and loops link nothing. Each round hangs neighbours onto the smallest node known to them, so the
    number of rounds grows with the logarithm of the longest path. A hub's neighbours are never gathered:
    only a minimum (combined on the map side) meets in one task, and the join back can be split. Before a round is
    written each task replaces the edges that it holds, up to a bounded number at a time, by edges to the smallest
    node that they reach, so few rounds are left to do.
    """
    ship_package(edges.sparkSession)
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null and u <> v")
    e = _written(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while not _is_flat(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = narrow(both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, F.col("u") == F.col("k"))
        pairs = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")
        old, e = e, _written(small.select(pairs).select("e.u", "e.v").where("u <> v"))
        discard(old)
    collect_garbage(e.sparkSession)
    roots = e.groupBy("v").count().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _written(e: DataFrame) -> DataFrame:
    """The edges as forests in the shared folder, each edge once."""
    kind = e.schema["u"].dataType.simpleString()
    # one task for each core: the more a task holds, the less is left
    return materialize(narrow(narrow(e).mapInArrow(_forest, f"u {kind}, v {kind}").distinct()))


def _is_flat(e: DataFrame) -> bool:
    """Whether every node hangs on one node only, which hangs on none: then that is the smallest it reaches."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not narrow(ends.where("up > 1 or (up > 0 and down > 0)")).agg(F.count("*")).first()[0]


def _forest(it: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Edges from each node to the smallest one that the task's edges reach from it."""
    above: dict = {}
    schema = None

    def root(x):
        path = []
        while (up := above.get(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            above[p] = x
        return x

    def out() -> pa.RecordBatch:
        pairs = [(x, root(x)) for x in list(above)]
        pairs = [(x, r) for x, r in pairs if x != r]
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], schema.field(k).type) for k in (0, 1)], ["u", "v"])

    for batch in it:
        schema = batch.schema
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                above[max(a, b)] = min(a, b)
        if len(above) >= most:
            yield out()
            above.clear()
    if above:
        yield out()
