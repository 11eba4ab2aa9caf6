"""Ranking curves, their areas, calibration and decile tables. Rows with equal scores enter together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.order_statistics import quantiles
from lodestone.operators.ranking import cumulate, row_numbers, tie_groups
from lodestone.session import materialize


def _zero(a, b) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def _curve(groups: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by, x, y) at the ends of tie groups, with the origin."""
    c = cumulate(groups, by)
    origin = groups.select(*by).distinct() if by else groups.limit(1).select()
    points = c.select(*by, F.col("N").cast("double").alias("x"), value.cast("double").alias("y"))
    return points.unionByName(origin.select(*by, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))


def qini_value() -> Column:
    return F.col("Y1") - _zero(F.col("Y0") * F.col("N1"), F.col("N") - F.col("N1"))


def uplift_value() -> Column:
    return (_zero(F.col("Y1"), F.col("N1")) - _zero(F.col("Y0"), F.col("N") - F.col("N1"))) * F.col("N")


def qini_curve(scored: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    return _curve(tie_groups(scored, by=by, **names), qini_value(), by or [])


def uplift_curve(scored: DataFrame, by: list[str] | None = None, **names) -> DataFrame:
    return _curve(tie_groups(scored, by=by, **names), uplift_value(), by or [])


def area(curve: DataFrame, by: list[str]) -> DataFrame:
    """Trapezoid area of (x, y), and the last point. Ranges of x are summed by themselves, then joined end to end."""
    parted = materialize(curve.repartitionByRange(*by, "x").withColumn("_range", F.spark_partition_id()))
    w = Window.partitionBy(*by, "_range").orderBy("x")
    step = (F.col("x") - F.lag("x").over(w)) * (F.col("y") + F.lag("y").over(w)) / 2
    point = F.struct("x", "y")
    parts = parted.withColumn("_s", step).groupBy(*by, "_range").agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("_a"), F.min(point).alias("_first"), F.max(point).alias("last"))
    before = F.lag("last").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_range"))  # a row a range
    parts = parts.withColumn("_before", before)
    gap = (F.col("_first.x") - F.col("_before.x")) * (F.col("_first.y") + F.col("_before.y")) / 2
    return parts.groupBy(*by).agg((F.sum("_a") + F.coalesce(F.sum(gap), F.lit(0.0))).alias("area"), F.max("last").alias("last"))


def normalised_area(scored: DataFrame, kind: str, by: list[str] | None = None, **names) -> DataFrame:
    """(by, qini_score) or (by, auuc_score): area over the diagonal's, as a share of the best ranking's; null if that is 0.

    The best ranking has at most four tie groups, told by the counts of arms and outcomes alone.
    """
    by = by or []
    g = materialize(tie_groups(scored, by=by, **names))
    value, column = (qini_value(), "qini_score") if kind == "qini" else (uplift_value(), "auuc_score")
    total = g.groupBy(*by).agg(*[F.sum(c).cast("double").alias(c) for c in ("n", "n1", "y1", "y0")])
    n0, a, b = F.col("n") - F.col("n1"), F.col("y1"), F.col("y0")  # a: treated events, b: control events
    if kind == "qini":  # scores 1: treated events, 0: rows without event, -1: control events
        cells = [(F.lit(1.0), a, a, a, F.lit(0.0)), (F.lit(0.0), F.col("n") - a - b, F.col("n1") - a, F.lit(0.0), F.lit(0.0)), (F.lit(-1.0), b, F.lit(0.0), F.lit(0.0), b)]
    else:  # 2 * (y = t) + (y if more control than treated rows are "wrong" else t)
        more = b > F.col("n1") - a  # (t=0, y=1) against (t=1, y=0)
        cells = [
            (F.lit(3.0), a, a, a, F.lit(0.0)), (F.lit(2.0), n0 - b, F.lit(0.0), F.lit(0.0), F.lit(0.0)),
            (F.when(more, 0.0).otherwise(1.0), F.col("n1") - a, F.col("n1") - a, F.lit(0.0), F.lit(0.0)), (F.when(more, 1.0).otherwise(0.0), b, F.lit(0.0), F.lit(0.0), b),
        ]
    row = lambda c: F.struct(*[x.cast("double").alias(k) for x, k in zip(c, ("score", "n", "n1", "y1", "y0"), strict=True)])
    best = total.select(*by, F.explode(F.array(*[row(c) for c in cells])).alias("c")).select(*by, "c.*").where("n > 0")
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    cum = best.select(*by, *[F.sum(c).over(w).alias(k) for k, c in (("N", "n"), ("N1", "n1"), ("Y1", "y1"), ("Y0", "y0"))])
    points = cum.select(*by, F.col("N").alias("x"), value.alias("y")).unionByName(total.select(*by, F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
    perfect = area(points, by).select(*by, F.col("area").alias("_p"), F.col("last").alias("_end"))
    actual = area(_curve(g, value, by), by)
    d = actual.join(perfect, by) if by else actual.join(perfect)
    line = F.col("_end.x") * F.col("_end.y") / 2
    return d.select(*by, F.when(F.abs(F.col("_p") - line) > 0, F.try_divide(F.col("area") - line, F.col("_p") - line)).alias(column))


def toc_curve(scored: DataFrame, signal: str, by: list[str] | None = None) -> DataFrame:
    """(by, q, toc, share): mean signal of the top share q less the mean of all, at the ends of tie groups."""
    by = by or []
    c = cumulate(tie_groups(scored, by=by, signal=signal), by)
    total = c.groupBy(*by).agg(F.max(F.struct("N", "G")).alias("_t"))
    c = c.join(total, by) if by else c.join(total)
    return c.select(*by, (F.col("N") / F.col("_t.N")).alias("q"), (F.col("G") / F.col("N") - F.col("_t.G") / F.col("_t.N")).alias("toc"), (F.col("g_n") / F.col("_t.N")).alias("share"))


def rate(scored: DataFrame, signal: str, by: list[str] | None = None) -> DataFrame:
    """(by, autoc, rate_qini): weighted Riemann sums of the TOC curve."""
    t = toc_curve(scored, signal, by)
    return t.groupBy(*(by or [])).agg(F.sum(F.col("toc") * F.col("share")).alias("autoc"), F.sum(F.col("q") * F.col("toc") * F.col("share")).alias("rate_qini"))


def interpolate(points: DataFrame, grid: list[float], by: list[str], x: str = "x", y: str = "y", at: str = "budget") -> DataFrame:
    """y at each grid value by straight lines between points; the ends hold beyond them."""
    g = F.explode(F.array(*[F.lit(float(b)) for b in grid])).alias(at)
    return between(points.select(*by, F.col(x).alias("x"), F.col(y).alias("y"), g), by, at)


def between(points: DataFrame, by: list[str], at: str = "budget") -> DataFrame:
    """(by, at, value): y at ``at`` by a straight line between the nearest of the points (by, at, x, y); the ends hold beyond them."""
    p = points.select(*by, at, F.struct("x", "y").alias("p"))
    lo, hi = F.max(F.when(F.col("p.x") <= F.col(at), F.col("p"))), F.min(F.when(F.col("p.x") >= F.col(at), F.col("p")))
    d = p.groupBy(*by, at).agg(lo.alias("lo"), hi.alias("hi"))
    lo, hi = F.coalesce("lo", "hi"), F.coalesce("hi", "lo")
    slope = F.coalesce(F.try_divide(hi["y"] - lo["y"], hi["x"] - lo["x"]), F.lit(0.0))
    return d.select(*by, at, (lo["y"] + slope * (F.col(at) - lo["x"])).alias("value"))


def policy_curve(scored: DataFrame, signal: str, budgets: list[float], by: list[str] | None = None, weight: Column | None = None) -> DataFrame:
    """(by, budget, value): value of targeting the top share, per row of the whole table."""
    by = by or []
    c = cumulate(tie_groups(scored, by=by, signal=signal, weight=weight), by)
    total = c.groupBy(*by).agg(F.max("N").alias("_n"))
    c = c.join(total, by) if by else c.join(total)
    points = c.select(*by, (F.col("N") / F.col("_n")).alias("x"), (F.col("G") / F.col("_n")).alias("y"))
    zero = total.select(*by, F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return interpolate(points.unionByName(zero), budgets, by)


def policy_area(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoid over the budgets, over their width; a single budget gives its value."""
    by = by or []
    a = area(curve.withColumnsRenamed({"budget": "x", "value": "y"}), by).withColumnRenamed("area", "_a")
    e = curve.groupBy(*by).agg(F.min("budget").alias("_lo"), F.max("budget").alias("_hi"), F.max("value").alias("_one"))
    d = a.join(e, by) if by else a.join(e)
    return d.select(*by, F.when(F.col("_hi") > F.col("_lo"), F.try_divide(F.col("_a"), F.col("_hi") - F.col("_lo"))).otherwise(F.col("_one")).alias("policy_area"))


def chunked(scored: DataFrame, k: int, order: list[Column], out: str = "chunk") -> DataFrame:
    """``scored`` cut into k parts of a total order; the first n mod k have one row more."""
    n = scored.agg(F.count("*").alias("_n"))
    d = row_numbers(scored, order).join(n)
    base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    edge = extra * (base + 1)
    at = F.when(F.col("rn") <= edge, F.ceil(F.col("rn") / (base + 1))).otherwise(extra + F.ceil(F.try_divide(F.col("rn") - edge, base)))
    return d.withColumn(out, at.cast("int")).drop("rn", "_n")


def euce(scored: DataFrame, k: int = 10, treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Expected uplift calibration error over k parts by rising score; parts without an arm do not count."""
    t, y = F.col(treatment), F.col(outcome)
    b = chunked(scored, k, [F.asc("score"), F.asc("row_id")]).groupBy("chunk").agg(F.count("*").alias("n"), F.avg(F.when(t == 1, y)).alias("r1"), F.avg(F.when(t == 0, y)).alias("r0"), F.avg("score").alias("s"))
    b = b.where("r1 is not null and r0 is not null")
    return b.agg(F.try_divide(F.sum(F.col("n") * F.abs(F.col("r1") - F.col("r0") - F.col("s"))), F.sum("n")).alias("euce"))


def decile_table(scored: DataFrame, k: int = 10, treatment: str = "treatment", outcome: str = "outcome") -> DataFrame:
    """Uplift of each part by falling score (ties by falling row_id), with the 1.96 interval and running totals."""
    t, y = F.col(treatment), F.col(outcome)
    d = chunked(scored, k, [F.desc("score"), F.desc("row_id")]).groupBy("chunk").agg(F.sum(t).alias("n1"), F.sum(1 - t).alias("n0"), F.sum(t * y).alias("y1"), F.sum((1 - t) * y).alias("y0"))
    w = Window.partitionBy(F.lit(0)).orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    up = lambda y1, n1, y0, n0: F.try_divide(y1, n1) - F.try_divide(y0, n0)
    r1, r0 = F.try_divide("y1", "n1"), F.try_divide("y0", "n0")
    se = F.sqrt(F.try_divide(r1 * (1 - r1), F.col("n1")) + F.try_divide(r0 * (1 - r0), F.col("n0")))
    uplift, run = r1 - r0, up(F.sum("y1").over(w), F.sum("n1").over(w), F.sum("y0").over(w), F.sum("n0").over(w))
    return d.select(F.col("chunk").alias("decile"), "n1", "n0", uplift.alias("uplift"), (uplift - 1.96 * se).alias("ci_low"), (uplift + 1.96 * se).alias("ci_high"), run.alias("cumulative_uplift"), (uplift * (F.col("n1") + F.col("n0"))).alias("incremental"))


def score_diagnostics(scored: DataFrame, by: list[str] | None = None, near: float = 1e-4) -> DataFrame:
    s, by = F.col("score"), by or []
    found = scored.groupBy(*by).agg(
        F.avg(s).alias("mean"), F.stddev_pop(s).alias("std"), F.min(s).alias("min"), F.max(s).alias("max"), F.avg((s < 0).cast("int")).alias("negative_share"), F.avg((F.abs(s) < near).cast("int")).alias("near_zero_share"),
        F.count_distinct(s).alias("n_distinct"),
    )
    q = quantiles(scored, "score", [0.01, 0.5, 0.99], by)
    q = q.select(*by, *[F.col("q")[i].alias(name) for i, name in enumerate(("p01", "p50", "p99"))])
    return found.join(q, by or F.lit(True), "left")


def score_histogram(scored: DataFrame, bins: int, by: list[str]) -> DataFrame:
    """Densities on edges shared by all: from the least 0.5 % to the greatest 99.5 % quantile; rows outside are left out."""
    q = quantiles(scored, "score", [0.005, 0.995], by).agg(F.min(F.col("q")[0]).alias("lo"), F.max(F.col("q")[1]).alias("hi"))
    d = scored.join(q).where("score between lo and hi and hi > lo")
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.least(F.floor((F.col("score") - F.col("lo")) / width), F.lit(bins - 1)).cast("int")
    h = d.groupBy(*by, at.alias("bin"), "lo", "hi").agg(F.count("*").alias("c"))
    n = d.groupBy(*by).agg(F.count("*").alias("n"))
    return h.join(n, by).select(*by, "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("c") / (F.col("n") * width)).alias("density"))
