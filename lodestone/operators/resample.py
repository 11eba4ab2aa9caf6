"""Paired bootstraps: each row has one Poisson(1) weight a replicate, the same for all models and budgets.

Weights are a hash of (row_id, replicate, seed), made where they are needed: none are stored and no row is
repeated. Rows are dealt out once by ranges of (model, falling score); a task walks its range and holds the
running sums of all replicates at once, as vectors. Ranges' totals give each range its start, and its ends are
joined at last, so neither a model nor a long tie needs one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.signals import POISSON, uniform_digits
from lodestone.operators.curves import between, policy_area
from lodestone.session import materialize, ship_package

_M = np.uint64(0xFFFFFFFF)
#: Fixed values of the weights' hash, which the registered SQL repeats.
LOW, HIGH, TURN, SEED, ROUND = 1640531527, 668265263, 374761393, 1274126177, 73244475
_ROWS = 2048  # rows whose weights are held at once by a mean
_CELLS = 1 << 19  # weights that are held at once by a ranking
_RANGE = 200_000  # rows of a range


#: The least 32-bit hash of each count over 0.
_STEPS = [np.uint32(np.ceil(p * 4294967296.0)) for p in POISSON]
_AT_ONCE = 1 << 16  # weights made at once, which stay in a core's cache


def _mixed(x: np.ndarray) -> np.ndarray:
    """``x``, of 32-bit numbers, mixed in place; products keep their lower half."""
    for _ in range(2):
        x ^= x >> np.uint32(16)
        x *= np.uint32(ROUND)
    x ^= x >> np.uint32(16)
    return x


def weights(row_id: np.ndarray, replicates: int, seed: int) -> np.ndarray:
    """A row for each id, a column for each replicate: counts of a Poisson distribution with mean 1."""
    ids = row_id.astype(np.uint64)
    own = (((ids & _M) * np.uint64(LOW)) & _M) ^ (((ids >> np.uint64(32)) * np.uint64(HIGH)) & _M)
    turn = _mixed(((np.arange(replicates, dtype=np.uint64) * np.uint64(TURN) + np.uint64(seed * SEED)) & _M).astype(np.uint32))
    own, out = own.astype(np.uint32), np.empty((len(ids), replicates))
    rows = max(1, _AT_ONCE // replicates)
    for at in range(0, len(ids), rows):
        h = _mixed(own[at : at + rows, None] ^ turn[None])
        count = (h >= _STEPS[0]).view(np.uint8)
        for step in _STEPS[1:]:
            count += (h >= step).view(np.uint8)
        out[at : at + rows] = count
    return out


def _numbers(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(float)


def bootstrap_mean(df: DataFrame, columns: list[str], replicates: int, seed: int) -> DataFrame:
    """(replicate, policy, value): weighted sums of contributions over the number of rows - one pass, no sort."""
    ship_package(df.sparkSession)

    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(columns), replicates)), 0
        for batch in it:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                total += np.stack([_numbers(part, c) for c in columns]) @ weights(part.column("row_id").to_numpy(), replicates, seed)
            n += batch.num_rows
        yield pa.RecordBatch.from_pydict({"n": pa.array([n]), **{c: pa.array([t]) for c, t in zip(columns, total, strict=True)}})

    d = df.select("row_id", *columns).mapInArrow(sums, "n long, " + ", ".join(f"`{c}` array<double>" for c in columns))
    n = d.agg(F.sum("n").alias("_n"))
    long = d.select(F.explode(F.array(*[F.struct(F.lit(c).alias("policy"), F.col(c).alias("v")) for c in columns])).alias("p")).select("p.policy", F.posexplode("p.v").alias("replicate", "v"))
    return long.groupBy("replicate", "policy").agg(F.sum("v").alias("v")).join(n).select(F.col("replicate").cast("int").alias("replicate"), "policy", (F.col("v") / F.col("_n")).alias("value"))


#: What a row adds to each running sum, times its weight.
_SUMS = {"N": lambda t, y, g: np.ones(len(t)), "N1": lambda t, y, g: t, "Y1": lambda t, y, g: t * y, "Y0": lambda t, y, g: (1 - t) * y, "G": lambda t, y, g: g}
#: From running sums and totals (each a vector by replicate) the points of a curve: x, and rows of y.
Points = Callable[[dict[str, np.ndarray], dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray]]


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def _qini_points(s: dict, t: dict) -> tuple[np.ndarray, np.ndarray]:
    return s["N"], (s["Y1"] - _divide(s["Y0"] * s["N1"], s["N"] - s["N1"]))[None]


def _policy_points(s: dict, t: dict) -> tuple[np.ndarray, np.ndarray]:
    return _divide(s["N"], t["N"]), _divide(s["G"], t["N"])[None]


def _rate_points(s: dict, t: dict) -> tuple[np.ndarray, np.ndarray]:
    share, toc = _divide(s["N"], t["N"]), _divide(s["G"], s["N"]) - _divide(t["G"], t["N"])
    return share, np.stack((toc, share * toc))


def _by_tie(batch: pa.RecordBatch, ends: np.ndarray, sums: list[str], signal: str | None, replicates: int, seed: int) -> np.ndarray:
    """(sum, tie, replicate): what the rows up to each of ``ends`` add since the one before; the last end is the batch's."""
    w = weights(batch.column("row_id").to_numpy(), replicates, seed)
    t, y = _numbers(batch, "treatment"), _numbers(batch, "outcome")
    values = np.stack([_SUMS[s](t, y, _numbers(batch, signal) if signal else None) for s in sums])
    starts = np.append(0, ends[:-1])
    if len(ends) * 8 > len(t):  # short ties
        return np.stack([np.add.reduceat(w * v[:, None], starts, 0) for v in values])
    return np.stack([values[:, a:b] @ w[a:b] for a, b in zip(starts, ends, strict=True)], 1)


def ranked_draws(scored: DataFrame, sums: list[str], signal: str | None, points: Points, trapezoid: bool, grid: list[float], replicates: int, seed: int) -> DataFrame:
    """(model, totals, areas, values) of long scores: arrays by replicate.

    totals are the last of the running ``sums``, areas the integrals of each row of y over x, by trapezoids or by the value at
    the right end, from the origin on; values y's first row on ``grid``, by straight lines between points. Points
    stand at the ends of ties. Rows without a score or a model take no part. A range has about ``_RANGE`` rows however
    many there are, and a block of it is as many rows as fit ``_CELLS`` weights, so a task's memory does not grow.
    """
    spark = scored.sparkSession
    ship_package(spark)
    columns = ["row_id", "treatment", "outcome", *([signal] if signal else [])]
    d = scored.where("model is not null and score is not null").select("model", F.col("score").cast("double").alias("score"), *columns)
    order = [F.asc("model"), F.desc("score"), F.xxhash64("row_id")]  # a long tie is cut too
    d = materialize(d)
    ranges = max(spark.sparkContext.defaultParallelism, -(-d.count() // _RANGE))
    parted = materialize(d.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    block = max(1, _CELLS // replicates)
    shape = (len(sums), replicates)

    def total(table: pa.Table) -> pa.Table:
        found = np.zeros(shape)
        for batch in table.to_batches(max_chunksize=block):
            found += _by_tie(batch, np.array([batch.num_rows]), sums, signal, replicates, seed)[:, 0]
        score = table.column("score").to_numpy()
        return pa.table({"model": table.column("model").slice(0, 1), "_range": table.column("_range").slice(0, 1), "high": [float(score.max())], "low": [float(score.min())], "sums": [found.ravel()]})

    kind = d.schema["model"].dataType.simpleString()
    key = ["model", "_range"]
    totals = materialize(parted.groupBy(*key).applyInArrow(total, f"model {kind}, _range int, high double, low double, sums array<double>"))

    def starts(table: pa.Table) -> pa.Table:
        """Of a model's ranges, a row each: sums before them, the model's, and whether the last tie goes on."""
        table = table.sort_by("_range")
        own = np.stack(table.column("sums").to_numpy(zero_copy_only=False))
        before = np.cumsum(own, 0) - own
        high, low = table.column("high").to_numpy(), table.column("low").to_numpy()
        goes_on = np.append(low[:-1] == high[1:], False)
        return pa.table({"model": table.column("model"), "_range": table.column("_range"), "before": list(before), "all": [own.sum(0)] * len(own), "goes_on": goes_on})

    begun = totals.groupBy("model").applyInArrow(starts, f"model {kind}, _range int, before array<double>, all array<double>, goes_on boolean")

    def walk(table: pa.Table, start: pa.Table) -> pa.Table:
        held, all_ = (np.asarray(start.column(c)[0].values).reshape(shape) for c in ("before", "all"))
        named = lambda x: dict(zip(sums, x, strict=True))
        score = table.column("score").to_numpy()
        order = np.argsort(-score, kind="stable")
        table, score = table.take(pa.array(order)), score[order]
        end = np.append(score[1:] != score[:-1], not start.column("goes_on")[0].as_py())
        first = last = area = None
        low = np.full((len(grid), 2, replicates), np.nan)
        high = np.full((len(grid), 2, replicates), np.nan)
        for at in range(0, len(score), block):
            batch = table.slice(at, block).combine_chunks().to_batches()[0]
            ends = np.flatnonzero(end[at : at + block]) + 1
            open_ = not len(ends) or ends[-1] < batch.num_rows  # the block's last tie goes on
            cum = held[:, None] + np.cumsum(_by_tie(batch, np.append(ends, batch.num_rows) if open_ else ends, sums, signal, replicates, seed), 1)
            held = cum[:, -1]
            cum = cum[:, :-1] if open_ else cum
            if not cum.shape[1]:
                continue
            x, y = points(named(cum), named(all_))
            if last is None:
                first, area = (x[0], y[:, 0]), np.zeros((len(y), replicates))
            else:
                x, y = np.concatenate((last[0][None], x)), np.concatenate((last[1][:, None], y), 1)
            height = (y[:, 1:] + y[:, :-1]) / 2 if trapezoid else y[:, 1:]
            area = area + (np.diff(x, axis=0)[None] * height).sum(1)
            last = x[-1], y[:, -1]
            for k, b in enumerate(grid):
                below, r = (x <= b).sum(0) - 1, np.arange(replicates)  # x never falls
                ok = below >= 0
                low[k][:, ok] = np.stack((x[below[ok], r[ok]], y[0][below[ok], r[ok]]))
                # the first point at b or over it; of equal points the first
                above = (x < b).sum(0)
                ok = (above < len(x)) & np.isnan(high[k, 0])
                high[k][:, ok] = np.stack((x[above[ok], r[ok]], y[0][above[ok], r[ok]]))
        none = np.zeros(0)
        columns = {"model": start.column("model"), "_range": start.column("_range"), "all": start.column("all")}
        parts = {"first": first, "last": last}
        for name, p in parts.items():
            columns[name] = [none if p is None else np.concatenate((p[0][None], p[1])).ravel()]
        return pa.table(columns | {"area": [none if area is None else area.ravel()], "low": [low.ravel()], "high": [high.ravel()]})

    schema = f"model {kind}, _range int, all array<double>, first array<double>, last array<double>, area array<double>, low array<double>, high array<double>"
    walked = parted.groupBy(*key).cogroup(begun.groupBy(*key)).applyInArrow(walk, schema)

    def joined(table: pa.Table) -> pa.Table:
        """Of a model's ranges, a row each: their areas and the steps between them."""
        table = table.sort_by("_range")
        get = lambda c, r: np.asarray(table.column(c)[r].values).reshape(-1, replicates)
        last, area = None, None
        low, high = np.full((len(grid), 2, replicates), np.nan), np.full((len(grid), 2, replicates), np.nan)
        for r in range(table.num_rows):
            first = get("first", r)
            if len(first):
                if last is None:
                    last, area = np.zeros_like(first), np.zeros((len(first) - 1, replicates))
                    low[:] = 0.0  # the origin
                    high[np.array(grid) <= 0] = 0.0
                height = (first[1:] + last[1:]) / 2 if trapezoid else first[1:]
                area = area + (first[0] - last[0])[None] * height + get("area", r)
                last = get("last", r)
                a, b = (get(c, r).reshape(low.shape) for c in ("low", "high"))
                low = np.where(np.isnan(a), low, a)
                high = np.where(np.isnan(high), b, high)
        low, high = np.where(np.isnan(low), high, low), np.where(np.isnan(high), low, high)
        slope = _divide(high[:, 1] - low[:, 1], high[:, 0] - low[:, 0])
        values = low[:, 1] + slope * (np.array(grid)[:, None] - low[:, 0]) if grid else np.zeros((0, replicates))
        return pa.table({"model": table.column("model").slice(0, 1), "totals": table.column("all").slice(0, 1), "areas": [area.ravel()], "values": [values.ravel()]})

    return walked.groupBy("model").applyInArrow(joined, f"model {kind}, totals array<double>, areas array<double>, values array<double>")


def _cell(column: str, row: int, replicates: int):
    """The value of a replicate in one row of a flattened matrix."""
    return F.get(column, F.col("replicate") + F.lit(row * replicates))


def _by_replicate(draws: DataFrame, replicates: int) -> DataFrame:
    """Replicates without any weight have no curve."""
    d = draws.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    return d.where(_cell("totals", 0, replicates) > 0)


def bootstrap_policy(scored: DataFrame, signal: str, budgets: list[float], replicates: int, seed: int) -> DataFrame:
    """(replicate, model, budget, value) of long scores (row_id, model, score, treatment, outcome, signal)."""
    d = _by_replicate(ranked_draws(scored, ["N", "G"], signal, _policy_points, True, budgets, replicates, seed), replicates)
    cells = F.array(*[F.struct(F.lit(float(b)).alias("budget"), _cell("values", k, replicates).alias("value")) for k, b in enumerate(budgets)])
    return d.select("replicate", "model", F.inline(cells))


def bootstrap_policy_area(draws: DataFrame) -> DataFrame:
    return policy_area(draws, ["replicate", "model"])


def bootstrap_rate(scored: DataFrame, signal: str, replicates: int, seed: int) -> DataFrame:
    """(replicate, model, autoc, rate_qini)."""
    d = _by_replicate(ranked_draws(scored, ["N", "G"], signal, _rate_points, False, [], replicates, seed), replicates)
    return d.select("replicate", "model", _cell("areas", 0, replicates).alias("autoc"), _cell("areas", 1, replicates).alias("rate_qini"))


def bootstrap_qini(scored: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(replicate, model, qini_score); null where the best ranking is as good as the diagonal."""
    d = _by_replicate(ranked_draws(scored, ["N", "N1", "Y1", "Y0"], None, _qini_points, True, [], replicates, seed), replicates)
    n, n1, a, b = (_cell("totals", k, replicates) for k in range(4))  # a: treated events, b: control events
    # the best ranking has three ties: treated events, rows without event, control events
    end = a - F.coalesce(F.try_divide(b * n1, n - n1), F.lit(0.0))
    best = a * a / 2 + (n - a - b) * a + b * (a + end) / 2
    line = n * end / 2
    return d.select("replicate", "model", F.when(F.abs(best - line) > 0, F.try_divide(_cell("areas", 0, replicates) - line, best - line)).alias("qini_score"))


def intervals(draws: DataFrame, value: str, by: list[str], alpha: float = 0.05) -> DataFrame:
    """Percentile intervals; replicates without a value do not count."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    d = draws.where(f"{value} is not null").groupBy(*by).agg(q.alias("_q"), F.avg(value).alias("mean"), F.count("*").alias("n_replicates"))
    return d.select(*by, "mean", F.col("_q")[0].alias("ci_low"), F.col("_q")[1].alias("ci_high"), "n_replicates")


def differences(draws: DataFrame, value: str, reference: str, model: str = "model", on: list[str] | None = None) -> DataFrame:
    """(replicate, model, .., diff) of each model to the reference of the same replicate."""
    on = ["replicate", *(on or [])]
    ref = draws.where(F.col(model) == reference).select(*on, F.col(value).alias("_r"))
    return draws.where(F.col(model) != reference).join(ref, on).select(*on, model, (F.col(value) - F.col("_r")).alias("diff"))


def pairwise_differences(draws: DataFrame, value: str, model: str = "model") -> DataFrame:
    a, b = (draws.select("replicate", F.col(model).alias(m), F.col(value).alias(v)) for m, v in (("a", "va"), ("b", "vb")))
    return a.join(b, "replicate").where("a < b").select("replicate", "a", "b", (F.col("va") - F.col("vb")).alias("diff"))


def difference_summary(diffs: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    d = intervals(diffs, "diff", by, alpha)
    p = diffs.groupBy(*by).agg(F.avg((F.col("diff") > 0).cast("int")).alias("share_positive"), F.least(2 * F.least(F.avg((F.col("diff") <= 0).cast("int")), F.avg((F.col("diff") >= 0).cast("int"))), F.lit(1.0)).alias("two_sided"))
    return d.join(p, by)


def simultaneous_band(diffs: DataFrame, observed: DataFrame, by: list[str], alpha: float = 0.05) -> DataFrame:
    """(by, observed, se, critical, low, high): the band covers all cells at once; a cell without spread counts 0."""
    se = diffs.groupBy(*by).agg(F.stddev_samp("diff").alias("se"))
    d = diffs.join(observed, by).join(se, by)
    t = F.when(F.col("se") > 0, F.abs(F.col("diff") - F.col("observed")) / F.col("se")).otherwise(0.0)
    crit = d.groupBy("replicate").agg(F.max(t).alias("m")).agg(F.percentile("m", 1 - alpha).alias("critical"))
    return observed.join(se, by).join(crit).select(*by, "observed", "se", "critical", (F.col("observed") - F.col("critical") * F.col("se")).alias("low"), (F.col("observed") + F.col("critical") * F.col("se")).alias("high"))


def random_policy_curves(df: DataFrame, signal: str, budgets: list[float], seeds: int, seed: int, digits: int = 3) -> DataFrame:
    """(draw, budget, value): value of targeting the top share of each of ``seeds`` random rankings of ``df``.

    A draw's scores are made from row_id where they are needed, and no row is sent for them. A first pass sums rows and
    signal by draw and slice, the scores' first ``digits`` hexadecimal digits, which tells the slice that each budget ends
    in; a second ranks the rows of these slices alone, about one in 16 ** ``digits`` for each draw and budget.
    """
    rows = materialize(df.select("row_id", F.col(signal).cast("double").alias("_g")))
    d = rows.select("_g", "row_id", F.explode(F.sequence(F.lit(0), F.lit(seeds - 1))).alias("draw")).withColumn("_score", uniform_digits("row_id", F.col("draw"), seed))
    d = d.withColumn("_slice", F.substring("_score", 1, digits))
    sums = {"_n": F.count("*"), "_g": F.coalesce(F.sum("_g"), F.lit(0.0))}
    held = materialize(d.groupBy("draw", "_slice").agg(*[c.alias(k) for k, c in sums.items()]))
    before = Window.partitionBy("draw").orderBy(F.desc("_slice")).rowsBetween(Window.unboundedPreceding, -1)  # a row a slice
    start = {k: F.coalesce(F.sum(c).over(before), F.lit(0)) for k, c in (("_n0", "_n"), ("_g0", "_g"))}
    whole = Window.partitionBy("draw")
    held = held.withColumns(start | {"_all": F.sum("_n").over(whole), "_last": F.min("_slice").over(whole)})
    asked = held.withColumn("budget", F.explode(F.array(*[F.lit(float(b)) for b in budgets])))
    ends = (F.col("_n0") + F.col("_n")) / F.col("_all") >= F.col("budget")
    asked = materialize(asked.where((F.col("_n0") / F.col("_all") < F.col("budget")) & (ends | (F.col("_slice") == F.col("_last")))).select("draw", "_slice", "budget", "_n0", "_g0", "_all"))

    wanted = asked.groupBy("draw", "_slice").agg(F.first("_n0").alias("_n0"), F.first("_g0").alias("_g0"), F.first("_all").alias("_all"))
    ties = d.join(F.broadcast(wanted), ["draw", "_slice"]).groupBy("draw", "_slice", "_n0", "_g0", "_all", "_score").agg(*[c.alias(k) for k, c in sums.items()])
    upto = Window.partitionBy("draw", "_slice").orderBy(F.desc("_score")).rowsBetween(Window.unboundedPreceding, 0)
    x, y = (F.col(a) + F.sum(b).over(upto) for a, b in (("_n0", "_n"), ("_g0", "_g")))
    points = ties.select("draw", "_slice", (x / F.col("_all")).alias("x"), (y / F.col("_all")).alias("y"))
    first = asked.select("draw", "budget", (F.col("_n0") / F.col("_all")).alias("x"), (F.col("_g0") / F.col("_all")).alias("y"))
    origin = held.select("draw").distinct().select("draw", F.explode(F.array(*[F.lit(float(b)) for b in budgets])).alias("budget"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    points = points.join(F.broadcast(asked.select("draw", "_slice", "budget")), ["draw", "_slice"]).select("draw", "budget", "x", "y")
    return between(points.unionByName(first).unionByName(origin), ["draw"])


def random_policy_sensitivity(df: DataFrame, signal: str, budgets: list[float], seeds: int, seed: int) -> DataFrame:
    """(budget, mean, min, max) of the value of random rankings."""
    c = random_policy_curves(df, signal, budgets, seeds, seed)
    return c.groupBy("budget").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
