"""Trees grown level by level from sums by (tree, node, feature, bin): one aggregate a level for any number of trees.

Features are cut into bins once and a row's bins are one byte each. A level of all trees is one pass: each task sums
gradient, curvature and rows of its part, sums meet by (tree, node), and only the best cut of each comes to the driver.
No row moves and the table is not rewritten as trees grow; boosting writes the rows' scores every ``keep`` rounds.

``boost`` fits any loss with a gradient and a curvature. ``causal_forest`` grows honest trees on residual moments.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.session import discard, materialize, ship_package

Batch = dict[str, np.ndarray]
#: Gradient and curvature of rows at their scores; a curvature of 0 leaves a row out.
Loss = Callable[[Batch, np.ndarray, int], tuple[np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Growth:
    depth: int = 5
    leaves: int = 31
    min_rows: int = 20
    min_curvature: float = 1e-3
    l1: float = 0.0
    l2: float = 1.0
    bins: int = 64
    #: Share of features that a node may be cut at, drawn by (tree, node); 1: all.
    features: float = 1.0
    seed: int = 7


@dataclass
class Tree:
    """Node i has the children 2i + 1 (bin <= cut) and 2i + 2; feature -1: a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    @staticmethod
    def root(depth: int) -> Tree:
        n = (2 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, int), np.zeros(n))

    def leaf(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node of each row; ``levels``: how many are grown yet."""
        at, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(int(math.log2(len(self.feature) + 1)) - 1 if levels is None else levels):
            f = self.feature[at]
            at = np.where(f >= 0, 2 * at + 1 + (bins[rows, f] > self.cut[at]), at)
        return at


def bin_edges(df: DataFrame, features: list[str], bins: int, error: float = 1e-3) -> list[np.ndarray]:
    """Upper edges of the bins of each feature but the last: distinct quantiles within ``error`` of the rows, in one pass."""
    found = df.approxQuantile(features, [k / bins for k in range(1, bins)], error)
    return [np.unique(np.array(q, float)) for q in found]


def binned(df: DataFrame, features: list[str], edges: list[np.ndarray], keep: list[str]) -> DataFrame:
    """``keep`` columns and ``_bins``, a byte a feature; a value up to an edge is in its bin, nulls are in the last."""
    ship_package(df.sparkSession)
    kept = df.select(*keep, *[F.col(f).cast("double").alias(f"_x{k}") for k, f in enumerate(features)])

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), _packed(_digitized([b.column(f"_x{k}") for k in range(len(edges))], edges))], [*keep, "_bins"])

    return kept.mapInArrow(cut, ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep), "_bins binary"]))


def _digitized(columns: list[pa.Array], edges: list[np.ndarray]) -> np.ndarray:
    x = [c.to_numpy(zero_copy_only=False).astype(float) for c in columns]
    return np.stack([np.searchsorted(e, v, "left") for v, e in zip(x, edges, strict=True)], 1).astype(np.uint8)


def _packed(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    size = rows.shape[1] * rows.itemsize
    off = np.arange(len(rows) + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(rows.tobytes())])


def _unpacked(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _batches(it: Iterator[pa.RecordBatch], columns: list[str], width: int) -> Iterator[tuple[Batch, np.ndarray]]:
    for b in it:
        if b.num_rows:
            yield {c: b.column(c).to_numpy(zero_copy_only=False) for c in columns}, _unpacked(b.column("_bins"), np.uint8, width)


def best_cut(sums: np.ndarray, allowed: np.ndarray, g: Growth) -> tuple[float, int, int, np.ndarray]:
    """Gain, feature, bin, and the sums left and right, of the best cut of a node; sums by (feature, bin, [gradient, curvature, rows])."""
    left = np.cumsum(sums, 1)[:, :-1]
    total = sums[0].sum(0)
    right = total - left

    def score(s: np.ndarray) -> np.ndarray:
        grad = np.sign(s[..., 0]) * np.maximum(np.abs(s[..., 0]) - g.l1, 0)
        return np.divide(grad**2, s[..., 1] + g.l2, out=np.zeros(s.shape[:-1]), where=s[..., 1] + g.l2 > 0)

    gain = score(left) + score(right) - score(total)
    able = allowed[:, None]
    for s in (left, right):
        able = able & (s[..., 2] >= g.min_rows) & (s[..., 1] >= g.min_curvature)
    gain = np.where(able, gain, -1.0)
    f, b = np.unravel_index(int(np.argmax(gain)), gain.shape)
    return float(gain[f, b]), int(f), int(b), np.stack([left[f, b], right[f, b]])


def _value(s: np.ndarray, g: Growth) -> float:
    grad = np.sign(s[0]) * max(abs(s[0]) - g.l1, 0)
    return float(-grad / (s[1] + g.l2)) if s[1] + g.l2 > 0 else 0.0


def _allowed(tree: int, node: int, width: int, g: Growth) -> np.ndarray:
    take = max(1, round(g.features * width))
    out = np.zeros(width, bool)
    out[np.random.default_rng([g.seed, tree, node]).permutation(width)[:take]] = True
    return out


def grow(table: DataFrame, width: int, columns: list[str], trees: int, stats: Callable[[Batch, np.ndarray, int], tuple[np.ndarray, np.ndarray]], g: Growth) -> list[Tree]:
    """``trees`` trees at once: ``stats(columns, bins, tree)`` gives gradient and curvature of a batch's rows; 0, 0 leaves one out.

    A task sends ``bins`` * 24 bytes for each feature of each open node; a node's sums meet in one task, as many as tasks.
    """
    out, open_ = [Tree.root(g.depth) for _ in range(trees)], {k: [0] for k in range(trees)}
    for level in range(g.depth):
        held = {k: v for k, v in open_.items() if v}
        if not held:
            break

        def sums(it: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            total = {k: np.zeros((len(v), width, g.bins, 3)) for k, v in held.items()}
            for batch, bins in _batches(it, columns, width):
                for k, nodes in held.items():
                    grad, curve = stats(batch, bins, k)
                    place = np.full(len(out[k].feature), -1)
                    place[nodes] = np.arange(len(nodes))
                    live = np.flatnonzero(curve > 0)  # of a forest's rows a tree takes a quarter
                    at = place[out[k].leaf(bins[live], level)]
                    live, at = live[at >= 0], at[at >= 0]
                    for f in range(width):
                        flat, size = at * g.bins + bins[live, f], len(nodes) * g.bins
                        for j, w in enumerate((grad[live], curve[live], None)):
                            total[k][:, f, :, j] += np.bincount(flat, w, size).reshape(len(nodes), g.bins)
            rows = [(k, node, total[k][i].tobytes()) for k, nodes in held.items() for i, node in enumerate(nodes)]
            yield pa.RecordBatch.from_pydict({"tree": [r[0] for r in rows], "node": [r[1] for r in rows], "sums": [r[2] for r in rows]})

        def choose(t: pa.Table) -> pa.Table:
            tree, node = t.column("tree")[0].as_py(), t.column("node")[0].as_py()
            total = sum(np.frombuffer(s.as_py()).reshape(width, g.bins, 3) for s in t.column("sums"))
            gain, f, b, sides = best_cut(total, _allowed(tree, node, width, g), g)
            return pa.table({"tree": [tree], "node": [node], "gain": [gain], "feature": [f], "cut": [b], "sides": [sides.reshape(-1).tolist()], "total": [total[0].sum(0).tolist()]})

        parts = table.mapInArrow(sums, "tree long, node long, sums binary").groupBy("tree", "node")
        found = parts.applyInArrow(choose, "tree long, node long, gain double, feature long, cut long, sides array<double>, total array<double>").collect()
        for k in held:
            own = sorted((r for r in found if r["tree"] == k), key=lambda r: (-r["gain"], r["node"]))
            open_[k], room = [], g.leaves - int((out[k].feature >= 0).sum()) - 1
            for r in own:
                node = r["node"]
                if level == 0:
                    out[k].value[node] = _value(np.array(r["total"]), g)
                if r["gain"] <= 0 or room <= 0:
                    continue
                room -= 1
                sides = np.array(r["sides"]).reshape(2, 3)
                out[k].feature[node], out[k].cut[node] = r["feature"], r["cut"]
                for side, child in enumerate((2 * node + 1, 2 * node + 2)):
                    out[k].value[child] = _value(sides[side], g)
                    open_[k].append(child)
            open_[k].sort()
    return out


# Boosting.


def logistic(label: str, weight: str | None = None) -> Loss:
    def loss(x: Batch, f: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        q = 1 / (1 + np.exp(-f))
        w = 1.0 if weight is None else x[weight]
        return w * (q - x[label]), w * q * (1 - q)

    return loss


def squared(label: str, weight: str | None = None) -> Loss:
    def loss(x: Batch, f: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        w = np.ones(len(f)) if weight is None else x[weight]
        return w * (f - x[label]), w

    return loss


@dataclass
class Ensemble:
    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    step: float
    base: float = 0.0
    history: list[float] = field(default_factory=list)

    def of_bins(self, bins: np.ndarray) -> np.ndarray:
        return self.base + self.step * sum((t.value[t.leaf(bins)] for t in self.trees), np.zeros(len(bins)))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        """``df`` with the ensemble's raw score (of a logistic loss: the log-odds)."""
        ship_package(df.sparkSession)
        own = self

        @F.arrow_udf("double")
        def scored(*columns: pa.Array) -> pa.Array:
            return pa.array(own.of_bins(_digitized(list(columns), own.edges)))

        return df.withColumn(out, scored(*[F.col(f).cast("double") for f in self.features]))


def boost(df: DataFrame, features: list[str], columns: list[str], loss: Loss, rounds: int = 300, step: float = 0.05, growth: Growth | None = None, base: float = 0.0, keep: int = 20, held_out: Column | None = None, value: Callable[[Batch, np.ndarray], np.ndarray] | None = None, patience: int = 3) -> Ensemble:
    """Newton boosting of ``loss``, which reads ``columns`` of a batch of rows.

    With ``held_out`` (a condition) and ``value`` (the loss itself, row by row) these rows are not learned from; their
    mean loss is taken every ``keep`` rounds, and after ``patience`` times without a new least the ensemble ends there.
    """
    g = growth or Growth()
    edges = bin_edges(df, features, g.bins)
    test = F.lit(False) if held_out is None else F.coalesce(held_out, F.lit(False))
    table = binned(df.withColumns({"_test": test, "_f": F.lit(float(base))}), features, edges, [*columns, "_test", "_f"])
    table = materialize(table)
    made, width, names = Ensemble(features, edges, [], step, base), len(features), [*columns, "_test", "_f"]
    written, least, waited = 0, (math.inf, 0), 0
    for turn in range(rounds):
        fresh = replace(made, trees=made.trees[written:], base=0.0)

        def stats(x: Batch, bins: np.ndarray, _: int, fresh=fresh, turn=turn) -> tuple[np.ndarray, np.ndarray]:
            grad, curve = loss(x, x["_f"] + fresh.of_bins(bins), turn)
            return grad, np.where(x["_test"], 0.0, curve)

        made.trees += grow(table, width, names, 1, stats, replace(g, seed=g.seed + turn))
        if (turn + 1) % keep == 0 or turn + 1 == rounds:
            before, fresh, written = table, replace(made, trees=made.trees[written:], base=0.0), len(made.trees)
            table = materialize(_advanced(table, fresh, names, width))
            discard(before)
            if value is not None and held_out is not None:
                made.history.append(_mean(table, value, names, width))
                if made.history[-1] < least[0]:
                    least, waited = (made.history[-1], written), 0
                else:
                    waited += 1
                if waited >= patience:
                    break
    discard(table)
    if least[1]:
        made.trees = made.trees[: least[1]]
    return made


def _advanced(table: DataFrame, fresh: Ensemble, names: list[str], width: int) -> DataFrame:
    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            f = b.column("_f").to_numpy() + fresh.of_bins(_unpacked(b.column("_bins"), np.uint8, width)) if b.num_rows else []
            yield b.set_column(b.schema.get_field_index("_f"), "_f", pa.array(f, pa.float64()))

    return table.mapInArrow(add, table.schema)


def _mean(table: DataFrame, value: Callable[[Batch, np.ndarray], np.ndarray], names: list[str], width: int) -> float:
    def sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in _batches(it, names, width):
            v = value(x, x["_f"])[x["_test"].astype(bool)]
            yield pa.RecordBatch.from_pydict({"s": [float(v.sum())], "n": [len(v)]})

    row = table.mapInArrow(sums, "s double, n long").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    return row["s"] / row["n"] if row["n"] else math.inf


# Causal forest.


@dataclass
class CausalForest:
    """Honest trees: ``moments[tree]`` holds for each node the sums of r * y, of r * r and of rows of the half that did not grow it."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree]
    moments: np.ndarray
    bag: int
    seed: int

    def of_bins(self, bins: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Effect and variance of rows; with ``ids``, by the trees that have not seen the row."""
        n, m = len(bins), len(self.trees)
        num, den = np.zeros((n, m)), np.zeros((n, m))
        for k, tree in enumerate(self.trees):
            s = self.moments[k][tree.leaf(bins)]
            able = s[:, 2] > 0
            if ids is not None:
                able &= _half(ids, k // self.bag, self.seed) == 2
            num[able, k], den[able, k] = (s[able, :2] / s[able, 2:]).T
        ok = den > 0
        count = np.maximum(ok.sum(1), 1)
        top, bottom = num.sum(1) / count, den.sum(1) / count
        effect = np.divide(top, bottom, out=np.zeros(n), where=bottom > 0)
        # what trees say beyond the effect, in its scale; trees of a bag share their rows, so bags vary as samples do
        rest = np.where(ok, np.divide(num - den * effect[:, None], bottom[:, None], out=np.zeros_like(num), where=bottom[:, None] > 0), np.nan)
        rest = rest.reshape(n, m // self.bag, self.bag)
        whole = np.isfinite(rest).all(2)
        means = np.where(whole, np.nan_to_num(rest).mean(2), 0.0)
        bags = np.maximum(whole.sum(1), 2)
        between = (means**2).sum(1) / bags
        within = np.where(whole, np.nan_to_num(rest).var(2, ddof=1), 0.0).sum(1) / bags / self.bag
        variance = np.maximum(between - within, between / (bags + 1))
        return effect, np.where(whole.sum(1) > 1, variance, np.nan)

    def score(self, df: DataFrame, row_id: str | None = None, z: float = 1.959964) -> DataFrame:
        """``df`` with score, variance, lower and upper; with ``row_id`` by the trees that did not see the row."""
        ship_package(df.sparkSession)
        own = self

        @F.arrow_udf("struct<score:double,variance:double>")
        def scored(ids: pa.Array, *columns: pa.Array) -> pa.Array:
            effect, variance = own.of_bins(_digitized(list(columns), own.edges), None if row_id is None else ids.to_numpy(zero_copy_only=False))
            return pa.StructArray.from_arrays([pa.array(effect), pa.array(variance, from_pandas=True)], ["score", "variance"])

        ids = F.lit(0).cast("long") if row_id is None else F.col(row_id).cast("long")
        d = df.withColumn("_s", scored(ids, *[F.col(f).cast("double") for f in self.features])).select("*", "_s.score", "_s.variance").drop("_s")
        wide = F.lit(z) * F.sqrt("variance")
        return d.withColumns({"lower": F.col("score") - wide, "upper": F.col("score") + wide})


def _half(ids: np.ndarray, bag: int, seed: int, salt: int = 0) -> np.ndarray:
    """0 or 1: the half of the bag's rows that a row is in; 2: the bag, a half of all rows drawn anew, does not hold it."""
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((seed * 1_000_003 + bag * 7919 + 1) * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    out = (h >> np.uint64(40)) & np.uint64(1)
    if salt:
        out ^= ((h * np.uint64(2 * salt + 1)) >> np.uint64(50)) & np.uint64(1)
    return np.where((h >> np.uint64(20)) & np.uint64(1), out, 2).astype(np.int64)


def causal_forest(df: DataFrame, features: list[str], row_id: str, y_residual: str, t_residual: str, trees: int = 200, bag: int = 4, growth: Growth | None = None) -> CausalForest:
    """A forest of honest trees on residuals of outcome and treatment, which must come from models that have not seen the row.

    Bags of ``bag`` trees share a half of the rows, drawn anew for each bag; each tree deals it anew in two, grows on one
    part and estimates on the other. A cut maximises (r2 left * r2 right / r2) * (effect left - effect right) ** 2, r2 being
    sums of squared treatment residuals: with gradient -r * y and curvature r * r that is the gain of a Newton step without
    penalty. All trees grow together, in one pass a level, and are filled in one more.
    """
    g = growth or Growth(depth=5, leaves=31, min_rows=25, min_curvature=1e-6, l2=0.0, features=0.5)
    trees = max(bag, trees // bag * bag)
    edges = bin_edges(df, features, g.bins)
    table = materialize(binned(df, features, edges, [row_id, y_residual, t_residual]))
    names, width = [row_id, y_residual, t_residual], len(features)

    def part(x: Batch, k: int) -> np.ndarray:
        return _half(x[row_id], k // bag, g.seed, k % bag)

    def stats(x: Batch, bins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        own, r = part(x, k) == 0, x[t_residual]
        return np.where(own, -r * x[y_residual], 0.0), np.where(own, r * r, 0.0)

    grown = grow(table, width, names, trees, stats, g)

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((trees, len(grown[0].feature), 3))
        for x, bins in _batches(it, names, width):
            r = x[t_residual]
            for k, tree in enumerate(grown):
                own = part(x, k) == 1
                leaf = tree.leaf(bins[own])
                for j, w in enumerate((r * x[y_residual], r * r, np.ones(len(r)))):
                    total[k, :, j] += np.bincount(leaf, w[own], total.shape[1])
        yield pa.RecordBatch.from_pydict({"tree": np.arange(trees), "sums": [t.tobytes() for t in total]})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in t.column("sums"))
        return pa.table({"tree": t.column("tree").slice(0, 1), "sums": [total.tobytes()]})

    moments = np.zeros((trees, len(grown[0].feature), 3))
    for row in table.mapInArrow(fill, "tree long, sums binary").groupBy("tree").applyInArrow(add, "tree long, sums binary").collect():  # nodes of the forest
        moments[row["tree"]] = np.frombuffer(row["sums"]).reshape(-1, 3)
    discard(table)
    return CausalForest(features, edges, grown, moments, bag, g.seed)
