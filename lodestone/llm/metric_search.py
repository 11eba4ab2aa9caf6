"""Exact top-k inner products by best-first search in M-trees.

Inner products become distances: vectors are scaled so that no norm is over 1, a vector x gets one more coordinate
sqrt(1 - |x|^2), a query gets 0, and d^2 = |q|^2 + 1 - 2 q.x. Vectors are dealt out to pivots, each pivot's
vectors in parts of bounded size; a part is an M-tree of paged nodes that keep a centre, a covering radius and
the distance to the centre of their parent. A query goes only to pivots whose ball it may gain from, and in a tree
only to nodes that the stored distances cannot exclude. Scores are exact integers; the scaled numbers only bound.

A tree is built once, in the task of its part, and queries stream past it: rows travel once, a query once to
each part that it may gain from, and neither is ever held whole. Where vectors have no structure the bounds
exclude little, and an exact search is queries times rows of work.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.session import materialize, ship_package

_SLACK = 1e-6  # far over the rounding of distances between vectors of norm 1
_LARGEST = float(np.finfo(float).max)
_MOST = 10**38 - 1


class Node:
    """A page: its centre's distance to the parent's centre, its radius, and children or rows."""

    __slots__ = ("centre", "children", "first", "radius", "spread", "to_parent")

    def __init__(self, centre: np.ndarray, radius: float, to_parent: float):
        self.centre, self.radius, self.to_parent = centre, radius, to_parent
        self.children: list[Node] = []
        self.first = 0  # of a leaf's rows in the tree's order, which stand together, the nearest to the centre first
        self.spread: np.ndarray | None = None  # their distances to it


class MTree:
    """``order`` lists the rows so that each page's stand together; ``search`` speaks of places in it."""

    def __init__(self, x: np.ndarray, page: int = 256, fan: int = 8):
        self.x, self.page, self.fan = x, page, fan
        self._pages: list[np.ndarray] = []
        self._placed = 0
        self.root = self._build(np.arange(len(x)), x.mean(0), 0.0)
        self.order = np.concatenate(self._pages)

    def _build(self, rows: np.ndarray, centre: np.ndarray, to_parent: float) -> Node:
        spread = np.sqrt(((self.x[rows] - centre) ** 2).sum(1))
        node = Node(centre, float(spread.max(initial=0.0)), to_parent)
        if len(rows) <= self.page:
            order = np.argsort(spread)
            node.first, node.spread = self._placed, spread[order]
            self._pages.append(rows[order])
            self._placed += len(rows)
            return node
        far, pivots = spread.copy(), []
        for _ in range(self.fan):
            p = int(np.argmax(far))
            if far[p] <= 0 and pivots:
                break
            pivots.append(p)
            far = np.minimum(far, np.sqrt(((self.x[rows] - self.x[rows[p]]) ** 2).sum(1)))
        part = _nearest(self.x[rows], self.x[rows[pivots]])
        groups = [rows[part == k] for k in range(len(pivots))]
        if max(map(len, groups)) > 0.9 * len(rows):  # as good as one place: cut it evenly
            groups = np.array_split(rows, self.fan)
        for g in groups:
            if len(g):
                c = self.x[g].mean(0)
                node.children.append(self._build(g, c, float(np.sqrt(((c - centre) ** 2).sum()))))
        return node

    def search(self, q: np.ndarray, reach: float, best, visits: list[int] | None = None) -> None:
        """Calls ``best(a, b)`` for places a to b of rows that may lie within reach; it returns the new reach."""
        d = float(np.sqrt(((q - self.root.centre) ** 2).sum()))
        heap = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        n = 1
        while heap:
            low, _, d, node = heapq.heappop(heap)
            if low > reach:
                return
            if visits is not None:
                visits[0] += 1
            if node.spread is not None:
                # by the stored distances, before any is computed
                a, b = node.spread.searchsorted(d - reach), node.spread.searchsorted(d + reach, "right")
                if a < b:
                    reach = best(node.first + int(a), node.first + int(b))
                continue
            for child in node.children:
                if abs(d - child.to_parent) - child.radius > reach:
                    continue
                dc = float(np.sqrt(((q - child.centre) ** 2).sum()))
                low = max(0.0, dc - child.radius)
                if low <= reach:
                    heapq.heappush(heap, (low, n, dc, child))
                    n += 1


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.argmin((pivots**2).sum(1) - 2 * x @ pivots.T, 1)


class MetricSearch:
    """``pivots`` and ``sample`` bound the routing table, ``part_bytes`` the vectors of a tree."""

    def __init__(self, k: int = 10, pivots: int = 32, sample: int = 4096, part_bytes: int = 16 << 20, page: int = 256):
        self.k, self.pivots, self.sample, self.part_bytes, self.page = k, pivots, sample, part_bytes, page

    def run(self, vectors: DataFrame, is_query: str, id_col: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
        """(query_id, rank, vec_id, score): the k highest integer inner products of each query with other rows.

        Components become floor(scale * x). Ties go to the smaller id. Null vectors, null ids, vectors that hold
        null or non-finite components and empty ones take no part; nor do vectors whose length differs from the
        query's. A row is its id: rows that share a query's id are not its candidates, queries that share an id
        are answered as one. Scores are ranked exactly, but for those of over 38 digits, which are not told apart,
        and given where they fit 64 bits, else null; what scales beyond the largest double counts as it. ``is_query`` is a SQL condition on vec_id;
        other columns are not read.
        """
        spark, k, page, part_bytes = vectors.sparkSession, self.k, self.page, self.part_bytes
        ship_package(spark)
        e = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("x"))
        # null wins over non-finite in forall, so nulls are turned into NaN first
        fine = F.forall("x", lambda c: F.coalesce(F.abs(F.coalesce(c, F.lit(float("nan")))) < float("inf"), F.lit(False)))
        e = materialize(e.where("vec_id is not null and x is not null and size(x) > 0").where(fine))
        at_most = lambda c: F.least(F.abs(c) * scale, F.lit(_LARGEST / 2)) + 1
        high = e.agg(F.max(F.array_max(F.transform("x", at_most)))).first()[0] or 1.0
        norm = F.aggregate(F.transform("x", lambda c: at_most(c) / high), F.lit(0.0), lambda s, c: s + c * c)
        unit = 1 / (high * float(np.sqrt(e.agg(F.max(norm)).first()[0] or 1.0)))  # no scaled norm is over 1

        rows = e.orderBy(F.xxhash64("vec_id", "x")).limit(self.sample).toArrow().combine_chunks()  # of bounded size
        routes = _routes(rows, scale, unit, self.pivots)
        schema = "vec_id long, x array<double>, dim int, pivot int, away double"
        dealt = materialize(e.mapInArrow(lambda it: _deal(it, routes, scale, unit), schema))
        parts = F.ceil(F.count("*") * F.col("dim") * 8 / part_bytes).cast("int")
        counts = materialize(dealt.groupBy("dim", "pivot").agg(parts.alias("parts"), F.max("away").alias("radius")))
        balls = {(r["dim"], r["pivot"]): r["radius"] for r in counts.where("pivot >= 0").collect()}  # a row a pivot of the routing table
        n_parts = counts.agg(F.sum("parts")).first()[0] or 1

        routed = dealt.where(is_query).mapInArrow(lambda it: _route(it, routes, balls, scale, unit, k), "id long, x array<double>, dim int, pivot int, least double")
        routed = routed.join(counts, ["dim", "pivot"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        trees = dealt.withColumn("row", F.monotonically_increasing_id()).join(counts, ["dim", "pivot"])
        trees = trees.select(F.col("vec_id").alias("id"), "x", "dim", "pivot", F.lit(None).cast("double").alias("least"), F.pmod("row", "parts").cast("int").alias("part"), F.lit(0).alias("kind"))
        both = trees.unionByName(routed.select("id", "x", "dim", "pivot", "least", "part", F.lit(1).alias("kind")))
        tasks = min(n_parts, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
        key = ["dim", "pivot", "part"]
        both = both.repartition(int(tasks), *key).sortWithinPartitions(*key, "kind")
        hits = both.mapInArrow(lambda it: _search(it, scale, unit, k, page), "query_id long, vec_id long, score decimal(38,0)")
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.select("query_id", "rank", "vec_id", F.col("score").try_cast("bigint").alias("score"))


def _by_length(lists: pa.Array, scale: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length, the rows that have it, and a matrix of their whole components."""
    size = lists.value_lengths().to_numpy()
    flat, first = lists.flatten().to_numpy(), np.cumsum(size) - size
    with np.errstate(over="ignore"):
        flat = np.floor(np.clip(flat * float(scale), -_LARGEST, _LARGEST))
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield int(n), rows, flat[first[rows][:, None] + np.arange(n)]


def _lifted(x: np.ndarray, unit: float) -> np.ndarray:
    x = x * unit
    return np.hstack((x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))[:, None]))


def _query(x: np.ndarray, unit: float) -> np.ndarray:
    return np.hstack((x * unit, np.zeros((len(x), 1))))


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows, each the farthest from those before it."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        p = int(np.argmax(far))
        chosen.append(p)
        far = np.minimum(far, ((x - x[p]) ** 2).sum(1))
    return x[chosen]


def _routes(rows: pa.Table, scale: int, unit: float, pivots: int) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each length in the sample: its ids, its vectors and its pivots."""
    out = {}
    if rows.num_rows:
        ids = rows.column("vec_id").to_numpy()
        for n, at, x in _by_length(rows.column("x").combine_chunks(), scale):
            lifted = _lifted(x, unit)
            out[n] = ids[at], lifted, _far_apart(lifted, pivots)
    return out


def _deal(it: Iterator[pa.RecordBatch], routes: dict, scale: int, unit: float) -> Iterator[pa.RecordBatch]:
    """Each row with its nearest pivot, -1 where the sample has none of its length."""
    for batch in it:
        dim, pivot, away = np.zeros(batch.num_rows, np.int32), np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
        for n, at, x in _by_length(batch.column("x"), scale):
            dim[at] = n
            if n in routes:
                x, pivots = _lifted(x, unit), routes[n][2]
                pivot[at] = _nearest(x, pivots)
                away[at] = np.sqrt(((x - pivots[pivot[at]]) ** 2).sum(1))
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(dim), pa.array(pivot), pa.array(away)], ["vec_id", "x", "dim", "pivot", "away"])


def _route(it: Iterator[pa.RecordBatch], routes: dict, balls: dict, scale: int, unit: float, k: int) -> Iterator[pa.RecordBatch]:
    """Each query with the pivots that may hold one of its k best; least is its k-th (scaled) score in the sample."""
    for batch in it:
        own = batch.column("vec_id").to_numpy()
        for n, at, x in _by_length(batch.column("x"), scale):
            if n in routes:
                ids, sample, pivots = routes[n]
                numbers = np.array(sorted(p for d, p in balls if d == n))
                radius = np.array([balls[n, p] for p in numbers])
                q = _query(x, unit)
                scores = q @ sample.T
                scores[own[at][:, None] == ids[None]] = -np.inf
                least = np.partition(scores, -k, 1)[:, -k] if scores.shape[1] > k else np.full(len(x), -np.inf)
                norm = (q * q).sum(1)
                reach = np.array([_reach(a, b) for a, b in zip(norm, least, strict=True)])
                away = np.sqrt(np.maximum(norm[:, None] + (pivots[numbers] ** 2).sum(1)[None] - 2 * q @ pivots[numbers].T, 0))
                row, to = np.nonzero(away - radius[None] <= reach[:, None] + _SLACK)
                pivot, least = numbers[to], least[row]
            else:
                row, pivot, least = np.arange(len(at)), np.full(len(at), -1), np.full(len(at), -np.inf)
            take = pa.array(at[row])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(take), batch.column("x").take(take), pa.array(np.full(len(row), n), pa.int32()), pa.array(pivot, pa.int32()), pa.array(least)],
                ["id", "x", "dim", "pivot", "least"],
            )


class _Part:
    """The vectors of one part in a tree, with their ids, page by page."""

    def __init__(self, held: list[pa.RecordBatch], scale: int, unit: float, page: int):
        ids = np.concatenate([b.column("id").to_numpy() for b in held])
        x = np.concatenate([next(_by_length(b.column("x"), scale))[2] for b in held])
        self.tree = MTree(_lifted(x, unit), page)
        self.ids, self.x = ids[self.tree.order], x[self.tree.order]
        self.high = float(np.abs(x).max())
        self.unit = unit

    def best(self, own: int, q: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best rows that are not the query's own, of those over ``least``.

        Inner products are taken in doubles or 64 bits where no sum can leave them, else in Python's integers.
        """
        asked = _query(q[None], self.unit)[0]
        norm, limit = float(asked @ asked), least
        most = len(q) * max(self.high, 1.0) * max(float(np.abs(q).max()), 1.0)
        exact, small = most < 2**53, most < 2**62
        whole = q.astype(np.int64) if small else [int(c) for c in q]
        ids, scores = np.zeros(0, np.int64), np.zeros(0, float if exact else np.int64 if small else object)

        def meet(a: int, b: int) -> float:
            nonlocal ids, scores, limit
            if exact:
                s = self.x[a:b] @ q
            elif small:
                s = self.x[a:b].astype(np.int64) @ whole
            else:
                s = np.array([sum(int(c) * w for c, w in zip(x, whole, strict=True)) for x in self.x[a:b]], object)
            keep = self.ids[a:b] != own
            if len(ids) == k:
                keep &= s >= scores[-1]
            at = np.flatnonzero(keep)
            if len(at):
                i, s = np.append(ids, self.ids[a:b][at]), np.append(scores, s[at])
                order = np.lexsort((i, -s)) if s.dtype != object else np.array(sorted(range(len(s)), key=lambda j: (-s[j], i[j])), np.int64)
                ids, scores = i[order[:k]], s[order[:k]]
                if len(ids) == k:
                    limit = max(limit, float(Fraction(scores[-1]) * Fraction(self.unit) ** 2) if s.dtype == object else float(scores[-1]) * self.unit * self.unit)
            return _reach(norm, limit)

        self.tree.search(asked, _reach(norm, limit), meet)
        return ids, scores


def _search(it: Iterator[pa.RecordBatch], scale: int, unit: float, k: int, page: int) -> Iterator[pa.RecordBatch]:
    """Answers of each part: its vectors come first, then queries, which meet one tree batch by batch."""
    key, held, part = None, [], None
    for batch in it:
        marks = np.stack([batch.column(c).to_numpy() for c in ("dim", "pivot", "part", "kind")])
        cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a == b:
                continue
            run = batch.slice(a, b - a)
            *own, kind = marks[:, a].tolist()
            if own != key:
                key, held, part = own, [], None
            if not kind:
                held.append(run)
            elif held:
                part = part or _Part(held, scale, unit, page)
                queries = next(_by_length(run.column("x"), scale))[2]
                found = [(i, *part.best(i, q, least, k)) for i, q, least in zip(run.column("id").to_pylist(), queries, run.column("least").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([i for i, *_ in found], [len(x) for _, x, _ in found]), pa.int64()), pa.array(np.concatenate([x for _, x, _ in found]), pa.int64()), pa.concat_arrays([_decimals(s) for *_, s in found])],
                    ["query_id", "vec_id", "score"],
                )


def _decimals(scores: np.ndarray) -> pa.Array:
    kind = pa.decimal128(38, 0)
    if scores.dtype != object:
        return pa.array(scores.astype(np.int64), pa.int64()).cast(kind)
    return pa.array([Decimal(min(max(int(s), -_MOST), _MOST)) for s in scores], kind)


def _reach(norm: float, limit: float) -> float:
    return float(np.sqrt(max(norm + 1 - 2 * limit, 0))) * (1 + _SLACK) + _SLACK if limit > -np.inf else float("inf")
