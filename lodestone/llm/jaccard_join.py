"""Exact Jaccard join of shingle sets as points of a metric space, by pivots, Voronoi regions and triangle inequalities.

With distance 1 - similarity, linked sets are at most ``eps`` apart. Each round picks pivots, and a set within eps of
some belongs to the Voronoi region of the nearest: to its core. By the triangle inequality whatever links with a core
member is within 2 * eps of the pivot: in the region's window. A core is linked through its pivot; only core against
window is left to compare, and there |d(x, pivot) - d(y, pivot)| <= eps. Pivots and cores then leave, and the sets that
are left are joined by the same rounds until none is. An area of few sets is joined as it is, by one task; so is what a round
of pivots has hardly thinned out, by a task for each two of its blocks.

Which sets are within 2 * eps of a pivot is never guessed: under one order of all shingles, rare ones first, two sets of
a similarity s share one of their first n - ceil(s * n) + 1 shingles. A set that is in no pair at all is found by a
count over the smallest hashes, before any set is sent anywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.near_dedup import _fingerprints, _sets, shingle_sets
from lodestone.llm.textops import pieces
from lodestone.session import discard, materialize, narrow, ship_package

_OWN = ["fp1", "fp2", "n"]


class JaccardJoin:
    """Links texts whose sets of ``width``-word shingles have a similarity of at least ``percent`` / 100 (over 50).

    ``cells_log2`` bounds the broadcast table of shingle frequencies (four bytes a cell: 16 MB at 22), which only orders
    shingles: it changes the work, not the result. ``block`` is how many members of a core and of a window
    a task compares, ``pivots`` how many a round expects to pick in a crowd, ``shard`` how many smallest hashes a task counts.
    """

    def __init__(self, width: int = 5, percent: int = 80, cells_log2: int = 22, block: int = 512, pivots: int = 8, shard: int = 1 << 19):
        if not 50 < percent <= 100:
            raise ValueError("percent must be over 50, so that a region's window is not everything")
        self.width, self.percent, self.cells_log2, self.block, self.pivots, self.shard = width, percent, cells_log2, block, pivots, shard

    def run(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id) for each row of ``docs``.

        Words are runs without ASCII white space, A-Z lower-cased; a text of fewer than ``width`` words has its whole
        sequence as only shingle. Null texts and texts without words have empty sets and link with nothing: component_id
        is their own id. A row without an id takes no part, its component_id is null. Rows that repeat are given each;
        unlike texts under one id are points of their own, and component_id is the smallest id that theirs reach. Other
        columns are not read.
        """
        ship_package(docs.sparkSession)
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
        width, percent = self.width, self.percent
        rows = materialize(d.mapInArrow(lambda it: _prints(it, width, percent), "doc_id long, fp1 long, fp2 long, n long, heads array<long>"))
        points = rows.where("n > 0 and doc_id is not null").groupBy(*_OWN).agg(F.min("doc_id").alias("doc_id"))
        # numbered by the hash partition and so in no order of ids: the smaller number has the right to be a pivot
        points = materialize(points.select(F.monotonically_increasing_id().alias("point"), "doc_id", *_OWN))
        found = self.links(d, points, rows)
        least = points.join(found, "point").groupBy("component").agg(F.min("doc_id").alias("least"))
        groups = points.join(found.join(least, "component"), "point", "left").select(*_OWN, F.coalesce("least", "doc_id").alias("least"))
        out = rows.drop("heads").join(groups, _OWN, "left")
        own = F.when(F.col("doc_id").isNull() | (F.col("n") == 0), F.col("doc_id")).otherwise(F.col("least"))
        return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))

    def links(self, d: DataFrame, points: DataFrame, rows: DataFrame) -> DataFrame:
        """(point, component) of the points that some link touches."""
        sets = self._sets(d, self._partnered(points, rows))
        keys = self._keys(sets)
        ranks = materialize(narrow(keys.select("point", "rank").distinct()))
        stars, windows, turn, last = [], [], 0, 0
        while True:
            # linked points share one of the keys marked link; a point that shares none of them has no partner left
            shared = keys.where("link").groupBy("key").agg(F.min("point").alias("leader"), F.count("*").alias("size")).where("size > 1")
            held = materialize(narrow(keys.where("link").join(shared, "key").select("point", "leader")))
            if held.isEmpty():
                discard(held), discard(keys)
                break
            # what hangs together by keys is an area; a small one is joined as it is, a large one by pivots
            areas = materialize(narrow(connected_components(held, "leader", "point").withColumnsRenamed({"node": "point", "component": "area"})))
            small = materialize(narrow(self._small(areas, sets)))
            percent = self.percent
            members = narrow(narrow(areas.join(small, "area")).join(ranks, "point")).join(sets, "point").select("area", "point", "rank", "shingles")
            stars.append(materialize(members.groupBy("area").applyInArrow(lambda t: _joined_whole(t, percent), "point long, leader long")))  # noqa: B023
            large = materialize(narrow(areas.join(small, "area", "left_anti")))
            discard(held), discard(areas), discard(small)
            left = large.count()
            if turn and 2 * left > last:  # a crowd too loose for pivots: each round would take a few members only
                stars.append(materialize(self._crowds(large, sets)))
            if not left or turn and 2 * left > last:
                discard(large), discard(keys)
                break
            last = left
            # the first of all its keys' points, and by lot about ``pivots`` of any one key: all, where it has no more
            wide = materialize(narrow(keys.join(large.select("point"), "point", "left_semi")))
            most = wide.groupBy("key").agg(F.min(F.struct("rank", "point"))["point"].alias("leader"), F.count("*").alias("size")).where("size > 1")
            drawn = F.pmod(F.xxhash64("point", F.lit(turn)), F.max("size")) < self.pivots
            pivots = narrow(wide.join(most, "key")).groupBy("point").agg(F.min(F.col("leader") == F.col("point")).alias("all"), drawn.alias("drawn"))
            pivots = materialize(narrow(pivots.where("all or drawn").select("point")))
            centres = narrow(wide.join(pivots, "point").select("key", F.col("point").alias("leader")))
            pairs = narrow(narrow(wide.select("key", "point").join(centres, "key").where("point <> leader").select("point", "leader")).distinct())
            pairs = pairs.join(pivots.select("point", F.lit(True).alias("pivot")), "point", "left").where("pivot is null or point > leader")
            near = materialize(self._measured(pairs.withColumn("pivot", F.col("pivot").isNotNull()), sets))
            core = near.where(100 * F.col("both") >= self.percent * F.col("all"))
            homes = core.where("not pivot").groupBy("point").agg(F.max_by("leader", F.struct(F.col("both") / F.col("all"), -F.col("leader"))).alias("home"))
            stars.append(core.select("point", "leader"))
            windows.append(near.where("not pivot").join(homes, "point", "left"))
            gone = pivots.unionByName(homes.select("point"))
            before, keys = keys, materialize(narrow(wide.join(gone, "point", "left_anti")))
            discard(before), discard(large), discard(wide)
            turn += 1
        if not stars:
            return sets.select("point", F.col("point").alias("component")).where("false")
        links = star = materialize(narrow(_union(stars)))
        if windows:
            links = materialize(narrow(star.unionByName(self._across(materialize(narrow(_union(windows))), star, sets))))
        discard(sets)
        return connected_components(links, "leader", "point").withColumnRenamed("node", "point")

    def _small(self, areas: DataFrame, sets: DataFrame) -> DataFrame:
        """(area): those that one task can join, members and shingles of which are few."""
        size = narrow(areas.join(sets.select("point", F.size("shingles").alias("n")), "point")).groupBy("area").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        return size.where((F.col("c") <= 2 * self.block) & ((F.col("s") <= 1 << 20) | (F.col("c") <= 2))).select("area")

    def _crowds(self, areas: DataFrame, sets: DataFrame) -> DataFrame:
        """(point, leader): links inside areas of any size, one at least for each two components that they join.

        Linked sets differ in size by a factor of at most 100 / percent, so they are of one band of sizes or of two that
        adjoin. A band is dealt into blocks, and a task compares two blocks, so none holds an area.
        """
        width = math.log(100 / self.percent + 0.01)  # over the factor, whatever is lost by rounding
        members = narrow(areas.join(sets.select("point", F.size("shingles").alias("n")), "point"))
        members = materialize(narrow(members.select("area", "point", "n", F.floor(F.log("n") / width).cast("int").alias("band"))))
        size = members.groupBy("area", "band").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        blocks = F.greatest(F.ceil(F.col("c") / (2 * self.block)), F.ceil(F.col("s") / (1 << 19))).cast("int")
        size = materialize(narrow(size.select("area", "band", blocks.alias("blocks"))))
        beside = lambda by, name: size.select("area", (F.col("band") + by).alias("band"), F.col("blocks").alias(name))
        dealt = narrow(members.join(size, ["area", "band"]).join(beside(-1, "above"), ["area", "band"], "left").join(beside(1, "below"), ["area", "band"], "left"))
        dealt = materialize(dealt.withColumn("own", F.pmod(F.xxhash64("point"), "blocks").cast("int")))

        def met(blocks: str, x, i, y, j) -> DataFrame:
            each = dealt.where(F.col(blocks) > 0).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(blocks) - 1)))
            return each.select("area", x.alias("x"), i.alias("i"), y.alias("y"), j.alias("j"), "point", ((F.col("band") == x) & (F.col("own") == i)).alias("first"))

        band, own, other = F.col("band"), F.col("own"), F.col("other")
        pairs = met("blocks", band, F.least(own, other), band, F.greatest(own, other))
        pairs = pairs.unionByName(met("above", band, own, band + 1, other)).unionByName(met("below", band - 1, other, band, own))
        percent = self.percent
        return pairs.join(sets, "point").groupBy("area", "x", "i", "y", "j").applyInArrow(lambda t: _joined_blocks(t, percent), "point long, leader long")

    def _partnered(self, points: DataFrame, rows: DataFrame) -> DataFrame:
        """(point, doc_id, fp1, fp2, n) of the points that may link with another.

        Linked sets of sizes m <= n share at least percent * n / 100 shingles. So their first k shared ones, by hash,
        stand among the first n - ceil(percent * n / 100) + k of each, and a set that shares fewer than k of those with
        any other is in no link. k is a tenth of m: with one alone a common passage would do.
        """
        heads = rows.where("doc_id is not null and n > 0").select("fp1", "heads")
        total = heads.agg(F.coalesce(F.sum(F.size("heads")), F.lit(0))).first()[0]
        shards = max(1, -(-total // self.shard))
        # hashes travel once, packed by ranges of hashes; what many texts of a task share is counted before it is sent
        packed = heads.mapInArrow(lambda it: _packed(it, shards), "shard int, hashes binary, owners binary, counted binary, counts binary")
        counts = packed.groupBy("shard").applyInArrow(_shared, "owner long, shared long").groupBy("owner").agg(F.sum("shared").alias("shared"))
        least = F.ceil(F.ceil(F.col("n") * self.percent / 100) / 10)
        return points.join(counts, F.col("owner") == F.col("fp1")).where(F.col("shared") >= least).select("point", "doc_id", *_OWN)

    def _sets(self, d: DataFrame, partnered: DataFrame) -> DataFrame:
        """(point, shingles), sorted, of the points that may link.

        Texts stay where they are read: a broadcast bitmap of the wanted ids says which sets are made and sent, and the join
        on ids and fingerprints drops what else it lets through.
        """
        wanted, width = materialize(partnered), self.width
        marks = self._marks(wanted)
        made = d.mapInArrow(lambda it: _sets(_among(it, marks), width), "doc_id long, fp1 long, fp2 long, n long, shingles array<long>")
        # rows that repeat meet before the join and by its keys, so that sets are dealt out once
        own = ["doc_id", *_OWN]
        sets = made.groupBy(*own).agg(F.first("shingles").alias("shingles")).join(wanted, own).select("point", "shingles")
        sets = materialize(sets)
        marks.destroy()
        return sets

    def _marks(self, wanted: DataFrame):
        """A broadcast bitmap of hashed ids, about sixteen bits an id and at most 2 ** 27 bits (16 MB).

        Past eight million ids it lets more texts through to the join, and none of the wanted is ever kept back.
        """
        log2 = min(27, wanted.count().bit_length() + 4)
        log2 = max(log2, 10)
        slices = wanted.select("doc_id").mapInArrow(lambda it: _marked(it, log2), "slice int, counts binary").groupBy("slice")
        bits = np.zeros(1 << (log2 - 3), np.uint8)
        for row in narrow(slices.applyInArrow(_either, "slice int, counts binary")).collect():  # of bounded size, as one job
            own = np.frombuffer(row["counts"], np.uint8)
            bits[row["slice"] * len(own) : (row["slice"] + 1) * len(own)] = own
        return wanted.sparkSession.sparkContext.broadcast(bits)

    def _keys(self, sets: DataFrame) -> DataFrame:
        """(point, rank, link, key): of each set the first n - ceil(s * n) + 1 shingles, s the similarity at distance 2 * eps, rare ones first.

        Two points at most 2 * eps apart share one of them, and two that link share one of those marked link: the first
        n - ceil(percent * n / 100) + 1.

        rank is the smaller, the more often a set's shingles occur: what stands in the middle of a crowd makes the best pivot.
        """
        total = sets.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
        cells = min(self.cells_log2, max(12, int(total).bit_length()))
        slices = sets.mapInArrow(lambda it: _count(it, cells), "slice int, counts binary").groupBy("slice")
        merged = narrow(slices.applyInArrow(_add, "slice int, counts binary"))
        table = np.zeros(1 << cells, np.int32)
        for row in merged.collect():  # at most 2 ** cells_log2 numbers, as one job
            own = np.frombuffer(row["counts"], np.int32)
            table[row["slice"] * len(own) : (row["slice"] + 1) * len(own)] = own
        shared, percent = sets.sparkSession.sparkContext.broadcast(table), self.percent
        keys = materialize(sets.mapInArrow(lambda it: _rare_first(it, shared, percent), "point long, rank long, link boolean, key long"))
        shared.destroy()
        return keys

    def _measured(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """(point, leader, pivot, both, all) of the pairs of a distance up to 2 * eps: sizes of intersection and union."""
        size = sets.select("point", F.size("shingles").alias("n"))
        pairs = narrow(narrow(pairs.join(size, "point")).join(size.select(F.col("point").alias("leader"), F.col("n").alias("m")), "leader"))
        wide = 2 * self.percent - 100
        pairs = pairs.where(100 * F.least("n", "m") >= wide * F.greatest("n", "m"))
        pairs = pairs.join(sets, "point").join(sets.select(F.col("point").alias("leader"), F.col("shingles").alias("others")), "leader")
        both = F.size(F.array_intersect("shingles", "others"))
        pairs = pairs.select("point", "leader", "pivot", both.alias("both"), (F.col("n") + F.col("m")).alias("sum"))
        return pairs.select("point", "leader", "pivot", "both", (F.col("sum") - F.col("both")).alias("all")).where(100 * F.col("both") >= wide * F.col("all"))

    def _across(self, near: DataFrame, star: DataFrame, sets: DataFrame) -> DataFrame:
        """(point, leader): links between core and window of a region, one at least for each two components that they join.

        A window member meets one block of the core first; only those that no link has joined to the core by then meet
        the other blocks. Both sides are dealt out by blocks, so no task holds a region.
        """
        inner = 100 * F.col("both") >= self.percent * F.col("all")
        near = near.where(~inner | (F.col("home") == F.col("leader")))
        near = near.select("leader", "point", inner.alias("core"), (1 - F.col("both") / F.col("all")).alias("gap"))
        size = near.groupBy("leader").agg(F.sum(F.col("core").cast("int")).alias("c"), F.sum((~F.col("core")).cast("int")).alias("w")).where("c > 0 and w > 0")
        blocks = lambda c: F.ceil(F.col(c) / self.block).cast("int")
        near = narrow(near.join(size.select("leader", blocks("c").alias("cs"), blocks("w").alias("ws")), "leader"))
        place = lambda of: F.pmod(F.xxhash64("point"), F.col(of)).cast("int")
        near = materialize(near.withColumn("own", F.when(F.col("core"), place("cs")).otherwise(place("ws"))))
        known, found = star, []
        for turn in ("first", "rest"):
            groups = materialize(narrow(connected_components(known, "leader", "point")))
            of = lambda c: groups.select(F.col("node").alias(c), F.col("component").alias(f"{c}_in"))  # noqa: B023, E731
            inside = near.where("core and own = 0" if turn == "first" else "core and own > 0")
            outside = near.where("not core" if turn == "first" else "not core and cs > 1")
            outside = narrow(narrow(outside.join(of("point"), "point", "left")).join(of("leader"), "leader"))
            outside = outside.where("point_in is null or point_in <> leader_in").drop("point_in", "leader_in")
            over = lambda begin, end: F.explode(F.sequence(begin, end))
            c = inside.join(outside.select("leader").distinct(), "leader", "left_semi").select("*", F.col("own").alias("x"), over(F.lit(0), F.col("ws") - 1).alias("y"))
            w = outside.select("*", F.col("own").alias("y"), F.lit(0).alias("x") if turn == "first" else over(F.lit(1), F.col("cs") - 1).alias("x"))
            both = c.unionByName(w).select("leader", "x", "y", "core", "point", "gap").join(sets, "point")
            percent = self.percent
            new = materialize(both.groupBy("leader", "x", "y").applyInArrow(lambda t: _joined(t, percent), "point long, leader long"))
            found.append(new)
            known = materialize(narrow(known.unionByName(new)))
        return _union(found)


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _heads(values: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``size`` values of each row, and the rows they are of."""
    row = np.repeat(np.arange(len(size)), size)
    begin = np.cumsum(size) - size
    return values[first[:-1][row] + np.arange(len(row)) - begin[row]], row


def _prints(it: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Fingerprints and size of each text's set, and its n - ceil(percent * n / 100) + ceil(n / 10) smallest hashes."""
    for piece in pieces(it, "text"):
        h, first = shingle_sets(piece, width)  # sorted by hash
        n = np.diff(first)
        take = np.minimum(n, n + (-percent * n // 100) + -(-n // 10))
        fp1, fp2 = _fingerprints(h, first)
        heads = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(take))), pa.int32()), pa.array(_heads(h.view(np.int64), first, take)[0]))
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "fp1": fp1, "fp2": fp2, "n": n, "heads": heads})


def _once(h: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of hash and owner once, sorted by both, and where another hash begins (also at the end)."""
    order = np.lexsort((o, h))
    h, o = h[order], o[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    begin = np.ones(len(h) + 1, bool)
    begin[1:-1] = h[1:] != h[:-1]
    return h, o, begin


def _packed(it: Iterator[pa.RecordBatch], shards: int, lot: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Smallest hashes and their owners by range of hashes, lot by lot.

    Hashes are cut to 48 bits: two that meet by that only keep a set for the exact steps. Of a hash's owners in a lot the
    first and the last are sent, which is enough to tell that it is shared; those between are counted here. So a hash
    of a third of all texts is sent twice a lot. Counts may exceed the truth where copies stand in several lots.
    """

    def flush() -> pa.RecordBatch:
        h, o, begin = _once(np.concatenate([v for v, _ in held]) >> np.uint64(16), np.concatenate([f for _, f in held]))
        sent = begin[:-1] | begin[1:]
        counted, counts = np.unique(o[~sent], return_counts=True)
        h, o = h[sent], o[sent]
        cut = np.searchsorted(((h >> np.uint64(16)) * np.uint64(shards)) >> np.uint64(32), np.arange(shards + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(cut))
        out = {"shard": full.tolist(), "hashes": [_planes(h[cut[s] : cut[s + 1]]) for s in full], "owners": [o[cut[s] : cut[s + 1]].tobytes() for s in full]}
        out["counted"], out["counts"] = [b""] * len(full), [b""] * len(full)
        k = int(counted[0] % len(full)) if len(counted) else 0  # whichever range: counts are added up after it
        out["counted"][k], out["counts"][k] = counted.tobytes(), counts.astype("<i4").tobytes()
        return pa.RecordBatch.from_pydict({c: pa.array(v, pa.int32() if c == "shard" else pa.binary()) for c, v in out.items()})

    held, size = [], 0
    for piece in pieces(it, "heads"):
        values, first = _lists(piece.column("heads"))
        if len(values):
            held.append((values.view(np.uint64), np.repeat(piece.column("fp1").to_numpy(), np.diff(first))))
            size += len(values)
        if size >= lot:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _planes(h: np.ndarray) -> bytes:
    """48-bit hashes as three runs of 16 bits, the upper of which compresses well as hashes are sorted."""
    return b"".join(((h >> np.uint64(k)) & np.uint64(0xFFFF)).astype("<u2").tobytes() for k in (32, 16, 0))


def _shared(table: pa.Table) -> pa.Table:
    """(owner, shared): how many of its smallest hashes in this range another owner has, with what was counted before."""
    read = lambda c, kind: [np.frombuffer(b, kind) for b in table.column(c).to_pylist()]
    planes = [p.reshape(3, -1).astype(np.uint64) for p in read("hashes", "<u2")]
    h = np.concatenate([(p[0] << np.uint64(32)) | (p[1] << np.uint64(16)) | p[2] for p in planes])
    _, o, begin = _once(h, np.concatenate(read("owners", np.int64)))
    several = np.repeat(np.diff(np.flatnonzero(begin)) > 1, np.diff(np.flatnonzero(begin)))
    owners = np.concatenate([o[several], *read("counted", np.int64)])
    counts = np.concatenate([np.ones(int(several.sum()), np.int64), *[c.astype(np.int64) for c in read("counts", "<i4")]])
    owner, at = np.unique(owners, return_inverse=True)
    return pa.table({"owner": pa.array(owner, pa.int64()), "shared": pa.array(np.bincount(at, counts, len(owner)).astype(np.int64), pa.int64())})


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    first = np.concatenate(([0], np.cumsum(column.value_lengths().to_numpy())))
    return column.flatten().to_numpy(), first


def _cell(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles.view(np.uint64) >> np.uint64(64 - cells)).astype(np.int64)


def _count(it: Iterator[pa.RecordBatch], cells: int) -> Iterator[pa.RecordBatch]:
    """How many shingles of the task's sets fall into each cell, in slices of at most 65,536 cells."""
    table = np.zeros(1 << cells, np.int32)
    for batch in it:
        table += np.bincount(_cell(_lists(batch.column("shingles"))[0], cells), minlength=len(table)).astype(np.int32)
    if table.any():
        slices = table.reshape(-1, min(len(table), 1 << 16))
        yield pa.RecordBatch.from_pydict({"slice": np.arange(len(slices), dtype=np.int32), "counts": [s.tobytes() for s in slices]})


def _add(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int32).astype(np.int64) for c in table.column("counts").to_pylist())
    return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()])})


def _bit(ids: np.ndarray, log2: int) -> np.ndarray:
    """Where in a bitmap of 2 ** log2 bits an id stands."""
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - log2)).astype(np.int64)


def _marked(it: Iterator[pa.RecordBatch], log2: int) -> Iterator[pa.RecordBatch]:
    """The bitmap of the task's ids, in slices of at most 65,536 bytes."""
    bits = np.zeros(1 << log2, bool)
    for batch in it:
        bits[_bit(batch.column("doc_id").to_numpy(), log2)] = True
    if bits.any():
        packed = np.packbits(bits, bitorder="little")
        slices = packed.reshape(-1, min(len(packed), 1 << 16))
        yield pa.RecordBatch.from_pydict({"slice": np.arange(len(slices), dtype=np.int32), "counts": [s.tobytes() for s in slices]})


def _either(table: pa.Table) -> pa.Table:
    total = np.bitwise_or.reduce([np.frombuffer(c, np.uint8) for c in table.column("counts").to_pylist()])
    return pa.table({"slice": table.column("slice").slice(0, 1), "counts": pa.array([total.tobytes()])})


def _among(it: Iterator[pa.RecordBatch], marks) -> Iterator[pa.RecordBatch]:
    """The rows with an id that the bitmap holds."""
    bits = marks.value
    log2 = len(bits).bit_length() + 2
    for batch in it:
        batch = batch.filter(pa.compute.is_valid(batch.column("doc_id")))
        at = _bit(batch.column("doc_id").to_numpy(), log2)
        yield batch.filter(pa.array(bits[at >> 3] >> (at & 7).astype(np.uint8) & 1, pa.uint8()).cast(pa.bool_()))


def _rare_first(it: Iterator[pa.RecordBatch], shared, percent: int) -> Iterator[pa.RecordBatch]:
    often = shared.value
    cells = len(often).bit_length() - 1
    for piece in pieces(it, "shingles"):
        values, first = _lists(piece.column("shingles"))
        n = np.diff(first)
        count = often[_cell(values, cells)]
        order = np.lexsort((values, count, np.repeat(np.arange(len(n)), n)))
        rank = -np.add.reduceat(count.astype(np.int64), first[:-1]) * 16 // n
        size = n + (-(2 * percent - 100) * n // 100) + 1
        head, row = _heads(values[order], first, size)
        link = np.arange(len(row)) - (np.cumsum(size) - size)[row] <= (n + (-percent * n // 100))[row]
        yield pa.RecordBatch.from_pydict({"point": piece.column("point").to_numpy()[row], "rank": rank[row], "link": link, "key": head})


def _joined_whole(table: pa.Table, percent: int) -> pa.Table:
    """Links of an area, one for each two components that they join; central members are compared first."""
    table = table.sort_by([("rank", "ascending"), ("point", "ascending")])
    values, first = _lists(table.column("shingles").combine_chunks())
    point, n = table.column("point").to_numpy(), np.diff(first)
    _, code = np.unique(values, return_inverse=True)
    mark, group = np.zeros(len(code) + 1, bool), np.arange(len(point))
    a, b = [], []
    for i in range(len(point) - 1):
        far = i + 1 + np.flatnonzero(group[i + 1 :] != group[i])
        far = far[100 * np.minimum(n[far], n[i]) >= percent * np.maximum(n[far], n[i])]
        if not len(far):
            continue
        mark[code[first[i] : first[i + 1]]] = True
        at = np.cumsum(n[far]) - n[far]
        both = np.add.reduceat(mark[code[np.repeat(first[far] - at, n[far]) + np.arange(n[far].sum())]].astype(np.int64), at)
        mark[code[first[i] : first[i + 1]]] = False
        for j in far[100 * both >= percent * (n[far] + n[i] - both)].tolist():
            if group[j] != group[i]:
                a.append(point[j])
                b.append(point[i])
                group[group == group[j]] = group[i]
    return pa.table({"point": pa.array(a, pa.int64()), "leader": pa.array(b, pa.int64())})


def _joined_blocks(table: pa.Table, percent: int) -> pa.Table:
    """Links between two blocks, or inside the only one, one for each two components that they join."""
    values, at = _lists(table.column("shingles").combine_chunks())
    point, n = table.column("point").to_numpy(), np.diff(at)
    first = table.column("first").to_numpy(zero_copy_only=False)
    alone = table.column("x")[0] == table.column("y")[0] and table.column("i")[0] == table.column("j")[0]
    rows = np.flatnonzero(first), np.flatnonzero(first if alone else ~first)
    near, a, b = np.zeros((len(point), len(point)), bool), [], []
    if len(rows[0]) and len(rows[1]):
        both = _both(values, at, *rows)
        near[np.ix_(*rows)] = (100 + percent) * both >= percent * (n[rows[0]][:, None] + n[rows[1]])
        near |= near.T
    seen = np.zeros(len(point), bool)
    for k in np.flatnonzero(near.any(axis=1)).tolist():
        reached = [] if seen[k] else [k]
        seen[k] = True
        while reached:
            i = reached.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            reached += new.tolist()
            a += point[new].tolist()
            b += [point[i]] * len(new)
    return pa.table({"point": pa.array(a, pa.int64()), "leader": pa.array(b, pa.int64())})


def _both(values: np.ndarray, at: np.ndarray, left: np.ndarray, right: np.ndarray, lot: int = 1 << 21) -> np.ndarray:
    """Sizes of the intersections of all left rows with all right ones.

    Shingles of many rows are counted by products of matrices, a thousand at a time; others by listing the pairs that share them.
    """
    _, code = np.unique(values, return_inverse=True)
    own = lambda some: np.concatenate([code[at[r] : at[r + 1]] for r in some])
    codes, n = (own(left), own(right)), np.diff(at)
    places = [np.repeat(np.arange(len(some)), n[some]) for some in (left, right)]
    counts = [np.bincount(c, minlength=int(code.max()) + 1) for c in codes]
    met, shape = counts[0] * counts[1], (len(left), len(right))
    both = np.zeros(shape, np.int64)
    common = np.flatnonzero(100 * met > len(left) * len(right))
    for k in range(0, len(common), 1024):
        some = common[k : k + 1024]
        column = np.full(len(met), -1)
        column[some] = np.arange(len(some))
        marks = []
        for c, place, size in zip(codes, places, shape, strict=True):
            held = column[c] >= 0
            marks.append(np.zeros((size, len(some)), np.float32))
            marks[-1][place[held], column[c[held]]] = 1
        both += (marks[0] @ marks[1].T).astype(np.int64)
    met[common] = 0
    order = np.argsort(codes[1], kind="stable")
    begin = np.cumsum(counts[1]) - counts[1]
    held = np.flatnonzero(met[codes[0]])
    ends = np.cumsum(counts[1][codes[0][held]])
    done = 0
    while done < len(held):  # pairs of rows that share a shingle, a lot at a time
        to = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + lot, "right")))
        some = held[done:to]
        times = counts[1][codes[0][some]]
        other = np.repeat(begin[codes[0][some]] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        both += np.bincount(np.repeat(places[0][some], times) * shape[1] + places[1][order[other]], minlength=both.size).reshape(shape)
        done = to
    return both


def _joined(table: pa.Table, percent: int) -> pa.Table:
    """Of each window member in the task: the first core member found that it links with, if any."""
    values, first = _lists(table.column("shingles").combine_chunks())
    values = values.view(np.uint64)  # as which they are sorted
    n, point, gap = np.diff(first), table.column("point").to_numpy(), table.column("gap").to_numpy()
    core = table.column("core").to_numpy(zero_copy_only=False)
    inside = np.flatnonzero(core)
    inside = inside[np.argsort(-gap[inside], kind="stable")]  # a member far from the pivot is nearer to the window
    a, b = [], []
    for i in np.flatnonzero(~core).tolist():
        own = values[first[i] : first[i + 1]]
        near = inside[gap[i] - gap[inside] <= (100 - percent) / 100 + 1e-9]
        near = near[100 * np.minimum(n[near], n[i]) >= percent * np.maximum(n[near], n[i])]
        for k in range(0, len(near), 64):
            some = near[k : k + 64]
            m = n[some]
            at = np.cumsum(m) - m
            flat = values[np.repeat(first[some] - at, m) + np.arange(m.sum())]
            place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
            both = np.add.reduceat((own[place] == flat).astype(np.int64), at)
            hit = np.flatnonzero(100 * both >= percent * (m + n[i] - both))
            if len(hit):
                a.append(point[i])
                b.append(point[some[hit[0]]])
                break
    return pa.table({"point": pa.array(a, pa.int64()), "leader": pa.array(b, pa.int64())})
