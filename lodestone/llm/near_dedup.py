"""MinHash near-dedup by a multi-index Hamming join of b-bit signatures, confirmed on full shingle sets.

A signature has ``chunks`` * ``per_chunk`` components of b = 16 bits. If two signatures differ in at most
r = chunks * (errors + 1) - 1 components, the pigeonhole principle gives a chunk with at most ``errors`` = 1
differing component. Enumerating the component that may differ (one key for each, over the others) finds every
such pair, and most pairs beyond: a pair is lost only if every chunk differs in two components or more. With 12
chunks of 4 (r = 23 of 48) that has probability (1 - 0.75**4 - 4 * 0.25 * 0.75**3)**12 = 1.0e-7 at a Jaccard
similarity of 0.75. Pairs that share a key are never judged by their signatures, only by their full sets.

Groups of copies never turn into all pairs: equal sets are one node; in each key the members are compared with
the smallest one, links make components, and only where one key still holds different components its members are
compared across them - by size, then by full sets, inside a task that emits nothing but links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import connected_components
from lodestone.llm.textops import LOWER, mix, pieces, text_buffer, window_hashes, window_starts, word_hashes
from lodestone.session import discard, materialize, ship_package

_RNG = np.random.default_rng(7)
_SEEDS = _RNG.integers(0, 2**64, (512, 2), dtype=np.uint64) | np.uint64(1)


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within the text, and where each text's begin."""
    data, off = text_buffer(batch.column("text"))
    words, first = word_hashes(LOWER[data], off)
    starts, text = window_starts(first, width)
    h = window_hashes(words, starts, width)
    count = np.diff(first)
    for i in np.flatnonzero((count > 0) & (count < width)):  # the whole sequence is the only shingle
        own = words[first[i] : first[i + 1]]
        whole = window_hashes(own, np.zeros(1, np.int64), len(own), 0xC2B2AE3D27D4EB4F + 2 * len(own))
        h, text = np.append(h, whole), np.append(text, i)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    h, text = h[new], text[new]
    return h, np.searchsorted(text, np.arange(len(count) + 1))


class NearDedup:
    """Links texts with Jaccard similarity of at least ``percent`` / 100 on sets of ``width``-word shingles."""

    def __init__(self, width: int = 5, percent: int = 75, chunks: int = 12, per_chunk: int = 4, block: int = 512):
        self.width, self.percent, self.chunks, self.per_chunk, self.block = width, percent, chunks, per_chunk, block

    def run(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

        Texts are cut into words at ASCII white space, A-Z lower-cased. A null text and one without words has
        an empty set, links with nothing and is kept. A null id takes no part: component_id is null, the row
        is kept. Equal ids are one document where their sets are equal; rows that repeat are given each.
        Other columns are not read.
        """
        judged = self.judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")))
        return judged.select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")

    def judge(self, docs: DataFrame) -> DataFrame:
        """(doc_id, tag, n, component, component_id, kept) for each row of ``docs``; tag is xxhash64 of the text.

        component tells apart what component_id, its smallest id, does not: unlike texts under one id. It is null
        where the row links with nothing by rule.
        """
        ship_package(docs.sparkSession)
        d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        width, k = self.width, self.chunks * self.per_chunk
        schema = "doc_id long, tag long, n long, fp1 long, fp2 long, sig binary"
        features = materialize(d.withColumn("tag", F.xxhash64("text")).mapInArrow(lambda it: _features(it, width, k), schema))
        nodes = features.where("n > 0 and doc_id is not null").groupBy("fp1", "fp2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("m"))
        nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "m.doc_id", "fp1", "fp2", "n", "m.sig")
        nodes = materialize(nodes)  # from here on a set has one number
        links = self.links(d, nodes)
        least = nodes.select("node", "doc_id").join(links, "node").groupBy("component").agg(F.min("doc_id").alias("least"))
        groups = nodes.drop("sig").join(links, "node", "left").join(least, "component", "left")
        groups = groups.select("fp1", "fp2", "n", F.coalesce("component", "node").alias("component"), F.coalesce("least", "doc_id").alias("least"))
        out = features.drop("sig").join(groups, ["fp1", "fp2", "n"], "left")
        alone = (F.col("n") == 0) | F.col("doc_id").isNull()
        out = out.withColumns({"component": F.when(~alone, F.col("component")), "component_id": F.when(alone, F.col("doc_id")).otherwise(F.col("least"))})
        return out.select("doc_id", "tag", "n", "component", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))

    def keep(self, docs: DataFrame) -> DataFrame:
        """One row of ``docs``, with all its columns, of each group of near copies: the smallest id; rows without an id stay.

        Unlike texts under one id are in groups of their own. Where a group has several texts under its smallest
        id, the one of the smallest tag stays.
        """
        own = ["doc_id", "_tag"]
        judged = self.judge(docs).where("doc_id is not null").withColumnRenamed("tag", "_tag")
        texts = materialize(judged.groupBy(*own, "component", "kept").count())
        stay = texts.where("kept").groupBy("doc_id", "component").agg(F.min("_tag").alias("_tag")).select(*own)
        gone = texts.select(*own).join(stay, own, "left_anti")
        left = docs.withColumn("_tag", F.xxhash64("text")).join(gone, own, "left_anti")
        repeated = texts.where("kept and count > 1").select(*own)
        if repeated.isEmpty():
            return left.select(*docs.columns)
        return left.join(repeated, own, "left_anti").select(*docs.columns).unionByName(left.join(repeated, own, "left_semi").dropDuplicates(own).select(*docs.columns))

    def links(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """(node, component) of the nodes that some link touches."""
        chunks, per, percent, block = self.chunks, self.per_chunk, self.percent, self.block
        keys = nodes.select("node", "sig").mapInArrow(lambda it: _keys(it, chunks, per), "node long, key long")
        lead = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("size")).where("size > 1")
        members = materialize(keys.join(lead, "key"))
        own = ["doc_id", "fp1", "fp2", "n"]
        touched = nodes.join(members.select("node"), "node", "left_semi").select("node", *own)
        wanted = docs.join(touched, "doc_id", "left_semi")
        width = self.width
        sets = wanted.mapInArrow(lambda it: _sets(it, width), "doc_id long, fp1 long, fp2 long, n long, shingles array<long>")
        sets = materialize(sets.groupBy(*own).agg(F.first("shingles").alias("shingles")).join(touched, own).select("node", "shingles"))

        star = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
        star = star.join(nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a")), "a").join(nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b")), "b")
        sized = star.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")).select("a", "b")
        confirmed = materialize(self.confirm(sized, sets))
        groups = materialize(connected_components(confirmed, "a", "b"))

        # what one key holds in different components is compared, but for the leader, with everything it may be near to
        open_ = members.where("size > 2").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        mixed = open_.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        rest = open_.join(mixed, "key").select("node", "leader").distinct()
        around = connected_components(rest, "leader", "node").select("node", F.col("component").alias("around"))
        rest = around.join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))
        # an area of many nodes is compared block by block, so that no task holds all of it
        count = rest.groupBy("around").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
        rest = rest.join(count, "around").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        rest = rest.join(sets, "node")
        rest = rest.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        rest = rest.withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
        rest = rest.select("around", "x", "y", "own", "node", "component", "shingles")
        more = materialize(rest.groupBy("around", "x", "y").applyInArrow(lambda t: _cross(t, percent), "a long, b long"))
        found = connected_components(confirmed.unionByName(more), "a", "b")
        for table in (members, sets, confirmed, groups, more):
            discard(table)
        return found

    def confirm(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs whose full sets are similar enough."""
        a, b = (sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab")
        both = F.size(F.array_intersect("set_a", "set_b"))
        p = pairs.join(a, "a").join(b, "b").select("a", "b", both.alias("both"), (F.size("set_a") + F.size("set_b")).alias("all"))
        return p.where(100 * F.col("both") >= self.percent * (F.col("all") - F.col("both"))).select("a", "b")


def _fingerprints(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over the mixed hashes of each set, which tell sets apart."""
    n = np.diff(first)
    full = np.flatnonzero(n)
    fp = np.zeros((2, len(n)), np.uint64)
    if len(full):
        for i in range(2):
            fp[i, full] = np.add.reduceat(mix(h ^ _SEEDS[-1, i]), first[:-1][full])
    return fp[0].view(np.int64), fp[1].view(np.int64)


def _features(it: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(it, "text"):
        h, first = shingle_sets(piece, width)
        n = np.diff(first)
        full = np.flatnonzero(n)
        at = first[:-1][full]
        fp1, fp2 = _fingerprints(h, first)
        least = np.zeros((len(n), k), np.uint64)
        if len(full):
            for j in range(k):
                least[full, j] = np.minimum.reduceat((h ^ _SEEDS[j, 0]) * _SEEDS[j, 1], at)
        sig = (mix(least) >> np.uint64(48)).astype("<u2")
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "tag": piece.column("tag"), "n": n, "fp1": fp1, "fp2": fp2, "sig": pa.array([s.tobytes() for s in sig], pa.binary())})


def _signatures(column: pa.Array) -> np.ndarray:
    data, _ = text_buffer(column)
    return np.ascontiguousarray(data).view("<u2").reshape(len(column), -1) if len(column) else np.zeros((0, 1), "<u2")


def _keys(it: Iterator[pa.RecordBatch], chunks: int, per: int) -> Iterator[pa.RecordBatch]:
    """Each chunk without each of its components: number of the key above, the other components below."""
    for batch in it:
        s = _signatures(batch.column("sig")).astype(np.uint64)
        out = np.empty((len(s), chunks * per), np.uint64)
        for c in range(chunks):
            for drop in range(per):
                key = np.full(len(s), c * per + drop, np.uint64)
                for j in range(per):
                    if j != drop:
                        key = (key << np.uint64(16)) | s[:, c * per + j]
                out[:, c * per + drop] = key
        yield pa.RecordBatch.from_pydict({"node": np.repeat(batch.column("node").to_numpy(), chunks * per), "key": out.reshape(-1).view(np.int64)})


def _sets(it: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(it, "text"):
        h, first = shingle_sets(piece, width)
        fp1, fp2 = _fingerprints(h, first)
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "fp1": fp1, "fp2": fp2, "n": np.diff(first), "shingles": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(h.view(np.int64)))})


def _cross(table: pa.Table, percent: int) -> pa.Table:
    """Links that join different components in one area (one pair of its blocks), by full sets; one for each two joined."""
    node, component = table.column("node").to_numpy(), table.column("component").to_numpy().copy()
    own = table.column("own").to_numpy()
    sets = table.column("shingles").combine_chunks()
    first = np.concatenate(([0], np.cumsum(sets.value_lengths().to_numpy())))
    values, code = np.unique(sets.flatten().to_numpy(), return_inverse=True)
    size = np.diff(first)
    x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
    left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
    held = np.zeros(len(values), bool)
    a, b = [], []
    for i in left:
        far = right[(component[right] != component[i]) & ((node[right] > node[i]) | (x != y))]
        far = far[100 * np.minimum(size[far], size[i]) >= percent * np.maximum(size[far], size[i])]
        if not len(far):
            continue
        held[code[first[i] : first[i + 1]]] = True
        n = size[far]
        at = np.cumsum(n) - n
        both = np.add.reduceat(held[code[np.repeat(first[far] - at, n) + np.arange(n.sum())]].astype(np.int64), at)
        held[code[first[i] : first[i + 1]]] = False
        far = far[100 * both >= percent * (n + size[i] - both)]
        for j in far.tolist():
            if component[j] != component[i]:  # what is joined already needs no more links
                a.append([node[i]])
                b.append([node[j]])
                component[component == component[j]] = component[i]
    a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
    return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})
