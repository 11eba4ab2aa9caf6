"""Fill-in-middle transformation, cut at units that a finite automaton counts by a parallel scan.

A chunk of bytes is a function of the state it is entered in: the state it is left in, the units begun inside and
whether a mark was completed. Such functions compose associatively, so chunks are scanned without knowing what stands
before them: inside a chunk the functions of short runs of bytes are looked up and composed in pairs, in pairs of pairs
and so on; across chunks a short fold over their functions gives the state each is entered in and the units before it.

A document of one chunk is scanned and cut where it stands. The chunks of a giant document are dealt out to many
tasks, its functions meet in one small row, and only the chunks that hold a cut are looked into again.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import free_name, pieces, text_buffer
from lodestone.session import materialize, ship_package

#: What stands before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")


@dataclass(frozen=True)
class Automaton:
    """``step[state, byte]`` is the next state, ``begins[state, byte]`` whether a unit begins at the byte, ``found[state, byte]`` whether a mark ends there."""

    step: np.ndarray
    begins: np.ndarray
    found: np.ndarray


def _with_marks(step: np.ndarray, begins: np.ndarray, marks: tuple[str, ...]) -> Automaton:
    """The automaton of units side by side with one that looks for ``marks``: a state is a pair of theirs."""
    texts = [m.encode() for m in marks]
    heads = sorted({t[:k] for t in texts for k in range(len(t))} | {b""}, key=lambda h: (len(h), h))
    units = len(step)
    to, begin, found = np.zeros((units * len(heads), 256), np.uint8), np.zeros((units * len(heads), 256), bool), np.zeros((units * len(heads), 256), bool)
    for i, head in enumerate(heads):
        for byte in range(256):
            seen = head + bytes([byte])
            after = max((h for h in heads if seen.endswith(h)), key=len)
            rows = np.arange(units) * len(heads) + i
            to[rows, byte] = step[:, byte] * len(heads) + heads.index(after)
            begin[rows, byte] = begins[:, byte]
            found[rows, byte] = any(seen.endswith(t) for t in texts)
    return _least(Automaton(to, begin, found))


def _least(a: Automaton) -> Automaton:
    """The same automaton with states that nothing tells apart made one; state 0 stays the first."""
    _, kind = np.unique(np.concatenate((a.begins, a.found), 1), axis=0, return_inverse=True)
    while True:
        _, finer = np.unique(np.concatenate((kind[:, None], kind[a.step]), 1), axis=0, return_inverse=True)
        if finer.max() == kind.max():
            break
        kind = finer
    order = np.unique(kind, return_index=True)[1]
    order = order[np.argsort(order)]  # the first state of each kind
    number = np.empty(len(order), np.uint8)
    number[kind[order]] = np.arange(len(order))
    return Automaton(number[kind[a.step[order]]], a.begins[order], a.found[order])


def code_points(marks: tuple[str, ...] = MARKS) -> Automaton:
    """Units are code points: one begins at every byte that does not continue another."""
    lead = (np.arange(256) & 0xC0) != 0x80
    return _with_marks(np.zeros((1, 256), np.uint8), lead[None], marks)


def words(marks: tuple[str, ...] = MARKS) -> Automaton:
    """Units are words with the white space (ASCII) behind them; white space in front is one too."""
    space = np.zeros(256, bool)
    space[[0x20, 9, 10, 11, 12, 13]] = True
    step = np.where(space, 2, 1)[None].repeat(3, 0).astype(np.uint8)  # 0: at the beginning, 1: in a word, 2: behind one
    return _with_marks(step, np.array([np.ones(256, bool), np.zeros(256, bool), ~space]), marks)


def lines(marks: tuple[str, ...] = MARKS) -> Automaton:
    """Units are lines with the line feed that ends them."""
    feed = np.arange(256) == 10
    step = np.where(feed, 0, 1)[None].repeat(2, 0).astype(np.uint8)
    return _with_marks(step, np.array([np.ones(256, bool), np.zeros(256, bool)]), marks)


def compose(first: tuple[np.ndarray, ...], then: tuple[np.ndarray, ...]) -> tuple[np.ndarray, ...]:
    """The functions ``first`` and ``then`` one after the other, row by row: (next state, units, marks) of each start state."""
    to, units, marks = first
    return np.take_along_axis(then[0], to, 1), units + np.take_along_axis(then[1], to, 1), marks | np.take_along_axis(then[2], to, 1)


@dataclass(frozen=True)
class Grams:
    """The functions of all runs of ``size`` byte classes: bytes that an automaton does not tell apart, and a filler that it ignores."""

    kind: np.ndarray
    base: int
    size: int
    functions: tuple[np.ndarray, ...]


def grams(a: Automaton, most: int = 1 << 16) -> Grams:
    """The longest grams of which there are at most ``most``."""
    _, sample, kind = np.unique(np.concatenate((a.step, a.begins, a.found)).T, axis=0, return_index=True, return_inverse=True)
    own = np.arange(len(a.step))[None]
    one = tuple(np.concatenate((x.T[sample].astype(t), y.astype(t))) for x, y, t in ((a.step, own, np.intp), (a.begins, 0 * own, np.int32), (a.found, 0 * own, bool)))
    base, size, made = len(sample) + 1, 1, one
    while base ** (size + 1) <= most:
        made = compose(tuple(x.repeat(base, 0) for x in made), tuple(np.tile(x, (len(made[0]), 1)) for x in one))
        size += 1
    return Grams(kind.reshape(-1).astype(np.uint8), base, size, made)


def scan(data: np.ndarray, offsets: np.ndarray, g: Grams) -> tuple[np.ndarray, ...]:
    """The function of each span of ``data``: those of its grams are looked up and composed pairwise; of an empty one, identity."""
    n = np.diff(offsets)
    cells = -(-n // g.size)
    at = np.concatenate(([0], np.cumsum(cells)))
    filled = np.full(at[-1] * g.size, g.base - 1, np.uint8)
    filled[np.arange(offsets[0], offsets[-1]) + np.repeat(at[:-1] * g.size - offsets[:-1], n)] = g.kind[data[offsets[0] : offsets[-1]]]
    code = np.zeros(at[-1], np.int32)
    for j in range(g.size):
        code = code * g.base + filled[j :: g.size]
    to, units, marks = (x[code] for x in g.functions)
    states = to.shape[1]
    own = (np.tile(np.arange(states, dtype=np.intp), (len(at) - 1, 1)), np.zeros((len(at) - 1, states), np.int32), np.zeros((len(at) - 1, states), bool))
    while len(to):
        # spans of an odd number give their first away, the rest pairs off
        n = np.diff(at)
        odd = np.flatnonzero(n & 1)
        if len(odd):
            own_odd = compose(tuple(x[odd] for x in own), tuple(x[at[:-1][odd]] for x in (to, units, marks)))
            for x, y in zip(own, own_odd, strict=True):
                x[odd] = y
        rest = np.ones(len(to), bool)
        rest[at[:-1][odd]] = False
        to, units, marks = (x[rest] for x in (to, units, marks))
        to, units, marks = compose((to[::2], units[::2], marks[::2]), (to[1::2], units[1::2], marks[1::2]))
        at = np.concatenate(([0], np.cumsum(n >> 1)))
    return own


BLOCK = 256


class Spans:
    """Spans of ``data`` entered in the states ``entry``: the state and the units before each block of 256 bytes, and the totals."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, a: Automaton, g: Grams, entry: np.ndarray):
        self.data, self.offsets, self.a = data, offsets, a
        blocks = -(-np.diff(offsets) // BLOCK)
        first = np.concatenate(([0], np.cumsum(blocks)))
        span = np.repeat(np.arange(len(blocks)), blocks)
        self.begin = offsets[span] + (np.arange(first[-1]) - first[span]) * BLOCK
        to, units, found = scan(data, np.append(self.begin, offsets[-1:]), g)
        state, seen, marked = entry.copy(), np.zeros(len(blocks), np.int64), np.zeros(len(blocks), bool)
        self.state, self.before = np.zeros(len(span), np.intp), np.zeros(len(span), np.int64)
        live = np.flatnonzero(blocks)
        for b in range(int(blocks.max(initial=0))):  # blocks of a span in turn, spans side by side
            live = live[blocks[live] > b]
            at = first[live] + b
            now = state[live]
            self.state[at], self.before[at] = now, seen[live]
            seen[live] += units[at, now]
            marked[live] |= found[at, now]
            state[live] = to[at, now]
        self.units, self.marked, self._key = seen, marked, span * (1 << 33) + self.before

    def locate(self, k: np.ndarray) -> np.ndarray:
        """Where in its span unit number ``k`` (from 0) begins; the span's length if it has no more than k."""
        place = np.diff(self.offsets)
        live = np.flatnonzero(k < self.units)
        block = np.searchsorted(self._key, live * (1 << 33) + k[live], "right") - 1
        at, state, seen = self.begin[block], self.state[block], self.before[block]
        for _ in range(BLOCK):
            if not len(live):
                break
            byte = self.data[at]
            new = self.a.begins[state, byte]
            hit = new & (seen == k[live])
            place[live[hit]] = at[hit] - self.offsets[live[hit]]
            go = ~hit
            live, at, seen, state = live[go], at[go] + 1, (seen + new)[go], self.a.step[state, byte][go]
        return place


class FillInMiddle:
    """Documents as prefix, suffix and middle, by a hash of seed and id; ``units`` makes the automaton that cuts count in.

    ``plain_percent`` of the documents stay as they are and ``spm_percent`` of the others put the suffix first. A text
    of over ``chunk`` bytes is scanned in chunks by many tasks; where it is cut does not depend on that.
    """

    def __init__(self, units=code_points, seed: int = 1, plain_percent: int = 10, spm_percent: int = 20, marks: tuple[str, str, str] = MARKS, chunk: int = 1 << 16):
        self.units, self.seed, self.plain_percent, self.spm_percent, self.marks, self.chunk = units, seed, plain_percent, spm_percent, marks, chunk

    def run(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n, form, prefix_units, middle_units, output) for each row of ``docs``.

        n counts units. The prefix ends after the smaller of two hashes modulo n + 1, the middle after the larger.
        A null or empty text, one that holds a mark, and one without an id stays plain: output is the text (null: empty)
        and the unit columns are null. Rows that repeat are given each. Other columns are not read.
        """
        ship_package(docs.sparkSession)
        d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        a, chunk = self.units(self.marks), self.chunk
        kind = d.schema["doc_id"].dataType.simpleString()
        d = d.withColumns({f"h{k}": self._hash(k) for k in (1, 2)})
        giant = F.octet_length("text") > chunk
        cut = d.where(~giant).mapInArrow(lambda it: _cut(it, a), f"doc_id {kind}, text string, n long, marked boolean, k1 long, k2 long, at1 long, at2 long")
        return self._formed(cut.unionByName(self._giants(d.where(giant), a)))

    def _hash(self, k: int) -> Column:
        digest = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.col("doc_id").cast("string")), 256)
        return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")

    def _giants(self, d: DataFrame, a: Automaton) -> DataFrame:
        """What ``_cut`` gives, for texts of many chunks: each distinct row once, joined back to all."""
        chunk, key = self.chunk, ["doc_id", "tag"]
        kind = d.schema["doc_id"].dataType.simpleString()
        d = d.withColumn("tag", F.xxhash64("text"))
        every = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("text") - 1) / chunk).cast("int")))
        parts = d.select(*key, "h1", "h2", "text", every.alias("chunk"))
        parts = parts.select(*key, "h1", "h2", "chunk", F.substring(F.col("text").cast("binary"), F.col("chunk") * chunk + 1, F.lit(chunk)).alias("data"))
        parts = materialize(parts.repartition("tag", "chunk").dropDuplicates([*key, "chunk"]))
        made = parts.mapInArrow(lambda it: _functions(it, a), f"doc_id {kind}, tag long, h1 long, h2 long, chunk int, next array<int>, units array<long>, marked array<boolean>")
        # at most 2 GB / chunk small functions a document
        facts = made.groupBy(*key, "h1", "h2").agg(F.sort_array(F.collect_list(F.struct("chunk", "next", "units", "marked"))).alias("f"))
        folded = materialize(facts.mapInArrow(_fold, f"doc_id {kind}, tag long, n long, marked boolean, k1 long, k2 long, cuts array<struct<cut:int,chunk:int,state:int,left:long>>"))
        cuts = folded.select(*key, F.inline("cuts")).withColumnRenamed("doc_id", "id")
        same = (F.col("id").eqNullSafe(parts["doc_id"])) & (cuts["tag"] == parts["tag"]) & (cuts["chunk"] == parts["chunk"])
        held = cuts.join(parts, same).select(parts["doc_id"], parts["tag"], cuts["chunk"], "cut", "state", "left", "data")
        found = held.mapInArrow(lambda it: _find(it, a, chunk), f"doc_id {kind}, tag long, cut int, at long")
        at = found.groupBy(*key).agg(*[F.max(F.when(F.col("cut") == k, F.col("at"))).alias(f"at{k}") for k in (1, 2)])
        folded = folded.alias("l").join(at.alias("r"), F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.tag") == F.col("r.tag")), "left")
        folded = folded.select(F.col("l.doc_id").alias("id"), F.col("l.tag").alias("key"), "n", "marked", "k1", "k2", "at1", "at2")
        end = F.octet_length("text").cast("long")
        out = d.join(folded, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("key") == F.col("tag")))
        return out.select("doc_id", "text", "n", "marked", "k1", "k2", F.coalesce("at1", end).alias("at1"), F.coalesce("at2", end).alias("at2"))

    def _formed(self, cut: DataFrame) -> DataFrame:
        p, s, m = map(F.lit, self.marks)
        plain = (F.col("n") == 0) | F.col("marked") | F.coalesce(self._hash(3) % 100 >= 100 - self.plain_percent, F.lit(True))
        form = F.when(plain, "plain").when(self._hash(4) % 100 < self.spm_percent, "spm").otherwise("psm")
        data = F.col("text").cast("binary")
        part = lambda begin, end: F.substring(data, begin + 1, end - begin).cast("string")
        at1, at2 = F.col("at1").cast("int"), F.col("at2").cast("int")
        d = cut.select("*", form.alias("form"), part(F.lit(0), at1).alias("prefix"), part(at1, at2).alias("middle"), part(at2, F.octet_length("text")).alias("suffix"))
        output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).otherwise(F.concat(s, "suffix", p, "prefix", m, "middle"))
        units = lambda c: F.when(F.col("form") != "plain", c)
        return d.select("doc_id", "n", "form", units(F.col("k1")).alias("prefix_units"), units(F.col("k2") - F.col("k1")).alias("middle_units"), output.alias("output"))

    def restore(self, done: DataFrame, out: str = "restored") -> DataFrame:
        """``done`` with the text that ``output`` was made from, rebuilt from it and ``form`` alone."""
        part = free_name(done.columns, "_part")
        mark = "|".join("".join(f"\\x{{{ord(c):x}}}" for c in m) for m in self.marks)
        d = done.withColumn(part, F.split("output", mark))
        p = [F.col(part)[k] for k in range(4)]
        text = F.when(F.col("form") == "plain", F.col("output")).when(F.col("form") == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))
        return d.withColumn(out, text).drop(part)


def _cut(it: Iterator[pa.RecordBatch], a: Automaton) -> Iterator[pa.RecordBatch]:
    g = grams(a)
    for piece in pieces(it, "text"):
        data, off = text_buffer(piece.column("text"))
        s = Spans(data, off, a, g, np.zeros(len(off) - 1, np.intp))
        cuts = np.sort([pc.fill_null(piece.column(h), 0).to_numpy(zero_copy_only=False) % (s.units + 1) for h in ("h1", "h2")], axis=0)
        at = [s.locate(k) for k in cuts]
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "text": piece.column("text"), "n": s.units, "marked": s.marked, "k1": cuts[0], "k2": cuts[1], "at1": at[0], "at2": at[1]})


def _functions(it: Iterator[pa.RecordBatch], a: Automaton) -> Iterator[pa.RecordBatch]:
    g = grams(a)
    for piece in pieces(it, "data"):
        to, units, marked = scan(*text_buffer(piece.column("data")), g)
        kept = {c: piece.column(c) for c in ("doc_id", "tag", "h1", "h2", "chunk")}
        yield pa.RecordBatch.from_pydict(kept | {"next": list(to.astype(np.int32)), "units": list(units.astype(np.int64)), "marked": list(marked)})


def _fold(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Composes a document's chunks: its number of units, and for each cut the chunk, its entry state and the units left."""
    for batch in it:
        rows = {c: batch.column(c).to_pylist() for c in ("h1", "h2")}
        n, marked, cuts = [], [], [[], []]
        where = []
        for i, f in enumerate(batch.column("f").to_pylist()):
            state, seen, mark, entries = 0, 0, False, []
            for x in f:
                entries.append((state, seen))
                mark |= x["marked"][state]
                seen, state = seen + x["units"][state], x["next"][state]
            ks = sorted((rows[h][i] or 0) % (seen + 1) for h in ("h1", "h2"))
            found = []
            for cut, k in enumerate(ks, 1):
                if k < seen:
                    c = bisect_right(entries, k, key=lambda e: e[1]) - 1
                    found.append({"cut": cut, "chunk": c, "state": entries[c][0], "left": k - entries[c][1]})
            n.append(seen), marked.append(mark), where.append(found)
            for k, out in zip(ks, cuts, strict=True):
                out.append(k)
        kind = pa.list_(pa.struct([("cut", pa.int32()), ("chunk", pa.int32()), ("state", pa.int32()), ("left", pa.int64())]))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "tag": batch.column("tag"), "n": pa.array(n, pa.int64()), "marked": pa.array(marked, pa.bool_()), "k1": pa.array(cuts[0], pa.int64()), "k2": pa.array(cuts[1], pa.int64()), "cuts": pa.array(where, kind)})


def _find(it: Iterator[pa.RecordBatch], a: Automaton, chunk: int) -> Iterator[pa.RecordBatch]:
    g = grams(a)
    for piece in pieces(it, "data"):
        s = Spans(*text_buffer(piece.column("data")), a, g, piece.column("state").to_numpy().astype(np.intp))
        at = s.locate(piece.column("left").to_numpy()) + chunk * piece.column("chunk").to_numpy().astype(np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": piece.column("doc_id"), "tag": piece.column("tag"), "cut": piece.column("cut"), "at": at})
