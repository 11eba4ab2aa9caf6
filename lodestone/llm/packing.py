"""Token ids packed into fixed rows: best-fit decreasing with a segment tree over free space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.bpe import WordTable, _slices, _spans, read_ranks
from lodestone.llm.textops import pieces, span_hashes
from lodestone.session import ship_package

Encoder = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


class FreeSpace:
    """A segment tree over amounts of free space 0..size: is there an open row with at least so much?"""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, space: int, row: int) -> None:
        self.rows[space].append(row)
        i = self.base + space
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The row with the least space of at least ``need``, the one opened or filled last of equals, and its space."""
        count, i = self.count, self.base + need
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        space = i - self.base
        while i:
            count[i] -= 1
            i >>= 1
        return self.rows[space].pop(), space


def best_fit_decreasing(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Items (at most ``size`` long) of each row; the longest first, ties in their order."""
    space, rows = FreeSpace(size), []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        got = space.take(n)
        if got is None:
            row, left = len(rows), size
            rows.append([])
        else:
            row, left = got
        rows[row].append(i)
        if left - n:
            space.add(left - n, row)
    return rows


class Packing:
    """``tokens`` bounds what a task packs at once; rows are not shared between such lots."""

    def __init__(self, path: str, size: int = 2048, tokens: int = 4_000_000, end: int | None = None):
        self.path, self.size, self.tokens, self.end = path, size, tokens, end

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, ids binary): token ids of whole texts as little-endian 16-bit numbers. Null: none."""
        d, encoded = self._encoder(docs, id_col, text)
        return d.mapInArrow(encoded, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, ids binary")

    def _encoder(self, docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, Encoder]:
        """The columns to read, and what turns their batches into (doc_id, ids)."""
        import public_tokenizers

        ship_package(docs.sparkSession)
        ranks = read_ranks(self.path)
        if max(ranks.values()) > 0xFFFE:
            raise ValueError("ids must fit 16 bits")
        shared = docs.sparkSession.sparkContext.broadcast((ranks, public_tokenizers.PATTERN))
        return docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), lambda it: _encode(it, shared)

    def pack(self, encoded: DataFrame) -> DataFrame:
        """Rows of ``size`` ids from (doc_id, ids): row_id, n_tokens, input_ids, cu_seqlens, position_resets, doc_ids.

        input_ids is a little-endian 16-bit matrix row, padded by 65535; cu_seqlens are the ends of its segments
        after a leading 0; position_resets the position, in its document, at which each segment begins (over 0
        where a document longer than ``size`` was cut); doc_ids the segments' documents. Every token stands once.
        Documents without tokens are in no row. row_id is the task's number and the row's in the task.
        """
        ship_package(encoded.sparkSession)
        size, limit = self.size, self.tokens
        return encoded.select("doc_id", "ids").mapInArrow(lambda it: _pack(it, size, limit), _schema(encoded))

    def run(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """``pack`` of ``encode``, in one Python worker a task."""
        d, encoded = self._encoder(docs, id_col, text)
        size, limit = self.size, self.tokens
        return d.mapInArrow(lambda it: _pack(encoded(it), size, limit), _schema(d))


def _schema(df: DataFrame) -> str:
    return f"row_id long, n_tokens int, input_ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<{df.schema['doc_id'].dataType.simpleString()}>"


def _encode(it: Iterator[pa.RecordBatch], shared, most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Each distinct word of a piece is encoded once; a table of about ``most`` words is kept for the next piece."""
    import tiktoken

    ranks, pattern = shared.value
    encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    none = tuple(np.zeros(0, kind) for kind in (np.uint64, np.int64, np.int32, np.int64))
    known, table = none, WordTable(*none)
    for piece in pieces(it, "text", 1 << 20):
        data, begin, end, first = _spans(piece)
        h, length = span_hashes(data, begin, end), end - begin
        at = table.find(h, length)
        lacking = np.flatnonzero(at < 0)
        if len(lacking):
            if len(known[0]) > most:  # bounded: the table starts anew
                known, lacking = none, np.arange(len(h))
            own = lacking[np.unique(h[lacking], return_index=True)[1]]
            ids = [encoding.encode_ordinary(w.decode()) for w in _slices(data, begin[own], end[own])]
            count = np.fromiter(map(len, ids), np.int64, len(ids))
            fresh = (h[own], length[own], np.fromiter((i for x in ids for i in x), np.int32), count)
            known = tuple(map(np.concatenate, zip(known, fresh, strict=True)))
            table = WordTable(*known)
            at = table.find(h, length)
        count = table.first[at + 1] - table.first[at]
        to = np.concatenate(([0], np.cumsum(count)))
        flat = table.flat[np.repeat(table.first[at] - to[:-1], count) + np.arange(to[-1])].astype("<u2").tobytes()
        off = (2 * to[first]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(flat)])], ["doc_id", "ids"])


def _pack(it: Iterator[pa.RecordBatch], size: int, limit: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    row_id = (task.partitionId() if task else 0) << 33
    held: list[pa.RecordBatch] = []
    n = 0
    for piece in pieces(it, "ids"):
        held.append(piece)
        n += sum(len(b) for b in piece.column("ids").to_pylist() if b) // 2
        if n >= limit:
            for out in _rows(held, size, row_id):
                row_id += out.num_rows
                yield out
            held, n = [], 0
    if n:
        yield from _rows(held, size, row_id)


def _rows(held: list[pa.RecordBatch], size: int, row_id: int) -> Iterator[pa.RecordBatch]:
    docs = pa.concat_arrays([b.column("doc_id") for b in held])
    blobs = [x or b"" for b in held for x in b.column("ids").to_pylist()]
    lengths = np.fromiter((len(b) // 2 for b in blobs), np.int64, len(blobs))
    cuts = -(-lengths // size)
    doc = np.repeat(np.arange(len(blobs)), cuts)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)) * size
    length = np.minimum(lengths[doc] - start, size)
    rows = best_fit_decreasing(length, size)
    for at in range(0, len(rows), 2000):
        part = rows[at : at + 2000]
        items = np.fromiter((i for r in part for i in r), np.int64)
        ends = np.cumsum([0, *map(len, part)])
        ids, cu, total = [], [], []
        for r in part:
            used = np.cumsum([0, *(length[i] for i in r)])
            cu.append(used.astype(np.int32))
            total.append(int(used[-1]))
            ids.append(b"".join(blobs[doc[i]][2 * start[i] : 2 * (start[i] + length[i])] for i in r) + b"\xff\xff" * (size - total[-1]))
        lists = lambda off, values: pa.ListArray.from_arrays(pa.array(off, pa.int32()), values)
        yield pa.RecordBatch.from_arrays(
            [pa.array(row_id + at + np.arange(len(part))), pa.array(total, pa.int32()), pa.array(ids, pa.binary()), lists(ends + np.arange(len(ends)), pa.array(np.concatenate(cu))), lists(ends, pa.array(start[items], pa.int32())), lists(ends, docs.take(pa.array(doc[items])))],
            ["row_id", "n_tokens", "input_ids", "cu_seqlens", "position_resets", "doc_ids"],
        )
