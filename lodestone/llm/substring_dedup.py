"""Exact substring dedup behind a count-min prefilter.

1. Every task adds its windows of words to a count-min sketch (two rows of cells, counts kept up to two) and
   writes the sketch in compressed blocks; blocks are merged by key.
2. Only windows whose estimate in the merged sketch is two or more are kept - a sketch overestimates and never
   underestimates, so no repeated window is lost. A task resolves what repeats inside its own rows; for each
   window it passes on only the occurrences of its smallest document, so a passage that a third of all
   documents hold costs one entry a task. Entries are grouped exactly by their window.
3. Flagged windows return to their documents, where the words that they cover are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import pieces, span_hashes, text_buffer, window_hashes, window_starts, word_spans
from lodestone.session import ship_package

_SECOND = 0xA24BAED4963EE407
#: A row is known by its id and its tag, a hash of the text; the tag shrinks to nothing where no id has two texts.
_FLAG = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("pos", "<u4")])
_ENTRY = np.dtype([("h1", "<u8"), ("h2", "<u4"), *_FLAG.descr])
_PAYLOAD = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])


def _pack(a: np.ndarray) -> bytes:
    """Columns one after another, compressed: a block of numbers of one kind shrinks better."""
    raw = b"".join(np.ascontiguousarray(a[name]).tobytes() for name in a.dtype.names)
    return len(a).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(blob[:8], "little")
    raw = pa.decompress(blob[8:], decompressed_size=n * dtype.itemsize, codec="zstd")
    out, at = np.empty(n, dtype), 0
    for name in dtype.names:
        kind = dtype[name]
        out[name] = np.frombuffer(raw, kind, n, at)
        at += n * kind.itemsize
    return out


class SubstringDedup:
    """Removes words covered by a window that also starts in a document with a smaller id.

    ``max_cells_log2`` bounds the sketch and with it the broadcast (two rows of one bit a cell: 64 MB at 28);
    the sketch has four cells a window up to that bound. Past it the estimate is looser and more windows are
    grouped exactly; the result is the same.
    """

    def __init__(self, window: int = 13, max_cells_log2: int = 28, cells_log2: int | None = None, entry_bytes: int = 16 << 20, text_bytes: int = 8 << 20):
        self.window, self.max_cells_log2, self.cells_log2 = window, max_cells_log2, cells_log2
        self.entry_bytes, self.text_bytes = entry_bytes, text_bytes

    def run(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, n_words, n_removed, kept_text) for each row of ``docs``.

        Words are runs without ASCII white space; kept words are joined by one space. Null and empty texts
        have no words and keep the empty text. A row without an id neither removes nor loses words. Rows that
        share an id do not remove each other's words. Other columns are not read.
        """
        ship_package(docs.sparkSession)
        spark = docs.sparkSession
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        tag = F.xxhash64("text")
        by_id = d.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("b"), (F.min(tag) < F.max(tag)).alias("unlike"))
        size, unlike = by_id.agg(F.coalesce(F.sum("b"), F.lit(0)), F.bool_or(F.col("unlike") & F.col("doc_id").isNotNull())).first()
        d = d.withColumn("tag", tag if unlike else F.lit(0).cast("long"))
        cells = self.cells_log2 or max(16, min(self.max_cells_log2, int(np.ceil(np.log2(max(size / 6.5, 1)))) + 2))
        blocks_log2 = max(0, cells - 22)
        known = d.where("doc_id is not null")

        width = self.window
        ones = known.mapInArrow(lambda it: _sketch(it, width, cells, blocks_log2), "block int, once binary, twice binary")
        merged = ones.repartition(2 << blocks_log2, "block").mapInArrow(_merge, "block int, twice binary")
        # bounded by the size of the sketch, compressed
        sketch = spark.sparkContext.broadcast({r["block"]: bytes(r["twice"]) for r in merged.toLocalIterator()})

        buckets = 1 << max(0, int(np.ceil(np.log2(max(size / 6.5 * _ENTRY.itemsize / self.entry_bytes, 1)))))
        parts = max(1, int(np.ceil(size / self.text_bytes)))
        entries = known.mapInArrow(lambda it: _entries(it, width, cells, sketch, buckets, parts), "bucket int, kind int, payload binary")
        flags = entries.groupBy("bucket").applyInArrow(lambda t: _resolve(t, parts), "part int, flags binary")
        d = d.withColumn("part", _part_column(parts))
        return d.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(lambda a, b: _remove(a, b, width), "doc_id long, n_words long, n_removed long, kept_text string")


def _windows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, ...]:
    """h1, h2, text and position in its text of each window."""
    data, off = text_buffer(batch.column("text"))
    begin, end, first = word_spans(data, off)
    starts, text = window_starts(first, width)
    h1 = window_hashes(span_hashes(data, begin, end), starts, width)
    h2 = window_hashes(span_hashes(data, begin, end, _SECOND), starts, width, _SECOND)
    return h1, h2, text, starts - first[:-1][text]


def _cells(h: np.ndarray, cells: int) -> np.ndarray:
    return (h >> np.uint64(64 - cells)).astype(np.uint32)


def _sketch(it: Iterator[pa.RecordBatch], width: int, cells: int, blocks_log2: int, flush: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = [[], []]
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        span = 1 << (cells - blocks_log2)
        for row in (0, 1):
            x = np.concatenate(held[row])
            x.sort()
            new = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            many = np.diff(np.append(new, len(x))) > 1
            x = x[new]
            cuts = np.searchsorted(x, np.arange(0, (1 << blocks_log2) + 1, dtype=np.uint64) * np.uint64(span))
            for b in range(1 << blocks_log2):
                own, twice = x[cuts[b] : cuts[b + 1]] - np.uint32(b * span), many[cuts[b] : cuts[b + 1]]
                if len(own):
                    blobs = []
                    for y in (own, own[twice]):
                        flat = np.zeros(span, bool)
                        flat[y] = True
                        blobs.append(pa.compress(np.packbits(flat, bitorder="little").tobytes(), codec="zstd", asbytes=True))
                    yield pa.RecordBatch.from_pydict({"block": pa.array([(row << blocks_log2) + b], pa.int32()), "once": pa.array([blobs[0]]), "twice": pa.array([blobs[1]])})

    for piece in pieces(it, "text"):
        h1, h2, *_ = _windows(piece, width)
        held[0].append(_cells(h1, cells))
        held[1].append(_cells(h2, cells))
        n += len(h1)
        if n >= flush:
            yield from out()
            held, n = [[], []], 0
    if n:
        yield from out()


def _merge(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in it:
        for r in range(batch.num_rows):
            once, twice = (_inflate(batch.column(c)[r].as_py()) for c in ("once", "twice"))
            k = batch.column("block")[r].as_py()
            if k in held:
                a, b = held[k]
                b |= twice | (a & once)
                a |= once
            else:
                held[k] = once, twice
    for k, (_, twice) in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "twice": pa.array([pa.compress(twice.tobytes(), codec="zstd", asbytes=True)])})


def _inflate(blob: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(blob), np.uint8).copy()


def _payload(bucket: int, kind: int, blob: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([kind], pa.int32()), pa.array([blob], pa.binary())], schema=_PAYLOAD)


def _pack_flags(flags: np.ndarray) -> bytes:
    """Sorted, as differences: documents and positions that follow one another shrink to little."""
    flags = flags[np.lexsort((flags["pos"], flags["tag"], flags["doc"]))]
    out = np.empty(len(flags), _FLAG)
    for name in _FLAG.names:
        out[name] = np.diff(flags[name], prepend=flags[name].dtype.type(0))
    return _pack(out)


def _unpack_flags(blob: bytes) -> np.ndarray:
    flags = _unpack(blob, _FLAG)
    for name in _FLAG.names:
        flags[name] = np.cumsum(flags[name], dtype=_FLAG[name])
    return flags


def _flag_parts(flags: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    if not len(flags):
        return
    part = _part_of(flags["doc"], parts)
    order = np.argsort(part, kind="stable")
    flags, part = flags[order], part[order]
    cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    for a, b in zip(cuts, [*cuts[1:], len(part)], strict=True):
        yield int(part[a]), flags[a:b]


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """As ``_part_column`` deals out documents."""
    return ids.astype(np.int64) % 2147483647 * 48271 % 2147483647 % parts


def _part_column(parts: int) -> Column:
    """The part of a row: by its id, as flags are dealt; rows without an id, which have no flags, by their text."""
    by_id = F.pmod(F.pmod(F.pmod("doc_id", F.lit(2147483647)) * 48271, F.lit(2147483647)), F.lit(parts))
    return F.coalesce(by_id, F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int")


def _bits(blocks: dict[int, bytes], cells: int) -> np.ndarray:
    """Which cells of the two rows count two or more, a bit each."""
    bits = np.zeros(2 * (1 << cells) // 8, np.uint8)
    for block, blob in blocks.items():
        part = _inflate(blob)
        bits[block * len(part) : (block + 1) * len(part)] = part
    return bits.reshape(2, -1)


def _entries(it: Iterator[pa.RecordBatch], width: int, cells: int, sketch, buckets: int, parts: int, flush: int = 1_500_000) -> Iterator[pa.RecordBatch]:
    bits = _bits(sketch.value, cells)
    shift = np.uint64(64 - int(np.log2(buckets))) if buckets > 1 else None
    held: list[np.ndarray] = []
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        e = np.concatenate(held)
        e, local = _split(e)
        bucket = (e["h1"] >> shift).astype(np.int64) if shift is not None else np.zeros(len(e), np.int64)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            yield _payload(int(b), 0, _pack(e[cuts[b] : cuts[b + 1]]))
        for part, flags in _flag_parts(local, parts):
            yield _payload(part % buckets, 1 + part, _pack_flags(flags))

    for piece in pieces(it, "text"):
        h1, h2, text, pos = _windows(piece, width)
        hit = np.ones(len(h1), bool)
        for row, h in enumerate((h1, h2)):
            c = _cells(h, cells)
            hit &= (bits[row][c >> np.uint32(3)] >> (c & np.uint32(7)).astype(np.uint8)) & np.uint8(1) > 0
        e = np.empty(int(hit.sum()), _ENTRY)
        e["h1"], e["h2"], e["pos"] = h1[hit], (h2[hit] & np.uint64(0xFFFFFFFF)), pos[hit]
        e["doc"] = piece.column("doc_id").to_numpy()[text[hit]]
        e["tag"] = piece.column("tag").to_numpy()[text[hit]]
        held.append(e)
        n += len(e)
        if n >= flush:
            yield from out()
            held, n = [], 0
    if n:
        yield from out()


def _split(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of the smallest document of each window, and flags for all others."""
    e = e[np.lexsort((e["doc"], e["h2"], e["h1"]))]
    if not len(e):
        return e, np.empty(0, _FLAG)
    new = np.concatenate(([True], (e["h1"][1:] != e["h1"][:-1]) | (e["h2"][1:] != e["h2"][:-1])))
    least = e["doc"][new][np.cumsum(new) - 1]
    later = e["doc"] > least
    flags = np.empty(int(later.sum()), _FLAG)
    for name in _FLAG.names:
        flags[name] = e[name][later]
    return e[~later], flags


def _resolve(table: pa.Table, parts: int) -> pa.Table:
    parts_out, blobs = [], []
    kinds, payloads = table.column("kind").to_pylist(), table.column("payload")
    entries = [_unpack(payloads[i].as_py(), _ENTRY) for i, k in enumerate(kinds) if k == 0]
    for i, k in enumerate(kinds):
        if k:
            parts_out.append(k - 1)
            blobs.append(payloads[i].as_py())
    if entries:
        _, flags = _split(np.concatenate(entries))
        for part, own in _flag_parts(flags, parts):
            parts_out.append(part)
            blobs.append(_pack_flags(own))
    return pa.table({"part": pa.array(parts_out, pa.int32()), "flags": pa.array(blobs, pa.binary())})


def _remove(docs: pa.Table, flagged: pa.Table, width: int) -> pa.Table:
    own = [_unpack_flags(b.as_py()) for b in flagged.column("flags")]
    flags = np.concatenate(own) if own else np.empty(0, _FLAG)
    flags = flags[np.lexsort((flags["doc"],))]
    n_words, n_removed, kept = [], [], []
    ids, texts, tags = docs.column("doc_id").to_pylist(), docs.column("text"), docs.column("tag").to_pylist()
    for i, (doc, tag) in enumerate(zip(ids, tags, strict=True)):
        words = texts[i].as_py().encode().split()
        gone = 0
        if doc is not None:
            a, b = np.searchsorted(flags["doc"], [doc, doc + 1])
            mine = flags[a:b]
            mine = mine[mine["tag"] == tag]["pos"]
            if len(mine):
                ends = np.zeros(len(words) + 1, np.int64)
                np.add.at(ends, mine, 1)
                np.add.at(ends, mine + np.uint32(width), -1)
                stay = np.cumsum(ends)[:-1] <= 0
                gone = len(words) - int(stay.sum())
                words = [words[j] for j in np.flatnonzero(stay)]
        n_words.append(len(words) + gone)
        n_removed.append(gone)
        kept.append(b" ".join(words).decode())
    return pa.table({"doc_id": docs.column("doc_id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})
