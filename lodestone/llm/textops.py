"""Word boundaries and rolling hashes of many texts at once, on the buffers of Arrow string columns.

Everything here works on one bounded piece of a partition (``pieces``); Spark deals out partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PIECE_BYTES = 1 << 19
_SEED = np.uint64(0x9E3779B97F4A7C15)
_LONG = 64  # bytes; longer spans are hashed by xxhash, one by one
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes that end a word: ASCII white space; all ASCII but letters and digits.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
WORD = np.ones(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes (of a list: values) in ``column``, or one row."""
    for batch in batches:
        x = batch.column(column)
        length = pc.list_value_length(x) if pa.types.is_list(x.type) else pc.binary_length(x)
        ends = np.cumsum(pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def free_name(columns: list[str], name: str) -> str:
    """``name``, with as many underscores behind it as no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after another, and where each begins (one more than rows). Null: empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    off = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if off is not None and len(column) else np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, wherever it stands; other seeds give independent hashes.

    A span of up to seven bytes and its size make one number, which is mixed by a bijection: no two of them share a
    hash. Longer ones, and they with those, meet only by chance: the size is mixed in after the first eight bytes, and
    nothing is summed, as in a polynomial hash, where texts of a regular pattern would meet. Spans of over 64 bytes go
    to xxhash.
    """
    size = ends - starts
    at_byte = np.ndarray((len(data) + 1,), "<u8", np.concatenate((data, np.zeros(8, np.uint8))), strides=(1,))  # eight bytes from each place on
    head = at_byte[starts] & _MASK[np.minimum(size, 8)]
    out = mix((head | (np.where(size < 8, size, 0).astype(np.uint64) << np.uint64(56))) ^ np.uint64(seed))
    live = np.flatnonzero((size > 7) & (size <= _LONG))
    out[live] = mix(out[live] ^ (size[live].astype(np.uint64) * _SEED))
    live = live[size[live] > 8]
    for done in range(8, _LONG, 8):
        if not len(live):
            break
        left = size[live] - done
        chunk = at_byte[starts[live] + done] & _MASK[np.minimum(left, 8)]
        out[live] = mix((out[live] ^ chunk) * _SEED)
        live = live[left > 8]
    for i in np.flatnonzero(size > _LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed)
    return out


def word_spans(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of runs without ``breaks`` (ASCII white space), and the first word of each text (one more than texts)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~breaks[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each text."""
    starts, ends, first = word_spans(data, offsets)
    return span_hashes(data, starts, ends), first


def window_starts(first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``width`` words inside one text: its first word, and its text."""
    count = np.maximum(np.diff(first) - width + 1, 0)
    text = np.repeat(np.arange(len(count)), count)
    begin = np.cumsum(count) - count
    return np.arange(count.sum()) - np.repeat(begin, count) + first[:-1][text], text


def window_hashes(words: np.ndarray, starts: np.ndarray, width: int, factor: int = 0x9FB21C651E98DF25) -> np.ndarray:
    """A 64-bit hash of each window of words; the state is mixed after each word, so that no pattern of words cancels out."""
    f = np.uint64(factor | 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h ^= words[k : k + len(h)]
        h *= f
        h ^= h >> np.uint64(31)
    return mix(h[starts])
