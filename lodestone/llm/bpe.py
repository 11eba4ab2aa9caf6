"""Byte-level BPE: ranked merges folded by Spark higher-order functions over the bytes of distinct words.

1. Texts are cut into the pattern's matches (``cut``), whole texts at a time on their buffers; every task
   counts its distinct words and Spark sums the counts.
2. The ``cache_words`` most frequent words are encoded once each by the fold; their hashes and ids reach the
   workers as one broadcast of bounded size, whatever the corpus holds.
3. Texts look their words up. Words that the broadcast lacks go, distinct by document, through the same fold
   beside their document, so nothing is shuffled and no word is left out. Rare words make up most of the
   distinct words but few of the occurrences, so this costs less than a shuffle of them to be encoded once.

A fold takes steps in proportion to a word's bytes, each over what is left of the word; words of over
``LONG_WORD`` bytes are merged in the order of a heap instead (``merge_by_heap``), which gives the same ids.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from lodestone.llm.textops import PIECE_BYTES, pieces, span_hashes, text_buffer
from lodestone.session import collect_garbage, discard, materialize, ship_package

LONG_WORD = 256
_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each match of ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.

    The matches cover a text without gaps. Also the first match of each text (one more than texts).
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    code = data[at].astype(np.uint32)
    pad = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32) & 0x3F
    for lo, hi, mask, extra in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        own = np.flatnonzero((code >= lo) & (code < hi) & (data[at] >= lo))
        c = code[own] & mask
        for k in range(1, extra + 1):
            c = (c << 6) | pad[at[own] + k]
        code[own] = np.minimum(c, 0x10FFFF)
    kind = _classes()[code]
    m = len(at)
    edge = np.zeros(m + 1, bool)  # a text begins here
    edge[np.searchsorted(at, offsets)] = True
    start = edge[:m].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # the last white space before a word is no longer part of its run; a space joins the word
    after = np.flatnonzero(start[1:] & ~edge[1:m] & (kind[:-1] == _SPACE)) + 1
    start[after - 1] = True
    start[after[code[after - 1] == 0x20]] = False
    # contractions: a lone apostrophe that begins a match, and the letters after it
    lone = np.flatnonzero(start & (code == 0x27))
    lone = lone[lone + 1 < m]
    lone = lone[(kind[lone + 1] == _LETTER) & ~edge[lone + 1]]
    c1 = code[lone + 1]
    short = lone[np.isin(c1, [ord(c) for c in "stmd"])]
    two = lone[lone + 2 < m]
    two = two[~edge[two + 2]]
    a, b = code[two + 1], code[two + 2]
    two = two[((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))]
    for own, size in ((short, 2), (two, 3)):
        start[own + 1] = False
        start[(own + size)[own + size < m]] = True
    begin = at[start]
    return begin, np.searchsorted(begin, offsets)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


class RankMap:
    """The ranked merges as one literal: which pair of tokens joins to which token, and so with which rank.

    A token is its rank. The pair (a, b) has its place at ``base[a] + b``, where bases are chosen so that no two pairs
    meet (rows of a sparse matrix laid over one another): ``left`` there is a, and ``joined`` what they join to. Where
    ``left`` is another token, there is no such merge. A lookup hashes nothing and mostly ends at ``left``.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = [ranks.get(bytes([b]), -1) for b in range(256)]
        if min(self.bytes) < 0:
            raise ValueError("every byte must be a token")
        most = max(ranks.values()) + 1
        rows: dict[int, list[tuple[int, int]]] = {}
        for token, r in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    rows.setdefault(a, []).append((b, r))
        pairs = sum(map(len, rows.values()))
        self.base = np.zeros(most, np.int32)
        self.left, self.joined = np.full(4 * pairs + 2 * most, -1, np.int32), np.zeros(4 * pairs + 2 * most, np.int32)
        rng = np.random.default_rng(0)
        for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):  # long rows first
            b, r = np.array(row).T
            spread = 2 * pairs + most
            while True:
                tried = rng.integers(0, spread, max(1, min(64, 4096 // len(b))))
                free = np.flatnonzero((self.left[tried[:, None] + b] < 0).all(1))
                if len(free):
                    break
                spread = min(spread + most, 4 * pairs + most)
            at = tried[free[0]]
            self.base[a], self.left[at + b], self.joined[at + b] = at, a, r

    def literal(self, spark: SparkSession) -> Column:
        """The map as one value of a query: a scalar subquery, so that plans name it without printing it."""
        columns = {"base": self.base, "left": self.left, "joined": self.joined, "bytes": np.array(self.bytes, np.int32)}
        one = {k: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v)) for k, v in columns.items()}
        return spark.createDataFrame(pa.table(one)).select(F.struct(*columns)).scalar()

    def fold(self, word: Column, table: Column) -> Column:
        """Token ids of one word, an array of its bytes: pairs joined one by one, lowest rank first, leftmost first."""
        ints = F.array().cast("array<int>")

        def rank(a: Column, b: Column) -> Column:
            at = F.get(table["base"], a) + b
            return F.when(F.get(table["left"], at) == a, F.get(table["joined"], at))

        def numbers(n: Column) -> Column:
            return F.when(n < 1, ints).otherwise(F.sequence(F.lit(1), n))

        def step(acc: Column, _: Column) -> Column:
            ids, ranks = acc["ids"], acc["ranks"]

            def merge(best: Column, p: Column) -> Column:
                # beside an end stands no token, and so no rank: the list of ranks keeps one place for each token
                before, after = F.get(ids, p - 2), F.get(ids, p + 1)
                left = F.when(p > 1, F.concat(F.slice(ranks, F.lit(1), p - 2), F.array(rank(before, best)))).otherwise(ints)
                joined = F.concat(F.slice(ids, F.lit(1), p - 1), F.array(best), F.slice(ids, p + 2, F.size(ids)))
                kept = F.concat(left, F.array(rank(best, after)), F.slice(ranks, p + 2, F.size(ids)))
                return F.struct(joined.alias("ids"), kept.alias("ranks"))

            best = F.array_min(ranks)
            return F.when(best.isNull(), acc).otherwise(_let(best, lambda v: _let(F.array_position(ranks, v).cast("int"), lambda p: merge(v, p))))

        def start(ids: Column) -> Column:
            pairs = F.transform(ids, lambda a, i: rank(a, F.get(ids, i + 1)))
            return F.aggregate(numbers(F.size(ids) - 1), F.struct(ids.alias("ids"), pairs.alias("ranks")), step, lambda acc: acc["ids"])

        return _let(F.transform(word, lambda b: F.get(table["bytes"], b)), start)


def encode_words(words: DataFrame, ranks: RankMap, column: str = "word", out: str = "ids") -> DataFrame:
    """``words`` with the token ids of a column of words as arrays of bytes (0 to 255)."""
    own = "_ranks"
    while own in words.columns:
        own += "_"
    held = words.withColumn(own, ranks.literal(words.sparkSession))
    return held.withColumn(out, _let(F.col(own), lambda t: ranks.fold(F.col(column), t))).drop(own)


def merge_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one word as ``RankMap.fold`` gives them, in n log n steps: for words of any length."""
    ends = list(range(1, len(word) + 1))  # of the token that begins at each place
    before = list(range(-1, len(word) - 1))  # where the token before it begins
    heap = [(r, i, i + 2) for i in range(len(word) - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        middle = ends[i]
        if not i < middle < end or ends[middle] != end:  # either token is no longer there
            continue
        ends[i], ends[middle] = end, 0
        if end < len(word):
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if i and (r := ranks.get(word[before[i] : end])) is not None:
            heapq.heappush(heap, (r, before[i], end))
    return [ranks[word[i:e]] for i, e in enumerate(ends) if e]


class WordTable:
    """Token ids of known words, found by a hash of the word (64 bits and the length)."""

    def __init__(self, h: np.ndarray, length: np.ndarray, flat: np.ndarray, count: np.ndarray):
        """Hash and length of each word; ids one after another and how many each word has."""
        order = np.argsort(h)
        self.hash, self.length = h[order], length[order].astype(np.int32)
        size, start = count[order], (np.cumsum(count) - count)[order]
        to = np.cumsum(size) - size
        self.flat = flat[np.repeat(start - to, size) + np.arange(size.sum())].astype(np.int32, copy=False) if len(h) else np.zeros(0, np.int32)
        self.first = np.concatenate(([0], np.cumsum(size)))
        self.bits = max(1, len(h).bit_length() + 1)
        self.heads = np.searchsorted(self.hash >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    @staticmethod
    def packed(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(hash, length, ids) of words, a row of packed columns for each batch."""
        for batch in it:
            ids = batch.column("ids")
            columns = {"hash": batch.column("hash").to_numpy(), "length": batch.column("length").to_numpy().astype("<u2"), "ids": ids.flatten().to_numpy().astype("<i4"), "count": ids.value_lengths().to_numpy().astype("<u2")}
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()]) for k, v in columns.items()})

    @classmethod
    def unpacked(cls, rows: list[tuple[bytes, ...]], ranks: dict[bytes, int]) -> WordTable:
        """The packed words, and every token as a word of its own."""
        hash_, length, ids, count = (np.frombuffer(b"".join(r[k] for r in rows), kind) for k, kind in enumerate(("<u8", "<u2", "<i4", "<u2")))
        size = np.fromiter(map(len, ranks), np.int64, len(ranks))
        ends = np.cumsum(size)
        own = span_hashes(np.frombuffer(b"".join(ranks), np.uint8), ends - size, ends)
        ids = np.concatenate((ids, np.fromiter(ranks.values(), np.int32, len(ranks))))
        return cls(np.concatenate((hash_, own)), np.concatenate((length, size)), ids, np.concatenate((count, np.ones(len(ranks), np.int64))))

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Position of each word in the table, -1 where it lacks it."""
        out = np.full(len(h), -1, np.int64)
        if not len(self.hash):
            return out
        head = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.heads[head].astype(np.int64), self.heads[head + 1]
        open_ = np.flatnonzero(at < end)
        while len(open_):
            i = at[open_]
            same = (self.hash[i] == h[open_]) & (self.length[i] == length[open_])
            out[open_[same]] = i[same]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


class BytePairEncoding:
    """Encodes and decodes whole texts by the ranks of a file in tiktoken's format."""

    def __init__(self, path: str, cache_words: int = 500_000):
        self.ranks = read_ranks(path)
        self.cache_words = cache_words

    def words(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(word binary, n): how often each distinct match of the pattern occurs in all texts."""
        ship_package(docs.sparkSession)
        counted = docs.select(F.col(text).alias("text")).mapInArrow(_count, "word binary, n long")
        return counted.groupBy("word").agg(F.sum("n").alias("n"))

    def known(self, docs: DataFrame, table: RankMap, tokens: Broadcast, text: str = "text") -> list[tuple[bytes, ...]]:
        """The most frequent words that are not tokens themselves, each encoded once; at most ``cache_words``.

        Frequencies are cut at a limit on an eighth of a power of two, found from a histogram of a few hundred
        rows; words that occur once are never kept. Comes as packed columns of ``WordTable.packed``.
        """
        words = materialize(self.words(docs, text).where("n > 1").mapInArrow(lambda it: _untokened(it, tokens), "word binary, n long"))
        step = F.floor(F.log2("n") * 8)
        left, least = self.cache_words, None
        for r in words.groupBy(step.alias("step")).count().orderBy(F.desc("step")).collect():
            if r["count"] > left:
                break
            left, least = left - r["count"], r["step"]
        if least is None:
            discard(words)
            return []
        chosen = words.where(step >= least).mapInArrow(lambda it: _as_bytes(it, tokens), "hash long, length int, bytes array<int>, heap array<int>")
        chosen = encode_words(chosen, table, "bytes").select("hash", "length", F.coalesce("heap", "ids").alias("ids"))
        found = chosen.mapInArrow(WordTable.packed, "hash binary, length binary, ids binary, count binary").collect()  # of bounded size
        discard(words)
        collect_garbage(docs.sparkSession)
        return [tuple(map(bytes, r)) for r in found]

    def encode(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """(doc_id, ids array<int>) for each row of ``docs``. Null and empty texts have no ids; other columns are not read."""
        filled, kind = self._folded(docs, id_col, text)
        return filled.mapInArrow(_fill, f"doc_id {kind}, ids array<int>")

    def round_trip(self, docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
        """``decode`` of ``encode``, (doc_id, ids, bytes), with one Python worker less a task."""
        filled, kind = self._folded(docs, id_col, text)
        tokens = docs.sparkSession.sparkContext.broadcast(_token_bytes(self.ranks))
        return filled.mapInArrow(lambda it: _concatenated(_fill(it), tokens, "ids", "bytes"), f"doc_id {kind}, ids array<int>, bytes binary")

    def _folded(self, docs: DataFrame, id_col: str, text: str) -> tuple[DataFrame, str]:
        """(doc_id, sequence, holes) with the ids of the words that each document folds for itself, and doc_id's type."""
        spark = docs.sparkSession
        ship_package(spark)
        table = RankMap(self.ranks)
        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
        tokens = spark.sparkContext.broadcast(self.ranks)
        known = spark.sparkContext.broadcast(self.known(d, table, tokens))
        kind = d.schema["doc_id"].dataType.simpleString()
        seen = d.mapInArrow(lambda it: _look_up(it, known, tokens), f"doc_id {kind}, sequence array<int>, holes array<array<int>>")
        filled = seen.withColumn("ranks", table.literal(spark)).withColumn("holes", _let(F.col("ranks"), lambda t: F.transform("holes", lambda w: table.fold(w, t))))
        return filled.drop("ranks"), kind

    def decode(self, encoded: DataFrame, ids: str = "ids", out: str = "bytes") -> DataFrame:
        """``encoded`` with the bytes of its token ids, one binary piece after another. Null: no bytes. An id that is no token raises."""
        ship_package(encoded.sparkSession)
        tokens = encoded.sparkSession.sparkContext.broadcast(_token_bytes(self.ranks))
        schema = StructType([f for f in encoded.schema if f.name != out]).add(out, BinaryType())
        return encoded.select(*[c for c in encoded.columns if c != out]).mapInArrow(lambda it: _concatenated(it, tokens, ids, out), schema)


def _spans(piece: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, ...]:
    data, off = text_buffer(piece.column(column))
    begin, first = cut(data, off)
    end = np.append(begin[1:], len(data))
    return data, begin, end, first


def _slices(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(begin.tolist(), end.tolist(), strict=True)]


def _count(it: Iterator[pa.RecordBatch], flush: int = 150_000) -> Iterator[pa.RecordBatch]:
    """Words and their counts in this task, written out whenever ``flush`` distinct words are held."""
    held = np.zeros(0, np.uint64)
    count = np.zeros(0, np.int64)
    words: dict[int, bytes] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([words[h] for h in held.tolist()], pa.binary()), "n": count})

    for piece in pieces(it, "text"):
        data, begin, end, _ = _spans(piece)
        h, at, n = np.unique(span_hashes(data, begin, end), return_index=True, return_counts=True)
        new = ~np.isin(h, held, assume_unique=True, kind="sort")
        words.update(zip(h[new].tolist(), _slices(data, begin[at[new]], end[at[new]]), strict=True))
        both = np.concatenate((held, h))
        held, back = np.unique(both, return_inverse=True)
        count = np.bincount(back, np.concatenate((count, n)), len(held)).astype(np.int64)
        if len(held) >= flush:
            yield out()
            held, count, words = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
    if len(held):
        yield out()


def _untokened(it: Iterator[pa.RecordBatch], tokens: Broadcast) -> Iterator[pa.RecordBatch]:
    """Words that are no tokens; those of over 2**16 bytes are left to their documents."""
    ranks = tokens.value
    for batch in it:
        yield batch.filter(pa.array([w not in ranks and len(w) < 1 << 16 for w in batch.column("word").to_pylist()], pa.bool_()))


def _lists(words: list[bytes]) -> pa.Array:
    off = np.cumsum([0, *map(len, words)])
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.frombuffer(b"".join(words), np.uint8).astype(np.int32)))


def _as_bytes(it: Iterator[pa.RecordBatch], tokens: Broadcast) -> Iterator[pa.RecordBatch]:
    """Hash, length and bytes of each word; of long ones the ids, and no bytes."""
    ranks = tokens.value
    for batch in it:
        word = batch.column("word")
        data, off = text_buffer(word)
        h, length = span_hashes(data, off[:-1], off[1:]), np.diff(off).astype(np.int32)
        words = word.to_pylist()
        heap = pa.array([merge_by_heap(w, ranks) if len(w) > LONG_WORD else None for w in words], pa.list_(pa.int32()))
        lists = _lists([w if len(w) <= LONG_WORD else b"" for w in words])
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(length), lists, heap], ["hash", "length", "bytes", "heap"])


_HELD: dict = {}


def _table_of(known: Broadcast, tokens: Broadcast) -> WordTable:
    """The table of a broadcast, built once in each Python worker."""
    if _HELD.get("of") is not known.value:
        _HELD.clear()
        _HELD.update(of=known.value, table=WordTable.unpacked(known.value, tokens.value))
    return _HELD["table"]


def _look_up(it: Iterator[pa.RecordBatch], known: Broadcast, tokens: Broadcast) -> Iterator[pa.RecordBatch]:
    """Ids of known words in order; a word that is not known stands as -1 - its number in the document's list of them."""
    table, ranks = _table_of(known, tokens), tokens.value
    for piece in pieces(it, "text"):
        data, begin, end, first = _spans(piece)
        h, length = span_hashes(data, begin, end), end - begin
        at = table.find(h, length)
        lacking = np.flatnonzero(at < 0)
        doc = np.searchsorted(first, lacking, "right") - 1
        # distinct by document, numbered within it
        order = np.lexsort((h[lacking], doc))
        l, d = lacking[order], doc[order]
        new = np.ones(len(l), bool)
        new[1:] = (h[l[1:]] != h[l[:-1]]) | (d[1:] != d[:-1])
        number = np.cumsum(new) - 1
        words = _slices(data, begin[l[new]], end[l[new]])
        own = d[new]
        long = {i: merge_by_heap(words[i], ranks) for i in np.flatnonzero(length[l[new]] > LONG_WORD).tolist()}
        hole = length[l[new]] <= LONG_WORD
        base = np.searchsorted(own[hole], np.arange(piece.num_rows))
        mark = -1 - (np.cumsum(hole) - 1 - base[own])
        count = np.ones(len(begin), np.int64)
        hit = at >= 0
        count[hit] = table.first[at[hit] + 1] - table.first[at[hit]]
        at_long = np.flatnonzero(np.isin(number, list(long))) if long else np.zeros(0, np.int64)
        count[l[at_long]] = [len(long[k]) for k in number[at_long].tolist()]
        to = np.concatenate(([0], np.cumsum(count)))
        sequence = np.empty(to[-1], np.int32)
        source = np.repeat(table.first[np.where(hit, at, 0)] - to[:-1], count) + np.arange(to[-1])
        known_slot = np.repeat(hit, count)
        sequence[known_slot] = table.flat[source[known_slot]] if len(table.flat) else 0
        sequence[to[l]] = mark[number]
        for i, k in zip(l[at_long].tolist(), number[at_long].tolist(), strict=True):
            sequence[to[i] : to[i + 1]] = long[k]
        ids = pa.ListArray.from_arrays(pa.array(to[first], pa.int32()), pa.array(sequence))
        outer = np.append(base, int(hole.sum()))
        holes = pa.ListArray.from_arrays(pa.array(outer, pa.int32()), _lists([w for w, x in zip(words, hole.tolist(), strict=True) if x]))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), ids, holes], ["doc_id", "sequence", "holes"])


def _fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Puts the ids of folded words where ``_look_up`` marked them."""
    for batch in pieces(it, "sequence"):
        rows, words = batch.column("sequence"), batch.column("holes")
        sequence, inner = rows.flatten().to_numpy(), words.flatten()
        base = np.cumsum(words.value_lengths().to_numpy()) - words.value_lengths().to_numpy()
        doc = np.repeat(np.arange(len(rows)), rows.value_lengths().to_numpy())
        size, flat = inner.value_lengths().to_numpy(), inner.flatten().to_numpy()
        mark = np.flatnonzero(sequence < 0)
        word = base[doc[mark]] - 1 - sequence[mark]
        count = np.ones(len(sequence), np.int64)
        count[mark] = size[word]
        to = np.concatenate(([0], np.cumsum(count)))
        out = np.repeat(sequence, count)
        n = count[mark]
        step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(to[mark], n) + step] = flat[np.repeat((np.cumsum(size) - size)[word], n) + step]
        off = np.concatenate(([0], np.cumsum(rows.value_lengths().to_numpy())))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(to[off], pa.int32()), pa.array(out))], ["doc_id", "ids"])


def _token_bytes(ranks: dict[bytes, int]) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens by id, and how many each has; -1 for an id that is no token."""
    by_id = {r: t for t, r in ranks.items()}
    most = max(by_id) + 1
    return b"".join(by_id.get(i, b"") for i in range(most)), np.array([len(by_id[i]) if i in by_id else -1 for i in range(most)])


def _concatenated(it: Iterator[pa.RecordBatch], tokens: Broadcast, ids: str, out: str) -> Iterator[pa.RecordBatch]:
    data, size = np.frombuffer(tokens.value[0], np.uint8), tokens.value[1]
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    for batch in pieces(it, ids):
        column = batch.column(ids)
        i = column.flatten().to_numpy(zero_copy_only=False)
        bad = (i < 0) | (i >= len(size)) | (size[np.clip(i, 0, len(size) - 1)] < 0) if i.dtype.kind in "iu" else np.ones(len(i), bool)
        if bad.any():
            raise ValueError(f"an id is no token: {i[bad][0]}")
        n = size[i]
        to = np.concatenate(([0], np.cumsum(n)))
        whole = [data[np.repeat(start[i[a : a + PIECE_BYTES]] - to[:-1][a : a + PIECE_BYTES] + to[a], n[a : a + PIECE_BYTES]) + np.arange(to[min(a + PIECE_BYTES, len(i))] - to[a])] for a in range(0, len(i), PIECE_BYTES)]
        row = np.concatenate(([0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())))
        binary = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(to[row].astype(np.int32).tobytes()), pa.py_buffer(np.concatenate(whole or [data[:0]]).tobytes())])
        yield pa.RecordBatch.from_arrays([*batch.columns, binary], [*batch.schema.names, out])
