"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

Seeds are runs of ``least`` words (``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, A-Z lower-cased) that a document
shares with a benchmark item. A bitmap of the items' seeds lets documents drop everything else; what is left is
joined exactly, and pairs that share too few seeds to reach the coverage go no further. For each pair left the
longest matches that overlap no earlier one are marked again and again; an item of whose words ``coverage`` are
marked is in the document, in whatever order its passages stand.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import LOWER, WORD, free_name, pieces, span_hashes, text_buffer, window_hashes, window_starts, word_spans
from lodestone.session import materialize, ship_package

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BLOCK = 20  # log2 of the bits in a block of the bitmap


def tokens(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and the first word of each text."""
    data, off = text_buffer(batch.column(column))
    data = LOWER[data]
    starts, ends, first = word_spans(data, off, WORD)
    return span_hashes(data, starts, ends), first


class Runs:
    """Words with a running Karp-Rabin hash of every window, and which of them are free."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        n = len(words)
        power, self.inverse = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, b)))) for b in (_BASE, _INVERSE))
        self.words, self.sums = words, np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * power[:n])))
        self.free = np.ones(n, bool)
        self.gap = np.concatenate(([True], np.diff(at) != 1))  # no window goes over a gap

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of free consecutive words."""
        taken, gaps = np.concatenate(([0], np.cumsum(~self.free))), np.cumsum(self.gap)
        n = max(len(self.words) - size + 1, 0)
        i = np.flatnonzero((taken[size:][:n] == taken[:n]) & (gaps[size - 1 :][:n] == gaps[:n]))
        return i, (self.sums[i + size] - self.sums[i]) * self.inverse[i]


def tile(text: np.ndarray, at: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(place in the text, place in the item, length) of the greedy tiles, the longest first.

    ``text`` are words at places ``at``; only words at consecutive places match as one run. Ties go to the
    smaller place in the item, then in the text. Match lengths fall: the greatest length at which free windows
    of both still share a hash is sought by halving (a match of a length holds matches of all smaller ones),
    its matches are compared word for word and marked, and the search goes on below it.
    """
    runs, own = Runs(text, at), Runs(item, np.arange(len(item)))
    out, most = [], min(len(text), len(item))
    shares = lambda n: len(np.intersect1d(runs.windows(n)[1], own.windows(n)[1])) > 0
    while most >= least:
        low = least - 1
        while low < most:
            middle = (low + most + 1) // 2
            low, most = (middle, most) if shares(middle) else (low, middle - 1)
        n, most = low, low - 1
        if n < least:
            break
        (i, h), (j, g) = runs.windows(n), own.windows(n)
        both = np.isin(h, g)
        seen: dict[int, list[int]] = defaultdict(list)
        for place, key in zip(i[both][::-1].tolist(), h[both][::-1].tolist(), strict=True):
            seen[key].append(place)  # the smallest last
        for b, key in zip(j.tolist(), g.tolist(), strict=True):
            if key not in seen or not own.free[b : b + n].all():
                continue
            held = seen[key]
            while held and not runs.free[held[-1] : held[-1] + n].all():
                held.pop()
            if held and (text[held[-1] : held[-1] + n] == item[b : b + n]).all():
                a = held.pop()
                out.append((int(at[a]), b, n))
                runs.free[a : a + n] = own.free[b : b + n] = False
    return out


class Decontamination:
    """The bitmap has sixteen bits a seed, up to ``max_bits_log2`` (64 MB); past it more documents reach the exact join."""

    def __init__(self, least: int = 5, coverage: float = 0.5, max_bits_log2: int = 29):
        self.least, self.coverage, self.max_bits_log2 = least, coverage, max_bits_log2

    def run(self, docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
        """(doc_id, tag, item_id, coverage, n_tiles, tiles) for each document and item that it holds; tag is xxhash64 of the text.

        Items of fewer than ``least`` words are sought whole. Null and empty texts and items hold nothing.
        Rows that repeat give repeated results only if their texts differ; other columns are not read.
        """
        least, threshold = self.least, self.coverage
        ship_package(docs.sparkSession)
        spark = docs.sparkSession
        it = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"))
        kind = it.schema["item_id"].dataType.simpleString()
        known = materialize(it.mapInArrow(lambda b: _items(b, least), f"item_id {kind}, words array<long>, seeds array<long>"))
        short = [r["n"] for r in known.where(F.size("words") < least).select(F.size("words").alias("n")).distinct().collect() if r["n"]]  # fewer than ``least``
        n_seeds = known.agg(F.coalesce(F.sum(F.size("seeds")), F.lit(1))).first()[0]
        log2 = min(max(_BLOCK, int(n_seeds * 16 - 1).bit_length()), self.max_bits_log2)
        blocks = known.mapInArrow(lambda b: _bitmap(b, log2), "block int, bits binary").groupBy("block").applyInArrow(_merged, "block int, bits binary")
        bits = bytearray((1 << log2) // 8)
        for r in blocks.collect():  # of bounded size
            bits[r["block"] << _BLOCK - 3 : (r["block"] + 1) << _BLOCK - 3] = r["bits"]
        bits = spark.sparkContext.broadcast((log2, bytes(bits)))

        d = docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).withColumn("tag", F.xxhash64("text"))
        own = d.schema["doc_id"].dataType.simpleString()
        schema = f"doc_id {own}, tag long, at array<int>, words array<long>, seeds array<long>"
        found = materialize(d.mapInArrow(lambda b: _seeds(b, least, short, bits), schema)).dropDuplicates(["doc_id", "tag"])
        # a tile of n words holds n - least + 1 seeds of the item, so this many are shared if the coverage is reached
        need = F.ceil(threshold * F.size("words") / F.least(F.lit(least), F.size("words")) - 1e-9)
        postings = known.select("item_id", F.size("words").alias("size"), need.alias("need"), F.explode("seeds").alias("seed"))
        postings = postings.groupBy("seed", "item_id", "size", "need").agg(F.count("*").alias("times"))
        pairs = found.select("doc_id", "tag", F.explode("seeds").alias("seed")).join(postings, "seed")
        pairs = pairs.groupBy("doc_id", "tag", "item_id", "size", "need").agg(F.sum("times").alias("shared")).where("shared >= need").select("doc_id", "tag", "item_id").distinct()
        same = F.col("p.tag").eqNullSafe(F.col("f.tag")) & F.col("p.doc_id").eqNullSafe(F.col("f.doc_id"))
        pairs = pairs.alias("p").join(found.alias("f"), same).select("p.doc_id", "p.tag", "p.item_id", "f.at", F.col("f.words").alias("words"))
        pairs = pairs.join(known.select("item_id", F.col("words").alias("item")), "item_id")
        tiles = "array<struct<at:int,item_at:int,words:int>>"
        out = pairs.mapInArrow(lambda b: _tiles(b, least), f"doc_id {own}, tag long, item_id {kind}, coverage double, n_tiles int, tiles {tiles}")
        return out.where(F.col("coverage") >= threshold)

    def clean(self, docs: DataFrame, items: DataFrame) -> DataFrame:
        """The rows of ``docs``, with all their columns, that hold no item."""
        own_id, own_tag = (free_name(docs.columns, c) for c in ("id", "tag"))
        found = self.run(docs, items).select(F.col("doc_id").alias(own_id), F.col("tag").alias(own_tag)).distinct()
        return docs.join(found, docs["doc_id"].eqNullSafe(F.col(own_id)) & F.xxhash64(docs["text"]).eqNullSafe(F.col(own_tag)), "left_anti")


def _windows(words: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    starts, _ = window_starts(first, width)
    return window_hashes(words, starts, width, 0x9FB21C651E98DF25 + 2 * width), starts


def _items(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    for batch in it:
        words, first = tokens(batch)
        seeds = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            seeds.append(_windows(words[a:b], np.array([0, b - a]), int(min(least, b - a)))[0].view(np.int64) if b > a else [])
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(words.view(np.int64))), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "words", "seeds"])


def _bit(h: np.ndarray, log2: int) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - log2)).astype(np.int64)


def _bitmap(it: Iterator[pa.RecordBatch], log2: int) -> Iterator[pa.RecordBatch]:
    """Of each batch the blocks of the bitmap that it sets."""
    for batch in it:
        b = np.unique(_bit(batch.column("seeds").flatten().to_numpy(), log2))
        for block in np.unique(b >> _BLOCK).tolist():
            flat = np.zeros(1 << _BLOCK, bool)
            flat[b[b >> _BLOCK == block] & (1 << _BLOCK) - 1] = True
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(flat, bitorder="little").tobytes()])})


def _merged(table: pa.Table) -> pa.Table:
    bits = np.bitwise_or.reduce([np.frombuffer(b.as_py(), np.uint8) for b in table.column("bits")])
    return pa.table({"block": table.column("block").slice(0, 1), "bits": pa.array([bits.tobytes()])})


def _seeds(it: Iterator[pa.RecordBatch], least: int, short: list[int], bits) -> Iterator[pa.RecordBatch]:
    """Of each document with hits: its words inside windows whose bit is set, their places, and those seeds."""
    log2, bitmap = bits.value[0], np.frombuffer(bits.value[1], np.uint8)
    for piece in pieces(it, "text"):
        words, first = tokens(piece)
        inside = np.zeros(len(words) + 1, np.int64)
        hits, texts = [], []
        for width in {least, *short}:
            h, starts = _windows(words, first, width)
            b = _bit(h, log2)
            hit = np.flatnonzero((bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1)
            np.add.at(inside, starts[hit], 1)
            np.add.at(inside, starts[hit] + width, -1)
            hits.append(h[hit])
            texts.append(np.searchsorted(first, starts[hit], "right") - 1)
        hits, texts = np.concatenate(hits), np.concatenate(texts)
        if not len(hits):
            continue
        place = np.flatnonzero(np.cumsum(inside)[:-1] > 0)
        doc = np.searchsorted(first, place, "right") - 1
        order = np.lexsort((hits, texts))
        hits, texts = hits[order], texts[order]
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:] != hits[:-1]) | (texts[1:] != texts[:-1])
        hits, texts = hits[new], texts[new]
        rows = np.unique(texts)
        lists = lambda of, values, kind: pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(of, rows), len(of)), pa.int32()), pa.array(values, kind))
        take = pa.array(rows)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id").take(take), piece.column("tag").take(take), lists(doc, place - first[doc], pa.int32()), lists(doc, words[place].view(np.int64), pa.int64()), lists(texts, hits.view(np.int64), pa.int64())], ["doc_id", "tag", "at", "words", "seeds"])


def _tiles(it: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("at", pa.int32()), ("item_at", pa.int32()), ("words", pa.int32())]))
    for batch in it:
        tiles, coverage = [], []
        for at, words, item in zip(*(batch.column(c) for c in ("at", "words", "item")), strict=True):
            at, words, item = (x.values.to_numpy() for x in (at, words, item))
            own = tile(words.view(np.uint64), at, item.view(np.uint64), min(least, len(item)))
            tiles.append([{"at": a, "item_at": j, "words": n} for a, j, n in own])
            coverage.append(sum(n for *_, n in own) / len(item))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), batch.column("item_id"), pa.array(coverage, pa.float64()), pa.array([len(t) for t in tiles], pa.int32()), pa.array(tiles, kind)], ["doc_id", "tag", "item_id", "coverage", "n_tiles", "tiles"])
