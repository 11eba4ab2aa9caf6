"""Quality classifier: a generalised additive model with pairwise interactions.

Features of each whole text are cut into bins. Shallow trees on one feature at a time are boosted in turn, round
by round, and summed into one lookup table a feature; then the pairs of features that explain most of what is
left get tables of two features in the same way. A score is the logistic of a sum of looked-up values.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textops import pieces, span_hashes, text_buffer, word_spans
from lodestone.session import ship_package

_CLASSES = {
    "upper": [*range(65, 91)], "lower": [*range(97, 123)], "digit": [*range(48, 58)], "space": [32, 9, 11, 12, 13], "line": [10],
    "stop": [ord("."), ord(",")], "bang": [ord("!")], "bar": [ord("|")], "mark": [ord(c) for c in "\"'();:?-"],
    "symbol": [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,!|\"'();:?-"], "wide": [*range(128, 256)],
}
FEATURES = ["log_words", "word_length", "upper", "digit", "symbol", "bang", "bar", "stop", "mark", "wide", "space", "lines", "distinct", "top_word", "echo", "same_lines"]


def text_features(piece: pa.RecordBatch, column: str = "text") -> np.ndarray:
    """A row of FEATURES for each text; an empty text has zeros."""
    data, off = text_buffer(piece.column(column))
    rows = len(off) - 1
    doc = np.repeat(np.arange(rows), np.diff(off))
    byte = np.bincount(doc * 256 + data, minlength=rows * 256).reshape(rows, 256)
    count = {k: byte[:, v].sum(1).astype(float) for k, v in _CLASSES.items()}
    size = np.maximum(np.diff(off), 1).astype(float)
    starts, ends, first = word_spans(data, off)
    n = np.diff(first)
    words = np.maximum(n, 1).astype(float)
    owner = np.repeat(np.arange(rows), n)
    h = span_hashes(data, starts, ends)
    distinct, most = _repeats(h, owner, rows)
    echo = np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=rows)
    breaks = np.zeros(256, bool)
    breaks[10] = True
    ls, le, lf = word_spans(data, off, breaks)
    ln = np.diff(lf)
    lines, _ = _repeats(span_hashes(data, ls, le), np.repeat(np.arange(rows), ln), rows)
    letters = np.maximum(count["upper"] + count["lower"], 1)
    columns = {
        "log_words": np.log1p(n), "word_length": (size - count["space"] - count["line"]) / words, "upper": count["upper"] / letters, "lines": ln / words,
        "distinct": distinct / words, "top_word": most / words, "echo": echo / words, "same_lines": 1 - lines / np.maximum(ln, 1),
    }
    out = np.stack([columns[f] if f in columns else count[f] / size for f in FEATURES], 1)
    out[np.diff(off) == 0] = 0
    return out


def _repeats(h: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each owner, and how often its most frequent one occurs."""
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]))))
    count = np.diff(np.append(new, len(h)))
    most = np.zeros(rows, np.int64)
    np.maximum.at(most, owner[new], count)
    return np.bincount(owner[new], minlength=rows), most


@dataclass
class AdditiveModel:
    """Cyclic boosting of shallow trees on binned features, one feature (then one pair) at a time."""

    bins: int = 32
    pair_bins: int = 8
    pairs: int = 5
    rounds: int = 150
    pair_rounds: int = 60
    rate: float = 0.15
    leaves: int = 3
    l2: float = 2.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def fit(self, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """Without rows of both classes the score is the (smoothed) share of 1, and nearly 1 without any row."""
        p = (y.sum() + 1) / (len(y) + 1 + (0 < y.sum() < len(y)))
        self.base = float(np.log(max(p, 1e-6) / max(1 - p, 1e-6)))
        self.edges = [self._edges(x[:, j], self.bins) for j in range(x.shape[1])]
        self.pair_edges = [self._edges(x[:, j], self.pair_bins) for j in range(x.shape[1])]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pair_tables = {}
        if not 0 < y.sum() < len(y):
            return self
        b = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            for j, own in enumerate(b):
                step = self._tree(*self._sums(own, y, f, len(self.tables[j])))
                self.tables[j] += step
                f += step[own]
        c = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.pair_edges)]
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            g, h = self._sums(c[i] * (len(self.pair_edges[j]) + 1) + c[j], y, f, (len(self.pair_edges[i]) + 1) * (len(self.pair_edges[j]) + 1))
            gains.append((float((g * g / (h + self.l2)).sum()), (i, j)))
        for _, (i, j) in sorted(gains, reverse=True)[: self.pairs]:
            self.pair_tables[i, j] = np.zeros((len(self.pair_edges[i]) + 1, len(self.pair_edges[j]) + 1))
        for _ in range(self.pair_rounds):
            for (i, j), t in self.pair_tables.items():
                g, h = (v.reshape(t.shape) for v in self._sums(c[i] * t.shape[1] + c[j], y, f, t.size))
                step = self._pair_tree(g, h)
                t += step
                f += step[c[i], c[j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, e in enumerate(self.edges):
            f += self.tables[j][np.searchsorted(e, x[:, j], "right")]
        for (i, j), t in self.pair_tables.items():
            f += t[np.searchsorted(self.pair_edges[i], x[:, i], "right"), np.searchsorted(self.pair_edges[j], x[:, j], "right")]
        return 1 / (1 + np.exp(-np.clip(f, -50, 50)))

    @staticmethod
    def _edges(v: np.ndarray, bins: int) -> np.ndarray:
        return np.unique(np.quantile(v, np.arange(1, bins) / bins)) if len(v) else np.zeros(0)

    @staticmethod
    def _sums(own: np.ndarray, y: np.ndarray, f: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Sums of gradient and curvature of the logistic loss for each bin."""
        p = 1 / (1 + np.exp(-f))
        return np.bincount(own, y - p, size), np.bincount(own, p * (1 - p), size)

    def _cut(self, g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
        """The best cut of a row of bins, and its gain."""
        if len(g) < 2:
            return 0.0, 0
        a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = a**2 / (b + self.l2) + (g.sum() - a) ** 2 / (h.sum() - b + self.l2) - g.sum() ** 2 / (h.sum() + self.l2)
        k = int(np.argmax(gain))
        return float(gain[k]), k + 1

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        parts = [(0, len(g))]
        while len(parts) < self.leaves:
            cuts = [(*self._cut(g[a:b], h[a:b]), a, b) for a, b in parts]
            gain, k, a, b = max(cuts)
            if gain <= 1e-9:
                break
            parts.remove((a, b))
            parts += [(a, a + k), (a + k, b)]
        out = np.zeros(len(g))
        for a, b in parts:
            out[a:b] = self.rate * g[a:b].sum() / (h[a:b].sum() + self.l2)
        return out

    def _pair_tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A cut along one axis, and one along the other in each half."""
        best = None
        for flip in (False, True):
            a, b = (g.T, h.T) if flip else (g, h)
            gain, k = self._cut(a.sum(1), b.sum(1))
            if not k:
                continue
            halves = [self._cut(a[s].sum(0), b[s].sum(0)) for s in (slice(0, k), slice(k, None))]
            total = gain + sum(x for x, _ in halves)
            if best is None or total > best[0]:
                best = (total, flip, k, halves)
        out = np.zeros(g.shape)
        if best is None:
            return out
        _, flip, k, halves = best
        view, a, b = (out.T, g.T, h.T) if flip else (out, g, h)
        for s, (_, m) in zip((slice(0, k), slice(k, None)), halves, strict=True):
            for t in (slice(0, m), slice(m, None)):
                view[s, t] = self.rate * a[s, t].sum() / (b[s, t].sum() + self.l2)
        return out


class QualityClassifier:
    """``sample_rows`` bounds the labelled rows a model is fitted on (smallest hashes of their ids)."""

    def __init__(self, sample_rows: int = 20_000, threshold: float = 0.7, held_out: int | None = 2):
        self.sample_rows, self.threshold, self.held_out = sample_rows, threshold, held_out

    def is_held_out(self, doc_id: Column) -> Column:
        if self.held_out is None:
            return F.lit(False)
        return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == self.held_out, F.lit(False))

    def fit(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> AdditiveModel:
        """A model from at most ``sample_rows`` labelled documents that are not held out."""
        ship_package(docs.sparkSession)
        known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y")).where("doc_id is not null and y is not null")
        known = known.where(~self.is_held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y"))
        sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(self.sample_rows)
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")  # of sample_rows at most
        rows = d.mapInArrow(_features, "doc_id long, y int, x array<float>").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).toArrow()
        rows = rows.combine_chunks().sort_by("doc_id")
        x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float) if rows.num_rows else np.zeros((0, len(FEATURES)))
        return AdditiveModel().fit(x, (rows.column("y").to_numpy() > 0).astype(float))

    def run(self, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
        """(doc_id, held_out, score, predicted) for each row of ``docs``; the text alone is scored.

        A row is held out of learning if crc32 of its id as text, modulo 4, is ``held_out``. Null and empty texts
        score as a text of no words; a null id is never held out nor learnt from. An id labelled more than once
        counts as 1 if any label does; of rows that share an id one is learnt from. Without labels every score
        is nearly 1. Other columns are not read.
        """
        model = self.fit(docs, labels, id_col, text, label)
        d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
        scored = d.withColumn("held_out", self.is_held_out(F.col("doc_id"))).mapInArrow(lambda it: _score(it, model), "doc_id long, held_out boolean, score double")
        return scored.withColumn("predicted", (F.col("score") >= self.threshold).cast("int"))

    def keep(self, docs: DataFrame, labels: DataFrame) -> DataFrame:
        """The rows of ``docs``, with all their columns, that ``run`` predicts as 1."""
        model, threshold = self.fit(docs, labels), self.threshold
        return docs.mapInArrow(lambda it: _kept(it, model, threshold), docs.schema)


def _features(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(it, "text"):
        x = text_features(piece).astype(np.float32)
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("y").cast(pa.int32()), flat], ["doc_id", "y", "x"])


def _score(it: Iterator[pa.RecordBatch], model: AdditiveModel) -> Iterator[pa.RecordBatch]:
    for piece in pieces(it, "text"):
        x = text_features(piece).astype(np.float32).astype(float)
        yield pa.RecordBatch.from_arrays([piece.column("doc_id"), piece.column("held_out"), pa.array(model.score(x))], ["doc_id", "held_out", "score"])


def _kept(it: Iterator[pa.RecordBatch], model: AdditiveModel, threshold: float) -> Iterator[pa.RecordBatch]:
    for piece in pieces(it, "text"):
        x = text_features(piece).astype(np.float32).astype(float)
        yield piece.filter(pa.array(model.score(x) >= threshold))
