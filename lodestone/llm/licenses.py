"""Licence scans by a positional index of rare licence words. DataFrame functions only."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Longer notices: label, words, key phrases of which all must stand in the match.
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2 0"]),
    ("cc-by-4.0", "licensed under cc by 4 0", ["cc by 4 0"]),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ["cc by nc 4 0"]),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ["cc by sa 4 0"]),
    ("gpl-3.0", "either version 3 of the license or at your option any later version", ["version 3 of the license", "any later version"]),
    ("gpl-2.0", "either version 2 of the license or at your option any later version", ["version 2 of the license", "any later version"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"]),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc0", "creative commons zero v1 0 universal", ["creative commons zero"]),
]
_SPLIT = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    keys: tuple[tuple[str, ...], ...]
    base: bool

    @property
    def key_offsets(self) -> list[tuple[int, tuple[str, ...]]]:
        return [(next(i for i in range(len(self.words)) if self.words[i : i + len(k)] == k), k) for k in self.keys]


def templates() -> list[Template]:
    base = [Template(label, tuple(p.split()), (tuple(p.split()),), True) for p, label in BASE.items()]
    return base + [Template(label, tuple(p.split()), tuple(tuple(k.split()) for k in keys), False) for label, p, keys in NOTICES]


def words(text: str = "text") -> Column:
    """Lower-cased (A-Z) words of a whole text; a null text has none."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, _SPLIT), "")


def document_frequencies(docs: DataFrame, vocabulary: list[str], text: str = "text") -> tuple[int, dict[str, int]]:
    """Number of documents, and of those that hold each word of the (small, fixed) licence vocabulary."""
    held = docs.select(F.array_intersect(words(text), F.lit(vocabulary)).alias("held"))
    counts = held.select(F.explode(F.concat("held", F.array(F.lit("")))).alias("word")).groupBy("word").count()
    found = Counter({r["word"]: r["count"] for r in counts.collect()})  # at most one row for each vocabulary word
    return found.pop("", 0), dict(found)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text: str = "text", anchors: int = 2, least_match: float = 0.75) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Each template is entered in a positional index under those ``anchors`` words of its key phrases that have
    the highest inverse document frequency in this corpus. A file's postings of these words, less their position
    in the template, are intersected: what is left are the places where the template may start. There every key
    phrase must stand word for word - so no place is lost by the intersection - and ``least_match`` of all words
    must agree. A base phrase is its own key phrase. ``places`` lists (label, start, match).

    Null and empty texts have no words, no labels and score 0. Repeated rows and ids are scanned one by one;
    other columns are not read.
    """
    all_templates = templates()
    vocabulary = sorted({w for t in all_templates for w in t.words})
    n, df = document_frequencies(docs, vocabulary, text)
    idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) for w in vocabulary}
    index = []  # (template, anchor word, position in the template)
    for t in all_templates:
        mandatory = sorted({at + i for at, k in t.key_offsets for i in range(len(k))})
        ranked = sorted(mandatory, key=lambda i, t=t: (-idf[t.words[i]], i))
        index += [(t, t.words[i], i) for i in ranked[:anchors]]
    looked_up = sorted({w for _, w, _ in index})

    d = docs.select(F.col(id_col).alias("doc_id"), words(text).alias("words"))
    d = d.withColumn("hits", F.when(F.arrays_overlap("words", F.lit(looked_up)), F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda h: h["w"].isin(looked_up))))
    postings = F.transform(F.lit(looked_up), lambda w: F.transform(F.filter("hits", lambda h: h["w"] == w), lambda h: h["i"]))
    d = d.withColumn("postings", F.when(F.size("hits") > 0, postings)).drop("hits")
    none = F.array().cast("array<struct<label:string,start:int,match:double,base:boolean>>")
    found = [_places(t, [(looked_up.index(w), i) for u, w, i in index if u is t], least_match) for t in all_templates]
    d = d.withColumn("found", F.when(F.col("postings").isNotNull(), F.concat(*found)).otherwise(none))
    base = F.filter("found", lambda p: p["base"])
    d = d.select("doc_id", F.size("words").cast("long").alias("n_words"), "found", base.alias("base"))
    label = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    start = F.transform("base", lambda p: p["start"])
    return d.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).cast("long").alias("first_word"), F.array_max(start).cast("long").alias("last_word"),
        label("base").alias("base_labels"), label("found").alias("labels"), F.coalesce(F.array_max(F.transform("found", lambda p: p["match"])), F.lit(0.0)).alias("score"),
        F.transform("found", lambda p: F.struct(p["label"].alias("label"), p["start"].alias("start"), p["match"].alias("match"))).alias("places"),
    )


def _places(t: Template, anchors: list[tuple[int, int]], least_match: float) -> Column:
    """Starts of a template in ``words``, where the postings of all anchors (their number, their place in it) agree, verified."""
    def of(number: int, at: int) -> Column:
        return F.transform(F.get("postings", F.lit(number)), lambda i: i - F.lit(at))

    starts = reduce(F.array_intersect, [of(*a) for a in anchors])
    at = lambda o, k, phrase: F.slice("words", o + F.lit(k + 1), len(phrase)) == F.lit(list(phrase))

    def fits(o: Column) -> Column:
        # a place may begin before the text as long as its key phrases stand inside
        ok = F.lit(True)
        for k, phrase in t.key_offsets:
            ok = ok & F.when(o + F.lit(k) >= 0, at(o, k, phrase)).otherwise(False)
        return ok

    def match(o: Column) -> Column:
        if t.base:
            return F.lit(1.0)
        same = [F.coalesce((F.get("words", o + F.lit(k)) == w).cast("int"), F.lit(0)) for k, w in enumerate(t.words)]
        return sum(same[1:], same[0]) / F.lit(float(len(t.words)))

    rows = F.transform(F.filter(starts, fits), lambda o: F.struct(F.lit(t.label).alias("label"), o.cast("int").alias("start"), match(o).alias("match"), F.lit(t.base).alias("base")))
    return rows if t.base else F.filter(rows, lambda p: p["match"] >= least_match)
