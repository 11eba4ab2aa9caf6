"""Importance resampling against plain Python: counts, gains, weights, scores and the draw."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import LOWER, docs, empty, fixture_texts, prose  # noqa: F401

from lodestone.llm.importance import ImportanceResampling


def features(text, orders, buckets):
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(ws) - k + 1)]


def brute(rows, target, orders=3, buckets=10_000, percent=5, least=20, seed=42):
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text, orders, buckets)[1])
    for text in target:
        t.update(features(text, orders, buckets)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in s}
    out = []
    for i, text in rows:
        n, f = features(text, orders, buckets)
        weight = sum(gain[b] for b in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, n, len(f), weight, score, None])
    able = sorted((r for r in out if r[1] >= least and r[0] is not None), key=lambda r: (-r[4], r[0]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = place
    return sorted(map(repr, map(tuple, out)))


ODD = ["Ünïcode ÉCOLE école 12a a12 _x_ y", "ÀB ab \x00 ab-AB", "K kelvin İ"]


@pytest.mark.parametrize("kinds", [dict(), dict(orders=1, buckets=7, percent=50, least_words=2, seed=3), dict(orders=4, percent=100, least_words=0)])
def test_rows_equal_plain_python(spark, docs, kinds):  # noqa: F811
    rows = fixture_texts() + list(enumerate(ODD, 500)) + [(700 + i, prose(30 + i)) for i in range(60)]
    more = spark.createDataFrame(list(enumerate(ODD, 500)) + rows[-60:], "doc_id long, text string")
    target = [prose(80), None, "", "école 12a y", "w1 w2 w3 w4"]
    found = ImportanceResampling(**kinds).run(docs.select("doc_id", "text").unionByName(more), spark.createDataFrame([(t,) for t in target], "text string"))
    plain = {{"least_words": "least"}.get(k, k): v for k, v in kinds.items()}
    assert sorted(repr(tuple(r)) for r in found.collect()) == brute(rows, target, **plain)


def test_clashing_names_and_empty_tables(spark, docs, empty):  # noqa: F811
    draw = ImportanceResampling()
    clash = docs.withColumns({"bucket": F.lit(1), "b1": F.lit("x"), "tag": F.lit("x"), "copies": F.lit(2), "upto": F.lit(0)})
    target = clash.select("text", "bucket", "doc_id")
    want = brute(fixture_texts(), [t for _, t in fixture_texts()])
    assert sorted(repr(tuple(r)) for r in draw.run(clash, target).collect()) == want
    assert draw.run(empty, target).count() == 0
    assert sorted(repr(tuple(r)) for r in draw.run(docs, empty).collect()) == brute(fixture_texts(), [])


def test_ties_and_many_repeats(spark):
    """Rows of one id and text have ranks of their own, in a row; of equal scores the smaller id comes first."""
    text = prose(25)
    rows = [(7, text)] * 40 + [(8, prose(25)) for _ in range(3)] + [(i, None) for i in range(20, 30)]
    found = ImportanceResampling(percent=60).run(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(text,)], "text string")).collect()
    assert sorted(repr(tuple(r)) for r in found) == brute(rows, [text], percent=60)
    assert sorted(r.rank for r in found if r.rank) == list(range(1, 26))


def test_similar_documents_are_drawn(spark):
    """Documents of the target's words outweigh those of others."""
    rows = [(i, prose(100, 30) if i % 10 == 0 else prose(100, 30).replace("w", "v")) for i in range(200)]
    found = ImportanceResampling(percent=5).run(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(prose(400, 30),)], "text string"))
    assert all(r.doc_id % 10 == 0 for r in found.where("rank is not null").collect())
