"""Fill-in-middle against plain Python: cuts in code points, words and lines, at every chunk size."""

import hashlib
import re

import numpy as np
import pytest
from test_operators import docs, empty, fixture_texts  # noqa: F401

from lodestone.llm import fill_middle as fm
from lodestone.llm.fill_middle import FillInMiddle

UNITS = {
    fm.code_points: lambda t: list(t),
    fm.words: lambda t: re.findall(r"^[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", t),
    fm.lines: lambda t: re.findall(r"[^\n]*\n|[^\n]+", t),
}


def brute(i, text, units, seed=1, plain=10, spm=20):
    text = text or ""
    parts = units(text)
    n = len(parts)
    digest = hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if i is None or not text or any(m in text for m in fm.MARKS) or h[2] % 100 >= 100 - plain:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(parts[x:y]) for x, y in ((0, a), (a, b), (b, n)))
    if h[3] % 100 < spm:
        return n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def odd_texts():
    rng = np.random.default_rng(3)
    rows = [r for r in fixture_texts() if r[0] is None or r[0] < 100]
    alphabet = ["<", "P", "S", "M", ">", "é", "\U0001f600", " ", "\n", "a", "ﬁ", "‍"]
    for i in range(200, 320):
        rows.append((i, "".join(rng.choice(alphabet, int(rng.integers(0, 400)), p=[0.02] * 5 + [0.12857] * 6 + [0.12858]))))
    return [*rows, (400, "x<P>y"), (401, "<" * 70 + "S>"), (402, "é" * 5000), (403, "a\n" * 3000), (200, "other text under the same id")]


@pytest.mark.parametrize("units", list(UNITS), ids=lambda u: u.__name__)
@pytest.mark.parametrize("chunk", [1 << 16, 7, 300])
def test_rows_equal_plain_python(spark, units, chunk):
    if chunk == 7:
        rows = [r for r in odd_texts() if not r[1] or len(r[1]) < 6000]
    else:
        rows = odd_texts()
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, tag string, n int").repartition(3)
    fim = FillInMiddle(units=units, chunk=chunk)
    found = fim.restore(fim.run(table)).collect()
    want = sorted((repr((i, *brute(i, t, UNITS[units]), t or "")) for i, t in rows))
    assert sorted(repr(tuple(r)) for r in found) == want
    assert {r.form for r in found} == {"plain", "psm", "spm"}


def test_nulls_repeats_and_empty_tables(spark, docs, empty):  # noqa: F811
    for chunk in (1 << 16, 64):
        fim = FillInMiddle(chunk=chunk)
        found = sorted(repr(tuple(r)) for r in fim.run(docs).collect())
        assert found == sorted(repr((i, *brute(i, t, list))) for i, t in fixture_texts())
        assert fim.restore(fim.run(empty)).count() == 0


def test_functions_compose(spark):
    """A chunk's function does not depend on where texts are cut into chunks."""
    rng = np.random.default_rng(4)
    data = np.frombuffer(bytes(rng.choice(list(b"<PSM> \na\xc3\xa9"), 3000).tolist()), np.uint8)
    for units in UNITS:
        a = units(fm.MARKS)
        g = fm.grams(a, 300)
        whole = fm.scan(data, np.array([0, len(data)]), g)
        cuts = np.unique(np.concatenate(([0, len(data)], rng.integers(0, len(data), 40))))
        parts = fm.scan(data, cuts, g)
        folded = tuple(x[:1] for x in parts)
        for k in range(1, len(cuts) - 1):
            folded = fm.compose(folded, tuple(x[k : k + 1] for x in parts))
        assert all((x == y).all() for x, y in zip(whole, folded, strict=True))
        state, begun = 0, 0
        for byte in data.tolist():
            begun += a.begins[state, byte]
            state = a.step[state, byte]
        assert whole[0][0, 0] == state and whole[1][0, 0] == begun
