"""The Jaccard join against all pairs in plain Python."""

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F
from test_operators import docs, empty, fixture_texts, prose, shingles  # noqa: F401

from lodestone.llm.jaccard_join import JaccardJoin, _both, _packed, _shared


def brute(rows, percent=80):
    sets = [(i, shingles(t)) for i, t in rows]
    distinct = sorted({frozenset(s) for i, s in sets if i is not None and s}, key=sorted)
    up = list(range(len(distinct)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = {}
    for k, s in enumerate(distinct):
        for x in s:
            holders.setdefault(x, []).append(k)
    for k, s in enumerate(distinct):
        for j in {j for x in s for j in holders[x] if j < k}:
            both = len(s & distinct[j])
            if 100 * both >= percent * (len(s) + len(distinct[j]) - both):
                up[root(k)] = root(j)
    number = {s: k for k, s in enumerate(distinct)}
    least = {}
    for i, s in sets:
        if i is not None and s:
            r = root(number[frozenset(s)])
            least[r] = min(least.get(r, i), i)
    return sorted(repr((i, len(s), i if i is None or not s else least[root(number[frozenset(s)])])) for i, s in sets)


def rows_of(spark, rows, **kinds):
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(repr(tuple(r)) for r in JaccardJoin(**kinds).run(d).collect())


def test_odd_rows(spark, docs):  # noqa: F811
    clash = docs.withColumns({"point": F.lit(1), "fp1": F.lit("x"), "shingles": F.lit(2)})
    assert sorted(repr(tuple(r)) for r in JaccardJoin().run(clash).collect()) == brute(fixture_texts())


def test_empty_tables_and_parameters(spark, empty):  # noqa: F811
    assert JaccardJoin().run(empty).count() == 0
    assert rows_of(spark, [(1, "a b c d e f"), (2, "g h i j k l")]) == brute([(1, "a b c d e f"), (2, "g h i j k l")])
    with pytest.raises(ValueError):
        JaccardJoin(percent=50)


@pytest.mark.parametrize("seed,percent,kinds", [(1, 80, {}), (2, 80, dict(block=4, cells_log2=12)), (3, 60, dict(block=3)), (4, 90, {})])
def test_chains_and_clusters(spark, seed, percent, kinds):
    """Texts that drift away from one another step by step, so that links lead through cores and windows."""
    rng = np.random.default_rng(seed)
    rows = []
    passage = prose(50, 5000, rng)
    for c in range(12):
        words = prose(int(rng.integers(8, 150)), 3000, rng).split()
        for k in range(int(rng.integers(1, 30))):
            words = list(words)
            for _ in range(int(rng.integers(0, 4))):
                words[int(rng.integers(len(words)))] = f"x{rng.integers(1000)}"
            if rng.random() < 0.2:
                words = words + [f"y{rng.integers(1000)}"] * int(rng.integers(1, 4))
            rows.append((len(rows), " ".join(words) + (" " + passage if c % 4 == 0 else "")))
    for _ in range(40):
        rows.append((len(rows), prose(30, 4000, rng) + " " + passage))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), t) for i, t in rows]
    found = rows_of(spark, rows, percent=percent, **kinds)
    assert found == brute(rows, percent)


def test_large_group_of_near_copies(spark):
    """Near copies that are alike or not by chance, whose regions' cores and windows take many blocks."""
    rng = np.random.default_rng(8)
    base, rows = prose(120, 3000, rng).split(), []
    for i in range(600):
        words = list(base)
        for _ in range(int(rng.integers(1, 7))):
            words[int(rng.integers(len(words)))] = f"x{rng.integers(100000)}"
        rows.append((i, " ".join(words)))
    assert rows_of(spark, rows, block=100) == brute(rows)


def test_loose_crowd_takes_few_rounds(spark, monkeypatch):
    """Copies of copies of three sizes, most of them too far from any pivot: rounds of pivots don't grow with the crowd."""
    rng = np.random.default_rng(12)
    rows, rounds, measured = [], [], JaccardJoin._measured
    monkeypatch.setattr(JaccardJoin, "_measured", lambda self, *a: rounds.append(1) or measured(self, *a))
    for size in (100, 120, 146):
        group = [prose(size, 3000, rng).split() if size == 100 else group[0] + prose(size - len(group[0]), 3000, rng).split()]
        for _ in range(199):
            group.append(list(group[int(rng.integers(len(group)))]))
            for _ in range(int(rng.integers(1, 6))):
                group[-1][int(rng.integers(size))] = f"x{rng.integers(100000)}"
        rows += [(len(rows) + k, " ".join(words)) for k, words in enumerate(group)]
    assert rows_of(spark, rows, block=20, pivots=2) == brute(rows)
    assert 1 <= len(rounds) <= 5


@pytest.mark.parametrize("lot", [7, 1 << 21])
def test_intersections_of_blocks(lot):
    """Shingles of many rows and of few, in one block and across two."""
    rng = np.random.default_rng(6)
    sets = [np.unique((rng.random(60) ** 3 * 300).astype(np.int64) * 7 - 900) for _ in range(70)]
    at = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
    for left, right in ((np.arange(0, 70, 2), np.arange(1, 70, 2)), (np.arange(30), np.arange(30)), (np.arange(1), np.arange(1, 70))):
        want = [[len(np.intersect1d(sets[i], sets[j])) for j in right] for i in left]
        assert _both(np.concatenate(sets), at, left, right, lot).tolist() == want


@pytest.mark.parametrize("lot", [1, 64, 1 << 20])
@pytest.mark.parametrize("shards", [1, 7])
def test_shared_hashes_are_counted(lot, shards):
    """Packed by ranges and lots: never under the count over all rows, and equal to it where no owner has copies."""
    rng = np.random.default_rng(5)
    pool = rng.integers(0, 2**63, 300) * 2 - 1
    owners = rng.permutation(np.arange(-60, 60) * 1_000_003)
    heads = [rng.choice(pool, k, replace=False).tolist() + [int(pool[0])] * int(k > 0) for k in rng.integers(0, 9, len(owners))]
    for copies in (1, 2):
        batch = pa.RecordBatch.from_pydict({"fp1": pa.array(np.tile(owners, copies)), "heads": pa.array(heads * copies, pa.list_(pa.int64()))})
        parts = [pa.Table.from_batches([b]) for b in _packed(iter([batch.slice(0, 50), batch.slice(50)]), shards, lot)]
        table, got = pa.concat_tables(parts), {}
        for k in range(shards):
            own = table.filter(pa.compute.equal(table.column("shard"), k))
            if own.num_rows:
                for o, n in zip(*(c.to_pylist() for c in _shared(own).columns), strict=True):
                    got[o] = got.get(o, 0) + n
        holders = {}
        for o, row in zip(owners.tolist(), heads, strict=True):
            for x in row:
                holders.setdefault(x, set()).add(o)
        want = {o: sum(len(holders[x]) > 1 for x in set(row)) for o, row in zip(owners.tolist(), heads, strict=True)}
        for o, n in want.items():
            assert got.get(o, 0) == n if copies == 1 else got.get(o, 0) >= n
