"""The merges as a matrix laid into one row: every pair is found by one place, and nothing else is."""

import numpy as np

from lodestone.llm.bpe import RankMap, read_ranks
from lodestone.llm.queries import tokenizer_path


def test_every_pair_has_one_place():
    ranks = read_ranks(tokenizer_path())
    table = RankMap(ranks)
    pairs = {(ranks[t[:i]], ranks[t[i:]]): r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
    a, b, r = np.array([(*k, v) for k, v in pairs.items()]).T
    assert (table.left[table.base[a] + b] == a).all() and (table.joined[table.base[a] + b] == r).all()
    assert (table.left >= 0).sum() == len(pairs) and table.base.max() + max(ranks.values()) < len(table.left)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, len(ranks), (2, 100_000))
    found = table.left[table.base[a] + b] == a
    assert found.tolist() == [k in pairs for k in zip(a.tolist(), b.tolist(), strict=True)]
