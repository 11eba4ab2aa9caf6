"""Words of unlike length never share a hash by rule, and what is built on word hashes tells them apart."""

import numpy as np
import pytest
from test_operators import Q, LOWER, brute_near, brute_substring  # noqa: F401

from lodestone.llm.near_dedup import NearDedup
from lodestone.llm.packing import Packing
from lodestone.llm.substring_dedup import SubstringDedup
from lodestone.llm.textops import _SEED, span_hashes

#: Two words, of seven and eight bytes, whose sums of size and bytes are equal.
SEVEN, EIGHT = bytes.fromhex("33dda969402d61"), bytes.fromhex("1e615fea86b32962")


def hashes(words, seed=0):
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return span_hashes(data, ends - [len(w) for w in words], ends, seed)


@pytest.mark.parametrize("seed", [0, 0xA24BAED4963EE407])
def test_sizes_and_bytes_do_not_add_up(seed):
    step, mask = int(_SEED), (1 << 64) - 1
    rng = np.random.default_rng(1)
    words = {SEVEN, EIGHT}
    for a in range(1, 9):
        for b in range(a + 1, 9):
            for x in [*range(1, 256), *rng.integers(1, 1 << 62, 2000).tolist()]:
                x &= (1 << (8 * a)) - 1
                other = (x - (b - a) * step) & mask  # bytes and size times the seed sum to the same
                words |= {x.to_bytes(a, "little"), (other & ((1 << (8 * b)) - 1)).to_bytes(b, "little")}
    words = sorted(words)
    assert len(np.unique(hashes(words, seed))) == len(words)


def test_a_hash_is_of_the_bytes_alone():
    words = [b"x" * n for n in range(1, 80)]
    turned = hashes(words[::-1])[::-1]
    assert (hashes(words) == turned).all() and len(set(turned.tolist())) == len(words)


def test_windows_of_unlike_words(spark):
    seven, eight = SEVEN.decode(), EIGHT.decode()
    rows = [(1, " ".join([seven] * 13)), (2, " ".join([eight] * 13)), (3, seven), (4, eight), (5, " ".join([seven] * 5)), (6, " ".join([eight] * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in SubstringDedup().run(docs).collect()} == dict.fromkeys(range(1, 7), 0)
    assert all(r.kept for r in NearDedup().run(docs).where("doc_id in (3, 4)").collect())
    found = {r.doc_id: r.component_id for r in NearDedup().run(docs).collect()}
    assert found[5] == found[1] == 1 and found[6] == found[2] == 2


def test_packing_of_unlike_words(spark):
    docs = spark.createDataFrame([(1, "kΔNuӭ1VRJϻYvb")], "doc_id long, text string")
    (row,) = Packing(Q.tokenizer_path(), size=64).run(docs).collect()
    assert row.n_tokens > 0
