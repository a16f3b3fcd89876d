"""Operator 1's local search on lengths where best fit loses, and its levels of groups."""

from collections import defaultdict

import numpy as np
import pytest

from factweave.llm import packing


def squares(bins, sizes):
    return sum(int(sizes[b].sum()) ** 2 for b in bins)


@pytest.mark.parametrize("sizes, fewer", [
    ([6, 5, 4, 3, 2], 2),  # best fit: 6+4, 5+3+2
    ([5, 4, 3, 3, 3, 2], 2),  # 5+3+2, 4+3+3; best fit: 5+4, 3+3+3, 2
    ([6, 4, 4, 3, 3], 2),  # 6+4, 4+3+3
])
def test_small_cases_reach_the_optimum(sizes, fewer):
    sizes = np.array(sizes)
    assert len(packing.improve(packing.best_fit(sizes, 10), sizes, 10)) == fewer


def test_each_kind_of_exchange():
    exchange = lambda bins, sizes: packing.best_exchange(0, np.array(bins), np.bincount(bins, weights=sizes).astype(np.int64), np.array(sizes), 10)
    assert exchange([0, 1], [3, 6]) == ((0,), 1, -1)  # a move
    give, b, take = exchange([0, 1, 1], [5, 4, 5])  # 5 for 4
    assert (give, b, take) == ((0,), 1, 1)
    give, b, take = exchange([0, 0, 1, 1], [2, 3, 4, 5])  # 2 and 3 for 4
    assert (set(give), b, take) == ({0, 1}, 1, 2)
    assert exchange([0, 1], [10, 10]) is None and exchange([0], [4]) is None


@pytest.mark.parametrize("low, high", [(1000, 2200), (1300, 1500), (1, 3000)])
def test_search_beats_best_fit(low, high):
    sizes = np.random.default_rng(1).integers(low, high, 600)
    first = packing.best_fit(sizes, 4096)
    last = packing.improve(first, sizes, 4096)
    assert sorted(i for b in last for i in b) == list(range(len(sizes))) and max(int(sizes[b].sum()) for b in last) <= 4096
    assert len(last) <= len(first) and (squares(last, sizes) > squares(first, sizes) or len(first) == -(-sizes.sum() // 4096))
    assert high == 3000 or len(last) < len(first)
    where = np.concatenate([np.full(len(b), k) for k, b in enumerate(last)])[np.argsort(np.concatenate(last))]
    fill = np.bincount(where, weights=sizes).astype(np.int64)
    assert len(last) == -(-sizes.sum() // 4096) or all(packing.best_exchange(d, where, fill, sizes, 4096) is None for d in np.flatnonzero(fill < 4096))


@pytest.mark.parametrize("group", [7, 40, 10_000])
def test_levels_pack_every_piece_once(spark, group):
    rng = np.random.default_rng(2)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 60, 300)] + [None, "", "x " * 250]
    docs = spark.createDataFrame([(i % 290, t, 1, 2, "x") for i, t in enumerate(texts)], "doc_id long, text string, spread int, loose int, sequence_id string")
    got = packing.pack(docs, limit=100, group=group).collect()
    assert len(got) == len(texts) + 2
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 100
    assert len(bins) <= -(-sum(r.length for r in got) // 100) + (8 if group == 7 else 2)
