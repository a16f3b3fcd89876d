"""Operator 6 over many small blocks, with texts that repeat only themselves."""

import hashlib
import random

import pytest

from factweave.llm import blocks, substrings


@pytest.mark.parametrize("hot", [20_000, 2])
def test_blocks_and_periods(spark, monkeypatch, hot):
    monkeypatch.setattr(blocks, "BLOCK", 3_000)
    monkeypatch.setattr(substrings, "HOT", hot)
    rng = random.Random(9)
    make = lambda n: [f"w{rng.randrange(300)}" for _ in range(n)]
    texts = [" ".join((make(k) * 60)[:n]) for k, n in ((1, 36), (1, 35), (3, 37), (5, 45), (12, 50), (31, 70), (34, 68), (34, 69), (35, 70), (40, 75), (33, 300))]
    shared = make(80)
    texts += [" ".join(make(rng.randrange(50)) + shared[rng.randrange(40) :] + make(rng.randrange(50))) for _ in range(60)] + [None, "", " \t\n", "x" * 9_000]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in enumerate(texts)], "doc_id long, text string, row int, block string").repartition(5)
    got = substrings.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got} == substrings.brute_force(dict(enumerate(texts)))
