"""Operator 9 against modified Kneser-Ney in plain Python."""

import random
from collections import Counter, defaultdict
from math import log2

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import blocks, perplexity
from factweave.llm import kneser_ney as kn

SCHEMA = "doc_id long, text string, lang string, block string, row int, fold int, g_row long"


def windows(text):
    data = b"\0" * (kn.ORDER - 1) + (text or "").encode()
    return [data[i : i + kn.ORDER] for i in range(len(data) - kn.ORDER + 1)]


class Plain:
    """Interpolated modified Kneser-Ney, count by count."""

    def __init__(self, texts):
        self.c = {kn.ORDER: Counter(g for t in texts for g in windows(t))}
        for k in range(kn.ORDER - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.after = {}, {}
        for k, c in self.c.items():
            n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
            y = n[0] / (n[0] + 2 * n[1]) if n[0] + 2 * n[1] else 0.5
            self.d[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1] if n[i - 1] else 0.5 * i, 0.1), i - 0.05) for i in (1, 2, 3)]
            self.after[k] = defaultdict(list)
            for g, v in c.items():
                self.after[k][g[:-1]].append(v)

    def p(self, gram):
        if not gram:
            return 1 / 256
        k, low = len(gram), self.p(gram[1:])
        every = self.after[k].get(gram[:-1])
        if not every:
            return low
        take = lambda v: self.d[k][min(v, 3) - 1]
        v = self.c[k].get(gram, 0)
        return ((v - take(v) if v else 0) + sum(map(take, every)) * low) / sum(every)

    def units(self, gram):
        return round(-log2(self.p(gram)) * kn.UNIT)


def prose(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def given():
    rng = random.Random(3)
    rows = [(i, prose(rng, "abcdé", rng.randrange(1, 60)), ("en", "de", None)[i % 3]) for i in range(120)]
    rows += [(200 + i, prose(rng, "abcd", 10) + " xyzzy xyzy", "en") for i in range(20)]
    return rows + [(300, None, "en"), (301, "", None), (None, "ab", "en"), (None, "ab", "en"), (5, "abc", "de"), (302, "a" * 3_000, "en"), (303, "日本語", "ja")]


def test_report_equals_plain_python(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 2_000)
    monkeypatch.setattr(blocks, "STEP", 700)
    rows = given()
    docs = spark.createDataFrame([(i, t, lang, "b", 1, 2, 3) for i, t, lang in rows], SCHEMA).repartition(3)
    labels = [(i, 1, 0) for i in range(100)] + [(200 + i, 1, 1) for i in range(20)] + [(7, 0, 0), (None, 1, 0)]
    fold = {r.doc_id: r.f for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).alias("f")).distinct().collect()} | {None: 0}
    bad = {7} | {200 + i for i in range(20)}
    good = set(range(100)) - bad
    models = {(r, f): Plain([t for i, t, _ in rows if i in ids and fold[i] == f]) for r, ids in ((0, good), (1, bad)) for f in (0, 1)}
    got = perplexity.quality_report(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    wanted = defaultdict(list)
    for i, t, _ in rows:
        own = [models[0, 1 - fold[i]].units(g) for g in windows(t)]
        more = [a - models[1, 1 - fold[i]].units(g) for a, g in zip(own, windows(t), strict=True)]
        best = max((sum(more[k : k + perplexity.WIDTH]) for k in range(max(1, len(more) - perplexity.WIDTH + 1))), default=0)
        wanted[i].append((len(own), sum(own) / kn.UNIT, best / kn.UNIT))
    for r in got:
        assert any(n == r.n_bytes and 2 ** (bits / max(n, 1)) == pytest.approx(r.perplexity, rel=2e-3) and (r.worst is None if not n else abs(best - r.worst) < 0.2) for n, bits, best in wanted[r.doc_id])
    held = defaultdict(list)
    for r in got:
        if r.doc_id in good and r.n_bytes:
            held[r.lang].append((r.score, r.worst))
    for r in got:
        if r.lang in held:
            assert r.threshold >= max(s for s, _ in held[r.lang]) and r.worst_threshold >= max(w for _, w in held[r.lang])
            assert r.kept == (r.n_bytes == 0 or (r.score <= r.threshold and r.worst <= r.worst_threshold))
        else:
            assert r.kept and r.threshold is None
    assert not any(r.kept for r in got if r.doc_id and r.doc_id >= 200 and r.doc_id < 220)
    kept = perplexity.quality_filter(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert kept.columns == docs.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, str(r.text))
    text = {(i, lang): t for i, t, lang in rows}
    assert sorted(map(key, kept.collect())) == sorted((r.doc_id is None, r.doc_id or 0, str(text[r.doc_id, r.lang])) for r in got if r.kept)


def test_probabilities_sum_to_one():
    rng = random.Random(1)
    grams = np.sort(np.array([int.from_bytes(bytes([1, 2, rng.randrange(3), 97, 98, rng.randrange(6)]), "big") for _ in range(50)]))
    key, counts = np.unique(grams, return_counts=True)
    every = kn.orders(key, counts)
    d = {k: kn.discounts(kn.count_of_counts(c)) for k, (_, c) in every.items()}
    shard = kn.Shard(key, counts, d, kn.low_orders(np.bincount(every[3][0] & 0xFFFF, minlength=1 << 16)))
    for start in (bytes([1, 2, 0, 97, 98]), bytes([9, 9, 9, 97, 98])):
        asked = np.array([int.from_bytes(start + bytes([z]), "big") for z in range(256)])
        assert sum(2.0 ** (-shard.bits(asked).astype(float) / kn.UNIT)) == pytest.approx(1, abs=2e-3)


def test_lookup_and_packing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 48, 5_000))
    assert (keys[kn.Lookup(keys)(asked := rng.choice(keys, 9_000))] == asked).all()
    assert (blocks.unpacked(blocks.packed(keys, 6), len(keys), 6, np.int64) == keys).all()
    signed = rng.integers(-30_000, 30_000, 100).astype(np.int16)
    assert (blocks.unpacked(blocks.packed(signed, 2), 100, 2, np.int16) == signed).all()
