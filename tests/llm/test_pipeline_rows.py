"""The pipeline's stages against plain Python, on nulls, empty and repeated texts and ids, and extra columns."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from factweave.llm import near_copies

STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, block int"


def given():
    rng = random.Random(2)
    make = lambda n: " ".join(f"w{rng.randrange(400)}" for _ in range(n))
    texts = [make(rng.randrange(60)) for _ in range(60)]
    texts += [t.upper() for t in texts[:9]] + [f"{t} more" for t in texts[10:20]] + [None, "", "", make(6_000)]
    ids = [*range(len(texts) - 4), 3, 3, None, None]
    return [(i, t, "en", "big" if k % 3 else None, None, "r", 1) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(given(), SCHEMA)


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_exact(spark, docs):
    best = {}
    for r in given():
        key = (r[1] or "").lower()
        if key not in best or (r[0] is not None, r[0] or 0) > (best[key][0] is not None, best[key][0] or 0):
            best[key] = r
    got = STAGES["exact_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.text or "").lower(), r.doc_id) for r in got.collect()) == sorted((k, r[0]) for k, r in best.items())


def test_near(spark, docs):
    every = given()
    sets = [near_copies.shingles_of((r[1] or "").lower()) for r in every]
    part = list(range(len(every)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 5 * len(x & sets[j]) >= 4 * len(x | sets[j]):
                part = [min(part[i], part[j]) if p in (part[i], part[j]) else p for p in part]
    stays = defaultdict(list)
    for r, p in zip(every, part, strict=True):
        stays[p].append((r[0] is None, r[0] or 0))
    got = STAGES["simhash_near_dedup"](spark, docs, "")
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == sorted(min(x) for x in stays.values())


def test_mix(spark, docs):
    size = defaultdict(int)
    for r in given():
        size[r[3]] += len((r[1] or "").encode())
    weight = {s: b**0.7 for s, b in size.items()}
    rate = {s: weight[s] / sum(weight.values()) * sum(size.values()) / b for s, b in size.items()}

    def copies(r):
        u = int(hashlib.md5(f"42:{'null' if r[0] is None else r[0]}:1".encode()).hexdigest()[:13], 16) / 2**52
        total = k = 0
        while k < 200:
            total += math.exp(-rate[r[3]]) * rate[r[3]] ** k / math.factorial(k)
            if u < total:
                return k
            k += 1
        return k

    got = STAGES["mix_sources"](spark, docs, "")
    assert got.columns == docs.columns
    assert Counter(map(tuple, got.collect())) == sum((Counter({r: copies(r)}) for r in given()), Counter())


def test_empty(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    none = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0, name
    kept = STAGES["quality_classifier"](spark, docs, str(tmp_path))  # without labels all stay
    assert kept.columns == docs.columns and rows(kept) == rows(docs)
