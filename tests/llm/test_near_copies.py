"""The near-duplicate stage against all pairs of five-word shingle sets in plain Python."""

import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from factweave.llm import near_copies, simhash

SCHEMA = "doc_id long, text string, row string, __salt int"


def similar(x, y):
    x, y = (near_copies.shingles_of((t or "").lower()) for t in (x, y))
    return 5 * len(x & y) >= 4 * len(x | y)


def kept_of(rows):
    left, kept = list(range(len(rows))), []
    while left:
        part, queue = [], [left.pop()]
        while queue:
            part.append(at := queue.pop())
            queue += (near := [i for i in left if similar(rows[i][1], rows[at][1])])
            left = [i for i in left if i not in near]
        kept.append(min((rows[i][0] is None, rows[i][0] or 0) for i in part))
    return sorted(kept)


def test_near_dedup_finds_pairs_from_similarity_0_8(spark):
    rng = random.Random(5)
    rows = [(None, None), (None, ""), (9, " "), (3, "A b"), (2, "a  B"), (2, "a b"), (None, "a b c"), (None, "a b c")]
    for k in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20, 300))]
        rows.append((100 + 10 * k, " ".join(words)))
        for copy in range(rng.randrange(1, 4)):
            for _ in range(max(1, round(len(words) * rng.uniform(0.01, 0.03)))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(3000)}"
            rows.append((101 + 10 * k + copy, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in rows], SCHEMA)
    got = near_copies.near_dedup(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got.collect()) == kept_of(rows)


def test_near_dedup_of_one_large_group(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(words[: i % 150] + ["x"] + words[i % 150 + 1 :]), "r", 0) for i in range(600)]
    assert [r.doc_id for r in near_copies.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()] == [0]


def test_near_dedup_of_copies_with_edits_of_their_own(spark):
    """A group that stays split: copies far from each other, near to one that few others are alike to, and rows without a partner."""
    rng = random.Random(3)
    words, rows = [f"w{i}" for i in range(150)], []
    for i in range(160):
        copy = list(words)
        for at in rng.sample(range(150), rng.randrange(0, 9)):
            copy[at] = f"x{i}-{at}"
        rows.append((i, " ".join(copy), "r", 0))
    got = near_copies.near_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((False, r.doc_id) for r in got) == kept_of(rows) and 1 < len(got) < 150


def test_near_dedup_of_nothing(spark):
    assert near_copies.near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_leave_all_alike_pairs(spark):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(120)]
    texts = ["", "a b"]
    for _ in range(60):
        copy = list(words)
        for _ in range(rng.randrange(0, 8)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(20)}"
        texts.append(" ".join(copy[rng.randrange(0, 15) :]))
    table = spark.createDataFrame(list(enumerate(texts)), "a long, text string")
    rows = near_copies.signed(table).join(near_copies.own_counts(table), "a", "left").fillna(0, ["own"])
    own = {r.a: r.own for r in rows.collect()}
    sets = [near_copies.shingles_of(t) for t in texts]
    assert own == {i: sum(all(s not in o for j, o in enumerate(sets) if j != i) for s in x) for i, x in enumerate(sets)}
    other = rows.select(*[F.col(c).alias("b" if c == "a" else f"f_{c}") for c in rows.columns])
    left = {(r.a, r.b) for r in rows.join(other, (F.col("a") < F.col("b")) & near_copies.may_be_alike()).collect()}
    alike = {(i, j) for j in range(len(texts)) for i in range(j) if similar(texts[i], texts[j])}
    assert alike and alike <= left
    assert len(left - alike) < len(texts) ** 2 / 8


def test_fingerprints_alone_find_candidates(spark, monkeypatch):
    """Copies whose fingerprints differ in few bits are joined without any band; components go on over fingerprints in between."""
    rng = random.Random(9)
    words = [f"w{rng.randrange(5000)}" for _ in range(400)]
    texts = [" ".join([*words[:k], f"x{k}", *words[k + 1 :]]) for k in (0, 1, 200, 399)] + [" ".join(words), "a b c"]
    monkeypatch.setattr(near_copies, "band_keys", lambda texts, size=5: np.arange(len(texts) * near_copies.BANDS).reshape(len(texts), -1) + 1000 * xxhash.xxh32_intdigest(str(texts)))
    docs = spark.createDataFrame([(i, t, "r", 0) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    prints = [int(f) for f in simhash.fingerprints_of(pa.array(texts), near_copies.SIZE)]
    groups = {r.a: r.key for r in near_copies.simhash_groups(spark.createDataFrame(list(enumerate(prints)), "a long, fingerprint long")).collect()}
    close = lambda i, j: ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4
    reach = [{i} for i in range(len(texts))]
    for _ in texts:
        reach = [r | {j for i in r for j in range(len(texts)) if close(i, j)} for r in reach]
    assert [[groups[i] == groups[j] for j in range(len(texts))] for i in range(len(texts))] == [[j in r for j in range(len(texts))] for r in reach]
    assert sum(map(len, reach)) > len(texts)
    assert sorted(r.doc_id for r in near_copies.near_dedup(docs).collect()) == sorted({min(r) for r in reach})
