"""Operators 2, 5 and 7 against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from factweave.llm import pii, queries, sharding, tokens

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(sum(divmod(int(d) * (1 + k % 2), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def test_op2_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in queries.QUERIES["op2_personal_data"](spark, SF).collect():
        found = sorted((m.start(), list(BASE).index(k), k, m.end()) for k, p in BASE.items() for m in re.finditer(p, texts[r.doc_id] or "") if passes(k, m[0]))
        n = Counter(k for _, _, k, _ in found)
        base = [f"{k}:{a}:{b}" for a, _, k, b in found]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE] == base


def best(key, weights):
    def score(s, w):
        digest = hashlib.md5(f"{'null' if key is None else key}:{s // 4}".encode()).hexdigest()
        return w / -math.log((int(digest[8 * (s % 4) : 8 * (s % 4) + 8], 16) + 0.5) / 4294967296)

    return max(range(len(weights)), key=lambda s: (score(s, weights[s]), -s))


@pytest.mark.parametrize("weights", [[1.0] * 24, [1.0, 2.0, 1.0, 0.5]])
def test_sharding(spark, weights):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, "", "é" * rng.randrange(9), "x"]), 1, "s") for i in [*range(3_000), 5, 5, None, None]]
    got = sharding.rendezvous_shards(spark.createDataFrame(rows, "doc_id long, text string, shard int, bucket string"), weights).collect()
    sizes = lambda t: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, *sizes(t)) for i, t, *_ in rows)
    slots = defaultdict(list)
    for r in got:
        assert r.shard == best(r.doc_id, weights) and r.grown_shard == best(r.doc_id, [*weights, 1.0])
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    for s, w in enumerate(weights):
        assert len(slots[s]) == pytest.approx(len(rows) * w / sum(weights), abs=5 * math.sqrt(len(rows) * w / sum(weights)))


def test_totals(spark):
    rng = random.Random(8)
    texts = [" ".join(["word"] * rng.randrange(40)) for _ in range(300)] + [None]
    n = sorted(len(t.split()) + 1 if t else 1 for t in texts)
    rows = tokens.length_histogram(spark.createDataFrame([(t,) for t in texts], "text string"), span=7)
    got = {(r.kind, r["at"]): r.value for r in tokens.totals(rows, [1, 10, 100], [0.1, 0.5, 0.99, 1.0]).collect()}
    assert all(got["limit", float(x)] == sum(min(x, v) for v in n) for x in (1, 10, 100))
    assert all(got["quantile", q] == n[math.ceil(q * len(n) - 1e-9) - 1] for q in (0.1, 0.5, 0.99, 1.0))
