"""The filter audit against all orders applied one by one, and against its SQL."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

from factweave.llm import filter_audit as audit

DOCS = "doc_id long, text string, lang string, mask string, n string"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(row, rows):
    text, words = row[1] or "", re.findall(r"[^\x20\x09-\x0D]+", row[1] or "")
    bad = ""
    bad += "A" * (len(words) < 100)
    bad += "B" * (100 * len(set(words)) < 80 * len(words))
    bad += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    bad += "D" * bool(re.search(r"[#$%&*|]", text))
    bad += "E" * any(row[0] is not None and o[0] is not None and o[0] < row[0] and (o[1] or "") == text for o in rows)
    return bad


def plain(rows, labels):
    good, toxic = {i for i, q, t in labels if q == 1} - {None}, {i for i, q, t in labels if t == 1} - {None}
    out, shapley = {}, Counter()
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], fails(r, rows)) for r in rows if (r[2] or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, f in enumerate(order, 1):
                gone, left = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = (len(left), len(gone), sum(f in m[1] for m in mine) - len(gone), sum(m[1] == f for m in mine), sum(m[0] in good for m in gone), sum(m[0] in toxic for m in gone))
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def run(spark, rows, labels, parts=3):
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS).repartition(parts)
    return {tuple(r) for r in audit.filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).select(COLUMNS).collect()}


LONG = " ".join(f"w{i}" for i in range(150))
ROWS = [
    (5, LONG, "en"), (3, LONG, "en"), (3, LONG, "de"), (3, LONG, "en"), (9, LONG + " #", None), (2, LONG + " #", "en"), (None, LONG, "en"), (None, None, "en"), (8, "", ""), (4, None, "fr"), (4, "A" * 50, "fr"),
    (10, "a " * 200, "en"), (11, "a " * 200 + "%", "en"), (12, "Ä ß " * 120, "de"), (13, LONG.upper(), "en"), (1, "x y " * 30_000, "de"), (14, LONG.upper(), "en"), (15, LONG, "de"),
]
LABELS = [(5, 1, 0), (3, 1, 1), (3, 0, None), (9, None, 1), (None, 1, 1), (14, 1, 0), (99, 1, 1), (4, 1, 1)]


@pytest.mark.parametrize("parts", [1, 4])
def test_against_all_orders(spark, parts):
    assert run(spark, ROWS, LABELS, parts) == plain(ROWS, LABELS)


def test_small_holds_and_colliding_fingerprints(spark, monkeypatch):
    """Tasks that send on at once, and texts that all share a fingerprint, within this process."""
    monkeypatch.setattr(audit, "HELD", 0)
    monkeypatch.setattr(audit.xxhash, "xxh64_intdigest", lambda data: 7)
    halves = [list(audit.combined((r[0], r[2] or "", r[1] or "") for r in part)) for part in (ROWS[:9], ROWS[9:])]
    got = Counter()
    for doc_id, part, mask, n in audit.merged(sorted(halves[0] + halves[1], key=lambda kv: kv[0])):
        got[doc_id, part, mask] += n
    assert got == Counter((r[0], r[2] or "", sum(1 << "ABCDE".index(f) for f in fails(r, ROWS))) for r in ROWS)


def test_empty_table_and_repeats(spark):
    assert run(spark, [], [], 1) == set()
    docs = spark.createDataFrame([(*r, "x", "y") for r in ROWS], DOCS)
    assert Counter(r.doc_id for r in audit.repeats(docs).collect()) == Counter(r[0] for r in ROWS if "E" in fails(r, ROWS))


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("documents", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = audit.op13_filter_interaction(spark, sf)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == sorted(db.sql(audit.SQL).select(*COLUMNS).fetchall())
