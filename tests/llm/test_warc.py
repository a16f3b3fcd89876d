"""Archives written and read back: round trips, equal bytes on every run, lost attempts, and the query's SQL."""

import base64
import hashlib
import os
from collections import Counter

import duckdb
import pytest

from factweave.llm import warc

PAGES = "page_id long, url string, html string, member string, file int, size string"
ROWS = [
    (4, "http://a/b c?x=1#yä%20\n", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (None, "http://a/n", "<p>same</p>"), (None, "http://a/n", "only null"), (None, "u", "only null"),
    (7, "", None), (8, "u", ""), (3, "u", "\r\n\r\nWARC/1.1\r\n\x00 €"), (3, "u", "\r\n\r\nWARC/1.1\r\n\x00 €"), (11, "u", "long " * 400_000), (1, "u", "long " * 400_000), (12, "u", "x"),
]


def table(spark, tmp_path, rows, parts=3):
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(*r, "m", 1, "s") for r in rows], PAGES).repartition(parts).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def expected(rows, least=0):
    first = {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    out = Counter()
    for i in order:
        page, url, html = rows[i][0], rows[i][1], rows[i][2] or ""
        again = html in first and len(html.encode()) >= least
        out[page, url if html != "only null" and page is not None else "?", "revisit" if again else "response", len(html.encode()), digest(html), first.get(html) if again else None, None if again else html.encode()] += 1
        first.setdefault(html, page)
    return out


def found(rows):
    return Counter((r.page_id, r.url if bytes(r.payload or b"") != b"only null" and r.page_id is not None else "?", r.record_type, r.payload_bytes, r.payload_digest, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in rows)


@pytest.mark.parametrize(("roll", "least"), [(1, 0), (1_000, 0), (10**9, 0), (400, 12)])
def test_round_trip(spark, tmp_path, roll, least):
    manifest = warc.write_warc(table(spark, tmp_path, ROWS), f"file://{tmp_path}/out", roll=roll, least_bytes=least)
    assert found(warc.read_warc(spark, f"file://{tmp_path}/out").collect()) == expected(ROWS, least)
    listed = manifest.collect()
    assert sum(r.records for r in listed) == len(ROWS) and (len(listed) == 1) == (roll == 10**9)
    assert sorted(f for f in os.listdir(tmp_path / "out") if "manifest" not in f) == sorted(r["name"] for r in listed)
    for r in listed:
        data = (tmp_path / "out" / r["name"]).read_bytes()
        assert len(data) == r.bytes and hashlib.sha256(data).hexdigest() == r.sha256


def test_archives_are_the_same_on_every_run(spark, tmp_path):
    pages = table(spark, tmp_path, [(i, f"http://h/{i}", f"page {i % 40} " * (i % 17)) for i in range(400)], 5)
    sums = [{(r["name"], r.sha256) for r in warc.write_warc(pages, f"{tmp_path}/{run}", roll=5_000).collect()} for run in ("a", "b")]
    assert sums[0] == sums[1] and len(sums[0]) > 5


def test_damage_is_seen(spark, tmp_path):
    pages = table(spark, tmp_path, [(i, "u", f"page {i}") for i in range(20)], 2)
    (listed,) = warc.write_warc(pages, f"{tmp_path}/out").collect()
    path = tmp_path / "out" / listed["name"]
    members = path.read_bytes()
    path.write_bytes(members[: len(members) - 40])
    with pytest.raises(Exception, match="archive ends|records"):
        warc.read_warc(spark, f"{tmp_path}/out").collect()
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(b"WARC/1.1\r\nWARC-Record-ID: x\r\nWARC-Block-Digest: sha1:A\r\nContent-Length: 1\r\n\r\nz\r\n\r\n")


def test_records_by_the_letter():
    raw = warc.page_record(5, 0, "http://a/ä b", b"abc", None, warc.DATE)
    assert raw.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and b"WARC-Target-URI: http://a/%C3%A4%20b\r\n" in raw and raw.endswith(b"\r\n\r\nabc\r\n\r\n")
    again = warc.page_record(6, 1, "http://b", b"abc", (5, 0), warc.DATE)
    headers, block = warc.parsed(again)
    assert headers["warc-refers-to"] == warc.parsed(raw)[0]["warc-record-id"] and headers["warc-profile"] == warc.PROFILE and block.endswith(b"\r\n\r\n")


def test_empty_table(spark, tmp_path):
    assert warc.write_warc(table(spark, tmp_path, []), f"{tmp_path}/out").count() == 0
    assert warc.read_warc(spark, f"{tmp_path}/out").count() == 0


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got = warc.op12_warc_archives(spark, sf)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, db.sql(warc.SQL).select(*got.columns).fetchall()))
