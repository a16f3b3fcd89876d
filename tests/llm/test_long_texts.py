"""Texts of hundreds of thousands of words, and columns whose names clash with those of the results."""

import zlib

import xxhash
from pyspark.sql import functions as F

from factweave.llm.quality_rules import clean_lines
from factweave.llm.sharding import rendezvous_shards
from factweave.llm.simhash import near_groups
from factweave.llm.tokens import length_histogram

LONG = " ".join(f"w{i % 5000}" for i in range(300_000))


def table(spark):
    rows = [(1, LONG, "a"), (2, LONG + " end", "b"), (3, "short", "c"), (3, "short", "c"), (4, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, salt string")
    return docs.withColumns({c: F.lit("x") for c in ("length", "docs", "shard", "slot", "fingerprint", "component_id", "rep", "kept", "n_words", "lang")})


def test_simhash(spark):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in near_groups(table(spark)).select("doc_id", "fingerprint", "component_id").collect()}
    words = LONG.split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]), 42) for i in range(len(words) - 3)]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert got[1] == (f"{bits:016x}", 1) and got[2][1] == 1 and got[4][0] == "0" * 16


def test_token_lengths(spark):
    got = length_histogram(table(spark)).select("length", "docs").collect()
    assert sum(r.docs for r in got) == 5 and sum(r.length > 300_000 for r in got) == 2


def test_shards(spark):
    got = {(r.doc_id, r["size"], r.text_crc32) for r in rendezvous_shards(table(spark), [1.0] * 24).collect()}
    assert (1, len(LONG) + 8, zlib.crc32(LONG.encode())) in got and (4, 8, 0) in got


def test_quality_rules(spark):
    got = {r.doc_id: r for r in clean_lines(table(spark)).collect()}
    assert got[1].n_words == 300_000 and got[2].n_words == 300_001 and got[1].n_repeat_words == 300_000
