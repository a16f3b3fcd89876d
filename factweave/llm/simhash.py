"""Operator 8: SimHash near-dedup by anchor-point covering.

A fingerprint has 64 bits in two halves of 32. If two differ in at most 4 bits, one half differs in at most 2. A half is
covered by the perfect Hamming code of length 31 (every 31-bit word lies within 1 of exactly one code word), kept
beside its last bit: 2 ** 27 anchors a half. A fingerprint goes to the anchor of its half and of every word one bit
away, that is to each code word within covering radius plus one: two halves that differ in at most 2 bits have a word
at most 1 from both, so they meet at its anchor. Distinct fingerprints are compared at their anchors, each anchor
giving a spanning forest of its links, never all pairs; components of the links follow.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factweave.operators.graph import stars

from .common import in_arrow, materialize, read_table, salt_of, salts_in
from .tokens import steps, words

NEAR = 4
SEED = 42
LANES = np.uint64(0x0101010101010101)
#: Shingles that one byte counts.
RUN = 255


def fingerprints_of(texts: pa.Array, size: int = 4) -> np.ndarray:
    """Signed 64-bit fingerprints; a text without words has 0, one with fewer than `size` words is a shingle as a whole."""
    distinct, codes, starts = words(pc.ascii_lower(pc.fill_null(texts, "")))
    out = np.zeros(len(starts) - 1, np.uint64)
    if not len(codes):
        return out.view(np.int64)
    every = distinct.cast(pa.binary()).take(pa.array(codes))
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), b" ")[0].as_py()
    length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes]
    begin = np.cumsum(length + 1) - length - 1
    n_words = np.diff(starts)
    n = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    first_of = np.cumsum(n) - n
    first = starts[:-1][doc] + np.arange(len(doc)) - first_of[doc]
    last = first + np.minimum(size, n_words[doc]) - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begin[first].tolist(), (begin[last] + length[last]).tolist(), strict=True)), np.uint64, len(doc))
    there = np.flatnonzero(n)
    runs = -(-n[there] // RUN)
    run_first = np.repeat(first_of[there], runs) + RUN * (np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs))
    doc_first = np.cumsum(runs) - runs
    bits = np.zeros(len(there), np.uint64)
    for k in range(8):  # each byte of a lane counts one bit over a run
        lane = np.add.reduceat((h >> np.uint64(k)) & LANES, run_first)
        count = np.add.reduceat(lane.view(np.uint8).reshape(-1, 8), doc_first, axis=0, dtype=np.int64)
        over = (2 * count > n[there][:, None]).astype(np.uint64)
        for byte in range(8):
            bits |= over[:, byte] << np.uint64(8 * byte + k)
    out[there] = bits
    return out.view(np.int64)


def fingerprint_table(docs: DataFrame, *, size: int = 4, key: str = "doc_id") -> DataFrame:
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(fingerprints_of(part.column("text"), size))], [key, "fingerprint"])

    return in_arrow(docs.select(key, F.col("text").cast("string").alias("text")), run, schema)


def anchors_of(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor): for both halves, the code words within covering radius plus one, and the home code word with its last bit turned."""
    rows, keys = [], []
    for half in (0, 1):
        x = (f.view(np.uint64) >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF)
        word, last = x & np.uint64(0x7FFFFFFF), x >> np.uint64(31)
        syndrome = np.zeros(len(f), np.uint64)
        for place in range(1, 32):
            syndrome ^= ((word >> np.uint64(place - 1)) & np.uint64(1)) * np.uint64(place)
        turn = lambda place: np.where(place > 0, np.uint64(1) << (np.maximum(place, np.uint64(1)) - np.uint64(1)), np.uint64(0))
        for a in range(32):
            b = syndrome ^ np.uint64(a)
            there = np.flatnonzero((a < b) | ((a == 0) & (b == 0)))
            rows.append(there)
            keys.append(((word ^ turn(np.full(len(f), a, np.uint64)) ^ turn(b)) | (last << np.uint64(31)))[there] | np.uint64(half << 32))
        rows.append(np.arange(len(f)))
        keys.append((word ^ turn(syndrome)) | ((last ^ np.uint64(1)) << np.uint64(31)) | np.uint64(half << 32))
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def forest(f: np.ndarray, near: int = NEAR) -> tuple[np.ndarray, np.ndarray]:
    """Links (member, root) that join all of `f` (distinct, one anchor) that links of at most `near` bits join: each member's row is compared once."""
    left, own, roots = np.arange(len(f)), [], []
    u = f.view(np.uint64)
    while len(left):
        root, left = left[0], left[1:]
        queue = [root]
        while queue and len(left):
            close = np.bitwise_count(u[left] ^ u[queue.pop()]) <= near
            if close.any():
                found = left[close]
                left = left[~close]
                queue.extend(found.tolist())
                own.append(found)
                roots.append(np.full(len(found), root))
    if not own:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return f[np.concatenate(own)], f[np.concatenate(roots)]


def links_in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each run of equal keys; rows come in the order of their keys, runs may go on over batches."""
    held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def links(key: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
        cut = np.flatnonzero(np.diff(key)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = end - first
        pair = first[size == 2]
        near = np.bitwise_count(f[pair].view(np.uint64) ^ f[pair + 1].view(np.uint64)) <= NEAR
        a, b = [f[pair[near]]], [f[pair[near] + 1]]
        for lo, hi in zip(first[size > 2].tolist(), end[size > 2].tolist(), strict=True):
            x, y = forest(f[lo:hi])
            a.append(x)
            b.append(y)
        both = np.unique(np.stack([np.concatenate(a), np.concatenate(b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.concatenate([held[0], batch.column("anchor").to_numpy(zero_copy_only=False)])
        f = np.concatenate([held[1], batch.column("fingerprint").to_numpy(zero_copy_only=False)])
        done = int(np.searchsorted(key, key[-1], side="left"))
        if done:
            yield links(key[:done], f[:done])
        held = key[done:], f[done:]
    if len(held[0]):
        yield links(*held)


def fingerprint_links(fingerprints: DataFrame, *, most: int = 20_000) -> DataFrame:
    """Links (a, b) whose components are those of all links of at most NEAR bits between the distinct `fingerprints`.

    An anchor with more than `most` fingerprints is dealt into tiles, and each pair of tiles compared by itself.
    """

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("fingerprint").to_numpy(zero_copy_only=False)
            for at in range(0, len(f), 20_000):
                row, key = anchors_of(f[at : at + 20_000])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(f[at : at + 20_000][row])], ["anchor", "fingerprint"])

    rows = in_arrow(fingerprints.select("fingerprint"), anchor, "anchor long, fingerprint long")
    crowded = materialize(rows.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > most), "crowded")
    if not crowded.isEmpty():
        tiled = rows.join(crowded, "anchor").withColumn("tiles", F.ceil(F.col("n") / (most / 2)).cast("int"))
        tiled = tiled.withColumn("t", F.pmod(F.xxhash64("fingerprint"), F.col("tiles"))).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tile = F.xxhash64("anchor", F.least("t", "o"), F.greatest("t", "o"))
        rows = rows.join(crowded, "anchor", "left_anti").unionByName(tiled.select(tile.alias("anchor"), "fingerprint"))
    return in_arrow(rows.repartition("anchor").sortWithinPartitions("anchor"), links_in_order, "a long, b long").distinct()


def near_groups(docs: DataFrame, *, size: int = 4, key: str = "doc_id", salts: int = 48) -> DataFrame:
    """One row per row of `docs` (key and text are read): key, fingerprint (16 hex digits), component_id, the smallest key reachable.

    Null and empty texts have fingerprint zero and are linked like any other. Null keys come out with the smallest key of
    their component (null if it has none). Repeated rows get equal answers, and ties of keys are one key. Texts of any length
    are read whole, some MB at a time. Other columns, whatever their names, are left out. An empty table gives no rows.
    """
    rows = materialize(fingerprint_table(docs, size=size, key=key), "fingerprints")
    rows = rows.withColumn("salt", salt_of(F.col(key), salts))
    classes = materialize(rows.groupBy("fingerprint").agg(F.min(key).alias("rep"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("seen")), "classes")
    star = stars(fingerprint_links(classes))
    member = star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
    member = member.join(classes.select(F.col("fingerprint").alias("node"), "rep"), "node")
    least = member.groupBy("root").agg(F.min("rep").alias("component"))
    least = least.withColumn("m_salt", F.explode(F.sequence(F.lit(0), F.lit(7)))).withColumnRenamed("root", "m_root")
    member = member.withColumn("salt", salt_of(F.col("node"), 8)).join(least, (F.col("root") == F.col("m_root")) & (F.col("salt") == F.col("m_salt")))
    named = classes.join(member.select(F.col("node").alias("fingerprint"), "component"), "fingerprint", "left")
    named = named.select(
        F.col("fingerprint").alias("n_fingerprint"), F.coalesce("component", "rep").alias("component_id"),
        F.explode(salts_in("seen", salts)).alias("n_salt"),
    )
    out = rows.join(named, (F.col("fingerprint") == F.col("n_fingerprint")) & (F.col("salt") == F.col("n_salt")))
    return out.select(key, F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(read_table(spark, sf_dir, "documents"))
