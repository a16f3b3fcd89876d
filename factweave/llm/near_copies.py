"""Near copies: rows whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash of operator 8 over five-word shingles: rows in one component of fingerprints that links
of at most 4 of 64 bits join, by anchors. As sets at 0.8 often differ in more bits, rows that agree in one of 32 bands
of four min-hashes are candidates as well: two sets at 0.8 miss each other in all of them with a chance of
(1 - 0.8 ** 4) ** 32, under 5e-8, and less the more alike they are. Similarities are then computed on the shingles of
the whole texts. Shingles that one candidate alone has are counted first, as no other row shares them:
a row with over a fifth of such is like none and drops out, and in each group (a component of fingerprints or a band's key) all rows are compared with the one
that has the smallest share of them, the nearest to what the group has in common. So copies with edits of their own are
linked to the copy with the fewest. Once components of these links are known, the pairs of a group that is still in two
components are compared as well, but for those that cannot be alike: own shingles and signatures of 1024 bits bound what
two sets share from above, and pairs below that bound never leave the join. So no pair is left out that could join
components, and a large group of copies costs about one comparison of texts a row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factweave.operators.graph import stars

from .common import free_name, in_arrow, lookup, lower_ascii, materialize, salt_of, text_of
from .simhash import fingerprint_links, fingerprints_of
from .tokens import steps, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SIZE = 5
BANDS, ROWS = 32, 4
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Longs of a signature.
SIGNED = 16
SIGNATURE = [f"s{j}" for j in range(SIGNED)]
#: A text is sent in as many copies as keep the pairs of each to about this number.
PAIRS = 200


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def band_keys(texts: pa.Array, size: int = SIZE) -> np.ndarray:
    """(texts, BANDS): equal shingle sets have equal keys; a text without words is the empty set, one with fewer than `size` words is a shingle as a whole."""
    distinct, codes, starts = words(pc.ascii_lower(pc.fill_null(texts, "")))
    rng = np.random.default_rng(42)
    times, plus = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    times = times * np.uint64(2) + np.uint64(1)
    n_words = np.diff(starts)
    n = np.where(n_words > 0, np.maximum(1, n_words - size + 1), 0)
    keys = np.zeros((len(n), BANDS), np.uint64)
    there = np.flatnonzero(n)
    if len(there):
        word = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))[codes]
        doc = np.repeat(np.arange(len(n)), n)
        first_of = np.cumsum(n) - n
        first = starts[:-1][doc] + np.arange(len(doc)) - first_of[doc]
        end = starts[1:][doc]
        h = np.zeros(len(doc), np.uint64)
        for j in range(size):
            h = mixed(h * ODD + np.where(first + j < end, word[np.minimum(first + j, len(word) - 1)], np.uint64(j)))
        for k in range(BANDS * ROWS):
            least = np.minimum.reduceat(h * times[k] + plus[k], first_of[there])
            keys[there, k // ROWS] = mixed(keys[there, k // ROWS] * ODD + least)
    return mixed(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * ODD).view(np.int64)


def shingles_of(text: str, size: int = SIZE) -> frozenset[tuple[str, ...]]:
    w = WORD.findall(text)
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def alike(x: frozenset, y: frozenset) -> bool:
    """Whether |x & y| / |x | y| is at least 0.8, in whole numbers; two empty sets are alike."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = len(x & y)
    return 5 * both >= 4 * (len(x) + len(y) - both)


def with_text(pairs: DataFrame, rows: DataFrame, side: str, other: str) -> DataFrame:
    """`pairs` with the text of `side`, sent in copies where it has many pairs."""
    often = pairs.groupBy(F.col(side)).agg(F.ceil(F.count("*") / F.lit(PAIRS)).cast("int").alias("copies"))
    often = materialize(often, "near-often")
    texts = rows.join(often.withColumnRenamed(side, "__row"), "__row")
    texts = texts.select(F.col("__row").alias("t_row"), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("t_copy"))
    dealt = lookup(pairs, often.where("copies > 1"), [side], F.col(other))
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1)))).drop("copies")
    return dealt.join(texts, (F.col(side) == F.col("t_row")) & (F.col("copy") == F.col("t_copy"))).drop("t_row", "t_copy", "copy")


def confirmed(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of row numbers whose whole texts are alike."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, frozenset] = {}

        def known(row: int, text: str) -> frozenset:
            if row not in held:
                if len(held) >= 64:
                    held.clear()
                held[row] = shingles_of(text)
            return held[row]

        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            x, y = batch.column("text_a"), batch.column("text_b")
            good = [alike(known(a[i], x[i].as_py()), known(b[i], y[i].as_py())) for i in range(len(a))]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = with_text(with_text(pairs, rows, "a", "b"), rows, "b", "a")
    return in_arrow(both.select("a", "b", "text_a", "text_b"), compare, "a long, b long")


def signed(texts: DataFrame) -> DataFrame:
    """a, size, s0 .. s15: how many shingles a row has, and a bit for each of their hashes modulo 1024."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                sizes, bits = [], np.zeros((part.num_rows, 64 * SIGNED), np.uint8)
                for i, hashes in enumerate(hashes_of(part)):
                    sizes.append(len(hashes))
                    bits[i, (hashes % np.uint64(64 * SIGNED)).astype(np.int64)] = 1
                longs = np.packbits(bits, axis=1).view(np.int64)
                columns = [part.column("a"), pa.array(sizes, pa.int64()), *(pa.array(longs[:, j]) for j in range(SIGNED))]
                yield pa.RecordBatch.from_arrays(columns, ["a", "size", *SIGNATURE])

    return in_arrow(texts, hashed, ", ".join(f"{c} long" for c in ["a", "size", *SIGNATURE]))


def hashes_of(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for text in batch.column("text").to_pylist():
        shingles = shingles_of(text)
        yield np.fromiter((xxhash.xxh64_intdigest(" ".join(s)) for s in shingles), np.uint64, len(shingles))


def own_counts(texts: DataFrame) -> DataFrame:
    """(a, own): how many shingles of a row are in no other, for rows that have some. Shingles of equal hash count as shared, so `own` is never too large."""

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                found = [np.empty(0, np.uint64), *hashes_of(part)]
                rows = np.repeat(part.column("a").to_numpy(), [len(h) for h in found[1:]])
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(np.concatenate(found).view(np.int64))], ["a", "hash"])

    of = in_arrow(texts, spelled, "a long, hash long").groupBy("hash").agg(F.count("*").alias("n"), F.min("a").alias("a"))
    return of.where("n = 1").groupBy("a").agg(F.count("*").alias("own"))


def may_be_alike() -> Column:
    """Whether own shingles and signatures (own, s0 .. and f_own, f_s0 ..) leave room for 5 * |x & y| >= 4 * |x | y|, which is 9 * |x & y| >= 4 * (|x| + |y|).
    A bit that only one of two rows has stands for a shingle that the other lacks, so |x & y| is at most |x| less such bits."""
    enough = 4 * (F.col("size") + F.col("f_size"))
    missing = sum((F.bit_count(F.col(c).bitwiseAND(F.bitwise_not(f"f_{c}"))) for c in SIGNATURE), F.lit(0))
    lacking = sum((F.bit_count(F.col(f"f_{c}").bitwiseAND(F.bitwise_not(c))) for c in SIGNATURE), F.lit(0))
    return leave_room() & (9 * (F.col("size") - missing) >= enough) & (9 * (F.col("f_size") - lacking) >= enough)


def leave_room() -> Column:
    """Whether the shingles that two rows (size, own and f_size, f_own) may share are enough."""
    return 9 * F.least(F.col("size") - F.col("own"), F.col("f_size") - F.col("f_own")) >= 4 * (F.col("size") + F.col("f_size"))


def simhash_groups(prints: DataFrame) -> DataFrame:
    """(a, key): rows (a, fingerprint) whose fingerprints links of at most 4 bits join have one key, that no band has but by chance."""
    distinct = materialize(prints.select("fingerprint").distinct(), "near-prints")
    roots = stars(fingerprint_links(distinct)).select(F.col("node").alias("fingerprint"), "root")
    named = lookup(prints, roots, ["fingerprint"], F.col("a"), salts=8)
    return named.select("a", F.xxhash64(F.lit("simhash"), F.coalesce("root", "fingerprint")).alias("key"))


def near_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) between row numbers; their components are those of all candidate pairs that are alike. `rows` is (__row, text), lower-cased, not null."""

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                keys = band_keys(part.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), pa.array(keys.ravel()))
                prints = pa.array(fingerprints_of(part.column("text"), SIZE))
                yield pa.RecordBatch.from_arrays([part.column("__row"), prints, lists], ["a", "fingerprint", "keys"])

    banded = materialize(in_arrow(rows, band, "a long, fingerprint long, keys array<long>"), "near-bands")
    simhashed = materialize(simhash_groups(banded.select("a", "fingerprint")), "near-simhash")
    members = banded.select("a", F.explode("keys").alias("key")).unionByName(simhashed)
    groups = materialize(members.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "near-groups")
    met = materialize(lookup(members, groups, ["key"], F.col("a"), how="inner", salts=8), "near-met")
    texts = rows.withColumnRenamed("__row", "a").join(met.select("a").distinct(), "a", "left_semi").select("a", "text")
    known = signed(texts).join(own_counts(texts), "a", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    # |x & y| is at most |x| less its own shingles, and at least 0.8 |x| for any y that is alike.
    known = materialize(known.where(5 * (F.col("size") - F.col("own")) >= 4 * F.col("size")), "near-known")
    grouped = materialize(met.join(known.select("a", "size", "own"), "a"), "near-members")
    best = F.struct((F.col("own") / F.greatest("size", F.lit(1))).alias("share"), F.col("a").alias("b"), F.col("size").alias("f_size"), F.col("own").alias("f_own"))
    first = materialize(grouped.groupBy("key").agg(F.min(best).alias("at")).select("key", "at.b", "at.f_size", "at.f_own"), "near-firsts")
    near = lookup(grouped, first, ["key"], F.col("a"), how="inner", salts=8).where((F.col("a") != F.col("b")) & leave_room())
    pairs = materialize(near.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-pairs")
    links = materialize(confirmed(pairs, rows), "near-links")
    part = stars(links).select(F.col("node").alias("a"), F.col("root").alias("part"))
    named = materialize(grouped.select("key", "a").join(part, "a", "left").withColumn("part", F.coalesce("part", "a")), "near-parts")
    parts = named.groupBy("key", "part").agg(F.count("*").alias("n"))
    split = parts.groupBy("key").agg(F.max(F.struct("n", "part")).alias("most"), F.count("*").alias("parts")).where("parts > 1")
    split = materialize(split.select("key", F.col("most.part").alias("largest")), "near-split")
    left = materialize(lookup(named, split, ["key"], F.col("a"), how="inner", salts=8), "near-left")
    left = materialize(left.join(known, "a"), "near-open")
    few = left.where("part <> largest").select(F.col("key").alias("f_key"), F.col("a").alias("b"), F.col("part").alias("f_part"), *[F.col(c).alias(f"f_{c}") for c in ["size", "own", *SIGNATURE]])
    few = few.withColumn("f_salt", F.explode(F.sequence(F.lit(0), F.lit(7))))
    on = (F.col("key") == F.col("f_key")) & (F.col("salt") == F.col("f_salt")) & (F.col("part") != F.col("f_part")) & may_be_alike()
    more = left.withColumn("salt", salt_of(F.col("a"), 8)).join(few, on)
    more = more.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    return materialize(links.unionByName(confirmed(materialize(more, "near-pairs"), rows)), "near-links")


def near_dedup(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, with all its columns: that of the smallest doc_id, null after all others, ties by row.

    Null and empty texts are alike. An empty table gives no rows.
    """
    row = free_name(docs, "row")
    rows = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "near-rows")
    star = materialize(stars(near_links(rows.select(F.col(row).alias("__row"), lower_ascii(text_of()).alias("text")))), "near-stars")
    member = star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
    member = rows.select(F.col(row).alias("node"), "doc_id").join(member, "node")
    member = materialize(member.select("root", F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("node").alias("row")).alias("at")), "near-components")
    stays = member.groupBy("root").agg(F.min("at").alias("at")).select(F.col("at.row").alias(row))
    gone = member.select(F.col("at.row").alias(row)).join(stays, row, "left_anti")
    return rows.join(gone, row, "left_anti").select(*docs.columns)
