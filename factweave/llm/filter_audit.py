"""How filters interact: what each removes at each place of each order, which failures others had removed already, and its Shapley share.

Texts are routed by their xxhash. Tasks first combine what they read: of equal texts the smallest id stays, the others are
known to repeat and travel on without their text. What stays is dealt by fingerprint and sorted by it; a fingerprint's
texts form a chain of (whole text, smallest id), so texts that only share a hash stay apart, and each id that meets a
smaller one is emitted as a repeat. A task holds one chain at a time. Failures are then masks of five bits, counted by
part, label and mask; combineByKey merges the counts into one vector a part, from which every order follows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.session import ship_package

from .common import lookup, read_table

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, SYMBOLS = 100, 80, 10, "#$%&*|"
#: Compressed bytes of texts that a task combines before it sends them on.
HELD = 32_000_000
LETTERS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEATS = 1 << FILTERS.index("E")
MASKS = 1 << len(FILTERS)


def own_mask(text: str, data: bytes) -> int:
    """The filters A to D that a text (with its UTF-8) fails, as bits."""
    words = data.split()  # at U+0020 and U+0009..U+000D
    failed = [
        len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words),
        100 * (len(data) - len(data.translate(None, LETTERS))) > UPPER_PERCENT * len(text), len(data.translate(None, SYMBOLS.encode())) < len(data),
    ]
    return sum(1 << i for i, f in enumerate(failed) if f)


class Chains:
    """Chains of the texts of a few fingerprints: [text, its length, smallest id, mask, rows of that id by part]."""

    def __init__(self) -> None:
        self.held: dict[int, list[list]] = {}
        self.size = 0

    def add(self, print_: int, text: bytes, length: int, doc_id: int, mask: int, parts: dict[str, int]) -> tuple | None:
        """What is now known to repeat, as (id, mask, rows by part)."""
        chain = self.held.setdefault(print_, [])
        for link in chain:
            if link[1] == length and same(link[0], text, length):
                if doc_id == link[2]:
                    for part, n in parts.items():
                        link[4][part] = link[4].get(part, 0) + n
                    return None
                gone = (max(doc_id, link[2]), mask, parts if doc_id > link[2] else link[4])
                if doc_id < link[2]:
                    link[2], link[4] = doc_id, parts
                return gone
        chain.append([text, length, doc_id, mask, parts])
        self.size += len(text) + 200
        return None

    def emptied(self) -> Iterator[tuple[int, list]]:
        for print_, chain in self.held.items():
            for link in chain:
                yield print_, link
        self.held, self.size = {}, 0


def same(a: bytes, b: bytes, length: int) -> bool:
    """Whether two compressed texts of `length` bytes are equal, by their contents if their compressed forms differ."""
    if a == b:
        return True
    return pa.decompress(a, decompressed_size=length, codec="zstd", asbytes=True) == pa.decompress(b, decompressed_size=length, codec="zstd", asbytes=True)


def combined(rows: Iterable[tuple]) -> Iterator[tuple[int, tuple]]:
    """(fingerprint, (text, length, id, mask, rows by part)) of a task's (doc_id, part, text); repeats have a key of their id and no text."""
    chains = Chains()
    for doc_id, part, text in rows:
        data = text.encode("utf-8", "surrogatepass")
        mask = own_mask(text, data)
        if doc_id is None:
            yield xxhash.xxh64_intdigest(data), (None, 0, None, mask, {part: 1})
            continue
        gone = chains.add(xxhash.xxh64_intdigest(data), pa.compress(data, codec="zstd", asbytes=True), len(data), doc_id, mask, {part: 1})
        if gone:
            yield spread_of(gone[0]), (None, 0, gone[0], gone[1] | REPEATS, gone[2])
        if chains.size > HELD:
            yield from routed(chains)
    yield from routed(chains)


def spread_of(doc_id: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id))


def routed(chains: Chains) -> Iterator[tuple[int, tuple]]:
    for print_, link in chains.emptied():
        yield print_, tuple(link)


def merged(rows: Iterable[tuple[int, tuple]]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of a partition sorted by fingerprint."""
    chains, last = Chains(), None
    for print_, (text, length, doc_id, mask, parts) in rows:
        if text is None:
            for part, n in parts.items():
                yield doc_id, part, mask, n
            continue
        if print_ != last:
            yield from passed(chains)
            last = print_
        gone = chains.add(print_, text, length, doc_id, mask, parts)
        for part, n in (gone[2] if gone else {}).items():
            yield gone[0], part, gone[1] | REPEATS, n
    yield from passed(chains)


def passed(chains: Chains) -> Iterator[tuple]:
    for _, (_, _, doc_id, mask, parts) in chains.emptied():
        for part, n in parts.items():
            yield doc_id, part, mask, n


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, part (lang, null: empty), mask (bit i: filter i of FILTERS fails), n rows of which that holds.

    Null text is empty. A row repeats if a smaller doc_id has its text; so null ids never do, nor rows of one id and text.
    Texts of any length are held whole, compressed. Other columns, whatever their names, aren't read. No rows give none.
    """
    ship_package(docs.sparkSession)
    rows: RDD = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))).rdd
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * rows.getNumPartitions())
    dealt = rows.mapPartitions(combined).repartitionAndSortWithinPartitions(parts, partitionFunc=lambda key: key)
    return docs.sparkSession.createDataFrame(dealt.mapPartitions(merged), "doc_id long, part string, mask int, n long", verifySchema=False)


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id of every row whose text a smaller doc_id has."""
    return verdicts(docs).where(F.col("mask").bitwiseAND(REPEATS) > 0).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).select("doc_id")


def audited(counts: list[list[int]]) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from [all, good, toxic] of each mask."""
    orders = 1
    for i in range(2, len(FILTERS) + 1):
        orders *= i
    # Among k failing filters each comes first in one of k orders.
    shapley = [sum(c[0] * orders // mask.bit_count() for mask, c in enumerate(counts) if mask >> i & 1) for i in range(len(FILTERS))]
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, i in enumerate(order, 1):
            here = [c for mask, c in enumerate(counts) if mask >> i & 1 and not mask & before]
            late = sum(c[0] for mask, c in enumerate(counts) if mask >> i & 1 and mask & before)
            before |= 1 << i
            kept = sum(c[0] for mask, c in enumerate(counts) if not mask & before)
            name = "".join(FILTERS[j] for j in order)
            yield (name, step, kept, sum(c[0] for c in here), late, counts[1 << i][0], sum(c[1] for c in here), sum(c[2] for c in here), shapley[i])


def vector_with(vector: list[list[int]], found: tuple[int, int, bool, bool]) -> list[list[int]]:
    mask, n, good, toxic = found
    for j, counts in enumerate((True, good, toxic)):
        vector[mask][j] += n if counts else 0
    return vector


def vectors_summed(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
    return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: all orders and steps of each part.

    `labels` are (doc_id, quality, toxic); null and absent labels are neither good nor toxic, of repeated ones any that
    is so counts, and null ids have none. The rest is as in `verdicts`.
    """
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    counts = lookup(verdicts(docs), known, ["doc_id"], F.col("mask")).select("part", "mask", "n", *flags).groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))
    pairs = counts.rdd.map(lambda r: (r.part, (r["mask"], r.n, r.good, r.toxic)))
    vectors = pairs.combineByKey(lambda found: vector_with([[0, 0, 0] for _ in range(MASKS)], found), vector_with, vectors_summed)
    rows = vectors.flatMap(lambda kv: [(kv[0], *row) for row in audited(kv[1])])
    columns = ", ".join(f"{c} long" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"))
    return docs.sparkSession.createDataFrame(rows, f"part string, filter_order string, step int, {columns}", verifySchema=False)


def op13_filter_interaction(spark, sf_dir):
    """The five filters over all of `documents`, by language."""
    return filter_audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


SQL = """WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words, min(doc_id) OVER (PARTITION BY t) AS first_id FROM t),
lb AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * list_unique(words) < 80 * len(words) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 10 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN lb USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM l a, l b, l c, l d, l e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT filter_order, step, 1 << (instr('ABCDE', filter_order[step]) - 1) AS bit, coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (instr('ABCDE', filter_order[i]) - 1))), 0)::BIGINT AS before
  FROM o, (SELECT unnest(range(1, 6)) AS step))
SELECT part, filter_order, step::INT AS step, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
  coalesce(sum(good) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) FILTER (mask & bit <> 0), 0)::BIGINT AS shapley
FROM c, s GROUP BY part, filter_order, step, bit, before"""
