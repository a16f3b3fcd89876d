"""Operator 9: quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

Grams are six bytes, exact in a long (kneser_ney.py). Documents are dealt once to blocks of some MB, in a table bucketed
by block, so a block's texts never travel again. A block combines before anything is shuffled: it counts the grams of
its trusted documents, and asks for each distinct gram once. Counts and questions meet in shards by the two bytes before
a gram's last, counts are summed there, and the answers go back to their blocks, which add them up for each document.

There are two folds by doc_id: a document is scored by the models of the other fold's text, so none is scored by a model
that has read it, and all trusted documents set thresholds. Beside the mean, a document is judged by the stretch of
WIDTH bytes that distrusted text explains best against trusted text; a short insult hardly moves the mean of a long document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kneser_ney as kn
from .blocks import by_shard, dealt, packed, slices, unpacked
from .common import free_name, in_arrow, lookup, materialize, read_table, text_of

#: Bytes of the stretch that a document is also judged by: about two words.
WIDTH = 16
#: Scores are kept to so many places, which bounds the values that a quantile is taken over.
PLACES = 3
MOST_SHARDS = 4096


def shard_of(grams: np.ndarray, shards: int) -> np.ndarray:
    pair = ((grams >> 8) & 0xFFFF).astype(np.uint64)
    return (((pair * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(shards)).astype(np.int32)


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    every = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return every[offsets[0] : offsets[-1]], offsets - offsets[0]


def distinct(texts: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(grams, counts) of all texts, sorted."""
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for part in slices(texts):
        k, c = np.unique(kn.grams_of(*bytes_of(part.column("text"))), return_counts=True)
        keys.append(k)
        counts.append(c)
    return summed(keys, counts)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.diff(key, prepend=key[:1] - 1)) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(key) else count


def roles(labels: DataFrame) -> DataFrame:
    """doc_id, role: 0 where all labels of it are quality 1 and toxic 0, 1 where any is quality 0 or toxic 1; others and null ids are left out."""
    good = F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    each = labels.where("doc_id is not null").groupBy("doc_id").agg(F.bool_and(good).alias("good"), F.bool_or(bad).alias("bad"))
    return each.where("good or bad").select("doc_id", F.when(F.col("bad"), 1).otherwise(0).alias("role"))


PACKED = "shard int, model int, grams binary, counts binary, n int"


def trusted_counts(texts: DataFrame, marked: DataFrame, shards: int) -> DataFrame:
    """Grams and counts, for each shard and model (2 * role + fold), summed over all blocks. `texts` is (block, row, text), `marked` (block, row, role)."""

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], [], [], []]
        at = pc.index_in(left.column("row"), right.column("row").combine_chunks())
        role = right.column("role").take(at.combine_chunks() if isinstance(at, pa.ChunkedArray) else at) if right.num_rows else None
        for r in (0, 1) if role is not None else ():
            keys, counts = distinct(left.filter(pc.fill_null(pc.equal(role, r), False)))
            for s, i in by_shard(shard_of(keys, shards), shards):
                for x, v in zip(out, (s, 2 * r + (left.column("block")[0].as_py() & 1), packed(keys[i], kn.ORDER), packed(counts[i].astype(np.uint32), 4), len(i)), strict=True):
                    x.append(v)
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary()), pa.array(out[4], pa.int32())], names=["shard", "model", "grams", "counts", "n"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, keys, counts = None, [], []

        def done() -> pa.RecordBatch:
            k, c = summed(keys, counts)
            return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([packed(k, kn.ORDER)], pa.binary()), pa.array([packed(c.astype(np.int64), 8)], pa.binary()), pa.array([len(k)], pa.int32())], ["shard", "model", "grams", "counts", "n"])

        for batch in batches:
            for s, m, g, c, n in zip(*[batch.column(x).to_pylist() for x in ("shard", "model", "grams", "counts", "n")], strict=True):
                if at and at != (s, m):
                    yield done()
                    keys, counts = [], []
                at = s, m
                keys.append(unpacked(g, n, kn.ORDER, np.int64))
                counts.append(unpacked(c, n, 4, np.uint32).astype(np.int64))
                if sum(map(len, keys[1:])) > max(1_000_000, len(keys[0])):
                    k, c = summed(keys, counts)
                    keys, counts = [k], [c]
        if at:
            yield done()

    found = texts.groupBy("block").cogroup(marked.groupBy("block")).applyInArrow(count, PACKED)
    return materialize(in_arrow(found.repartition("shard", "model").sortWithinPartitions("shard", "model"), merge, PACKED), "quality-counts")


def statistics(counts: DataFrame) -> dict[int, tuple[dict[int, np.ndarray], np.ndarray]]:
    """Of each model: its orders' discounts, and its probabilities of order 2. At most 2 ** 16 and 16 numbers a model reach the driver."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for m, g, c, n in zip(*[batch.column(x).to_pylist() for x in ("model", "grams", "counts", "n")], strict=True):
                every = kn.orders(unpacked(g, n, kn.ORDER, np.int64), unpacked(c, n, 8, np.int64))
                pairs, pair_counts = np.unique(every[3][0] & kn.mask(2), return_counts=True)
                key = np.concatenate([pairs, *[-(10 * k + np.arange(4)) for k in every]])
                value = np.concatenate([pair_counts, *[kn.count_of_counts(x[1]) for x in every.values()]])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), m), pa.int32()), pa.array(key, pa.int64()), pa.array(value, pa.int64())], ["model", "key", "c"])

    rows = in_arrow(counts.select("model", "grams", "counts", "n"), partial, "model int, key long, c long").groupBy("model", "key").agg(F.sum("c").alias("c"))
    got: dict[int, dict[int, int]] = {m: {} for m in range(4)}
    for m, key, c in rows.collect():
        got[m][key] = c
    out = {}
    for m, sums in got.items():
        d = {k: kn.discounts(np.array([sums.get(-(10 * k + i), 0) for i in range(4)])) for k in range(3, kn.ORDER + 1)}
        pairs = np.zeros(1 << 16, np.int64)
        there = [k for k in sums if k >= 0]
        pairs[there] = [sums[k] for k in there]
        out[m] = d, kn.low_orders(pairs)
    return out


def gram_bits(texts: DataFrame, counts: DataFrame, shards: int, copies: int) -> DataFrame:
    """block, grams, bits, n: for each distinct gram of a block, its bits under the other fold's trusted model, and how many more they are than
    under its distrusted one. A shard's counts are held in `copies` tasks, which share the questions of the blocks."""
    low = texts.sparkSession.sparkContext.broadcast(statistics(counts))

    def ask(table: pa.Table) -> pa.Table:
        keys, _ = distinct(table)
        of = list(by_shard(shard_of(keys, shards), shards))
        block = table.column("block")[0].as_py()
        return pa.table([pa.array([s for s, _ in of], pa.int32()), pa.array(np.full(len(of), 1 - (block & 1)), pa.int32()), pa.array([packed(keys[i], kn.ORDER) for _, i in of], pa.binary()), pa.array([len(i) for _, i in of], pa.int32()), pa.array(np.full(len(of), block), pa.int64())], names=["shard", "model", "grams", "n", "block"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, models = None, {}
        for batch in batches:
            out = [], [], [], []
            for s, copy, m, g, c, n, block in zip(*[batch.column(x).to_pylist() for x in ("shard", "copy", "model", "grams", "counts", "n", "block")], strict=True):
                if at != (s, copy):
                    none = np.zeros(0, np.int64)
                    at, models = (s, copy), {k: kn.Shard(none, none, *low.value[k]) for k in range(4)}
                grams = unpacked(g, n, kn.ORDER, np.int64)
                if c is not None:
                    models[m] = kn.Shard(grams, unpacked(c, n, 8, np.int64), *low.value[m])
                    continue
                bits = models[m].bits(grams)
                both = np.concatenate([bits, bits - models[2 + m].bits(grams)])
                for x, v in zip(out, (block, g, packed(both, 2), n), strict=True):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], ["block", "grams", "bits", "n"])

    asked = texts.groupBy("block").applyInArrow(ask, "shard int, model int, grams binary, n int, block long")
    asked = asked.select("shard", F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int").alias("copy"), "model", "grams", F.lit(None).cast("binary").alias("counts"), "n", "block")
    known = counts.select("shard", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"), "model", "grams", "counts", "n", F.lit(None).cast("long").alias("block"))
    meet = known.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", F.col("counts").isNull())
    return in_arrow(meet, answer, "block long, grams binary, bits binary, n int")


def text_scores(texts: DataFrame, bits: DataFrame) -> DataFrame:
    """block, row, n_bytes, units (bits in units of 1 / UNIT), most (the stretch's excess bits, in units) of each text."""

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, own, more = [np.zeros(0, np.int64)], [np.zeros(0, np.int16)], [np.zeros(0, np.int16)]
        for g, b, n in zip(*[right.column(x).to_pylist() for x in ("grams", "bits", "n")], strict=True):
            grams.append(unpacked(g, n, kn.ORDER, np.int64))
            both = unpacked(b, 2 * n, 2, np.int16)
            own.append(both[:n])
            more.append(both[n:])
        key, own, more = (np.concatenate(x) for x in (grams, own, more))
        order = np.argsort(key)
        key, own, more = key[order], own[order], more[order]
        place = kn.Lookup(key) if len(key) else None
        out = [[np.zeros(0, np.int64)] for _ in range(5)]
        for part in slices(left):
            data, offsets = bytes_of(part.column("text"))
            at = place(kn.grams_of(data, offsets)) if len(data) else np.zeros(0, np.int64)
            for x, v in zip(out, (part.column("block"), part.column("row"), np.diff(offsets), between(own[at], offsets), stretches(more[at], offsets)), strict=True):
                x.append(v if isinstance(v, np.ndarray) else v.to_numpy(zero_copy_only=False))
        return pa.table([pa.array(np.concatenate(x), pa.int64()) for x in out], names=["block", "row", "n_bytes", "units", "most"])

    return texts.groupBy("block").cogroup(bits.groupBy("block")).applyInArrow(score, "block long, row long, n_bytes long, units long, most long")


def between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def stretches(values: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """The largest sum of `width` neighbours in each text, of all where there are fewer."""
    out = between(values, offsets)
    long = np.flatnonzero(np.diff(offsets) > width)
    if len(long):
        sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
        window = np.append(sums[width:] - sums[:-width], 0)
        ends = np.stack([offsets[:-1][long], offsets[1:][long] - width + 1], axis=1).ravel()
        out[long] = np.maximum.reduceat(window, ends)[::2]
    return out


def thresholds(held: DataFrame, score: str, quantile: float) -> DataFrame:
    """lang, threshold: the `quantile` of the language's held-out scores where they are enough to have one below their
    maximum; else the maximum and a margin, the larger interquartile range of the language's and of all held-out scores."""
    wide = F.percentile(score, F.lit(0.75)) - F.percentile(score, F.lit(0.25))
    own = held.groupBy("lang").agg(F.percentile(score, F.lit(quantile)).alias("at"), F.max(score).alias("most"), F.count("*").alias("k"), wide.alias("own"))
    own = own.join(F.broadcast(held.agg(wide.alias("every"))))  # one row
    few = F.col("k") * (1 - quantile) < 1
    return own.select("lang", F.when(few, F.col("most") + F.greatest("own", "every")).otherwise(F.col("at")).alias("threshold"))


def judged(docs: DataFrame, labels: DataFrame, *, quantile: float = 0.998, slack: float = 6.0) -> tuple[DataFrame, DataFrame, str, str]:
    """(the rows of `docs` as dealt, a verdict for each, the names of block and row in both)."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text_of())), F.lit(0))).first()[0]
    block, row = free_name(docs, "block"), free_name(docs, "row")
    fold = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)).cast("int")
    table = dealt(docs.withColumn("text", F.col("text").cast("string")), block, row, total, fold)
    texts = table.select(F.col(block).alias("block"), F.col(row).alias("row"), text_of().alias("text"))
    heads = table.select(F.col(block).alias("block"), F.col(row).alias("row"), "doc_id")
    marked = materialize(heads.where("doc_id is not null").join(roles(labels), "doc_id").select("block", "row", "role"), "quality-roles")
    shards = max(128, min(MOST_SHARDS, total >> 31))
    counts = trusted_counts(texts, marked, shards)
    scores = text_scores(texts, gram_bits(texts, counts, shards, copies=max(1, total >> 36)))
    scores = materialize(scores, "quality-scores")
    n, bits = F.col("n_bytes"), F.col("units") / kn.UNIT
    per = F.when(n > 0, bits / n).otherwise(0.0)
    scores = scores.join(marked.where("role = 0"), ["block", "row"], "left").join(table.select(F.col(block).alias("block"), F.col(row).alias("row"), "doc_id", "lang"), ["block", "row"])
    scores = scores.select("block", "row", "doc_id", "lang", "n_bytes", "role", F.pow(F.lit(2.0), per).alias("perplexity"), F.round(F.when(n > 0, per - slack / n).otherwise(0.0), PLACES).alias("score"), F.when(n > 0, F.round(F.col("most") / kn.UNIT, PLACES)).alias("worst"))
    scores = materialize(scores, "quality-scored")
    held = scores.where("role = 0 and n_bytes > 0")
    out = lookup(scores, thresholds(held, "score", quantile), ["lang"], F.col("row"))
    out = lookup(out, thresholds(held, "worst", quantile).withColumnRenamed("threshold", "worst_threshold"), ["lang"], F.col("row"))
    within = F.coalesce(F.col("score") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("worst") <= F.col("worst_threshold"), F.lit(True))
    return table, out.withColumn("kept", (n == 0) | within).drop("role"), block, row


def quality_report(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per row of `docs` (doc_id, text, lang are read): doc_id, lang, n_bytes, perplexity (a byte), score, threshold, worst, worst_threshold, kept.

    Trusted are documents with a label of quality 1 and toxic 0 and no other label, distrusted those with one of quality 0
    or toxic 1; all of both are counted. `score` is bits per byte less `slack` / n, to PLACES places, so the first words
    of a short text don't decide. `worst` is by how many bits the stretch of WIDTH bytes that is worst in this is likelier
    in distrusted than in trusted text. A document is kept up to the thresholds that thresholds() draws from the scores of
    its language's trusted documents (null is a language); all are kept where there are none. Null and empty texts have
    perplexity 1 and are kept. Repeated rows are judged alike. Null ids are never trusted. Very long texts are scored
    whole, each in a block of its own. Other columns don't matter, whatever their names. An empty table gives no rows.
    """
    _, verdicts, _, _ = judged(docs.select("doc_id", "lang", "text"), labels, **options)
    return verdicts.drop("block", "row")


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of `docs` that quality_report() keeps, with all their columns; verdicts go to the blocks, texts don't travel."""
    table, verdicts, block, row = judged(docs, labels, **options)
    gone = verdicts.where("not kept").select(F.col("block").alias("g_block"), F.col("row").alias("g_row"))

    def keep(left: pa.Table, right: pa.Table) -> pa.Table:
        stays = left.filter(pc.invert(pc.is_in(left.column(row), right.column("g_row").combine_chunks()))) if right.num_rows else left
        return stays.select([c for c in stays.column_names if c not in (block, row)])

    return table.groupBy(block).cogroup(gone.groupBy("g_block")).applyInArrow(keep, table.drop(block, row).schema)


def op9_quality_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", "lang", "n_bytes", F.round("perplexity", 6).alias("perplexity"), "score", F.round("threshold", 6).alias("threshold"), "worst", F.round("worst_threshold", 6).alias("worst_threshold"), "kept")
