"""Operator 6: substring dedup by super-k-mer partitioning.

A window is 35 consecutive words; its minimiser is the smallest hash of its 4-word grams. Consecutive windows that
share a minimiser travel as one packed string to its bucket, so a word is sent about three times instead of 35.
Equal windows have equal minimisers and meet there; a bucket sorts its windows and counts them exactly.

Before any string is sent, blocks of documents ask for their distinct minimisers: shards count the strings of each over
all blocks, and answer which have more than one. A window whose minimiser has a single string in all documents cannot
be repeated, but within that string, where it is looked for at home; so unique text stays where it is.

A minimiser with too many strings is hot. Its windows are counted one by one instead, by a combining aggregation over
their words, and the counts go back to them in salted copies, so that neither a frequent gram nor a passage that a
third of all documents share fills a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import by_shard, dealt, packed, slices, unpacked
from .common import in_arrow, lookup, materialize, read_table, text_of
from .tokens import words

WINDOW = 35
GRAM = 4
#: Windows of one string at most, so that a text of one repeated word is cut.
LONGEST = 256
#: A bucket of more strings is hot.
HOT = 20_000
MOST_SHARDS = 1 << 16
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


def rolling(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of `size` neighbours of `h`."""
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x100000001B3) + h[k : k + len(out)]
    return mixed(out)


def sliding_min(h: np.ndarray, size: int) -> np.ndarray:
    done = 1
    while done * 2 <= size:
        h = np.minimum(h[:-done], h[done:])
        done *= 2
    return np.minimum(h[: len(h) - (size - done)], h[size - done :]) if size > done else h


def hashes(distinct: pa.Array) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, 7) for w in distinct.cast(pa.large_binary()).to_pylist()), np.uint64, len(distinct))


class Packing:
    """The words of a batch of texts, joined, and their super-k-mers."""

    def __init__(self, texts: pa.Array, window: int):
        distinct, codes, self.starts = words(texts)
        every = distinct.cast(pa.binary()).take(pa.array(codes))
        self.joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), b" ")[0].as_py() if len(codes) else b""
        length = pc.binary_length(distinct).to_numpy(zero_copy_only=False).astype(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
        self.end = np.cumsum(length + 1) - 1
        self.begin = self.end - length
        self.hash, self.window = (hashes(distinct)[codes] if len(codes) else np.zeros(0, np.uint64)), window
        self.gram = np.zeros(len(codes), np.uint64)

    def strings(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first word in it, windows, minimiser) of each."""
        out = [], [], [], []
        for doc in range(len(self.starts) - 1):
            a, b = self.starts[doc], self.starts[doc + 1]
            if b - a < self.window:
                continue
            gram = rolling(self.hash[a:b], GRAM)
            self.gram[a : a + len(gram)] = gram
            low = sliding_min(gram, self.window - GRAM + 1)
            first = np.concatenate([[0], np.flatnonzero(np.diff(low)) + 1])
            n = np.diff(np.append(first, len(low)))
            if n.max() > LONGEST:
                cuts = -(-n // LONGEST)
                no = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                first, n = np.repeat(first, cuts) + no * LONGEST, np.minimum(LONGEST, np.repeat(n, cuts) - no * LONGEST)
            for x, y in zip(out, (np.full(len(first), doc), first, n, low[first]), strict=True):
                x.append(y)
        if not out[0]:
            return (*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64))
        return tuple(np.concatenate(x) for x in out)

    def repeats(self, doc: np.ndarray, first: np.ndarray, n: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Whether a string may hold a window twice: then its minimiser stands at two places in it."""
        if not len(doc):
            return np.zeros(0, bool)
        size = n + self.window - GRAM
        begin = np.cumsum(size) - size
        at = np.repeat(self.starts[doc] + first - begin, size) + np.arange(size.sum())
        return np.add.reduceat((self.gram[at] == np.repeat(low, size)).astype(np.int64), begin) > 1

    def packed(self, doc: np.ndarray, first: np.ndarray, n: np.ndarray) -> pa.Array:
        at = self.starts[doc] + first
        lo, hi = self.begin[at], self.end[at + n + self.window - 2]
        return pa.array([self.joined[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())


def strings_of(texts: pa.Table, window: int) -> Iterator[tuple[pa.RecordBatch, Packing, tuple[np.ndarray, ...]]]:
    """Slices of a block's texts with their strings (text, first word, windows, minimiser)."""
    for part in slices(texts, 3_000_000):
        made = Packing(part.column("text"), window)
        doc, first, n, low = made.strings()
        yield part, made, (doc, first, n, low.astype(np.uint64))


def shared_minimisers(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """block, low, hot, n: a block's minimisers with more than one string in all blocks, packed, and whether they are hot."""
    most = HOT

    def ask(table: pa.Table) -> pa.Table:
        low = np.sort(np.concatenate([np.zeros(0, np.uint64), *[x[3] for _, _, x in strings_of(table, window)]]))
        low, n = np.unique(low, return_counts=True)
        got = list(by_shard((mixed(low) % np.uint64(shards)).astype(np.int32), shards))
        return pa.table([
            pa.array([s for s, _ in got], pa.int32()), pa.array(np.full(len(got), table.column("block")[0].as_py(), np.int64)), pa.array([packed(low[i], 8) for _, i in got], pa.binary()),
            pa.array([packed(n[i].astype(np.int64), 8) for _, i in got], pa.binary()), pa.array([len(i) for _, i in got], pa.int32()),
        ], names=["shard", "block", "low", "times", "n"])

    def answer(table: pa.Table) -> pa.Table:
        n = table.column("n").to_numpy()
        low = np.concatenate([unpacked(x, k, 8, np.uint64) for x, k in zip(table.column("low").to_pylist(), n.tolist(), strict=True)])
        times = np.concatenate([unpacked(x, k, 8, np.int64) for x, k in zip(table.column("times").to_pylist(), n.tolist(), strict=True)])
        _, code = np.unique(low, return_inverse=True)
        total = np.bincount(code, weights=times)[code]
        ends, out = np.cumsum(n), [[], [], [], []]
        for block, a, b in zip(table.column("block").to_pylist(), (ends - n).tolist(), ends.tolist(), strict=True):
            there = np.flatnonzero(total[a:b] > 1) + a
            for x, v in zip(out, (block, packed(low[there], 8), packed((total[there] > most).astype(np.uint8), 1), len(there)), strict=True):
                x.append(v)
        return pa.table([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.binary(), pa.binary(), pa.int32()), strict=True)], names=["block", "low", "hot", "n"]).filter(pc.greater(pa.array(out[3]), 0))

    asked = texts.groupBy("block").applyInArrow(ask, "shard int, block long, low binary, times binary, n int")
    return materialize(asked.groupBy("shard").applyInArrow(answer, "block long, low binary, hot binary, n int"), "minimisers")


def super_kmers(texts: DataFrame, shared: DataFrame, window: int) -> DataFrame:
    """The strings of shared minimisers, and those that repeat a gram within; those of hot minimisers as one string a window."""

    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = list(zip(*[right.column(c).to_pylist() for c in ("low", "hot", "n")], strict=True))
        known = np.concatenate([np.zeros(0, np.uint64), *[unpacked(x, k, 8, np.uint64) for x, _, k in parts]])
        hot = np.concatenate([np.zeros(0, np.uint8), *[unpacked(x, k, 1, np.uint8) for _, x, k in parts]]).astype(bool)
        order = np.argsort(known)
        known, hot = known[order], hot[order]
        out = []
        for part, made, (doc, first, n, low) in strings_of(left, window):
            at = np.minimum(np.searchsorted(known, low), max(len(known) - 1, 0))
            there = known[at] == low if len(known) else np.zeros(len(low), bool)
            single = np.where(there, hot[at], False) if len(known) else there
            goes = there.copy()
            goes[~there] = made.repeats(doc[~there], first[~there], n[~there], low[~there])
            doc, first, n, low, single = (x[goes] for x in (doc, first, n, low, single))
            times = np.where(single, n, 1)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            doc, first, low = (np.repeat(x, times) for x in (doc, first, low))
            single = np.repeat(single, times)
            first, n = first + step, np.where(single, 1, np.repeat(n, times))
            ids = pa.array(doc)
            out.append(pa.table(
                [part.column("block").take(ids), part.column("row").take(ids), pa.array(first, pa.int32()), pa.array(n, pa.int32()), pa.array(low.view(np.int64)), pa.array(single), made.packed(doc, first, n)],
                names=["block", "row", "start", "n", "minimiser", "hot", "packed"],
            ))
        return pa.concat_tables(out)

    return texts.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(cut, "block long, row long, start int, n int, minimiser long, hot boolean, packed binary")


def repeated_in(packed: pa.Array, n: np.ndarray, window: int) -> np.ndarray:
    """For the windows of whole buckets' strings in turn: whether its words stand there more than once. Hashes are sorted to find windows that
    may be equal; those are compared word for word."""
    distinct, codes, begin = words(packed.cast(pa.string()))
    h = rolling(hashes(distinct)[codes], window)
    begin = begin[:-1]
    at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    own = h[at]
    order = np.argsort(own, kind="stable")
    same = own[order[1:]] == own[order[:-1]]
    out = np.zeros(len(own), bool)
    if not same.any():
        return out
    run = np.concatenate([[0], np.cumsum(~same)])
    often = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    seen: dict[bytes, int] = {}
    last = -1
    for i, r in zip(order[often].tolist(), run[often].tolist(), strict=True):
        if r != last:
            seen, last = {}, r
        words_here = codes[at[i] : at[i] + window].tobytes()
        if words_here in seen:
            out[i] = out[seen[words_here]] = True
        else:
            seen[words_here] = i
    return out


def ranges_in_order(window: int):
    """Strings in the order of their minimisers to ranges of repeated words; a bucket may go on over batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def ranges(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            n, first = rows["n"].to_numpy().astype(np.int64), rows["start"].to_numpy()
            i = np.flatnonzero(repeated_in(rows["packed"].combine_chunks(), n, window))
            if len(i):
                of = np.repeat(np.arange(len(n)), n)
                step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                new = np.concatenate([[True], (np.diff(i) > 1) | (np.diff(of[i]) > 0)])
                end = np.append(np.flatnonzero(new)[1:] - 1, len(i) - 1)
                row, lo, hi = of[i[new]], first[of[i[new]]] + step[i[new]], first[of[i[end]]] + step[i[end]] + window
                ids = pa.array(row)
                got = [rows["block"].take(ids), rows["row"].take(ids), pa.array(lo, pa.int32()), pa.array(hi, pa.int32())]
                yield from pa.table(got, names=["block", "row", "lo", "hi"]).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("minimiser")
            last = key[-1].as_py()
            done = int(np.searchsorted(key.to_numpy(), last, side="left"))
            if held and (done or held[-1].column("minimiser")[-1].as_py() != last):
                yield from ranges(pa.Table.from_batches([*held, batch.slice(0, done)]))
                held = []
            elif done:
                yield from ranges(pa.Table.from_batches([batch.slice(0, done)]))
            held.append(batch.slice(done))
        if held:
            yield from ranges(pa.Table.from_batches(held))

    return run


def repeated_ranges(texts: DataFrame, window: int, shards: int) -> DataFrame:
    """block, row, lo, hi: words that windows cover whose words start elsewhere too. `texts` is (block, row, text), dealt by block."""
    shared = shared_minimisers(texts, window, shards)
    strings = super_kmers(texts, shared, window)
    any_hot = in_arrow(shared.select("hot", "n"), hot_ones, "hot boolean").where("hot").limit(1).count() > 0
    if any_hot:  # their windows are used twice more
        strings = materialize(strings, "strings")
    cool = strings.where("not hot").drop("hot").repartition("minimiser").sortWithinPartitions("minimiser")
    found = in_arrow(cool, ranges_in_order(window), "block long, row long, lo int, hi int")
    if not any_hot:
        return found
    single = strings.where("hot").select("block", "row", F.col("start").alias("lo"), "packed")
    often = materialize(single.groupBy("packed").agg(F.count("*").alias("times")).where("times > 1").select("packed", F.lit(True).alias("often")), "hot-windows")
    back = lookup(single, often, ["packed"], F.struct("row", "lo"), how="inner")
    return found.unionByName(back.select("block", "row", "lo", (F.col("lo") + window).cast("int").alias("hi")))


def hot_ones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([bool(unpacked(x, n, 1, np.uint8).any()) for x, n in zip(batch.column("hot").to_pylist(), batch.column("n").to_pylist(), strict=True)], pa.bool_())], ["hot"])


def remove_repeats(docs: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs` (doc_id and text are read): doc_id, n_words, n_removed, kept_text (its words joined by spaces).

    Null and empty texts have no words. Rows repeated under one doc_id repeat all of their windows, so a row of 35 words or
    more loses all of them in every copy, like copies under other ids; null ids are one id. Texts shorter than the window
    are untouched. Very long texts are cut up whole, each in a block of its own. Other columns don't matter, whatever
    their names. An empty table gives no rows.
    """
    if window < GRAM:
        raise ValueError(f"window: at least {GRAM}")
    text = text_of()
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    table = dealt(docs.select("doc_id", text.alias("text")), "block", "row", total)
    spans = repeated_ranges(table.select("block", "row", "text"), window, max(128, min(MOST_SHARDS, total >> 25)))
    kind = docs.schema["doc_id"].dataType

    def clean(left: pa.Table, right: pa.Table) -> pa.Table:
        order = pc.sort_indices(right, [("row", "ascending")])
        span_row, lo, hi = (right.column(c).take(order).to_numpy() for c in ("row", "lo", "hi"))
        total, removed, kept, ids = [], [], [], []
        for part in slices(left):
            rows = part.column("row").to_numpy()
            ends = np.searchsorted(span_row, rows, "left"), np.searchsorted(span_row, rows, "right")
            ids.append(part.column("doc_id"))
            for text, a, b in zip(part.column("text").to_pylist(), *[x.tolist() for x in ends], strict=True):
                every = text.encode().split()
                mask = np.zeros(len(every) + 1, np.int64)
                if b > a:
                    np.add.at(mask, lo[a:b], 1)
                    np.add.at(mask, hi[a:b], -1)
                stays = np.cumsum(mask[:-1]) == 0
                total.append(len(every))
                removed.append(int(len(every) - stays.sum()))
                kept.append(b" ".join(every if b == a else [w for w, s in zip(every, stays.tolist(), strict=True) if s]).decode())
        return pa.table([pa.chunked_array(ids), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return table.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(clean, f"doc_id {kind.simpleString()}, n_words long, n_removed long, kept_text string")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def brute_force(texts: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """What op6 must give, for tests on small tables with distinct ids."""
    seen: dict[tuple, int] = {}
    each = {k: (t or "").encode().split() for k, t in texts.items()}
    for w in each.values():
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] = seen.get(tuple(w[i : i + window]), 0) + 1
    out = {}
    for k, w in each.items():
        gone = {i + j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(window)}
        out[k] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out
