"""Operator 1: best-fit packing with a swap-based local search.

Only lengths travel: documents are encoded where they are read, their pieces dealt by a hash into groups of bounded
size, and each group packed by itself: best fit, longest first, then moves and exchanges between underfull bins, each
raising the sum of squared fills, until bins empty or nothing helps. The emptiest sequences of all groups are opened again
and packed together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, read_table
from .tokens import pieces

LIMIT = 4096


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of item numbers: each item, longest first, in the open bin that it leaves the least room in."""
    bins: list[list[int]] = []
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    there = 0  # bit f: some bin has f free
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        fits = there >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                there &= ~(1 << room)
            bins[b].append(item)
        else:
            room, b = limit, len(bins)
            bins.append([item])
        if rest := room - size:
            free[rest].append(b)
            there |= 1 << rest
    return bins


def gives_of(items: np.ndarray, sizes: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Size -> one item, or else two, of a bin that have it together: exchanges of equal size gain the same."""
    order = items[np.argsort(sizes[items], kind="stable")]
    size, first = np.unique(sizes[order], return_index=True)
    out = {int(s): (int(order[i]),) for s, i in zip(size, first, strict=True)}
    twice = np.flatnonzero(np.diff(np.append(first, len(order))) > 1)
    pairs = [(int(order[first[i]]), int(order[first[i] + 1])) for i in twice.tolist()]
    one = [int(order[i]) for i in first.tolist()]
    pairs += [(x, y) for k, x in enumerate(one) for y in one[k + 1 :]]
    for x, y in pairs:
        out.setdefault(int(sizes[x] + sizes[y]), (x, y))
    return out


def best_exchange(d: int, where: np.ndarray, fill: np.ndarray, sizes: np.ndarray, limit: int) -> tuple[tuple[int, ...], int, int] | None:
    """(items that bin `d` gives, the bin that gets them, the item it gives back or -1): what raises squared fill most, None if nothing does."""
    others = np.flatnonzero((fill > 0) & (fill < limit))
    others = others[others != d]
    held = np.flatnonzero((fill[where] < limit) & (where != d))
    of, own = fill[where[held]], int(fill[d])
    best, most = None, 0
    for size, give in gives_of(np.flatnonzero(where == d), sizes).items():
        if len(give) == 1 and len(others):  # a move
            gain = np.where(fill[others] + size <= limit, size * (fill[others] + size - own), 0)
            k = int(gain.argmax())
            if gain[k] > most:
                best, most = (give, int(others[k]), -1), int(gain[k])
        more = size - sizes[held]
        gain = np.where((more > 0) & (of + more <= limit), more * (of + more - own), 0)
        if len(gain):
            k = int(gain.argmax())
            if gain[k] > most:
                best, most = (give, int(where[held[k]]), int(held[k])), int(gain[k])
    return best


def improve(bins: list[list[int]], sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins after all exchanges that raise squared fill: items of each underfull bin in turn, the emptiest first, go to others as a move, one
    for one or two for one, until a whole turn changes nothing or as many bins are left as the total needs."""
    least = -(-int(sizes.sum()) // limit)
    where = np.zeros(len(sizes), np.int64)
    for b, items in enumerate(bins):
        where[items] = b
    fill = np.bincount(where, weights=sizes, minlength=len(bins)).astype(np.int64)
    changed = True
    while changed and np.count_nonzero(fill) > least:
        changed = False
        under = np.flatnonzero((fill > 0) & (fill < limit))
        for d in under[np.argsort(fill[under], kind="stable")].tolist():
            while 0 < fill[d] < limit and (found := best_exchange(d, where, fill, sizes, limit)):
                give, b, take = found
                more = int(sizes[list(give)].sum()) - (int(sizes[take]) if take >= 0 else 0)
                where[list(give)] = b
                if take >= 0:
                    where[take] = d
                fill[b] += more
                fill[d] -= more
                changed = True
            if not fill[d] and np.count_nonzero(fill) <= least:
                break
    out: list[list[int]] = [[] for _ in bins]
    for i, b in enumerate(where.tolist()):
        out[b].append(i)
    return [b for b in out if b]


def pack_lengths(sizes: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item."""
    where, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for b, items in enumerate(improve(best_fit(sizes, limit), sizes, limit)):
        at = 0
        for i in items:
            where[i], offset[i] = b, at
            at += int(sizes[i])
    return where, offset


def released(where: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Whether an item is in one of the emptiest underfull bins: as many as hold an eighth of all items together, one at least."""
    fill, n = np.bincount(where, weights=sizes), np.bincount(where)
    under = np.flatnonzero(fill < limit)
    under = under[np.argsort(fill[under], kind="stable")]
    out = under[: max(1, int(np.searchsorted(np.cumsum(n[under]), len(where) // 8, side="right")))]
    return np.isin(where, out)


def packed_group(level: int, last: bool, limit: int, names: list[str]):
    def one(at: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "ids_crc32", "piece", "spread"], kind="stable", ignore_index=True)
        sizes = part["length"].to_numpy(np.int64)
        where, offset = pack_lengths(sizes, limit)
        loose = np.zeros(len(sizes), bool) if last else released(where, sizes, limit)
        return part.assign(sequence_id=(level << 56) + (int(at[0]) << 32) + where, offset=offset, loose=loose)[names]

    return one


def pack(docs: DataFrame, *, tokenizer: str | None = None, limit: int = LIMIT, group: int = 6000, key: str = "doc_id") -> DataFrame:
    """A row for each piece of each row of `docs` (key and text are read): key, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one end token. Rows repeated under one key are packed each for itself; null keys are kept.
    Ties go by checksum, piece and place in the input. Other columns don't matter, whatever their names. An empty table
    gives no rows. Only documents longer than `limit` tokens are cut. About `group` pieces are packed in a task; what
    their emptiest sequences hold is dealt again into groups and packed together, until one group is left.
    """
    cut = materialize(pieces(docs, tokenizer=tokenizer, most=limit, key=key), "pieces")
    number = T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())
    schema = T.StructType([*cut.schema, *number, T.StructField("loose", T.BooleanType())])
    names = [f.name for f in schema]
    out: DataFrame | None = None
    rows, n, level = cut, cut.count(), 0
    while True:
        groups = max(1, -(-n // group))

        dealt = F.pmod(F.xxhash64(key, "piece", "spread", "ids_crc32", F.lit(level)), F.lit(groups))
        placed = rows.groupBy(dealt).applyInPandas(packed_group(level, groups == 1, limit, names), schema)
        if groups > 1:
            placed = materialize(placed, "placed")
        fixed = placed.where("not loose") if groups > 1 else placed
        fixed = fixed.drop("spread", "loose")
        out = fixed if out is None else out.unionByName(fixed)
        if groups == 1:
            return out
        rows, before, level = placed.where("loose").drop("sequence_id", "offset", "loose"), n, level + 1
        n = rows.count()
        if n > 0.9 * before:  # sequences that hold a whole group: packing them again gains nothing
            return out.unionByName(placed.where("loose").drop("spread", "loose"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
