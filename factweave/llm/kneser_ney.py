"""Interpolated modified Kneser-Ney over byte grams, in numpy: what a task does with one shard of a model.

A gram is ORDER bytes in a long, the last byte lowest. A shard holds all grams with the same two bytes before the last, so
the counts of every order from 3 up, which are numbers of distinct longer grams, are whole in it. Orders 1 and 2 run
over shards: their tables have 2 ** 16 entries at most, come from sums over all shards and go to every task.
"""

from __future__ import annotations

import numpy as np

ORDER = 6
#: Probabilities are kept as bits in units of 1 / UNIT, whole numbers, so sums don't depend on their order.
UNIT = 512
MOST_BITS = 60.0


def mask(k: int) -> np.int64:
    return np.int64((1 << 8 * k) - 1)


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of grams with counts 1 to 4; where these are lacking, half a count each."""
    n1, n2 = float(n[0]), float(n[1])
    y = n1 / (n1 + 2 * n2) if n1 + 2 * n2 > 0 else 0.5
    raw = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] > 0 else 0.5 * k for k in (1, 2, 3)]
    return np.array([min(max(d, 0.1), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True)])


def count_of_counts(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(np.int64)


def orders(grams: np.ndarray, counts: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(grams, counts) of each order from ORDER to 3; below ORDER a count is the number of distinct bytes that stand before."""
    out = {ORDER: (grams, counts)}
    for k in range(ORDER - 1, 2, -1):
        out[k] = np.unique(out[k + 1][0] & mask(k), return_counts=True)
    return out


def shares(grams: np.ndarray, counts: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For sorted grams: the discounted share of each, and contexts with their back-off weights."""
    context = grams >> 8
    first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(grams) else np.zeros(0, np.int64)
    given = d[np.minimum(counts, 3) - 1]
    if not len(grams):
        return np.zeros(0), context, np.zeros(0)
    total = np.add.reduceat(counts, first).astype(np.float64)
    run = np.diff(np.append(first, len(grams)))
    return (counts - given) / np.repeat(total, run), context[first], np.add.reduceat(given, first) / total


def low_orders(bigrams: np.ndarray) -> np.ndarray:
    """P(last byte | byte before), 65,536 of them, from the number of distinct bytes before each pair; a byte never seen has its part of 1 / 256."""
    pairs = np.flatnonzero(bigrams)
    one, one_counts = np.unique(pairs & 255, return_counts=True)
    p = np.full(256, 1.0 / 256)
    if len(one):
        d = discounts(count_of_counts(one_counts))
        share, _, gamma = shares(one.astype(np.int64), one_counts, d)
        p *= gamma[0]
        p[one] += share
    out = np.tile(p, 256)
    if len(pairs):
        counts = bigrams[pairs].astype(np.int64)
        share, context, gamma = shares(pairs.astype(np.int64), counts, discounts(count_of_counts(counts)))
        weight = np.ones(256)
        weight[context] = gamma
        out *= np.repeat(weight, 256)
        out[pairs] += share
    return out


class Shard:
    """One model's orders from 3 up in a shard."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, d: dict[int, np.ndarray], low: np.ndarray):
        self.low = low
        self.tables = [(k, g, *shares(g, c, d[k])) for k, (g, c) in sorted(orders(grams, counts).items())]

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """-log2 P(last byte | bytes before) of each gram, in units."""
        p = self.low[grams & mask(2)]
        for k, table, share, contexts, gamma in self.tables:
            sub = grams & mask(k)
            p = p * found(contexts, gamma, sub >> 8, 1.0) + found(table, share, sub, 0.0)
        return np.rint(np.minimum(-np.log2(p), MOST_BITS) * UNIT).astype(np.int16)


def found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, otherwise: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), otherwise)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], otherwise)


def grams_of(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The gram that ends in each byte of texts laid end to end; a text starts after zeros."""
    pad = ORDER - 1
    size = np.diff(offsets)
    at = np.arange(len(data)) + np.repeat(pad * np.arange(1, len(size) + 1), size)
    padded = np.zeros(len(data) + pad * len(size), np.int64)
    padded[at] = data
    out = np.zeros(len(padded) - pad if len(padded) else 0, np.int64)
    for j in range(ORDER):
        out = (out << 8) | padded[j : j + len(out)]
    return out[at - pad]


class Lookup:
    """Places of grams in a sorted table: a slot by a hash, and a binary search for the few that another gram holds the slot of."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.shift = np.uint64(64 - max(10, min(24, int(len(keys) * 8).bit_length())))
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, grams: np.ndarray) -> np.ndarray:
        return ((grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        at = self.slots[self.slot(grams)]
        other = np.flatnonzero(self.keys[at] != grams)
        at[other] = np.searchsorted(self.keys, grams[other])
        return at
