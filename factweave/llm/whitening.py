"""Whitening of embeddings from an exact scatter of whole numbers.

Entries become whole numbers, x = floor(1024 * c) + SHIFT. Each task takes the shift off and adds up counts, sums and
cross-products of blocks of rows: the numbers are cut into digits of 18 bits, so products of digits and their sums over
a block stay under 2 ** 53 and a float matrix product gives them exactly; digits are then put together as Python
integers. What tasks found is summed by Spark, again in digits, as longs. The driver gets one number for each pair of
dimensions, forms n * XᵀX - S * Sᵀ exactly and only then goes over to floats and eigh. So nothing cancels, and the
result doesn't depend on how rows were dealt.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_arrow, read_table

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a digit and rows of a block: 2 ** (2 * 18 + 16) products stay exact in a double.
DIGIT, BLOCK = 18, 1 << 16
#: Values of a block, so that wide vectors make short blocks.
VALUES = 4_000_000
#: Bits of a digit of the sums that Spark adds up: longs hold 2 ** 33 of them.
SUM_DIGIT = 30
#: Entries beyond (over 2 ** 50 after scaling) count as this large.
MOST = float(1 << 60)
LONG = (1 << 63) - 1


class Whitening(NamedTuple):
    """n rows, sums of the entries less SHIFT, unit vectors by falling variance, their variances, and the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    variances: np.ndarray
    trace: float


def whole_vectors(lists: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that count, their entries as longs less SHIFT): no null or non-finite entry, and `dims` entries if that is given."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    flat = lists.flatten().cast(pa.float64())
    values = pc.fill_null(flat, np.nan).to_numpy(zero_copy_only=False)
    ends = np.cumsum(np.maximum(sizes, 0))
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    good = (sizes >= 0) & (bad[ends] == bad[ends - np.maximum(sizes, 0)])
    if dims is None:
        return np.flatnonzero(good), sizes
    rows = np.flatnonzero(good & (sizes == dims))
    at = (ends[rows] - dims)[:, None] + np.arange(dims)
    return rows, np.floor(np.clip(values[at] * SCALE, -MOST, MOST)).astype(np.int64)


def digits_of(values: np.ndarray) -> list[np.ndarray]:
    """Signed digits of DIGIT bits, lowest first, as doubles."""
    out = []
    while True:
        low = ((values + (1 << (DIGIT - 1))) & ((1 << DIGIT) - 1)) - (1 << (DIGIT - 1))
        out.append(low.astype(np.float64))
        values = (values - low) >> DIGIT
        if not values.any():
            return out


def scatter_of(y: np.ndarray) -> np.ndarray:
    """(1 + d) x (1 + d) Python integers: of each row with a 1 before it, the cross-products, summed. It holds the count, the sums and YᵀY."""
    d = y.shape[1]
    total = np.zeros((d + 1, d + 1), object)
    step = max(1, min(BLOCK, VALUES // (d + 1)))
    for start in range(0, len(y), step):
        part = digits_of(np.hstack([np.ones((len(y[start : start + step]), 1), np.int64), y[start : start + step]]))
        for i, a in enumerate(part):
            for j, b in enumerate(part):
                total = total + (a.T @ b).astype(np.int64).astype(object) * (1 << (DIGIT * (i + j)))
    return total


def dimension(rows: DataFrame, vector: str) -> int | None:
    """The commonest length of vectors that count, the longer of equally common ones."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, sizes = whole_vectors(batch.column(0))
            found, counts = np.unique(sizes[good], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(counts, pa.int64())], ["d", "n"])

    found = in_arrow(rows.select(vector), lengths, "d long, n long").groupBy("d").agg(F.sum("n").alias("n"))
    best = found.agg(F.max(F.struct("n", "d")).alias("most")).first().most
    return best.d if best else None


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """The components of all vectors that count; None where there are none, or none with entries.

    The driver holds two numbers for each pair of dimensions, whatever the number of rows.
    """
    dims = dimension(rows, vector)
    if not dims:
        return None
    base = 1 << SUM_DIGIT

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1), object)
        for batch in batches:
            _, y = whole_vectors(batch.column(0), dims)
            if len(y):
                total = total + scatter_of(y)
        cells, digits, values = [], [], []
        for cell, value in enumerate(total[np.tril_indices(dims + 1)].tolist()):
            sign, value, digit = (1, value, 0) if value >= 0 else (-1, -value, 0)
            while value:
                value, low = divmod(value, base)
                cells.append(cell), digits.append(digit), values.append(sign * low)
                digit += 1
        yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(digits, pa.int32()), pa.array(values, pa.int64())], ["cell", "digit", "value"])

    found = in_arrow(rows.select(vector), scatter, "cell long, digit int, value long").groupBy("cell", "digit").agg(F.sum("value").alias("value"))
    exact = [0] * ((dims + 1) * (dims + 2) // 2)
    for r in found.toLocalIterator():
        exact[r.cell] += r.value << (SUM_DIGIT * r.digit)
    full = np.zeros((dims + 1, dims + 1), object)
    full[np.tril_indices(dims + 1)] = exact
    full = np.where(np.tril(np.ones_like(full, bool)), full, full.T)
    n, sums = full[0, 0], full[1:, 0]
    return decomposed(n, sums, full[1:, 1:], components)


def decomposed(n: int, sums: np.ndarray, products: np.ndarray, components: int = COMPONENTS) -> Whitening:
    """Components from exact sums and cross-products; vectors have their largest entry positive."""
    centred = n * products - np.outer(sums, sums)
    scale = max(1, max(abs(v) for v in np.diag(centred)))  # the largest entry, as the matrix is positive semidefinite
    values, vectors = np.linalg.eigh(np.array([[v / scale for v in row] for row in centred.tolist()], np.float64))
    order = np.argsort(-values, kind="stable")[:components]
    vectors = vectors[:, order]
    vectors = vectors * np.where(vectors[np.abs(vectors).argmax(0), np.arange(len(order))] < 0, -1.0, 1.0)
    unit = scale / (n * n)
    # Below what rounding leaves of a zero there is no variance to divide by.
    tiny = len(values) * np.finfo(float).eps * max(values.max(), 0.0)
    return Whitening(int(n), [int(s) for s in sums], vectors, np.where(values[order] > tiny, values[order], 0.0) * unit, sum(np.diag(centred).tolist()) / (n * n))


def centred(y: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, exactly: longs if they surely fit, else Python integers. The shift cancels."""
    if len(y) and model.n * int(np.abs(y).max()) + max(map(abs, model.sums)) >= 1 << 62:
        return y.astype(object) * model.n - np.array(model.sums, object)
    return y * model.n - np.array(model.sums, np.int64)


def squares(exact: np.ndarray) -> list[int]:
    """Sums of squares of each row, exactly."""
    if exact.dtype != object and exact.size and int(np.abs(exact).max()) ** 2 * exact.shape[1] <= LONG:
        return (exact * exact).sum(1).tolist()
    return (exact.astype(object) ** 2).sum(1).tolist()


def projected(exact: np.ndarray, model: Whitening) -> np.ndarray:
    """x - S / n on each component over its deviation; nan for a component without variance."""
    root = np.sqrt(model.variances)
    return (exact.astype(np.float64) / model.n) @ (model.vectors / np.where(root > 0, root, np.nan))


def identity_error(rows: DataFrame, model: Whitening, vector: str = "embedding") -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured on all rows; over the components with variance, None without any."""
    kept = np.flatnonzero(model.variances > 0)
    if not len(kept):
        return None
    dims, k = len(model.sums), len(kept)
    cells = [f"c{i}" for i in range(k + k * k)]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            _, y = whole_vectors(batch.column(0), dims)
            z = projected(centred(y, model), model)[:, kept]
            total += np.concatenate([z.sum(0), (z.T @ z).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total], cells)

    found = in_arrow(rows.select(vector), sums, ", ".join(f"{c} double" for c in cells)).agg(*[F.sum(c) for c in cells]).first()
    mean, products = np.array(found[:k]) / model.n, np.array(found[k:]).reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained, identity_error, deviation_exact: a row for each vector that counts and each of up to `components`.

    Vectors that are null or hold null or non-finite entries don't count, nor do those of another length than the
    commonest. `deviation` is null where it is beyond a long; `deviation_exact` has all its digits. A component without
    variance (as of equal rows, or of fewer rows than components) has null `whitened` and 0 as `explained`;
    `identity_error` leaves it out and is null if all are such. Null and repeated keys, repeated vectors and ties of
    variances (any vectors of their space) are fine; other columns, whatever their names, are left out. A table without
    vectors that count gives no rows. `rows` is read four times and must be the same each time.
    """
    kind = rows.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
                        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()), T.StructField("deviation_exact", T.StringType())])
    rows = rows.select(key, vector)
    model = fit(rows, vector, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    error, dims, k = identity_error(rows, model, vector), len(model.sums), len(model.variances)
    shares = (model.variances / model.trace if model.trace else np.zeros(k)).tolist()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, y = whole_vectors(batch.column(1), dims)
            exact = centred(y, model)
            found, m = squares(exact), len(good)
            again = np.repeat(np.arange(m), k)
            columns = [
                batch.column(0).take(pa.array(good)).take(pa.array(again)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                pa.array([v if v <= LONG else None for v in found], pa.int64()).take(pa.array(again)), pa.array(projected(exact, model).ravel(), from_pandas=True), pa.array(np.tile(shares, m), pa.float64()),
                pa.array([error] * (m * k), pa.float64()), pa.array([str(v) for v in found], pa.string()).take(pa.array(again)),
            ]
            yield pa.RecordBatch.from_arrays(columns, out.names)

    return in_arrow(rows, apply, out)


def op11_embedding_whitening(spark, sf_dir):
    """Every vector of `embeddings` on the eight largest components of them all."""
    return whiten(read_table(spark, sf_dir, "embeddings"))
