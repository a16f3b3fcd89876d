"""Whitening against exact fractions and plain numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from factweave.llm.whitening import decomposed, digits_of, op11_embedding_whitening, scatter_of, whiten

SCHEMA = "vec_id long, embedding array<float>, n string, component string"


def rows_of(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", None) for i, v in enumerate(vectors)], SCHEMA).repartition(parts)


def plain(vectors, components=8):
    """(kept, n, deviations, variances, trace), by fractions and eigvalsh."""
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in vectors[i]] for i in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    deviations = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in x]
    cov = [[float(Fraction(n * sum(r[i] * r[j] for r in x) - sums[i] * sums[j], n * n)) for j in range(d)] for i in range(d)]
    return kept, n, deviations, np.linalg.eigvalsh(cov)[::-1][:components], sum(cov[i][i] for i in range(d))


def test_exact_sums_of_large_numbers():
    rng = np.random.default_rng(1)
    y = rng.integers(-(1 << 61), 1 << 61, (50, 3))
    y[0] = [(1 << 60) - 1, -(1 << 60), 0]
    assert all(sum(int(d[i, 0]) << (18 * k) for k, d in enumerate(digits_of(y))) == int(y[i, 0]) for i in range(50))
    full = np.hstack([np.ones((50, 1), np.int64), y]).astype(object)
    assert (scatter_of(y) == full.T @ full).all()


def test_against_fractions(spark):
    rng = np.random.default_rng(7)
    vectors = (rng.normal(size=(200, 11)) * np.linspace(0.01, 3, 11)).tolist()
    vectors[3], vectors[5][2], vectors[6][0], vectors[8][1] = None, None, float("nan"), float("inf")
    vectors[20:60] = [vectors[20]] * 40
    got = whiten(rows_of(spark, vectors)).toPandas().sort_values(["vec_id", "component"])
    kept, n, deviations, variances, trace = plain(vectors)
    assert got.columns[:7].tolist() == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got.vec_id.unique().tolist() == kept and (got.groupby("vec_id").size() == 8).all() and (got.n == n).all()
    assert got.groupby("vec_id").deviation.first().tolist() == deviations and got.groupby("vec_id").deviation_exact.first().tolist() == list(map(str, deviations))
    assert np.allclose(got[got.vec_id == kept[0]].explained, variances / trace, rtol=1e-9)
    z = got.whitened.to_numpy().reshape(-1, 8)
    error = np.abs(np.cov(z.T, bias=True) - np.eye(8)).max()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9 and error < 1e-9
    assert np.abs(z.mean(0)).max() < 1e-9


def test_result_is_the_same_however_rows_are_dealt(spark):
    vectors = np.random.default_rng(3).normal(size=(300, 5)).tolist()
    one, many = (whiten(rows_of(spark, vectors, p)).drop("identity_error").toPandas().sort_values(["vec_id", "component"]).reset_index(drop=True) for p in (1, 7))
    assert one.equals(many)


@pytest.mark.parametrize("vectors", [[], [None], [[float("nan")]], [[]]])
def test_nothing_to_whiten(spark, vectors):
    assert whiten(rows_of(spark, vectors, 1)).count() == 0


def test_no_variance_other_lengths_and_ties(spark):
    got = whiten(rows_of(spark, [[1.0, 2.0], [1.0, 2.0], [3.0]])).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got) == [(i, c, 2, 0, None, 0.0, None) for i in (0, 1) for c in (1, 2)]
    line = whiten(rows_of(spark, [[0.0, 0.0], [1.0, 1.0], [0.0, 0.0], [1.0, 1.0]])).orderBy("vec_id", "component").collect()
    assert [r.whitened for r in line if r.component == 2] == [None] * 4 and np.allclose([r.whitened for r in line if r.component == 1], [-1, 1, -1, 1])
    assert all(r.identity_error < 1e-9 for r in line)


def test_deviations_beyond_a_long(spark):
    got = whiten(rows_of(spark, [[1e9, 0.0], [-1e9, 1.0], [0.5, 3e15]])).collect()
    assert all(r.deviation is None for r in got if r.vec_id == 2) and all(int(r.deviation_exact) > 2**63 for r in got)
    huge = decomposed(3, np.array([0, 0], object), np.array([[2 << 200, 0], [0, 6 << 200]], object))
    assert np.allclose(huge.variances / huge.trace, [0.75, 0.25])


def test_query_on_the_table(spark):
    got = op11_embedding_whitening(spark, "/root/testdata/sf0.001").toPandas().sort_values(["vec_id", "component"])
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    kept, n, deviations, variances, trace = plain([r.embedding for r in table])
    assert got.vec_id.unique().tolist() == [table[i].vec_id for i in kept] and got.groupby("vec_id").deviation.first().tolist() == deviations
    assert np.allclose(got.explained.to_numpy()[:8], variances / trace, rtol=1e-9) and got.identity_error.iloc[0] < 1e-4
