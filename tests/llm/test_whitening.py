import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import whitening as W

SCHEMA = "vec_id long, embedding array<double>, label int"


def table_of(spark, vectors, extra=()):
    return spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(vectors)] + list(extra), SCHEMA).repartition(3)


def model_of(spark, vectors, extra=()):
    rows = W.usable(table_of(spark, vectors, extra), "embedding")
    dim = W.dimension(rows)
    rows = rows.filter(F.size("vector") == dim)
    return rows, dim, W.fit(rows, dim)


def cloud(n, dim, seed=1, spread=None):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, dim)) @ rng.normal(size=(dim, dim)) * (1.0 if spread is None else spread)


def exact(vectors):
    x = [[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[k] for r in x) for k in range(dim)]
    v = [[Fraction(sum((n * r[i] - sums[i]) * (n * r[j] - sums[j]) for r in x), n ** 3) for j in range(dim)] for i in range(dim)]
    return x, n, sums, v


def test_covariance_components_and_deviations(spark):
    vectors = cloud(90, 7)
    rows, dim, model = model_of(spark, vectors)
    x, n, sums, v = exact(vectors)
    assert (model.n, model.sums) == (n, sums)
    assert [[Fraction(int(e), n * n) for e in row] for row in W.scatter(rows, n, sums)] == v
    assert model.trace == float(sum(v[i][i] for i in range(dim)))
    cov = np.array([[float(e) for e in row] for row in v])
    values, components = np.linalg.eigh(cov)
    assert np.allclose(model.values, values[::-1], rtol=1e-12)
    for k in range(dim):
        u = components[:, dim - 1 - k]
        assert np.allclose(model.components[:, k] * np.sign(u @ model.components[:, k]), u, atol=1e-11)
    got = {r.vec_id: r for r in W.whitened(rows, dim, model).collect()}
    z = np.array([got[i].whitened for i in range(n)])
    want = (np.array([[float(Fraction(n * r[k] - sums[k], n)) for k in range(dim)] for r in x]) @ model.components) / np.sqrt(model.values)
    assert np.allclose(z, want, atol=1e-10)
    assert np.abs(z.T @ z / n - np.eye(dim)).max() < 1e-9 and model.identity_error < 1e-9
    assert [got[i].deviation for i in range(n)] == [sum((n * r[k] - sums[k]) ** 2 for k in range(dim)) for r in x]


def test_wide_spectrum_and_large_entries(spark):
    # variances over twelve orders of magnitude, and entries whose products pass 2^53
    spread = np.array([10.0 ** k for k in range(0, 7)])
    _, dim, model = model_of(spark, cloud(80, 7, 3) * spread)
    _, _, _, v = exact(cloud(80, 7, 3) * spread)
    cov = np.array([[float(e) for e in row] for row in v])
    assert np.allclose((model.components * model.values) @ model.components.T, cov, rtol=1e-10, atol=1e-10 * np.abs(cov).max())
    assert model.identity_error < 1e-6
    huge = [[1e30, 2.0, -3e17], [-1e25, 5.0, 4e18], [0.0, 1.0, 1.5], [7e29, -2.0, 1e3]]
    rows, dim, model = model_of(spark, huge)
    x, n, sums, _ = exact(huge)
    assert model.sums == sums
    assert [r.deviation for r in W.whitened(rows, dim, model).collect()] == [None] * 4
    assert model.n == 4 and np.isfinite(model.identity_error)


def test_rank_and_repeated_vectors(spark):
    flat = [[i, 2 * i, 3.0] for i in range(40)]
    _, _, model = model_of(spark, flat)
    assert len(model.values) == 1 and abs(model.values[0] / model.trace - 1) < 1e-12
    assert model_of(spark, [[1.0, 2.0]] * 9)[2] is None
    _, _, one = model_of(spark, [[float(i % 2)] for i in range(10)])
    assert one.values.tolist() == [1024.0] and one.components.tolist() == [[1.0]]


@pytest.mark.parametrize("dim", [1, 2, 5, 64, 65])
def test_jacobi_on_pivoted_factor(dim):
    rng = np.random.default_rng(dim)
    a = rng.normal(size=(dim, max(1, dim - 1)))
    a = a @ a.T
    factor = W.pivoted_cholesky(a)
    assert np.allclose(factor @ factor.T, a, atol=1e-10)
    values, components = W.one_sided_jacobi(factor)
    assert np.allclose(components.T @ components, np.eye(len(values)), atol=1e-12)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][:len(values)], rtol=1e-9)


def test_query_rows_and_dropped_vectors(spark, scratch):
    vectors = cloud(60, 40, 5)
    bad = [(100, None, 1), (101, [1.0] * 39 + [None], 1), (102, [float("nan")] * 40, 1), (103, [float("inf")] + [1.0] * 39, 1),
           (104, [], 1), (105, [1.0, 2.0], 1), (None, [0.5] * 40, 1), (7, [0.25] * 40, 1)]
    table_of(spark, vectors, bad).withColumns({"component": F.lit("x"), "n": F.lit("x"), "whitened": F.lit("x"), "vector": F.lit("x")}).write.parquet(scratch + "/embeddings.parquet")
    got = W.op12_embedding_whitening(spark, scratch)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    rows = got.collect()
    assert len(rows) == 62 * 32 and {r.n for r in rows} == {62} and {r.component for r in rows} == set(range(1, 33))
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-4
    assert sum(r.vec_id is None for r in rows) == 32 and sum(r.vec_id == 7 for r in rows) == 64
    x, n, sums, v = exact(np.vstack([vectors, [[0.5] * 40, [0.25] * 40]]))
    cov = np.array([[float(e) for e in row] for row in v])
    values = np.linalg.eigvalsh(cov)[::-1]
    explained = {r.component: r.explained for r in rows}
    assert all(abs(explained[k + 1] / (values[k] / np.trace(cov)) - 1) < 1e-9 for k in range(32))


def test_empty_tables(spark, scratch):
    spark.createDataFrame([], SCHEMA).write.parquet(scratch + "/embeddings.parquet")
    assert W.op12_embedding_whitening(spark, scratch).count() == 0
    spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA).write.mode("overwrite").parquet(scratch + "/embeddings.parquet")
    assert W.op12_embedding_whitening(spark, scratch).count() == 0
