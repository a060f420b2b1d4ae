import numpy as np
import pytest
from pyspark.sql import functions as F

from heliograph.llm.whitening import COMPONENTS, _deviation, leading, whitened

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(vectors):
    """(x, eigenvalues falling, eigenvectors) by one dense decomposition."""
    x = np.floor(1024 * np.asarray(vectors, np.float32).astype(np.float64)).astype(np.int64) + 100_000
    centred = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], turn[:, ::-1]


def check(spark, vectors, ids=None, tolerance=1e-7):
    n = len(vectors)
    ids = list(range(n)) if ids is None else ids
    rows = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in zip(ids, vectors, strict=True)], SCHEMA)
    got = whitened(rows).toPandas()
    x, values, turn = brute(vectors)
    k = min(COMPONENTS, int((values > 1e-10 * values[0]).sum()))
    assert len(got) == n * k
    sums = [int(s) for s in x.sum(axis=0)]
    exact = {i: sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for i, row in zip(ids, x, strict=True)}
    assert all(int(d) == exact[i] for i, d in zip(got.vec_id, got.deviation, strict=True))
    want = (x - x.mean(axis=0)) @ turn[:, :k] / np.sqrt(values[:k])
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((wide * want).sum(axis=0))
    assert np.abs(wide * signs - want).max() < tolerance
    shares = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(shares, values[:k] / values.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-10
    assert set(got.n) == {n}


def test_equals_dense_decomposition(spark):
    rng = np.random.default_rng(3)
    check(spark, rng.standard_normal((700, 48)) * np.linspace(1, 3, 48))


def test_flat_spectrum_and_strong_direction(spark):
    rng = np.random.default_rng(4)
    flat = rng.standard_normal((900, 40))
    flat[300:600] = flat[0] * 3  # a third of the rows is one vector
    check(spark, flat)


def test_fewer_dimensions_and_low_rank(spark):
    rng = np.random.default_rng(5)
    check(spark, rng.standard_normal((60, 3)))
    thin = np.zeros((80, 50))
    thin[:, 4], thin[:, 9] = rng.integers(-50, 50, 80), rng.integers(-50, 50, 80)
    check(spark, thin)


def test_odd_rows(spark):
    rng = np.random.default_rng(6)
    good = rng.standard_normal((40, 5))
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(good)]
    bad = [(100, None, 0), (101, [1.0, None, 1.0, 1.0, 1.0], 0), (102, [1.0, float("nan"), 1.0, 1.0, 1.0], 0),
           (103, [float("inf")] * 5, 0), (104, [1.0] * 4, 0), (105, [], 0), (None, [0.5] * 5, 0), (3, [0.25] * 5, 0)]
    df = spark.createDataFrame(rows + bad, SCHEMA).withColumn("component", F.lit(7)).withColumn("x", F.lit("a"))
    got = whitened(df).toPandas()
    assert set(got.n) == {42}
    assert sorted(got[got.component == 1].vec_id.fillna(-1).astype(int)) == sorted([*range(40), 3, -1])


@pytest.mark.parametrize("rows", [[], [(1, [2.0, 3.0], 0)], [(i, [2.0, 3.0], 0) for i in range(9)], [(1, None, 0)]])
def test_nothing_to_whiten(spark, rows):
    assert whitened(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_huge_entries_do_not_fail(spark):
    rows = [(i, [float(i), 3e38 if i == 4 else -1.0 * i * i], 0) for i in range(9)]
    got = whitened(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert np.isfinite(got.whitened.astype(float)).all() and set(got.n) == {9}


def test_deviation_is_exact_at_every_size():
    rng = np.random.default_rng(7)
    for size, n in ((1 << 10, 1000), (1 << 20, 1 << 28), (1 << 50, 1 << 30)):
        x, rest = rng.integers(-size, size, (6, 7)), rng.integers(0, n, 7)
        want = [sum((int(c) * n - int(r)) ** 2 for c, r in zip(row, rest, strict=True)) for row in x]
        assert _deviation(x, rest, n) == [str(w) if w < 10**38 else None for w in want]


def test_many_equal_eigenvalues_are_certified():
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.standard_normal((90, 90)))
    values = np.concatenate([np.full(60, 5.0), np.full(30, 1.0)])
    v = (turn * values) @ turn.T
    got, q, residual = leading(lambda m: v @ m, 90)
    assert np.allclose(got, 5) and residual < 1e-11
    assert np.allclose(v @ q, 5 * q, atol=1e-9)


@pytest.mark.parametrize("vectors", [615_000, 3_000_000])
def test_flat_noise_of_many_vectors_is_certified(vectors):
    rng = np.random.default_rng(9)
    turn, _ = np.linalg.qr(rng.standard_normal((64, 64)))
    values = np.append(1 + np.sqrt(64 / vectors) * np.linspace(-2, 2, 62), [1.6, 1.7])[::-1]
    passes = []
    got, q, residual = leading(lambda m: passes.append(1) or (turn * values) @ (turn.T @ m), 64)
    assert np.allclose(got, values[:8], rtol=1e-12) and residual < 1e-11
    assert np.abs(np.abs((turn[:, :8] * q).sum(axis=0)) - 1).max() < 1e-9
    assert len(passes) < 200
