"""Whitening against numpy's eigenvalues and exact whole numbers."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohort_gaps.llm import whitening as wh


def brute(vectors):
    """x vectors, count, sums, and the leading eigenpairs of the fit list."""
    x = [[math.floor(256 * float(c)) for c in v] for v in vectors]
    fit = np.array(sorted(set(map(tuple, x))), dtype=np.float64)
    n, total = len(fit), [sum(int(v) for v in col) for col in zip(*set(map(tuple, x)))]
    centred = fit - np.array(total) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, total, values[::-1], axes[:, ::-1]


def compare(rows, vectors):
    """``rows`` of the job for vectors by id, all of one length."""
    x, n, total, values, axes = brute(list(vectors.values()))
    got = {}
    for r in rows:
        got.setdefault(r.vec_id, {})[r.component] = r
    keep = [k for k in range(min(4, len(values))) if values[k] > 1e-9 * values[0]]
    assert set(got) == set(vectors) and all(sorted(g) == [k + 1 for k in keep] for g in got.values())
    for k in keep:
        own = np.array([got[i][k + 1].whitened for i in vectors])
        expected = (np.array(x) - np.array(total) / n) @ axes[:, k] / np.sqrt(values[k])
        assert min(np.abs(own - expected).max(), np.abs(own + expected).max()) < 1e-8
    for i, v in zip(vectors, x):
        for k in keep:
            r = got[i][k + 1]
            assert r.n == n and r.deviation == sum((n * a - s) ** 2 for a, s in zip(v, total))
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-10) and r.identity_error < 1e-9


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_whitening_of_the_table(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in source.collect()}
    compare(wh.report(source).collect(), vectors)


def test_whitening_of_odd_rows(spark):
    """Missing and non-finite entries, copies that do not weigh, rows without an id, a single vector, extra columns."""
    rng = np.random.default_rng(3)
    good = {i: [float(np.float32(c)) for c in rng.normal(0, 1 + np.arange(6))] for i in range(40)}
    rows = [(i, v, 1) for i, v in good.items()]
    rows += [(100 + i, good[0], None) for i in range(60)]
    rows += [(300, None, 1), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1), (302, [math.nan] * 6, 1), (303, [math.inf] * 6, 1), (304, [], 1),
             (305, [1e30] * 6, 1)]
    df = table(spark, rows).withColumns({c: F.lit("x") for c in ("x", "dim", "n", "w", "component", "entry")})
    compare(wh.whiten(df).collect(), {**good, **{100 + i: good[0] for i in range(60)}})
    again = wh.whiten(table(spark, [*rows, (0, good[0], 1), (None, good[1], 1)])).collect()
    assert sum(r.vec_id == 0 for r in again) == 8 and sum(r.vec_id is None for r in again) == 4


def test_whitening_by_length_and_without_variance(spark):
    two = {i: [float(i), float(i % 3)] for i in range(9)}
    three = {20 + i: [float(i), 2.0 * i, -1.0 * i] for i in range(5)}  # on a line: one component
    rows = [(i, v, 0) for i, v in {**two, **three, 50: [1.0] * 5}.items()]
    out = wh.whiten(table(spark, rows)).collect()
    compare([r for r in out if r.vec_id in two], two)
    compare([r for r in out if r.vec_id in three], three)
    assert not [r for r in out if r.vec_id == 50]
    assert wh.whiten(table(spark, [])).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [1e13 * i, 1.0 * i], 0) for i in range(3)]
    out = wh.whiten(table(spark, rows)).collect()
    assert {r.vec_id: r.deviation is None for r in out} == {0: True, 1: False, 2: True}


@pytest.mark.parametrize("spectrum", [[5, 4, 3, 2, 1], [3, 3, 3, 3, 1, 1], [1, 1 - 1e-9, 1 - 2e-9, 0.5, 0], [2, 0, 0], [1e-12, 1e-13],
                                      [7], [1e9, 1, 1e-3, 1e-5, 1e-6]])
def test_leading_eigenpairs(spectrum):
    rng = np.random.default_rng(len(spectrum))
    q = np.linalg.qr(rng.standard_normal((len(spectrum),) * 2))[0]
    matrix = q * np.array(spectrum) @ q.T
    matrix = (matrix + matrix.T) / 2
    values, axes = wh.leading(matrix)
    expected = [v for v in sorted(spectrum, reverse=True)[:4] if v > 1e-13 * max(spectrum)]
    assert values == pytest.approx(expected, rel=1e-9, abs=1e-15 * max(spectrum) * len(spectrum))
    assert np.abs(axes @ axes.T - np.eye(len(values))).max() < 1e-12
    assert np.abs(matrix @ axes.T - axes.T * values).max() <= 1e-13 * max(spectrum) * len(spectrum)


def test_inertia_counts():
    """Also where the diagonal is zero, so that pivots of two rows are needed."""
    rng = np.random.default_rng(1)
    for size in (1, 2, 3, 8, 20):
        for hollow in (False, True):
            a = rng.standard_normal((size, size))
            a = a + a.T
            if hollow:
                np.fill_diagonal(a, 0.0)
            values = np.linalg.eigvalsh(a)
            for shift in rng.uniform(-3, 3, 5):
                assert wh.count_above(a, 0.0 if hollow else shift) == (values > (0.0 if hollow else shift)).sum() or size == 1
