import math

import numpy as np
import pytest

from tabweave.llm import whitening as wh


def planted(d, values, seed=1):
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]
    return (q * np.array(values)) @ q.T, q


def test_inertia_counts_eigenvalues():
    rng = np.random.default_rng(2)
    for d in (1, 2, 5, 30):
        a = rng.standard_normal((d, d))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in [-100, *((values[1:] + values[:-1]) / 2), 0.123, 100]:
            assert wh.inertia_above(a, shift) == int((values > shift).sum())
    assert wh.inertia_above(np.zeros((3, 3)), 0.0) == 0
    assert wh.inertia_above(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1


@pytest.mark.parametrize(
    "values",
    [
        [50 * 0.8**k for k in range(40)],
        [9.0] * 12 + [5.0 + 1e-3 * k for k in range(8)] + [1.0] * 20,  # equal and close ones, more than an interval is meant for
        [100.0, 1e-3] + [1e-6] * 30,
        [1.0 + 1e-7 * k for k in range(40)],
        [3.0, 2.0, 1.0] + [0.0] * 30,
    ],
)
def test_intervals_and_feast_find_every_leading_eigenvalue(values):
    v, _ = planted(len(values), values)
    parts = wh.intervals(v, 16)
    assert all(a[0] >= b[1] for a, b in zip(parts, parts[1:]))
    found = [wh.feast(v, *p) for p in parts]
    got = np.concatenate([f[0] for f in found])
    vectors = np.concatenate([f[1] for f in found])
    expected = np.linalg.eigvalsh(v)[::-1][: len(got)]
    assert len(got) >= min(16, sum(x > 0 for x in values))
    assert np.allclose(got, expected, rtol=0, atol=1e-13 * max(values))
    assert np.abs(v @ vectors.T - vectors.T * got).max() < 1e-12 * max(values)
    assert np.allclose(vectors @ vectors.T, np.eye(len(got)), atol=1e-6)


def brute(rows, k=16):
    kept = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:k], vectors.T[::-1][:k]
    out = {}
    for at, (i, x) in enumerate(kept):
        gaps = [n * a - s for a, s in zip(x, sums)]
        for c in range(len(values)):
            out[i, at, c + 1] = (n, sum(g * g for g in gaps), float(np.array(gaps) / n @ vectors[c] / np.sqrt(values[c])), values[c] / np.trace(v))
    return out


def check(df, rows, k=16):
    got = sorted(wh.whiten(df, k).collect(), key=lambda r: (repr(r.id), r.component))
    expected = brute(rows, k)
    assert len(got) == len(expected)
    by_id = {}
    for (i, _, c), e in expected.items():
        by_id.setdefault((i, c), []).append(e)
    signs = {}
    for r in got:
        n, deviation, white, explained = next(e for e in by_id[r.id, r.component] if e[1] == int(r.deviation))
        sign = signs.setdefault(r.component, 1 if r.whitened * white >= 0 else -1)
        assert r.n == n and abs(r.whitened * sign - white) < 1e-8 and abs(r.explained / explained - 1) < 1e-9
        assert r.identity_error < 1e-9
    return got


def test_equals_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((300, 24)) * (2.0 ** -np.arange(24) * 3 + 0.05)
    rows = [(k % 290, [float(c) for c in v]) for k, v in enumerate(base.astype(np.float32))]
    rows += [(1000 + k, rows[5][1]) for k in range(100)]  # copies count once in the fit
    rows += [(None, rows[6][1]), (2000, None), (2001, [None] + rows[1][1][1:]), (2002, [math.nan] + rows[1][1][1:]), (2003, [-math.inf] + rows[1][1][1:]), (2004, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, vector array<float>, x string, component int").repartition(5)
    check(df, rows)
    check(df, rows, 3)


def test_edges(spark):
    schema = "id long, vector array<float>"
    assert wh.whiten(spark.createDataFrame([], schema)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert wh.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], schema)).collect() == []  # nothing varies
    rows = [(1, [1.0, 2.0]), (2, [0.5, -2.0]), (3, [0.5, 9.0])]
    odd = [(7, [1.0, 2.0, 3.0])]
    check(spark.createDataFrame(rows + odd, schema), rows)  # a vector of another length is left out
    line = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [3.0, 6.0])]
    assert {r.component for r in wh.whiten(spark.createDataFrame(line, schema)).collect()} == {1}


def test_integers_beyond_a_long_stay_exact():
    w = wh.Whitening(10**7, [10**17, 5], np.eye(2), np.ones(2), 2.0)
    exact, gaps = w.gaps(np.array([[10**15, -3]]))
    assert exact.tolist() == [[10**22 - 10**17, -3 * 10**7 - 5]] and gaps.dtype == np.float64
