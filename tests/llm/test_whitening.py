"""Whitening against a covariance matrix in numpy, and block Lanczos against dense eigenvalues."""

from __future__ import annotations

import math

import numpy as np
import pytest

from rasterloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, component int"


def rows_of(spark, vectors, width=6):
    return spark.createDataFrame([(i, v, "other", 9) for i, v in vectors], SCHEMA).repartition(3)


def plain(vectors, count=4, factor=256):
    width = max(len(v) for _, v in vectors)
    kept = [(i, [math.floor(float(np.float32(c)) * factor) for c in v] + [0] * (width - len(v))) for i, v in vectors]
    fit = np.array(sorted(set(tuple(x) for _, x in kept)), dtype=object)
    n, total = len(fit), [int(s) for s in fit.sum(axis=0)]
    y = (fit - np.array([s / n for s in total])).astype(float)
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1][:count], u[:, ::-1][:, :count]
    some = e > 1e-11 * e[0]
    out = {}
    for i, x in kept:
        dev = sum((n * a - s) ** 2 for a, s in zip(x, total))
        w = (np.array(x, float) - np.array(total) / n) @ u[:, some] / np.sqrt(e[some])
        out.setdefault(i, []).append((n, dev, w, e[some] / np.trace(cov)))
    return out


@pytest.mark.parametrize("seed, width, n", [(0, 6, 50), (1, 3, 40), (2, 12, 200)])
def test_against_numpy(spark, seed, width, n):
    rng = np.random.default_rng(seed)
    data = rng.standard_normal((n, width)) * np.arange(1, width + 1) * 0.3
    vectors = [(k % (n - 5), [float(c) for c in row]) for k, row in enumerate(data)]
    vectors += [(1000 + k, vectors[0][1]) for k in range(30)] + [(None, vectors[1][1])]
    got = whitening.whiten(rows_of(spark, vectors)).collect()
    model = plain(vectors)
    k = min(4, width)
    assert len(got) == k * len(vectors)
    assert max(r.identity_error for r in got) < 1e-9
    signs = {}
    seen = {}
    for r in got:
        seen.setdefault(r.vec_id, []).append(r)
    for i, rows in seen.items():
        for c in range(1, k + 1):
            ours = sorted((r.deviation, r.n, abs(r.whitened), r.explained) for r in rows if r.component == c)
            theirs = sorted((d, m, abs(w[c - 1]), ex[c - 1]) for m, d, w, ex in model[i])
            assert [o[:2] for o in ours] == [t[:2] for t in theirs]
            np.testing.assert_allclose([o[2:] for o in ours], [t[2:] for t in theirs], rtol=1e-7, atol=1e-9)
        if len(rows) == k:
            for r in rows:
                w = model[i][0][2][r.component - 1]
                if abs(w) > 1e-6:
                    signs.setdefault(r.component, set()).add(np.sign(w) == np.sign(r.whitened))
    assert all(len(s) == 1 for s in signs.values())  # one sign for all rows


def test_rows_that_are_dropped_and_padded(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 0.0]), (6, [-1.0]), (7, [0.5, -0.0]), (8, [])]
    got = whitening.whiten(rows_of(spark, vectors)).collect()
    assert {r.vec_id for r in got} == {1, 6, 7, 8}
    assert {r.component for r in got} == {1, 2}
    model = plain([(1, [1.0, 2.0]), (6, [-1.0]), (7, [0.5, 0.0]), (8, [])])
    for r in got:
        assert (r.n, r.deviation) == model[r.vec_id][0][:2]


def test_no_variance_and_no_rows(spark):
    assert whitening.whiten(rows_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    empty = whitening.whiten(rows_of(spark, []))
    assert empty.collect() == [] and empty.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert whitening.whiten(rows_of(spark, [(1, None), (2, [])])).collect() == []


def test_large_components(spark):
    vectors = [(1, [3e30, 1.0]), (2, [-2e9, 5.0]), (3, [7e9, 2.0])]
    got = whitening.whiten(rows_of(spark, vectors)).collect()
    assert {r.vec_id for r in got} == {1, 2, 3} and any(r.deviation is None for r in got)


@pytest.mark.parametrize("kind", ["full", "low", "repeated", "restart", "one"])
def test_block_lanczos(kind):
    rng = np.random.default_rng(3)
    d = 1 if kind == "one" else 90
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    e = {"full": np.sort(rng.random(d))[::-1], "low": np.r_[5.0, 3.0, np.zeros(d - 2)], "repeated": np.r_[[2.0] * 6, [1.0] * (d - 6)], "restart": 1.1 ** -np.arange(d), "one": np.ones(1)}[kind] if d > 1 else np.ones(1)
    a = (q * e) @ q.T
    passes = []

    def times(b):
        passes.append(b.shape[1])
        return a @ b

    values, vectors = whitening.leading(times, d, 4, most=32 if kind == "restart" else 512)
    k = min(4, d)
    np.testing.assert_allclose(values, np.sort(e)[::-1][:k], atol=1e-12)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-12)
    np.testing.assert_allclose(a @ vectors, vectors * values, atol=1e-11)
