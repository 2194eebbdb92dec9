"""Whitening against exact sums and a library eigen solver."""

import math
from fractions import Fraction

import numpy as np

from geoloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, n long, component string"


def brute(rows, k=16):
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1000000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, x in kept:
        dev = sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True))
        out.setdefault(i, (n, dev, np.array([float(Fraction(n * c - s, n)) for c, s in zip(x, sums, strict=True)]) @ vectors / np.sqrt(values), values / np.trace(y.T @ y / n)))
    return out


def test_whiten(spark):
    rng = np.random.default_rng(3)
    mixed = (rng.standard_normal((300, 24)) * np.linspace(0.1, 3, 24)) @ np.linalg.qr(rng.standard_normal((24, 24)))[0]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(mixed)]
    rows += [(1000 + i, rows[0][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[7][1])]
    odd = [(2000, None), (2001, [None] + rows[0][1][1:]), (2002, [float("nan")] + rows[0][1][1:]), (2003, [float("inf")] + rows[0][1][1:]), (2004, []), (2005, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows + odd], SCHEMA)
    got = whitening.whiten(df).collect()
    want = brute(rows)
    assert len(got) == 16 * len(rows) and {r.vec_id for r in got} == {i for i, _ in rows}
    flip = {}
    for r in got:
        n, dev, white, share = want[r.vec_id]
        assert (r.n, r.deviation) == (n, dev) and abs(r.explained / share[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-9
        sign = flip.setdefault(r.component, math.copysign(1, r.whitened * white[r.component - 1]))
        assert abs(sign * r.whitened - white[r.component - 1]) < 1e-8


def test_few_and_no_vectors(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, "")], SCHEMA)).collect() == []
    one = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, ""), (2, [1.0, 2.0, 3.0], 1, "")], SCHEMA)).collect()
    assert len(one) == 6 and {(r.n, r.deviation, r.whitened, r.explained) for r in one} == {(1, 0, 0.0, 0.0)}
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], 1, "") for i in range(9)], SCHEMA)).collect()
    assert {r.identity_error < 1e-9 for r in line} == {True} and {abs(r.explained - 1) < 1e-9 for r in line if r.component == 1} == {True}
    assert {r.whitened for r in line if r.component > 1} == {0.0}


def test_components_of_equal_and_close_values():
    rng = np.random.default_rng(5)
    for values in (np.ones(30), np.r_[np.full(5, 2.0), np.full(5, 2.0 + 1e-9), np.linspace(0, 1, 30)], np.diag(np.arange(4.0)).diagonal(), np.zeros(3), np.ones(1)):
        q = np.linalg.qr(rng.standard_normal((len(values), len(values))))[0]
        for v in (q * values @ q.T, np.diag(values)):
            v = (v + v.T) / 2
            k = min(16, len(v))
            got, basis = whitening.leading_components(v, k)
            assert np.allclose(got, np.sort(values)[::-1][:k], atol=1e-12 * max(1, values.max()))
            assert np.abs(basis.T @ basis - np.eye(k)).max() < 1e-10
            assert np.abs(v @ basis - basis * got).max() < 1e-10 * max(1, values.max())
