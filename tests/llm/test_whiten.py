"""Whitening against a dense eigendecomposition, hard spectra, and odd tables."""

import math

import numpy as np
import pytest

from larkspur.llm import whiten

SF = "/root/testdata/sf0.001"


def dense(ids, vectors, wanted):
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], object)
    n = len(x)
    s = x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    centred = ((n * x - s) / n).astype(float)
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    values, vecs = values[::-1][:wanted], vecs[:, ::-1][:, :wanted]
    return deviation, centred @ vecs / np.sqrt(values), values / (centred**2).sum() * n


def as_matrix(got, ids, k):
    place = {i: p for p, i in enumerate(ids)}
    m = np.zeros((len(ids), k))
    for r in got:
        m[place[r.vec_id], r.component - 1] = r.whitened
    return m


def test_query_equals_dense_decomposition(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    plain = rows.collect()
    ids = [r.vec_id for r in plain]
    deviation, white, shares = dense(ids, [r.embedding for r in plain], 32)
    got = whiten.whiten(rows).collect()
    assert len(got) == 32 * len(ids) and {r.n for r in got} == {len(ids)}
    want = dict(zip(ids, deviation))
    assert all(r.deviation == want[r.vec_id] for r in got)
    mine = as_matrix(got, ids, 32)
    assert np.abs(mine * np.sign((mine * white).sum(0)) - white).max() < 1e-7
    assert np.allclose([r.explained for r in got], [shares[r.component - 1] for r in got], rtol=1e-10)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


@pytest.mark.parametrize("spectrum", ["many equal", "one", "falling", "rank 5", "two levels"])
def test_lanczos_on_hard_spectra(spectrum):
    rng, dim = np.random.default_rng(7), 90
    values = {"many equal": np.r_[np.full(40, 3.0), np.full(50, 1.0)], "one": np.full(dim, 2.0), "falling": 0.7 ** np.arange(dim), "rank 5": np.r_[np.arange(5, 0, -1.0), np.zeros(85)], "two levels": np.r_[np.full(20, 5.0), np.linspace(4, 0, 70)]}[spectrum]
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    matrix = turn * values @ turn.T
    got, vectors = whiten.block_lanczos(lambda b: matrix @ b, dim, 24, block=7)
    assert np.allclose(got, values[:24], atol=1e-12) and np.allclose(vectors.T @ vectors, np.eye(24), atol=1e-12)
    assert np.abs(matrix @ vectors - vectors * got).max() < 1e-11


def test_lanczos_ends_before_the_space_does():
    passes, dim = [], 400
    values = np.r_[np.linspace(100, 50, 10), np.linspace(1, 0, 390)]
    got, _ = whiten.block_lanczos(lambda b: passes.append(b.shape[1]) or values[:, None] * b, dim, 10)
    assert np.allclose(got, values[:10]) and sum(passes) < dim / 2


def test_odd_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 1.0]), (5, [inf, 1.0, 1.0]), (6, []), (None, [0.0, 0.0, 0.0]), (7, [0.25, -3.0, 0.5]), (7, [0.25, -3.0, 0.5]), (8, [5.0, 0.1, 0.5])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, x int, n int")
    got = whiten.whiten(table).collect()
    kept = [r for r in rows if r[0] in (None, 1, 7, 8)]
    # Three entries for five rows: three components, and as many rows of each for the repeated one.
    assert len(got) == 15 and {r.n for r in got} == {5} and sum(r.vec_id == 7 for r in got) == 6 and max(r.identity_error for r in got) < 1e-10
    deviation = dense([], [np.float32(v) for _, v in kept], 3)[0]
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviation)
    flat = spark.createDataFrame([(i, [float(i), 2.0, float(-i)]) for i in range(9)], "vec_id long, embedding array<double>")
    assert {r.component for r in whiten.whiten(flat).collect()} == {1}
    for few in (table.limit(0), table.where("vec_id = 1"), table.where("vec_id = 7"), table.where("vec_id = 2")):
        assert whiten.whiten(few).count() == 0
    with pytest.raises(ValueError, match="entries"):
        whiten.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
