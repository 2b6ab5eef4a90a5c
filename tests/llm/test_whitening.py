"""Whitening against numpy's eigendecomposition of the whole covariance."""

import numpy as np
import pytest

from tillroll.llm import queries, whitening
from tillroll.llm.whitening import SHIFT, Spectrum, rank_one, secular_roots

SCHEMA = "vec_id long, embedding array<double>, n string, `odd.name` int, v int, k0 int"


def plain(vectors):
    """(x, n, sums, eigenvalues, eigenvectors) of the distinct whole-number vectors."""
    x = np.floor(np.array(vectors, dtype=float) * 64).astype(np.int64) + SHIFT
    fit = np.unique(x, axis=0)
    off = (fit - SHIFT) - (fit - SHIFT).mean(0)
    vals, vecs = np.linalg.eigh(off.T @ off / len(fit))
    return x, len(fit), fit.sum(0), vals[::-1], vecs[:, ::-1]


def check(rows, vectors, k):
    x, n, sums, vals, vecs = plain(vectors)
    w = np.array([r["whitened"] for r in rows])
    assert w.shape == (len(vectors), k)
    want = ((x - SHIFT) - (sums - SHIFT * n) / n) @ vecs[:, :k] / np.sqrt(vals[:k])
    signs = np.sign((w * want).sum(0))
    assert np.abs(w - want * signs).max() < 1e-7
    for r, y in zip(rows, x.tolist(), strict=True):
        assert r["n"] == n and r["deviation"] == sum((n * a - int(s)) ** 2 for a, s in zip(y, sums, strict=True))
        assert np.allclose(r["explained"], vals[:k] / vals.sum(), rtol=1e-9) and r["identity_error"] < 1e-8


@pytest.mark.parametrize("kind", ["plain", "few", "equal", "thin", "axes"])
def test_rank_one_updates(kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(400, 24)) * 9
    if kind == "few":
        x = x[rng.integers(0, 6, 400)]
    if kind == "equal":
        x[:] = x[0]
    if kind == "thin":
        x[:, 3:] = 0
    if kind == "axes":
        x = np.eye(24)[rng.integers(0, 24, 400)] * 10
    x = np.floor(x).astype(np.int64) + SHIFT
    parts = [Spectrum(24) for _ in range(3)]
    for p, rows in zip(parts, (x[:150], x[150:151], x[151:]), strict=True):
        p.add(rows)
    for p in parts[1:]:
        parts[0].combine(p)
    s, off = parts[0], (x - SHIFT) - (x - SHIFT).mean(0)
    want, size = off.T @ off, max(1.0, np.trace(off.T @ off))
    assert s.n == 400 and s.sums == x.sum(0).tolist()
    assert np.abs(s.vecs @ np.diag(s.vals) @ s.vecs.T - want).max() < 1e-11 * size
    assert np.abs(s.vecs.T @ s.vecs - np.eye(24)).max() < 1e-11 and (np.diff(s.vals) >= 0).all()


def test_secular_roots_between_close_poles():
    d = np.array([0.0, 1e-13, 1.0, 1.0 + 1e-12, 5.0])
    z = np.array([1e-7, 3.0, 1e-6, 2.0, 1e-9])
    gaps, roots = secular_roots(d, z)
    assert (gaps[np.arange(5), np.arange(5)] < 0).all()  # above their own pole
    assert (gaps[np.arange(4), np.arange(1, 5)] > 0).all()  # below the next
    assert np.isclose(roots.sum(), d.sum() + (z * z).sum())


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(700, 20)) @ rng.normal(size=(20, 20)) * 0.2).tolist()
    v += [v[0]] * 200 + v[5:9]  # a hot vector and repeats
    df = spark.createDataFrame([(i, x, "n", 1, 2, 3) for i, x in enumerate(v)], SCHEMA).repartition(40)
    got = whitening.whiten(df)
    assert got.columns == ["vec_id", "embedding", "odd.name", "v", "k0", *whitening.OUTPUT]
    check(sorted(got.collect(), key=lambda r: r["vec_id"]), v, 16)


def test_spectra_of_many_tasks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.floor(rng.normal(size=(500, 10)) * 30).astype(np.int64) + SHIFT
    fit = spark.createDataFrame([(r,) for r in x.tolist()], "v array<long>").repartition(3)
    monkeypatch.setattr(whitening, "TASK_ROWS", (5, 7))
    s = whitening.spectrum(fit, 10)  # 72, 9, 2 and 1 spectra
    off = (x - SHIFT) - (x - SHIFT).mean(0)
    assert s.n == 500 and s.sums == x.sum(0).tolist()
    assert np.abs(s.vecs @ np.diag(s.vals) @ s.vecs.T - off.T @ off).max() < 1e-9 * np.trace(off.T @ off)


def test_unusable_rows_short_vectors_and_low_rank(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0, 3.0], [2.0, 1.0, 3.0], [0.5, 0.25, 3.0], [-1.0, 7.0, 3.0], [1.0, 2.0, 3.0]]
    bad = [None, [], [1.0, None, 2.0], [1.0, nan, 2.0], [inf, 1.0, 2.0], [1.0, 2.0, -inf], [1.0, 2.0], [1.0] * 4]
    rows = [(i, x, None, 1, 2, 3) for i, x in enumerate(good)] + [(100 + i, x, None, 1, 2, 3) for i, x in enumerate(bad)]
    got = sorted(whitening.whiten(spark.createDataFrame(rows, SCHEMA), columns=["vec_id"]).collect(), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in got] == list(range(5))
    check(got, good, 2)  # the third dimension is constant
    equal = spark.createDataFrame([(i, [1.0, 2.0], None, 1, 2, 3) for i in range(4)], SCHEMA)
    assert [(r["n"], r["deviation"], r["whitened"], r["identity_error"]) for r in whitening.whiten(equal).collect()] == [(1, 0, [], 0.0)] * 4
    none = whitening.whiten(spark.createDataFrame(rows[5:8], SCHEMA))
    assert none.count() == 0 and none.columns[-5:] == list(whitening.OUTPUT)


def test_query(spark):
    df = queries.op11_whitening(spark, "/root/testdata/sf0.001")
    assert df.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = df.collect()
    n = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").count()
    assert len(rows) == 16 * n and max(r["identity_error"] for r in rows) < 1e-9
    w = np.zeros((n, 16))
    for r in rows:
        w[r["vec_id"], r["component"] - 1] = r["whitened"]
    assert np.abs(w.T @ w / n - np.eye(16)).max() < 1e-9
