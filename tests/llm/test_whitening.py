"""Whitening against eigenvectors in double precision, closed forms, and defined results."""

import math

import numpy as np
import pytest

from terrane.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def rows_of(spark, rows, more=""):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>{more}")
    return [r.asDict() for r in whitening.whitening_digest(df).collect()]


def check(got, vectors):
    """``got`` against numpy: vectors by id, all of one length, eigenvalues apart."""
    x = {i: np.floor(256 * np.array(v, float)).astype(int) for i, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    n, s = len(fit), fit.sum(axis=0)
    centred = fit - s / n
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1], u[:, ::-1]
    sign = {}
    for r in got:
        k, v = r["component"] - 1, x[r["vec_id"]]
        assert r["n"] == n and r["deviation"] == sum((n * int(a) - int(b)) ** 2 for a, b in zip(v, s, strict=True))
        assert r["explained"] == pytest.approx(e[k] / e.sum(), rel=1e-9) and r["identity_error"] < 1e-9
        want = (v - s / n) @ u[:, k] / math.sqrt(e[k])
        if abs(want) > 1e-6:
            assert sign.setdefault(k, np.sign(want * r["whitened"])) * r["whitened"] == pytest.approx(want, rel=1e-7, abs=1e-8)


def test_query_equals_brute_force(spark):
    got = [r.asDict() for r in queries.queries()["op13_whitening"](spark, SF).collect()]
    rows = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert len(got) == 4 * len(rows)
    check(got, rows)


def test_copies_nulls_and_clashing_columns(spark):
    rng = np.random.default_rng(0)
    vectors = {i: [float(v) for v in rng.normal(size=6) * [9, 5, 3, 2, 1, 1]] for i in range(40)}
    vectors |= {100 + i: vectors[3] for i in range(50)}
    bad = [(900, None), (901, [1.0, None, 2.0, 0.0, 0.0, 0.0]), (902, [math.nan] * 6), (903, [math.inf] + [0.0] * 5), (904, []), (905, [1e300] * 6)]
    rows = [(i, v, "x", 1) for i, v in [*vectors.items(), *bad]]
    got = rows_of(spark, rows + [rows[0]], ", x string, component int")
    assert len(got) == 4 * (len(vectors) + 1) and {r["vec_id"] for r in got} == set(vectors)
    check(got, vectors)


def test_close_and_multiple_eigenvalues():
    axes = [[s * 5.0 * (k == j) for j in range(5)] for k in range(5) for s in (1, -1)]
    x = np.floor(256 * np.array(axes)).astype(np.int64)
    n, c = len(x), len(x) * x.T @ x - np.outer(x.sum(0), x.sum(0))
    p = whitening.primes(32)
    mod = whitening.polynomials(c.astype(object), p)
    coefficients = [whitening.remaindered(mod[:, k].tolist(), list(p)) for k in range(6)]
    assert coefficients[5] == 1 and coefficients[4] == -int(np.trace(c))
    for root in [int(c[0, 0])]:
        assert sum(v * root**k for k, v in enumerate(coefficients)) == 0  # a scalar matrix: one root, five times
    i, j = np.triu_indices(5)
    m = whitening.model_of(5, n, "0 0 0 0 0", " ".join(map(str, c[i, j])), [str(v) for v in coefficients], 4)
    u = np.array(m["directions"]).reshape(4, 5)
    assert np.allclose(u @ u.T, np.eye(4), atol=1e-15) and np.allclose(m["explained"], 0.2)
    near = np.diag([10**15 + 1, 10**15, 10**15 - 1, 5, 0]).astype(object)
    roots = [10**15 + 1, 10**15, 10**15 - 1, 5, 0]
    coefficients = [1]
    for r in roots:  # times (x - r)
        coefficients = [(coefficients[k - 1] if k else 0) - r * (coefficients[k] if k < len(coefficients) else 0) for k in range(len(coefficients) + 1)]
    m = whitening.model_of(5, 1, "0 0 0 0 0", " ".join(map(str, near[i, j])), [str(v) for v in coefficients], 5)
    assert np.allclose(np.abs(np.array(m["directions"]).reshape(5, 5)[:4]), np.eye(5)[:4], atol=1e-12)
    assert np.allclose(m["eigenvalues"], roots, rtol=1e-15) and m["explained"][4] == 0


def test_products_of_large_entries():
    rng = np.random.default_rng(1)
    x = rng.integers(-(1 << 62), 1 << 62, (50, 3))
    assert (whitening.products(x) == x.T.astype(object) @ x.astype(object)).all()
    assert [v.tolist() for _, v in whitening.unpacked(whitening.packed(x[:2]))] == [x[:2].tolist()]


def test_few_rows_and_lengths(spark):
    assert rows_of(spark, []) == []
    one = rows_of(spark, [(1, [1.0, 2.0])])
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in one] == [(1, 0, None, None)] * 2
    two = rows_of(spark, [(1, [0.0]), (2, [1.0]), (3, [0.0, 1.0, 2.0]), (None, [3.0, 0.0, 2.0])])
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in two) == [(0, 1, 2), (0, 2, 2), (0, 3, 2), (1, 1, 2), (2, 1, 2), (3, 1, 2), (3, 2, 2), (3, 3, 2)]
    assert all(abs(abs(r["whitened"]) - 1) < 1e-12 for r in two if r["component"] == 1)
    large = rows_of(spark, [(i, [v, 1.0]) for i, v in enumerate([1e15, -1e15, 3e15])])
    assert all(r["identity_error"] < 1e-9 and r["whitened"] is not None for r in large if r["component"] == 1)
