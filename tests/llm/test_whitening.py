"""Whitening against numpy's own eigenvectors and exact integers."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoremap.llm import queries as Q
from scoremap.llm.common import materialize
from scoremap.llm.whitening import deviations, eigen, polar, whiten

SF = "/root/testdata/sf0.001"
NAMES = ["component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain(rows, components=4):
    """{id: [(component, n, deviation, |whitened|, explained), ...]} of usable rows."""
    x = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(v) for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array(fit, float) - np.array(sums) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, v in x:
        dev = sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True))
        for k in range(min(components, int((values > len(sums) * 2.2e-16 * values[0]).sum()))):
            out.append((i, k + 1, n, dev, abs((np.array(v) - np.array(sums) / n) @ vectors[:, k]) / math.sqrt(values[k]), values[k] / values.sum()))
    return out


def same(got, want):
    key = lambda r: (str(r[0]), r[1], round(r[4], 6))
    got = sorted([(r["vec_id"], *(r[c] for c in NAMES[:3]), abs(r["whitened"]), r["explained"]) for r in got], key=key)
    want = sorted(want, key=key)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    assert np.allclose([r[4:] for r in got], [r[4:] for r in want], rtol=1e-9, atol=1e-9)


def test_op12(spark):
    got = Q.op12_whitening(spark, SF).collect()
    same(got, plain([tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]))
    assert len({r["identity_error"] for r in got}) == 1 and 0 <= got[0]["identity_error"] <= 1e-9
    for k in range(1, 5):  # one sign of a component for all rows, and unit variance
        z = [r["whitened"] for r in got if r["component"] == k]
        assert abs(np.mean(z)) < 1e-9 and abs(np.var(z) - 1) < 1e-9


def test_odd_rows(spark):
    rng, nan, inf = np.random.default_rng(5), float("nan"), float("inf")
    rows = [(i, rng.normal(size=5).tolist()) for i in range(40)]
    rows += [(i, rows[0][1]) for i in (0, 0, 90, None)]  # repeated vectors, ids, null id
    rows += [(50, None), (51, []), (52, [None, 1.0, 1.0, 1.0, 1.0]), (53, [nan] * 5), (54, [inf, 0.0, 0.0, 0.0, 0.0])]
    other = [(60, [1.0, 2.0]), (61, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0])]
    schema = "vec_id long, embedding array<double>, x int, _id string, n long, component string"
    df = materialize(spark.createDataFrame([(*r, 1, "a", 2, "b") for r in rows + other], schema), "v")
    same(whiten(df).collect(), plain(rows))
    for none in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        got = whiten(materialize(spark.createDataFrame(none, "vec_id long, embedding array<float>"), "v"))
        assert got.columns == ["vec_id", *NAMES] and got.collect() == []
    # rank 1, and ends of the range: deviations that no long holds are null
    line = whiten(materialize(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1e300, 4.0])], "vec_id long, embedding array<double>"), "v")).collect()
    assert {r["component"] for r in line} <= {1, 2} and all(r["deviation"] is None for r in line if r["vec_id"] == 3)
    flat = whiten(materialize(spark.createDataFrame([(i, [float(i), 2.0 * i]) for i in range(5)], "vec_id long, embedding array<double>"), "v")).collect()
    assert {r["component"] for r in flat} == {1} and len(flat) == 5 and all(abs(r["explained"] - 1) < 1e-12 for r in flat)


def test_deviations_are_exact():
    big = np.array([[2**40, -(2**41)], [3, 4]])
    assert deviations(big, 5, [7, 8]) == [None, 8**2 + 12**2] and deviations(np.array([[1, 2]]), 3, [1, 1]).tolist() == [29]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.integers(0, 2**32), st.sampled_from(["any", "twins", "low", "graded", "zero", "scalar"]))
def test_eigen(d, seed, kind):
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(d, d)))[0]
    values = {"any": rng.normal(size=d), "twins": rng.integers(0, 3, d).astype(float), "low": np.where(rng.random(d) < 0.5, 0.0, rng.random(d)), "graded": 10.0 ** -rng.integers(0, 14, d), "zero": np.zeros(d), "scalar": np.full(d, 3.0)}[kind]
    a = q @ np.diag(values) @ q.T
    a = (a + a.T) / 2
    got, v = eigen(a)
    assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.all(np.diff(got) <= 0)
    assert np.allclose(got, np.sort(values)[::-1], atol=1e-13 * max(1, np.abs(values).max()) * d)
    assert np.linalg.norm(a @ v - v * got) <= 1e-13 * d * max(np.linalg.norm(a), 1e-300)


@pytest.mark.parametrize("d", [1, 2, 17])
def test_polar_factor(d):
    a = np.random.default_rng(d).normal(size=(d, d))
    a = a + a.T
    u = polar(a)
    assert np.allclose(u @ u, np.eye(d), atol=1e-13) and np.all(np.linalg.eigvalsh(u @ a) > 0)
