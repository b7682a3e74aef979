"""Whitening against plain whole numbers and numpy."""

import math

import numpy as np
import pytest

from graphweave.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, x string, component int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "x", 2) for r in rows], SCHEMA).repartition(parts)


def plain(rows):
    """n, sums, covariance, and what is left: (id, vector of whole numbers)."""
    left = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({tuple(v) for _, v in left})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[k] for v in distinct) for k in range(d)]
    cov = np.array([[sum((n * v[a] - sums[a]) * (n * v[b] - sums[b]) for v in distinct) / n**3 for b in range(d)] for a in range(d)])
    return left, n, sums, cov


def make(seed, n=120, d=6, scale=1.0):
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)) @ np.diag(np.linspace(1, 3, d)) * scale
    rows = [(i, v[i].tolist()) for i in range(n)]
    rows += [(i + 500, v[0].tolist()) for i in range(200)] + [(None, v[1].tolist()), (3, v[3].tolist())]
    return rows + [(900, None), (901, [None] + [0.0] * (d - 1)), (902, [math.nan] + [0.0] * (d - 1)), (903, [math.inf] + [0.0] * (d - 1)), (904, [-0.0] * d), (905, [1.0] * (d + 1)), (906, [])]


@pytest.mark.parametrize(("seed", "scale", "d"), [(1, 1.0, 6), (2, 900.0, 3), (3, 1e-2, 2), (4, 3e9, 5)])
def test_whitening_equals_plain_sums(spark, monkeypatch, seed, scale, d):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    rows = make(seed, d=d, scale=scale)
    got = whitening.whiten(frame(spark, rows)).collect()
    left, n, sums, cov = plain([r for r in rows if r[1] is None or len(r[1]) == d])
    k = min(4, d)
    assert len(got) == k * len(left) and {r["n"] for r in got} == {n}
    deviation = {(i, sum((n * c - s) ** 2 for c, s in zip(v, sums))) for i, v in left}
    assert {(r["vec_id"], r["deviation"]) for r in got} == {(i, x if x < 1 << 63 else None) for i, x in deviation}
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    assert max(r["identity_error"] for r in got) < 1e-9 and len({r["identity_error"] for r in got}) == 1
    mean = np.array(sums) / n
    want = {}
    for i, v in left:
        want.setdefault(i, set()).add(tuple(v))
    for c in range(k):
        own = [r for r in got if r["component"] == c + 1]
        assert np.isclose(own[0]["explained"], values[c] / np.trace(cov), rtol=1e-9)
        w = {i: [(np.array(v) - mean) @ vectors[:, c] / math.sqrt(values[c]) for v in vs] for i, vs in want.items()}
        assert all(any(np.isclose(abs(r["whitened"]), abs(x), rtol=1e-6, atol=1e-8) for x in w[r["vec_id"]]) for r in own)
        sign = {np.sign(r["whitened"] * w[r["vec_id"]][0]) for r in own if abs(r["whitened"]) > 1e-6}
        assert len(sign) == 1


def test_bit_planes_give_exact_products():
    r = np.random.default_rng(5)
    x = r.integers(0, 1 << 40, size=(1000, 3), dtype=np.uint64)
    products, sums = np.zeros((3, 3, 5), np.int64), np.zeros((3, 5), np.int64)
    for at in range(0, 1000, 192):
        whitening.scatter(whitening.planes(x[at : at + 192], 40), products, sums)
    rows = x.astype(object)
    for i in range(3):
        assert sum(int(v) << 16 * k for k, v in enumerate(sums[i])) == sum(rows[:, i])
        for j in range(i, 3):
            assert sum(int(v) << 16 * k for k, v in enumerate(products[i, j])) == sum(rows[:, i] * rows[:, j])


def test_extremes(spark):
    """Entries at the ends of a long, far from zero and close together: exact, or null where 64 bits don't do."""
    rows = [(i, [2.0**54 + 64 * i, 1e300, -1e300]) for i in range(5)]
    got = whitening.whiten(frame(spark, rows)).filter("component = 1").orderBy("vec_id").collect()
    x = [math.floor(256 * v[0]) for _, v in rows]
    assert [r["deviation"] for r in got] == [(5 * a - sum(x)) ** 2 for a in x]
    far = [(1, [-1e300, 0.0]), (2, [1e300, 0.0])]
    assert {r["deviation"] for r in whitening.whiten(frame(spark, far)).collect()} == {None}


def test_no_variance(spark):
    one = whitening.whiten(frame(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])])).orderBy("vec_id", "component").collect()
    assert [tuple(r) for r in one] == [(i, c, 1, 0, None, None, 0.0) for i in (1, 2) for c in (1, 2)]
    line = whitening.whiten(frame(spark, [(i, [i / 4, i / 2]) for i in range(9)])).collect()
    assert {(r["component"], r["whitened"] is None) for r in line} == {(1, False), (2, True)}
    assert all(r["explained"] > 0.999999 for r in line if r["component"] == 1) and line[0]["identity_error"] < 1e-9


@pytest.mark.parametrize("rows", [[], [(1, None), (2, []), (3, [math.nan])]])
def test_nothing_to_fit(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
