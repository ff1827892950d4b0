import math

import numpy as np
import pytest

from corpusmill.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int, component string, n string, `x.y` int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "c", "n", 0) for i, v in rows], SCHEMA).repartition(5)


def brute(rows, k=32):
    """Covariance by exact integers, eigenvectors by LAPACK."""
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in good]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    dev = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in x]
    y = np.array([[(n * r[j] - s[j]) / n for j in range(d)] for r in x])
    u, sv, axes = np.linalg.svd(y, full_matrices=False)
    e = sv ** 2 / n
    return good, n, dev, y, axes, e


def check(spark, rows, k=32, rank=None):
    good, n, dev, y, axes, e = brute(rows)
    k = min(k, rank or len(e))
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == len(good) * k
    cells = {}
    for r in got:
        cells.setdefault((r.vec_id, r.component), []).append(r)
    sign = {}
    for i, (vec, _) in enumerate(good):
        for j in range(k):
            same = cells[vec, j + 1]
            want = y[i] @ axes[j] / math.sqrt(e[j])
            if j not in sign and abs(want) > 1e-3:
                sign[j] = np.sign(want * same[0].whitened)
            for r in same:
                assert r.n == n and r.deviation in [dev[q] for q, g in enumerate(good) if g[0] == vec]
                assert abs(r.explained - e[j] / e.sum()) <= 1e-10 * r.explained and r.identity_error < 1e-9
            assert min(abs(r.whitened * sign.get(j, 1) - want) for r in same) < 1e-7
    return got


def vectors(seed, n=300, d=12, scale=0.2):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(d, d)) * np.linspace(3, 0.2, d)
    return [[float(np.float32(c)) for c in v] for v in rng.normal(size=(n, d)) @ mixing * scale]


def test_against_exact_covariance(spark):
    rows = [(i * 3 % 601, v) for i, v in enumerate(vectors(1))]
    rows += [(1000, None), (1001, [None] + [0.1] * 11), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), rows[0], rows[0]]
    check(spark, rows)


def test_ill_conditioned(spark):
    """Dimensions that nearly depend on each other: a plain Gram matrix loses the small ones."""
    rng = np.random.default_rng(5)
    a = rng.normal(size=(200, 3)) * 1e6
    v = np.hstack([a, a[:, :1] + rng.integers(-2, 3, (200, 1)) / 64, a[:, 1:2] - a[:, 2:] + rng.integers(-2, 3, (200, 1)) / 64])
    v = np.floor(v * 64) / 64
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(v)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = W.whiten(df).collect()
    x = np.floor(v * 64)
    y = x - x.mean(axis=0)
    e = np.linalg.svd(y, compute_uv=False) ** 2 / len(y)
    assert e[0] / e[-1] > 1e12
    assert len(got) == 1000 and max(r.identity_error for r in got) < 1e-4
    for r in got[:5]:
        assert abs(r.explained - (e / e.sum())[r.component - 1]) <= 1e-4 * r.explained


@pytest.mark.parametrize("seed", [2, 3])
def test_dependent_and_constant_dimensions(spark, seed):
    rows = []
    for i, v in enumerate(vectors(seed, 80, 5)):
        v = [math.floor(64 * c) / 64 for c in v]
        rows.append((i, v + [v[0], 0.5, v[1]]))
    check(spark, rows, rank=5)


def test_edges(spark):
    assert W.whiten(frame(spark, [])).collect() == []
    assert W.whiten(frame(spark, [(1, None), (2, [])])).collect() == []
    assert W.whiten(frame(spark, [(1, [0.5, 0.25])])).collect() == []                  # nothing varies
    assert W.whiten(frame(spark, [(1, [0.5]), (1, [0.5]), (None, [0.5])])).collect() == []
    short = [(None, [1.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.5])]
    full = [(None, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [-1.0, 0.5])]
    a, b = (sorted((str(r.vec_id), r.component, r.n, r.deviation, round(abs(r.whitened), 9)) for r in W.whiten(frame(spark, x)).collect())
            for x in (short, full))
    assert a == b and len(a) == 6
    huge = W.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")).collect()
    assert len(huge) == 6 and {r.vec_id: r.deviation for r in huge} == {1: None, 2: None, 3: 64 * 64}


def test_deviation_beyond_a_long():
    m = W.Whitening(1 << 40, np.array([0], np.int64), np.ones((1, 1)), np.ones(1), np.ones(1))
    assert m.deviation(np.array([[1], [1 << 20]])).to_pylist() == [None, None]
    m.n = 1 << 20
    assert m.deviation(np.array([[1], [1 << 20]])).to_pylist() == [1 << 40, None]


def test_one_row_of_many_dimensions(spark):
    rows = [(i, [float(np.float32(c)) for c in np.random.default_rng(i).normal(size=400)]) for i in range(40)]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 40 * 32 and max(r.identity_error for r in got) < 1e-9
