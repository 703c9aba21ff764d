"""The Gauss-Jacobi rule of the expected purchases: moments, error bound, and the double-exponential rule beside it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from custval.operators import bgnbd as B
from custval.operators.bgnbd import BetaGeoParams, expected_if_alive

POINTS = [
    BetaGeoParams(0.243, 4.414, 0.793, 2.426),
    BetaGeoParams(1.7, 9.0, 6.2, 8.1),
    BetaGeoParams(0.05, 0.4, 0.02, 0.3),
    BetaGeoParams(3.0, 30.0, 1.0, 20.0),  # a = 1
    BetaGeoParams(1.0, 10.0, 300.0, 0.2),  # a > 100
    BetaGeoParams(1.0, 10.0, 0.4, 0.6),  # a + b = 1
    BetaGeoParams(1.0, 10.0, 1.0, 1e-3),
]


@pytest.mark.parametrize("n", [2, 8, 40])
@pytest.mark.parametrize(("a", "c"), [(0.793, 2.426), (0.4, 0.6), (0.02, 0.3), (300.0, 0.2), (1.0, 1e5), (0.5, 0.5)])
def test_rule_has_the_moments_of_the_weight(a, c, n):
    """Powers below 2 n: E p ** j = a (a + 1) ... / ((a + c) (a + c + 1) ...)."""
    nodes, weights = B.jacobi_rule(a, c, n)
    assert (nodes >= 0).all() and (nodes <= 1).all() and weights.sum() == pytest.approx(1.0, rel=1e-12)
    moment = 1.0
    for j in range(1, min(2 * n, 24)):
        moment *= (a + j - 1) / (a + c + j - 1)
        if moment < 1e-250:
            break
        assert float(nodes**j @ weights) == pytest.approx(moment, rel=1e-9)


@pytest.mark.parametrize("p", POINTS)
def test_rule_equals_the_double_exponential_rule(p):
    x = np.array([0.0, 1.0, 4.0, 30.0, 300.0, 5000.0, 1e6])
    s = np.array([1e-6, 1e-3, 0.1, 1.0, 5.0, 20.0])
    grid = np.array([(i, j) for i in x for j in s])
    got = B.mean_gain(p, grid[:, 0], grid[:, 1])
    want = [B._wide_mean(p.a, p.b + i, p.r + i, j) for i, j in grid]
    np.testing.assert_allclose(got, want, rtol=2e-10)


@pytest.mark.parametrize("p", POINTS)
def test_bound_holds_and_twice_the_nodes_change_nothing(p):
    for x in (0.0, 2.0, 25.0, 200.0):
        for s in (0.01, 0.5, 3.0, 12.0):
            k, c = p.r + x, p.b + x
            n = int(B.gauss_nodes(p.a, np.array([c]), np.array([k]), np.array([s]))[0])
            once, twice = (float(B.gain(nodes, k, s) @ weights) for nodes, weights in (B.jacobi_rule(p.a, c, m) for m in (n, 2 * n)))
            assert once == pytest.approx(twice, rel=1e-11)
    few = B.gauss_nodes(p.a, np.array([p.b + 3]), np.array([p.r + 3]), np.array([1.0]))
    assert few[0] <= 40


def test_node_count_grows_with_s():
    p = POINTS[0]
    s = np.geomspace(1e-3, 1e3, 30)
    n = B.gauss_nodes(p.a, np.full(30, p.b), np.full(30, p.r), s)
    assert (np.diff(n) >= 0).all() and n[0] == 8 and n[-1] > B.MOST_NODES


def test_unsettled_integral_is_an_error(monkeypatch):
    monkeypatch.setattr(B, "LEAST_STEP", 0.2)
    with pytest.raises(ArithmeticError):
        B.mean_gain(POINTS[0], np.array([0.0]), np.array([1e4]))


def test_column_form(spark):
    """Null inputs give null, several horizons and columns as horizons, order of rows kept."""
    p = POINTS[0]
    rows = [(1.0, 10.0, 3.0), (0.0, 2.0, 39.0), (None, 2.0, 1.0), (1.0, None, 1.0), (7.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "x double, T double, horizon double")
    got = [r.e for r in df.select(expected_if_alive(p, [4.0, F.col("horizon")], "x", "T").alias("e")).collect()]
    assert got[2] is None and got[3] is None
    for i in (0, 1, 4):
        x, age, t = rows[i]
        for value, horizon in zip(got[i], (4.0, t), strict=True):
            want = 0.0 if horizon == 0 else B._wide_mean(p.a, p.b + x, p.r + x, horizon / (p.alpha + age))
            assert value == pytest.approx(want, rel=1e-10)


def test_rows_are_cheap():
    """A hundred thousand distinct pairs in seconds (they took 3 ms each as interpreted expressions)."""
    import time

    rnd = np.random.default_rng(5)
    x, s = rnd.integers(1, 60, 100_000).astype(float), 12.0 / (4.4 + rnd.random(100_000) * 300)
    began = time.process_time()
    out = B.mean_gain(POINTS[0], x, s)
    assert np.isfinite(out).all() and time.process_time() - began < 10
    assert not math.isnan(out.sum())
