"""Newton fits: Hessians against differences, the optimum against BFGS, few jobs, standard errors."""

from __future__ import annotations

import math

import numpy as np
import pytest

from custval.operators import bgnbd, gammagamma
from custval.operators.bgnbd import BetaGeoParams, fit_bgnbd, likelihood_sums, np_trigamma, penalised_newton
from custval.operators.gammagamma import GammaGammaParams, fit_gamma_gamma
from custval.operators.optim import bfgs, digamma, newton, trigamma, trust_step


def customers(seed=3, n=1500):
    rng = np.random.default_rng(seed)
    lam, p = rng.gamma(0.8, 1 / 4.0, n), rng.beta(0.6, 2.5, n)
    rows = []
    for i in range(n):
        age, t, x, last = rng.uniform(20, 60), 0.0, 0, 0.0
        while True:
            t += rng.exponential(1 / max(lam[i], 1e-9))
            if t > age:
                break
            x, last = x + 1, t
            if rng.random() < p[i]:
                break
        rows.append((i, float(x), last, age, float(rng.gamma(5, 8))))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, frequency double, recency double, T double, monetary double")


def test_trigamma():
    for z in (1e-3, 0.3, 1.0, 2.5, 7.9, 40.0, 1e4):
        slope = (digamma(z * (1 + 1e-6)) - digamma(z * (1 - 1e-6))) / (2e-6 * z)
        assert trigamma(z) == pytest.approx(slope, rel=1e-4)
        assert float(np_trigamma(np.array(z))) == pytest.approx(trigamma(z), rel=1e-11)
    assert trigamma(1.0) == pytest.approx(math.pi**2 / 6, rel=1e-13)


@pytest.mark.parametrize(
    ("terms", "make", "points"),
    [
        (bgnbd.likelihood_terms, BetaGeoParams, [(0.243, 4.414, 0.793, 2.426), (3.0, 0.2, 0.05, 9.0)]),
        (gammagamma.likelihood_terms, GammaGammaParams, [(6.25, 3.74, 15.44), (0.4, 0.3, 900.0)]),
    ],
)
def test_derivatives_against_differences(terms, make, points):
    rng = np.random.default_rng(2)
    x = np.concatenate([[1.0], rng.integers(1, 9, 30).astype(float)])
    tx, age = rng.random(31) * 5, 5 + rng.random(31) * 9
    columns = (x, tx, age) if make is BetaGeoParams else (x, age * 10)
    if make is BetaGeoParams:
        x[0] = tx[0] = 0.0

    def at(values):
        return np.array([t.sum() for t in terms(make(*values), *columns)])

    for point in points:
        k, here = len(point), at(point)
        upper = iter(here[1 + k :])
        for i in range(k):
            up, down = list(point), list(point)
            up[i] *= 1 + 1e-6
            down[i] *= 1 - 1e-6
            slope = (at(up) - at(down)) / (2e-6 * point[i])
            assert here[1 + i] == pytest.approx(slope[0], rel=2e-5, abs=1e-6)
            for j in range(i, k):
                assert next(upper) == pytest.approx(slope[1 + j], rel=2e-5, abs=1e-6)


def test_trust_steps():
    """Inside, on the rim, with negative curvature, and without a gradient along it."""
    h = np.diag([2.0, 4.0])
    np.testing.assert_allclose(trust_step(np.array([2.0, 4.0]), h, 10.0), [-1.0, -1.0])
    rng = np.random.default_rng(4)
    for h, g in [(h, np.array([20.0, 4.0])), (np.diag([-1.0, 3.0]), np.array([0.1, 1.0])), (np.diag([-1.0, 3.0]), np.array([0.0, 1.0]))]:
        p = trust_step(g, h, 0.7)
        assert np.linalg.norm(p) <= 0.7 * (1 + 1e-9)
        tries = rng.normal(size=(20_000, 2))
        tries *= 0.7 * np.sqrt(rng.random((20_000, 1))) / np.linalg.norm(tries, axis=1, keepdims=True)
        assert g @ p + 0.5 * p @ h @ p <= min(tries @ g + 0.5 * np.einsum("ij,jk,ik->i", tries, h, tries)) + 1e-6


def test_newton_on_a_curved_valley():
    def rosenbrock(x):
        a, b = x
        g = np.array([-400 * a * (b - a * a) - 2 * (1 - a), 200 * (b - a * a)])
        return 100 * (b - a * a) ** 2 + (1 - a) ** 2, g, np.array([[1200 * a * a - 400 * b + 2, -400 * a], [-400 * a, 200.0]])

    res = newton(rosenbrock, [-1.2, 1.0], gtol=1e-10)
    assert res.converged and res.iterations < 40
    np.testing.assert_allclose(res.x, [1.0, 1.0], atol=1e-9)


def test_same_optimum_as_bfgs_in_few_jobs(spark, monkeypatch):
    df = table(spark, customers())
    most = max(r[3] for r in customers())
    grouped = bgnbd.grouped_inputs(df, "frequency", "recency", "T", 1 / most).cache()

    def both(thetas):
        return [penalised_newton(t, likelihood_sums(grouped, lambda *c: bgnbd.likelihood_terms(BetaGeoParams(*np.exp(t)), *c), 4), 0.001)[:2] for t in thetas]

    slow = bfgs(both, np.full(4, 0.1), gtol=1e-8)
    jobs = []
    monkeypatch.setattr(bgnbd, "likelihood_sums", lambda *a, run=bgnbd.likelihood_sums: jobs.append(1) or run(*a))
    fit = fit_bgnbd(df, scale_times=True)
    r, alpha, a, b = np.exp(slow.x)
    np.testing.assert_allclose([fit.params.r, fit.params.alpha, fit.params.a, fit.params.b], [r, alpha * most, a, b], rtol=1e-6)
    again = fit_bgnbd(df, warm_start=False)
    np.testing.assert_allclose(list(vars(fit.params).values()), list(vars(again.params).values()), rtol=1e-6)
    assert fit.converged and fit.iterations <= 5 and len(jobs) - again.iterations - 1 <= 6


def test_standard_errors(spark):
    """They shrink with the customers, and cover the spread of fits to other samples of them."""
    fit = fit_bgnbd(table(spark, customers(5)), penalizer=0.0)
    twice = fit_bgnbd(table(spark, [r for r in customers(5) for _ in range(4)]), penalizer=0.0)
    for name in vars(fit.params):
        assert twice.errors[name] == pytest.approx(fit.errors[name] / 2, rel=1e-3)
    others = [fit_bgnbd(table(spark, customers(s)), penalizer=0.0).params for s in (6, 7, 8)]
    for name, error in fit.errors.items():
        assert all(abs(getattr(o, name) - getattr(fit.params, name)) < 6 * error for o in others)
    gg = fit_gamma_gamma(table(spark, [r for r in customers(5) if r[1] > 0]))
    assert set(gg.errors) == {"p", "q", "v"} and all(e is None or e > 0 for e in gg.errors.values())


def test_no_error_without_curvature():
    flat = bgnbd.standard_errors(["a", "b"], np.array([1.0, 2.0]), np.diag([1.0, 0.0]), 100.0)
    assert flat == {"a": None, "b": None} and bgnbd.standard_errors(["a"], np.array([1.0]), None, 1.0) == {"a": None}
    assert bgnbd.standard_errors(["a"], np.array([3.0]), np.array([[4.0]]), 25.0)["a"] == pytest.approx(3.0 * 0.5 / 5)
