"""BG/NBD and Gamma-Gamma: published example, identities, gradients, recovery."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from custval.operators.bgnbd import (
    BetaGeoParams,
    _row_terms,
    expected_purchases,
    fit_bgnbd,
    probability_of_n_purchases,
)
from custval.operators.gammagamma import (
    GammaGammaParams,
    discounted_clv,
    expected_average_profit,
    fit_gamma_gamma,
)
from custval.operators.optim import bfgs, digamma

CDNOW = BetaGeoParams(0.243, 4.414, 0.793, 2.426)


def test_cdnow_expected_purchases(spark):
    df = spark.createDataFrame([(2.0, 30.43, 38.86)], "x double, tx double, T double")
    value = df.select(expected_purchases(CDNOW, 39.0, "x", "tx", "T")).first()[0]
    assert value == pytest.approx(1.226, abs=5e-4)


def _direct_expected(p, t, x, tx, T, terms=5000):
    """Textbook form with the direct 2F1 series (slow, for checking only)."""
    a_, b_, c_ = p.r + x, p.b + x, p.a + p.b + x - 1
    z = t / (p.alpha + T + t)
    term, total = 1.0, 0.0
    for n in range(terms):
        total += term
        term *= (a_ + n) * (b_ + n) / ((c_ + n) * (n + 1)) * z
    first = (p.a + p.b + x - 1) / (p.a - 1)
    second = 1 - total * ((p.alpha + T) / (p.alpha + t + T)) ** (p.r + x)
    denom = 1 + (x > 0) * (p.a / (p.b + x - 1)) * ((p.alpha + T) / (p.alpha + tx)) ** (p.r + x)
    return first * second / denom


def _exact_expected(p, t, x, tx, T):
    """The textbook series in 60-digit decimals, summed until nothing is left."""
    from decimal import Decimal, localcontext

    with localcontext() as ctx:
        ctx.prec = 60
        r, alpha, a, b, t, x, tx, T = (Decimal(repr(float(v))) for v in (p.r, p.alpha, p.a, p.b, t, x, tx, T))
        A, B, C, z = r + x, b + x, a + b + x - 1, t / (alpha + T + t)
        term, total, n = Decimal(1), Decimal(0), 0
        while True:
            total += term
            ratio = (A + n) * (B + n) / ((C + n) * (n + 1)) * z
            term, n = term * ratio, n + 1
            if abs(ratio) < 1 and abs(term) < abs(total) * Decimal("1e-40"):
                break
        second = 1 - total * ((alpha + T) / (alpha + t + T)) ** (r + x)
        denom = 1 + (a / (b + x - 1) * ((alpha + T) / (alpha + tx)) ** (r + x) if x > 0 else 0)
        return float(C / (a - 1) * second / denom)


GRID = [
    (p, rows)
    for p, rows in [
        (CDNOW, [(0.0, 0.0, 10.0, 5.0), (3.0, 8.0, 20.0, 12.0), (12.0, 30.0, 35.0, 26.07), (0.0, 0.0, 0.5, 50.0), (4.0, 0.3, 0.5, 50.0)]),
        (BetaGeoParams(2.0, 5.0, 150.0, 300.0), [(3.0, 5.0, 6.0, 39.0), (0.0, 0.0, 1.0, 3.0), (80.0, 50.0, 60.0, 12.0)]),
        (BetaGeoParams(0.243, 4.414, 60.0, 1.2), [(1.0, 1.0, 6.0, 100.0), (2.0, 3.0, 9.0, 4.0)]),
        (BetaGeoParams(0.243, 0.05, 0.793, 2.426), [(2.0, 0.005, 0.01, 30.0)]),
        (BetaGeoParams(0.3, 4.0, 1.0 + 1e-6, 2.0), [(2.0, 30.0, 38.0, 39.0), (0.0, 0.0, 38.0, 39.0)]),
        (BetaGeoParams(0.3, 4.0, 1.0 - 1e-6, 2.0), [(2.0, 30.0, 38.0, 39.0)]),
        (BetaGeoParams(0.3, 4.0, 1e-9, 1e-5), [(2.0, 30.0, 38.0, 39.0), (1.0, 3.0, 5.0, 12.0)]),
        (BetaGeoParams(1.7, 9.0, 6.2, 8.1), [(40.0, 20.0, 30.0, 12.0), (3000.0, 100.0, 101.0, 10.0)]),
        (BetaGeoParams(0.3, 4.0, 5.0, 400.0), [(300.0, 100.0, 101.0, 10.0)]),
    ]
]


@pytest.mark.parametrize("params, rows", GRID)
def test_expected_purchases_over_a_grid(spark, params, rows):
    df = spark.createDataFrame(rows, "x double, tx double, T double, horizon double").coalesce(1)
    got = [r[0] for r in df.select(expected_purchases(params, F.col("horizon"), "x", "tx", "T")).collect()]
    for (x, tx, T, t), g in zip(rows, got, strict=True):
        assert g == pytest.approx(_exact_expected(params, t, x, tx, T), rel=1e-9)


def test_expected_purchases_at_a_equal_1(spark):
    """a = 1 divides by zero in the closed form only: the value lies between its neighbours'."""
    df = spark.createDataFrame([(2.0, 30.0, 38.0)], "x double, tx double, T double")
    near = [BetaGeoParams(0.3, 4.0, a, 2.0) for a in (1.0 - 1e-6, 1.0, 1.0 + 1e-6)]
    low, at, high = df.select(*[expected_purchases(p, 39.0, "x", "tx", "T").alias(f"c{i}") for i, p in enumerate(near)]).first()
    assert at == pytest.approx((low + high) / 2, rel=1e-9)


def test_long_horizon_without_cap(spark):
    """t / (alpha + T + t) next to 1: compared with the mean over p by brute-force integration."""
    p = BetaGeoParams(0.243, 0.05, 0.793, 2.426)
    x, T, t = 2.0, 0.01, 720.0
    u = np.linspace(-60.0, 40.0, 400_001)  # logit of the dropout probability
    q = 1.0 / (1.0 + np.exp(-u))
    weight = np.exp(p.a * -np.logaddexp(0, -u) + (p.b + x) * -np.logaddexp(0, u))
    gain = -np.expm1(-(p.r + x) * np.log1p(t / (p.alpha + T) * q)) / q
    mean = np.sum(weight * gain) / np.sum(weight)
    odds = 1 + p.a / (p.b + x - 1) * ((p.alpha + T) / (p.alpha + 0.005)) ** (p.r + x)
    df = spark.createDataFrame([(x, 0.005, T)], "x double, tx double, T double")
    assert df.select(expected_purchases(p, t, "x", "tx", "T")).first()[0] == pytest.approx(mean / odds, rel=1e-9)


def test_scores_by_distinct_pairs_equal_row_by_row(spark):
    from custval.plans.predict import score_customers

    rng = np.random.default_rng(3)
    rows = [(i, int(x), float(tx), float(tx) + 3.0, 20.0 + i) for i, (x, tx) in enumerate(zip(rng.integers(2, 6, 200), rng.integers(1, 9, 200), strict=True))]
    df = spark.createDataFrame([*rows, (999, None, 1.0, None, 5.0)], "customer_id long, frequency int, recency double, T double, monetary double")
    gg = GammaGammaParams(6.25, 3.74, 15.44)
    got = {r.customer_id: r for r in score_customers(df, CDNOW, gg).collect()}
    plain = df.select(
        "customer_id", expected_purchases(CDNOW, 4.0, "frequency", "recency", "T").alias("e"),
        discounted_clv(CDNOW, gg, "frequency", "recency", "T", "monetary", 3, 0.01, "W").alias("clv"),
    ).collect()
    assert len(got) == len(plain) == 201 and got[999].clv is None
    for r in plain[:200]:
        assert got[r.customer_id].expected_purc_1_month == pytest.approx(r.e, rel=1e-12)
        assert got[r.customer_id].clv == pytest.approx(r.clv, rel=1e-12)


def test_pmf_sums_to_one(spark):
    df = spark.createDataFrame([(2.0,), (7.5,)], "T double")
    cols = [probability_of_n_purchases(CDNOW, "T", n).alias(f"p{n}") for n in range(40)]
    for row in df.select(*cols).collect():
        assert sum(row) == pytest.approx(1.0, abs=1e-9)


def test_digamma():
    for x in (0.3, 1.0, 2.5, 7.0, 40.0):
        h = 1e-6
        fd = (math.lgamma(x + h) - math.lgamma(x - h)) / (2 * h)
        assert digamma(x) == pytest.approx(fd, abs=1e-7)


def test_bgnbd_gradient(spark):
    data = spark.createDataFrame(
        [(2.0, 0.3, 0.9), (5.0, 0.8, 1.0), (1.0, 0.0, 0.5), (0.0, 0.0, 0.7), (3.0, 0.2, 0.4)],
        "x double, tx double, T double",
    )

    def ll(p):
        row = data.selectExpr(*[f"sum({t}) AS s{j}" for j, t in enumerate(_row_terms(p))]).first()
        return row["s0"], np.array([row[f"s{j}"] for j in range(1, 5)])

    base = [0.5, 0.7, 0.9, 1.3]
    _, grad = ll(BetaGeoParams(*base))
    for k in range(4):
        up, dn = list(base), list(base)
        up[k] += 1e-6
        dn[k] -= 1e-6
        fd = (ll(BetaGeoParams(*up))[0] - ll(BetaGeoParams(*dn))[0]) / 2e-6
        assert grad[k] == pytest.approx(fd, abs=1e-6)


def test_bfgs_quadratic():
    target = np.array([1.0, -2.0, 0.5])

    def evaluate(points):
        return [(float(np.sum((p - target) ** 2)), 2 * (p - target)) for p in points]

    res = bfgs(evaluate, [0.0, 0.0, 0.0])
    assert res.converged and np.allclose(res.x, target, atol=1e-7)


def _simulate_bgnbd(rng, n, r, alpha, a, b, T_max):
    rows = []
    for i in range(n):
        lam = rng.gamma(r, 1.0 / alpha)
        p = rng.beta(a, b)
        T = float(rng.integers(20, T_max))
        t, x, tx = 0.0, 0, 0.0
        while True:
            t += rng.exponential(1.0 / lam)
            if t > T:
                break
            x, tx = x + 1, t
            if rng.random() < p:
                break
        rows.append((i, float(x), float(tx), T))
    return rows


def test_bgnbd_recovers_parameters(spark):
    rng = np.random.default_rng(42)
    rows = _simulate_bgnbd(rng, 4000, 0.8, 4.0, 0.6, 2.5, 60)
    df = spark.createDataFrame(rows, "id long, frequency double, recency double, T double")
    fit = fit_bgnbd(df, penalizer=0.0)
    p = fit.params
    assert fit.converged
    assert p.r == pytest.approx(0.8, rel=0.25)
    assert p.alpha == pytest.approx(4.0, rel=0.3)
    assert p.a == pytest.approx(0.6, rel=0.4)
    assert p.b == pytest.approx(2.5, rel=0.5)


def test_gamma_gamma_recovers_parameters(spark):
    rng = np.random.default_rng(1)
    p_true, q_true, v_true = 6.0, 4.0, 15.0
    rows = []
    for i in range(3000):
        x = int(rng.integers(1, 10))
        nu = rng.gamma(q_true, 1.0 / v_true)
        m = float(np.mean(rng.gamma(p_true, 1.0 / nu, size=x)))
        rows.append((i, float(x), m))
    df = spark.createDataFrame(rows, "id long, frequency double, monetary double")
    fit = fit_gamma_gamma(df, penalizer=0.0)
    assert fit.converged
    assert fit.params.p == pytest.approx(p_true, rel=0.2)
    assert fit.params.q == pytest.approx(q_true, rel=0.3)


def test_profit_and_clv_expressions(spark):
    gg = GammaGammaParams(6.25, 3.74, 15.44)
    df = spark.createDataFrame([(2.0, 30.43, 38.86, 35.0)], "x double, tx double, T double, m double")
    row = df.select(
        expected_average_profit(gg, "x", "m").alias("e"),
        discounted_clv(CDNOW, gg, "x", "tx", "T", "m", 3, 0.01, "W").alias("clv"),
    ).first()
    w = 6.25 * 2 / (6.25 * 2 + 2.74)
    assert row["e"] == pytest.approx((1 - w) * 15.44 * 6.25 / 2.74 + w * 35.0)
    manual, prev = 0.0, 0.0
    for i in (4.345, 8.69, 13.035):
        cur = _direct_expected(CDNOW, i, 2.0, 30.43, 38.86)
        manual += row["e"] * (cur - prev) / 1.01 ** (i / 4.345)
        prev = cur
    assert row["clv"] == pytest.approx(manual, rel=1e-9)


def test_spark_fit_equals_numpy_fit(spark):
    """The distributed objective and a numpy evaluation of it reach the same optimum."""
    from custval.operators.bgnbd import _np_row_sums, penalised

    rng = np.random.default_rng(5)
    rows = _simulate_bgnbd(rng, 1500, 0.6, 3.0, 0.8, 3.0, 50)
    df = spark.createDataFrame(rows, "id long, frequency double, recency double, T double")
    fit = fit_bgnbd(df, penalizer=0.001, warm_start=False)

    x = np.array([r[1] for r in rows]); tx = np.array([r[2] for r in rows]); T = np.array([r[3] for r in rows])
    scale = 1.0 / T.max()

    def evaluate(thetas):
        out = []
        for th in thetas:
            p = BetaGeoParams(*np.exp(th))
            ll, g = _np_row_sums(p, x, tx * scale, T * scale, np.ones_like(x))
            out.append(penalised(th, ll, g, float(len(x)), 0.001))
        return out

    local = bfgs(evaluate, np.full(4, 0.1))
    r, alpha, a, b = np.exp(local.x)
    assert fit.params.r == pytest.approx(r, rel=1e-4)
    assert fit.params.alpha == pytest.approx(alpha / scale, rel=1e-4)
    assert fit.params.a == pytest.approx(a, rel=1e-3)
    assert fit.params.b == pytest.approx(b, rel=1e-3)


def test_model_classes(spark):
    from custval.operators.bgnbd import BetaGeoModel
    from custval.operators.gammagamma import GammaGammaModel

    rng = np.random.default_rng(8)
    rows = [(i, float(x), float(tx), float(T), float(m)) for i, (_, x, tx, T) in
            enumerate(_simulate_bgnbd(rng, 800, 0.8, 4.0, 0.6, 2.5, 60)) for m in [rng.gamma(5, 8)] if x > 0]
    df = spark.createDataFrame(rows, "id long, frequency double, recency double, T double, monetary double")
    bgf = BetaGeoModel(penalizer_coef=0.001).fit(df)
    ggf = GammaGammaModel(penalizer_coef=0.01).fit(df)
    out = df.select(
        bgf.predict(4.0, "frequency", "recency", "T").alias("e"),
        ggf.conditional_expected_average_profit("frequency", "monetary").alias("p"),
        ggf.customer_lifetime_value(bgf, "frequency", "recency", "T", "monetary", time=3, freq="W").alias("clv"),
    ).collect()
    assert all(r["e"] >= 0 and r["clv"] is not None for r in out)


def test_warm_start_keeps_the_optimum(spark):
    rng = np.random.default_rng(12)
    rows = [
        (i, float(x), float(tx), float(T), float(rng.gamma(5, 8)))
        for i, (_, x, tx, T) in enumerate(_simulate_bgnbd(rng, 1500, 0.8, 4.0, 0.6, 2.5, 60))
        if x > 0
    ]
    df = spark.createDataFrame(rows, "id long, frequency double, recency double, T double, monetary double")
    pairs = [
        (fit_bgnbd(df, penalizer=0.001, warm_start=False), fit_bgnbd(df, penalizer=0.001)),
        (fit_gamma_gamma(df, penalizer=0.01, warm_start=False), fit_gamma_gamma(df, penalizer=0.01)),
    ]
    for cold, warm in pairs:
        assert cold.converged and warm.converged
        for a, b in zip(vars(cold.params).values(), vars(warm.params).values(), strict=True):
            assert a == pytest.approx(b, rel=1e-3)


def test_unscaled_times_reach_the_same_optimum(spark):
    rng = np.random.default_rng(4)
    rows = _simulate_bgnbd(rng, 800, 0.8, 4.0, 0.6, 2.5, 60)
    df = spark.createDataFrame(rows, "id long, frequency double, recency double, T double")
    a = fit_bgnbd(df, penalizer=0.0).params
    b = fit_bgnbd(df, penalizer=0.0, scale_times=False).params
    for u, v in zip(vars(a).values(), vars(b).values(), strict=True):
        assert u == pytest.approx(v, rel=1e-3)


def test_untrustworthy_fits_warn(spark):
    """All customers buy on: no dropout to learn (boundary); equal spends: q runs off; one iteration: not converged."""
    from custval.plans.predict import fit_table

    rows = [(float(x), 9.0 + x / 10, 10.0 + x / 10, 50.0) for x in range(1, 9)] * 5
    df = spark.createDataFrame(rows, "frequency double, recency double, T double, monetary double")
    with pytest.warns(UserWarning, match="boundary|converge"):
        fit = fit_bgnbd(df, penalizer=0.0, max_iter=60)
    table = {r.parameter: r.value for r in fit_table(spark, fit, "bgnbd").collect()}
    assert table["boundary"] == 1.0 or table["converged"] == 0.0
    with pytest.warns(UserWarning, match="converge"):
        short = fit_bgnbd(df, penalizer=0.001, max_iter=1, warm_start=False)
    assert not short.converged
    spread = spark.createDataFrame([(1.0, float(10.0 ** (i % 7))) for i in range(60)], "frequency double, monetary double")
    with pytest.warns(UserWarning, match="q = "):
        gg = fit_gamma_gamma(spread, penalizer=0.01)
    assert {r.parameter: r.value for r in fit_table(spark, gg, "gg").collect()}["q_at_most_1"] == 1.0


def test_sql_gamma_functions(spark):
    from custval.operators.bgnbd import np_digamma, np_lgamma, sql_digamma, sql_lgamma

    z = [1e-6, 0.01, 0.5, 1.0, 3.3, 80.0, 1e5]
    df = spark.createDataFrame([(v,) for v in z], "z double").coalesce(1)
    rows = df.selectExpr(f"{sql_lgamma('z')} AS l", f"{sql_digamma('z')} AS d").collect()
    for v, r in zip(z, rows, strict=True):
        assert r.l == pytest.approx(math.lgamma(v), rel=1e-12, abs=1e-12) and r.l == pytest.approx(float(np_lgamma(np.array(v))), rel=1e-12, abs=1e-12)
        assert r.d == pytest.approx(digamma(v), rel=1e-10) and r.d == pytest.approx(float(np_digamma(np.array(v))), rel=1e-12)
