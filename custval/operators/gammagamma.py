"""Gamma-Gamma spend model (Fader & Hardie 2013) and discounted CLV.

Inputs per customer: ``x`` = number of transactions (> 0) and ``m`` = mean
transaction value (> 0).  Per-customer log-likelihood:

    LL = lnG(px+q) - lnG(px) - lnG(q) + q ln v + (px-1) ln m + px ln x
         - (px+q) ln(xm+v)

Its sum over the table grouped by (x, m), with gradient and Hessian, is one job per Newton
iteration (as in ``bgnbd``).
Objective: mean negative log-likelihood + ``penalizer * sum(params**2)`` over
log parameters starting at 0.1.

With q <= 1 the population mean of the spend does not exist: E[M | x, m] is then not a
shrunk mean (the weight of the observed mean exceeds 1), and ``fit_gamma_gamma`` warns.

CLV over ``time`` periods of ``factor`` model time units (4.345 weeks per
month for ``freq="W"``), discounted per period:

    sum_i  E[M] * (E[X(i f)] - E[X((i-1) f)]) / (1 + d) ** i
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custval.functions.numeric import col_of
from custval.operators.bgnbd import (
    BetaGeoParams,
    FitResult,
    alive_odds,
    expected_if_alive,
    fit_result,
    likelihood_sums,
    np_digamma,
    np_lgamma,
    np_trigamma,
    penalised,
    penalised_newton,
    sql_digamma,
    sql_double,
    sql_lgamma,
)
from custval.operators.optim import bfgs, digamma, newton, trigamma
from custval.session import materialize

# Model time units per month for each period code.
PERIODS_PER_MONTH = {"W": 4.345, "M": 1.0, "D": 30.0, "H": 30.0 * 24}


@dataclass(frozen=True)
class GammaGammaParams:
    p: float
    q: float
    v: float


def expected_average_profit(params: GammaGammaParams, frequency: Column | str, monetary: Column | str) -> Column:
    """E[M | x, m] = p (v + x m) / (p x + q - 1): the observed mean shrunk towards the population mean v p / (q - 1).

    For q <= 1 the population mean does not exist and the value is above the observed mean; null where p x + q <= 1.
    """
    p, q, v = params.p, params.q, params.v
    x = col_of(frequency).cast("double")
    m = col_of(monetary).cast("double")
    below = F.lit(p) * x + F.lit(q - 1.0)
    return F.when(below > 0, F.lit(p) * (F.lit(v) + x * m) / below)


def check_inputs(df: DataFrame, frequency: str, monetary: str):
    """Validate in one pass; returns the row with the count and the range of ln m."""
    x, m = F.col(frequency).cast("double"), F.col(monetary).cast("double")
    row = df.agg(
        F.count("*").alias("n"),
        F.count_if(x.isNull() | m.isNull()).alias("nulls"),
        F.count_if(m <= 0).alias("non_positive_monetary"),
        F.count_if(x <= 0).alias("non_positive_frequency"),
        F.count_if(x != F.floor(x)).alias("non_integer"),
    ).collect()[0]
    problems = {
        k: row[k]
        for k in ("nulls", "non_positive_monetary", "non_positive_frequency", "non_integer")
        if row[k]
    }
    if problems:
        raise ValueError(f"invalid Gamma-Gamma inputs: {problems}")
    if row["n"] == 0:
        raise ValueError("no customers to fit")
    return row


def _row_terms(pr: GammaGammaParams, x: str = "x", m: str = "m") -> list[str]:
    """Log-likelihood of a row and its gradient in (p, q, v), as SQL."""
    p, q, v = (sql_double(val) for val in (pr.p, pr.q, pr.v))
    px, pxq, ln_xmv = f"({p} * {x})", f"({p} * {x} + {q})", f"ln({x} * {m} + {v})"
    fixed = sql_double(pr.q * math.log(pr.v) - math.lgamma(pr.q))
    return [
        f"{fixed} + {sql_lgamma(pxq)} - {sql_lgamma(px)} + ({px} - 1.0D) * ln({m}) + {px} * ln({x}) - {pxq} * {ln_xmv}",
        f"{x} * ({sql_digamma(pxq)} - {sql_digamma(px)} + ln({m}) + ln({x}) - {ln_xmv})",
        f"{sql_double(math.log(pr.v) - digamma(pr.q))} + {sql_digamma(pxq)} - {ln_xmv}",
        f"{q} / {v} - {pxq} / ({x} * {m} + {v})",
    ]


def _np_row_sums(pr: GammaGammaParams, x, m, w) -> tuple[float, np.ndarray]:
    """:func:`_row_terms` weighted and summed with numpy (warm start)."""
    p, q, v = pr.p, pr.q, pr.v
    ln_xmv, pxq = np.log(x * m + v), p * x + q
    ll = q * math.log(v) - math.lgamma(q) + np_lgamma(pxq) - np_lgamma(p * x) + (p * x - 1) * np.log(m) + p * x * np.log(x) - pxq * ln_xmv
    grads = [
        x * (np_digamma(pxq) - np_digamma(p * x) + np.log(m) + np.log(x) - ln_xmv),
        math.log(v) - digamma(q) + np_digamma(pxq) - ln_xmv,
        q / v - pxq / (x * m + v),
    ]
    return float(np.sum(w * ll)), np.array([float(np.sum(w * g)) for g in grads])


def likelihood_terms(pr: GammaGammaParams, x, m) -> list[np.ndarray]:
    """Log-likelihood of every row, its gradient in (p, q, v), and the upper triangle of its Hessian."""
    p, q, v = pr.p, pr.q, pr.v
    px, pxq, xmv = p * x, p * x + q, x * m + v
    ln_xmv, more = np.log(xmv), np_trigamma(pxq)
    ll = q * math.log(v) - math.lgamma(q) + np_lgamma(pxq) - np_lgamma(px) + (px - 1) * np.log(m) + px * np.log(x) - pxq * ln_xmv
    grad = [
        x * (np_digamma(pxq) - np_digamma(px) + np.log(m) + np.log(x) - ln_xmv),
        math.log(v) - digamma(q) + np_digamma(pxq) - ln_xmv,
        q / v - pxq / xmv,
    ]
    hess = [x**2 * (more - np_trigamma(px)), x * more, -x / xmv, more - trigamma(q), 1.0 / v - 1.0 / xmv, -q / v**2 + pxq / xmv**2]
    return [ll, *grad, *hess]


def objective_values(grouped: DataFrame, params: Sequence[GammaGammaParams], penalizer: float) -> list[tuple[float, np.ndarray]]:
    """The fit's objective and gradient at each of ``params``, by one aggregate over (x, m, w)."""
    aggs = ["sum(w) AS n"]
    aggs += [f"sum(w * ({term})) AS s{k}_{j}" for k, pr in enumerate(params) for j, term in enumerate(_row_terms(pr))]
    row = grouped.selectExpr(*aggs).first()
    return [
        penalised(np.log([pr.p, pr.q, pr.v]), row[f"s{k}_0"], np.array([row[f"s{k}_{j}"] for j in range(1, 4)]), row["n"], penalizer)
        for k, pr in enumerate(params)
    ]


#: Warm start: the table binned to this many steps of ln x and ln m, so of bounded size whatever the data.
WARM_BINS = 64


def _warm_start(grouped: DataFrame, penalizer: float):
    """(start point, inverse-Hessian estimate) fitted to the binned table, at most about WARM_BINS ** 2 rows."""
    start = np.full(3, 0.1)
    ln_x, ln_m = F.log("x"), F.log("m")
    ends = grouped.agg(F.min(ln_x).alias("ax"), F.max(ln_x).alias("bx"), F.min(ln_m).alias("am"), F.max(ln_m).alias("bm")).first()

    def step(c, a, b):
        return F.floor((c - F.lit(a)) / F.lit(max(b - a, 1e-9)) * F.lit(float(WARM_BINS)))

    means = [F.exp(F.sum(F.log(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("x", "m")]
    bins = [step(ln_x, ends["ax"], ends["bx"]).alias("i"), step(ln_m, ends["am"], ends["bm"]).alias("j")]
    coarse = grouped.groupBy(*bins).agg(*means, F.sum("w").alias("w")).collect()
    x, m, w = (np.array([r[c] for r in coarse], dtype=float) for c in ("x", "m", "w"))

    def evaluate(thetas):
        out = []
        for th in thetas:
            with np.errstate(all="ignore"):
                out.append(penalised(th, *_np_row_sums(GammaGammaParams(*np.exp(th)), x, m, w), w.sum(), penalizer))
        return out

    res = bfgs(evaluate, start, gtol=1e-5, max_iter=500)
    return (res.x, res.inverse_hessian) if np.all(np.isfinite(res.x)) else (start, None)


def grouped_inputs(df: DataFrame, frequency: str, monetary: str) -> DataFrame:
    """Customers counted by (x, m)."""
    columns = [F.col(frequency).cast("double").alias("x"), F.col(monetary).cast("double").alias("m")]
    return df.select(*columns).groupBy("x", "m").agg(F.count("*").cast("double").alias("w"))


def fit_gamma_gamma(
    df: DataFrame,
    frequency: str = "frequency",
    monetary: str = "monetary",
    penalizer: float = 0.01,
    tol: float = 1e-7,
    max_iter: int = 200,
    warm_start: bool = True,
) -> FitResult:
    """Penalised maximum-likelihood Gamma-Gamma parameters via Spark aggregates.

    The input is read twice: for the checks, and to write the grouped table that
    all iterations read.  Warns for q <= 1, no convergence, or a boundary.
    """
    rows = check_inputs(df, frequency, monetary)["n"]
    grouped = materialize(grouped_inputs(df, frequency, monetary), "gamma_gamma_grouped")

    def evaluate(theta):
        params = GammaGammaParams(*np.exp(theta).tolist())
        return penalised_newton(theta, likelihood_sums(grouped, partial(likelihood_terms, params), 3), penalizer)

    start = _warm_start(grouped, penalizer)[0] if warm_start else np.full(3, 0.1)
    res = newton(evaluate, start, gtol=tol, max_iter=max_iter)
    params = GammaGammaParams(*np.exp(res.x).tolist())
    if params.q <= 1:
        warnings.warn(f"Gamma-Gamma q = {params.q:.4g} <= 1: the expected average profit is no shrunk mean", stacklevel=2)
    return fit_result("Gamma-Gamma", params, res, rows)


def purchase_horizons(time: int, freq: str = "W") -> list[float]:
    """The model times i * factor, i = 1..time, as the common implementation computes them."""
    factor = PERIODS_PER_MONTH[freq]
    return [float(t) for t in np.arange(1, time + 1) * factor]


def discounted_clv(
    bg: BetaGeoParams,
    gg: GammaGammaParams,
    frequency: Column | str,
    recency: Column | str,
    T: Column | str,
    monetary: Column | str,
    time: int = 12,
    discount_rate: float = 0.01,
    freq: str = "D",
) -> Column:
    """Discounted CLV over ``time`` months (column expression)."""
    gains = expected_if_alive(bg, purchase_horizons(time, freq), frequency, T)
    profit = expected_average_profit(gg, frequency, monetary)
    return profit * discounted_gain(gains, discount_weights(time, discount_rate, freq)) / alive_odds(bg, frequency, recency, T)


def discount_weights(time: int, discount_rate: float, freq: str) -> list[float]:
    """Weights of E[X(t_1)], E[X(t_2)], ... in the sum of the discounted monthly differences."""
    factor = PERIODS_PER_MONTH[freq]
    rates = [(1 + discount_rate) ** -(t / factor) for t in purchase_horizons(time, freq)]
    return [d - e for d, e in zip(rates, [*rates[1:], 0.0], strict=True)]


def discounted_gain(gains: Column, weights: Sequence[float]) -> Column:
    """The weighted sum of an array column."""
    parts = F.zip_with(gains, F.array(*[F.lit(w) for w in weights]), lambda g, w: g * w)
    return F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v)


class GammaGammaModel:
    """Fitter-style wrapper: ``fit`` a DataFrame, then build column expressions."""

    def __init__(self, penalizer_coef: float = 0.0):
        self.penalizer_coef = penalizer_coef
        self.result: FitResult | None = None

    @property
    def params(self) -> GammaGammaParams:
        if self.result is None:
            raise ValueError("fit the model first")
        return self.result.params

    def fit(self, df: DataFrame, frequency: str = "frequency", monetary: str = "monetary", **kw):
        self.result = fit_gamma_gamma(df, frequency, monetary, self.penalizer_coef, **kw)
        return self

    def conditional_expected_average_profit(self, frequency, monetary) -> Column:
        return expected_average_profit(self.params, frequency, monetary)

    def customer_lifetime_value(
        self, transaction_model, frequency, recency, T, monetary, time=12, discount_rate=0.01, freq="D"
    ) -> Column:
        return discounted_clv(
            transaction_model.params, self.params, frequency, recency, T, monetary, time, discount_rate, freq
        )
