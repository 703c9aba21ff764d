"""BG/NBD purchase model (Fader, Hardie & Lee 2005) on Spark DataFrames.

Inputs per customer: ``x`` = number of transactions, ``tx`` = time between
first and last transaction, ``T`` = time between first transaction and the
analysis date (the same time unit, e.g. weeks).

Fit.  The log-likelihood of one customer is

    LL = [lnG(r+x) - lnG(r) + r ln a_]                         (x only)
       + [lnG(a+b) + lnG(b+x) - lnG(b) - lnG(a+b+x)]           (x only)
       + ln(exp(A3) + [x > 0] exp(A4))                          (per row)
    A3 = -(r+x) ln(alpha+T)
    A4 = ln a - ln(b + max(x,1) - 1) - (r+x) ln(alpha+tx)

Its sum over the table pre-grouped by (x, tx, T), with gradient and Hessian, is made
batch by batch (``likelihood_terms``; the gamma functions by Stirling's series after a
shift by 8); fifteen numbers reach the driver.  The objective alone is also there as
column arithmetic (``objective_values``).  It is
the weighted mean negative log-likelihood plus ``penalizer * sum(params**2)``,
minimised over log parameters from 0.1 with the times scaled so that max(T) = 1
(``scale_times``; alpha is scaled back afterwards) - the conventions of the common
Python implementation.

Prediction.  Given that a customer is alive, the dropout probability p is
Beta(a, b + x) and the purchase rate Gamma(r + x, alpha + T), so with
s = t / (alpha + T) the expected purchases until t are the mean over p of

    g(p) = (1 - (1 + s p) ** -(r + x)) / p

(the hypergeometric closed form is this integral; it divides by a - 1 and its
series needs ever more terms as t / (alpha + T + t) nears 1, the integral does
not).  The mean is a Gauss sum over the Jacobi polynomials of the customer's own Beta
weight: the nodes are the eigenvalues of the weight's Jacobi matrix (Golub & Welsch 1969),
one matrix for each distinct x.  g is analytic but for p = -1 / s, which bounds the
error of n nodes (``gauss_nodes``), so that a row takes as many as it needs, 8 to 40 for usual
horizons.  Rows with s so large that ``MOST_NODES`` would not do are integrated by the
double-exponential rule, p = 1 / (1 + exp(-pi sinh u)) on an even grid of u, refined until it
stands still.  Both are numpy over Arrow batches (a vectorised UDF without a shuffle), once
for each distinct (x, s) of a batch.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custval.functions.numeric import col_of
from custval.operators.optim import bfgs, digamma, newton, trigamma
from custval.session import materialize

@dataclass(frozen=True)
class BetaGeoParams:
    r: float
    alpha: float
    a: float
    b: float


#: A parameter this small or large has run to the boundary: the log-likelihood hardly depends on it there.
BOUNDARY = (1e-4, 1e6)


@dataclass
class FitResult:
    """``objective`` is the penalised mean negative log-likelihood (of the scaled times), ``rows`` the number of customers,
    ``errors`` the parameters' standard errors (None each where the objective does not curve upwards: no optimum inside)."""

    params: object
    objective: float
    iterations: int
    converged: bool
    boundary: bool = False
    rows: int | None = None
    errors: dict[str, float | None] | None = None


def fit_result(model: str, params, res, rows: int | None = None) -> FitResult:
    """The result of a fit; warns if it should not be trusted."""
    boundary = [k for k, v in vars(params).items() if not BOUNDARY[0] < v < BOUNDARY[1]]
    if not res.converged:
        warnings.warn(f"the {model} fit did not converge in {res.iterations} iterations", stacklevel=3)
    if boundary:
        warnings.warn(f"the {model} fit ended at the boundary for {', '.join(boundary)}", stacklevel=3)
    errors = standard_errors(list(vars(params)), np.array(list(vars(params).values())), res.hessian, rows) if rows else None
    return FitResult(params, res.fun, res.iterations, res.converged, bool(boundary), rows, errors)


#: Relative error that the rules keep to, and the most Gauss nodes (more: the double-exponential rule).
RULE_TOL = 1e-12
MOST_NODES = 96
#: Finest step of the double-exponential rule.
LEAST_STEP = 1e-4
#: Values of g held at a time.
HELD = 1 << 20


def gain(p: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """g(p) = (1 - (1 + s p) ** -k) / p, with its limit k s at 0."""
    small = np.abs(p) < 1e-300
    q = np.where(small, 1.0, p)
    return np.where(small, k * s, -np.expm1(-k * np.log1p(s * q)) / q)


@lru_cache(maxsize=4096)
def jacobi_rule(a: float, c: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and weights (of sum 1) that give the mean over Beta(a, c) of any polynomial below degree 2 n.

    The three-term recurrence is that of the weight on (0, 1), in a form without cancellation.
    """
    i = np.arange(1.0, n)
    both = a + c - 2.0
    diagonal = np.empty(n)
    diagonal[0] = a / (a + c)
    diagonal[1:] = (2.0 * i * (i + both + 1.0) + both * a) / ((2.0 * i + both) * (2.0 * i + both + 2.0))
    off = i * (i + c - 1.0) * (i + a - 1.0) * (i + both) / ((2.0 * i + both) ** 2 * (2.0 * i + both + 1.0))
    beside = np.empty(n - 1)
    beside[1:] = off[1:] / (2.0 * i[1:] + both - 1.0)
    beside[:1] = a * c / ((a + c) ** 2 * (a + c + 1.0))  # the variance: the general form is 0 / 0 for a + c = 1
    matrix = np.diag(diagonal) + np.diag(np.sqrt(beside), 1) + np.diag(np.sqrt(beside), -1)
    nodes, vectors = np.linalg.eigh(matrix)
    return np.maximum(nodes, 0.0), vectors[0] ** 2


def gauss_nodes(a: float, c: np.ndarray, k: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Nodes that keep the Gauss sum within RULE_TOL of the mean of g (a multiple of 8).

    Inside the ellipse of radii sum rho / 2 around (0, 1) g is analytic while the ellipse ends right of -1 / s, at
    -d; there |g| <= k s (1 - s d) ** -(k + 1), and n nodes err by 4 max|g| rho ** -2n / (1 - 1 / rho) at most
    (weights are positive, of sum 1).  The best rho of a grid counts; the mean is g(a / (a + c)) at least (g is convex).
    """
    least = np.full(len(s), np.inf)
    mean = gain(a / (a + c), k, s)
    for share in (0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9):
        d = share / s
        log_rho = np.log1p(2.0 * d + 2.0 * np.sqrt(d * (1.0 + d)))
        log_most = np.log(4.0 * k * s / mean) - (k + 1.0) * math.log1p(-share) - np.log(-np.expm1(-log_rho))
        least = np.minimum(least, (log_most - math.log(RULE_TOL)) / (2.0 * log_rho))
    return (8 * np.ceil(np.maximum(least, 1.0) / 8.0)).astype(np.float64)


def _wide_mean(a: float, c: float, k: float, s: float) -> float:
    """The mean of g over Beta(a, c) by the double-exponential rule.

    The chord g(0) (1 - p) + g(1) p has a mean in closed form, the rest is summed over nodes that reach to where
    p ** (a + 1) (1 - p) ** (c + 1) has fallen by e ** -45 from its peak.
    """

    def reach(power: float) -> float:
        return 45.0 / power + math.sqrt(90.0 / power) + 4.0

    peak = math.log((a + 1.0) / (c + 1.0))
    ends = [math.asinh(v / math.pi) for v in (peak - reach(a + 1.0), peak + reach(c + 1.0))]
    g0, g1 = k * s, -math.expm1(-k * math.log1p(s))
    shift = (a + 1.0) * math.log((a + 1.0) / (a + c + 2.0)) + (c + 1.0) * math.log((c + 1.0) / (a + c + 2.0))
    step, last = 0.25, math.nan
    while step > LEAST_STEP:
        u = np.arange(math.floor(ends[0] / step), math.ceil(ends[1] / step) + 1) * step
        v = math.pi * np.sinh(u)
        ln_p, ln_q = -np.logaddexp(0.0, -v), -np.logaddexp(0.0, v)
        w = np.exp((a + 1.0) * ln_p + (c + 1.0) * ln_q + np.log(math.pi * np.cosh(u)) - shift)
        p, q = np.exp(ln_p), np.exp(ln_q)
        rest = float(np.sum(w * ((gain(p, k, s) - g0 * q - g1 * p) / (p * q))) / np.sum(w))
        mean = (g0 * c + g1 * a) / (a + c) + rest * a * c / ((a + c) * (a + c + 1.0))
        if abs(mean - last) <= 10.0 * RULE_TOL * (abs(mean) + 1e-3 * g0):
            return mean
        step, last = step / 2.0, mean
    raise ArithmeticError(f"expected purchases: the integral does not settle for a={a}, c={c}, k={k}, s={s}")


def mean_gain(params: BetaGeoParams, x: np.ndarray, s: np.ndarray) -> np.ndarray:
    """The mean of g over Beta(a, b + x) for arrays of x and s = t / (alpha + T) >= 0."""
    pairs, back = np.unique(np.column_stack([x, s]), axis=0, return_inverse=True)
    x, s = pairs[:, 0], pairs[:, 1]
    out = np.where(s == 0, 0.0, np.nan)
    at = np.flatnonzero((s > 0) & np.isfinite(s) & np.isfinite(x))
    nodes = gauss_nodes(params.a, params.b + x[at], params.r + x[at], s[at])
    wide = nodes > MOST_NODES
    for i in at[wide]:
        out[i] = _wide_mean(params.a, params.b + x[i], params.r + x[i], s[i])
    at, nodes = at[~wide], nodes[~wide]
    order = np.lexsort([nodes, x[at]])
    at, nodes = at[order], nodes[order]
    begins = np.flatnonzero((np.diff(x[at], prepend=np.nan) != 0) | (np.diff(nodes, prepend=np.nan) != 0))
    for begin, end in zip(begins, np.append(begins[1:], len(at)), strict=False):
        n = int(nodes[begin])
        p, w = jacobi_rule(params.a, params.b + x[at[begin]], n)
        for j in range(begin, end, max(1, HELD // n)):
            part = at[j : min(end, j + max(1, HELD // n))]
            out[part] = gain(p[None, :], params.r + x[at[begin]], s[part][:, None]) @ w
    return out[back.ravel()]


def expected_if_alive(params: BetaGeoParams, times: Sequence[float | Column], frequency: Column | str, T: Column | str) -> Column:
    """Expected purchases within each of ``times`` of a customer known to be alive, as an array (null for a null input).

    Depends on frequency and T only.
    """

    many = len(times)

    @F.pandas_udf("array<double>")
    def evaluate(x: pd.Series, age: pd.Series, until: pd.Series) -> pd.Series:
        x, age = x.to_numpy(np.float64, na_value=np.nan), age.to_numpy(np.float64, na_value=np.nan)
        t = np.array([[np.nan if v is None else v for v in row] for row in until], np.float64).reshape(len(x), many)
        s = t / (params.alpha + age)[:, None]
        mean = mean_gain(params, np.repeat(x, many), s.ravel()).reshape(s.shape)
        return pd.Series([None if np.isnan(row).all() else row for row in mean], dtype=object)

    until = F.array(*[(t if isinstance(t, Column) else F.lit(float(t))).cast("double") for t in times])
    return evaluate(col_of(frequency).cast("double"), col_of(T).cast("double"), until)


def expected_of_pairs(params: BetaGeoParams, times: Sequence[float], pairs: DataFrame, tasks: int) -> DataFrame:
    """The pairs (x, T) with ``gains``, the expected purchases of a live customer within each of ``times``.

    The rows are small and dear, so they are dealt to ``tasks`` tasks: by their bytes all would come into one.
    """
    x, age = pairs.columns
    horizons = np.array(times, np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, since = (pc.fill_null(pc.cast(c, pa.float64()), math.nan).to_numpy(zero_copy_only=False) for c in batch.columns)
            s = horizons[None, :] / (params.alpha + since)[:, None]
            mean = mean_gain(params, np.repeat(of, len(horizons)), s.ravel()).reshape(s.shape)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(mean.ravel()), len(horizons)).cast(pa.list_(pa.float64()))
            yield pa.record_batch([*batch.columns, lists], names=[x, age, "gains"])

    schema = T.StructType([*pairs.schema.fields, T.StructField("gains", T.ArrayType(T.DoubleType()))])
    return pairs.repartition(tasks, x, age).mapInArrow(run, schema)


def alive_odds(params: BetaGeoParams, frequency: Column | str, recency: Column | str, T: Column | str) -> Column:
    """1 + odds of having dropped out: what the expectation of a live customer is divided by."""
    x, tx, age = (col_of(v).cast("double") for v in (frequency, recency, T))
    ratio = F.pow((F.lit(params.alpha) + age) / (F.lit(params.alpha) + tx), F.lit(params.r) + x)
    return F.lit(1.0) + F.when(x > 0, F.lit(params.a) / (F.lit(params.b - 1.0) + x) * ratio).otherwise(F.lit(0.0))


def expected_purchases(
    params: BetaGeoParams,
    t: float | Column,
    frequency: Column | str,
    recency: Column | str,
    T: Column | str,
) -> Column:
    """Conditional expected number of purchases in the next ``t`` periods."""
    return expected_if_alive(params, [t], frequency, T)[0] / alive_odds(params, frequency, recency, T)


def probability_of_n_purchases(
    params: BetaGeoParams, t: Column | str, n: int
) -> Column:
    """P(X(t) = n) for a customer observed for ``t`` periods (closed form)."""
    r, alpha, a, b = params.r, params.alpha, params.a, params.b
    tt = col_of(t).cast("double")

    def lbeta(p, q):
        return math.lgamma(p) + math.lgamma(q) - math.lgamma(p + q)

    base = lbeta(a, b)
    first = math.exp(lbeta(a, b + n) - base + math.lgamma(r + n) - math.lgamma(r) - math.lgamma(n + 1))
    p_alpha = F.lit(alpha) / (F.lit(alpha) + tt)
    p_t = tt / (F.lit(alpha) + tt)
    term = F.lit(first) * F.pow(p_alpha, F.lit(r)) * F.pow(p_t, F.lit(float(n)))
    if n == 0:
        return term
    second = math.exp(lbeta(a + 1, b + n - 1) - base)
    # sum_{j<n} c_j p_t**j by Horner's rule (an expression linear in n)
    partial = F.lit(0.0)
    for j in reversed(range(n)):
        coef = math.exp(math.lgamma(r + j) - math.lgamma(r) - math.lgamma(j + 1))
        partial = partial * p_t + F.lit(coef)
    return term + F.lit(second) * (F.lit(1.0) - F.pow(p_alpha, F.lit(r)) * partial)


def check_inputs(df: DataFrame, frequency: str, recency: str, T: str):
    """Validate in one pass; returns the row with the count and max(T)."""
    x, tx, age = F.col(frequency), F.col(recency), F.col(T)
    row = df.agg(
        F.count("*").alias("n"),
        F.max(age).alias("max_t"),
        F.count_if(x.isNull() | tx.isNull() | age.isNull()).alias("nulls"),
        F.count_if(tx > age).alias("recency_after_T"),
        F.count_if(x != F.floor(x)).alias("non_integer"),
        F.count_if(x < 0).alias("negative"),
        F.count_if((x == 0) & (tx != 0)).alias("recency_without_repeat"),
    ).collect()[0]
    problems = {k: row[k] for k in ("nulls", "recency_after_T", "non_integer", "negative", "recency_without_repeat") if row[k]}
    if problems:
        raise ValueError(f"invalid BG/NBD inputs: {problems}")
    if row["n"] == 0:
        raise ValueError("no customers to fit")
    return row


def sql_double(v: float) -> str:
    """An exact double literal for Spark SQL text."""
    return f"CAST({float(v)!r} AS DOUBLE)"


#: Coefficients of Stirling's series for ln Gamma; its derivative gives digamma.
_STIRLING = (1 / 12, -1 / 360, 1 / 1260, -1 / 1680, 1 / 1188, -691 / 360360)
_SHIFT = 8


def _in_squares(y: str, coefficients: Sequence[float]) -> str:
    """c0 + c1 / y**2 + c2 / y**4 + ... by Horner's rule."""
    out = f"({coefficients[-1]!r}D)"
    for c in reversed(coefficients[:-1]):
        out = f"({out} / ({y} * {y}) + ({c!r}D))"
    return out


def sql_lgamma(z: str) -> str:
    """ln Gamma(z), z > 0, as Spark SQL: the series at z + 8 less the logs of z ... z + 7."""
    y = f"({z} + {_SHIFT}.0D)"
    shift = " + ".join(f"ln({z} + {j}.0D)" for j in range(_SHIFT))
    return f"(({y} - 0.5D) * ln({y}) - {y} + {0.5 * math.log(2 * math.pi)!r}D + {_in_squares(y, _STIRLING)} / {y} - ({shift}))"


def sql_digamma(z: str) -> str:
    """The derivative of ln Gamma(z), z > 0, as Spark SQL."""
    y = f"({z} + {_SHIFT}.0D)"
    series = _in_squares(y, [(2 * i + 1) * c for i, c in enumerate(_STIRLING)])
    shift = " + ".join(f"1.0D / ({z} + {j}.0D)" for j in range(_SHIFT))
    return f"(ln({y}) - 0.5D / {y} - {series} / ({y} * {y}) - ({shift}))"


def np_lgamma(z: np.ndarray) -> np.ndarray:
    y = z + _SHIFT
    series = sum(c / y ** (2 * i + 1) for i, c in enumerate(_STIRLING))
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + series - sum(np.log(z + j) for j in range(_SHIFT))


def np_digamma(z: np.ndarray) -> np.ndarray:
    y = z + _SHIFT
    series = sum((2 * i + 1) * c / y ** (2 * i + 2) for i, c in enumerate(_STIRLING))
    return np.log(y) - 0.5 / y - series - sum(1.0 / (z + j) for j in range(_SHIFT))


def np_trigamma(z: np.ndarray) -> np.ndarray:
    y = z + _SHIFT
    # the derivative of the digamma series, term by term
    series = sum((2 * i + 1) * (2 * i + 2) * c / y ** (2 * i + 3) for i, c in enumerate(_STIRLING))
    return 1.0 / y + 0.5 / y**2 + series + sum(1.0 / (z + j) ** 2 for j in range(_SHIFT))


def _row_terms(p: BetaGeoParams, x: str = "x", tx: str = "tx", age: str = "T") -> list[str]:
    """Log-likelihood of a row and its gradient in (r, alpha, a, b), as SQL.

    SQL text keeps building a batch of these aggregates to one call; the
    expressions are plain arithmetic that Spark compiles with codegen.
    """
    r, alpha, a, b = (sql_double(v) for v in (p.r, p.alpha, p.a, p.b))
    rx, bx, abx = f"({r} + {x})", f"({b} + {x})", f"({a} + {b} + {x})"
    fixed = math.lgamma(p.a + p.b) - math.lgamma(p.b) - math.lgamma(p.r) + p.r * math.log(p.alpha)
    ln_at = f"ln({alpha} + {age})"
    ln_ax = f"ln({alpha} + {tx})"
    b_x = f"({b} + greatest({x}, 1.0D) - 1.0D)"
    a3 = f"(-{rx} * {ln_at})"
    a4 = f"(ln({a}) - ln({b_x}) - {rx} * {ln_ax})"
    m = f"greatest({a3}, {a4})"
    e3, e4 = f"exp({a3} - {m})", f"exp({a4} - {m})"
    ll = f"CASE WHEN {x} > 0 THEN {m} + ln({e3} + {e4}) ELSE {a3} END"
    w = f"(CASE WHEN {x} > 0 THEN {e4} / ({e3} + {e4}) ELSE 0.0D END)"
    ends = sql_digamma(abx)
    return [
        f"{sql_double(fixed)} + {sql_lgamma(rx)} + {sql_lgamma(bx)} - {sql_lgamma(abx)} + {ll}",
        f"{sql_double(math.log(p.alpha) - digamma(p.r))} + {sql_digamma(rx)} - (1.0D - {w}) * {ln_at} - {w} * {ln_ax}",
        f"{r} / {alpha} - {rx} * ((1.0D - {w}) / ({alpha} + {age}) + {w} / ({alpha} + {tx}))",
        f"{sql_double(digamma(p.a + p.b))} - {ends} + {w} / {a}",
        f"{sql_double(digamma(p.a + p.b) - digamma(p.b))} + {sql_digamma(bx)} - {ends} - {w} / {b_x}",
    ]


def _np_row_sums(p: BetaGeoParams, x, tx, age, w) -> tuple[float, np.ndarray]:
    """:func:`_row_terms` weighted and summed with numpy (warm start, tests)."""
    ln_at = np.log(p.alpha + age)
    ln_ax = np.log(p.alpha + tx)
    b_x = p.b + np.maximum(x, 1.0) - 1.0
    a3 = -(p.r + x) * ln_at
    a4 = np.log(p.a) - np.log(b_x) - (p.r + x) * ln_ax
    m = np.maximum(a3, a4)
    e3, e4 = np.exp(a3 - m), np.exp(a4 - m)
    pos = x > 0
    wt = np.where(pos, e4 / (e3 + e4), 0.0)
    fixed = math.lgamma(p.a + p.b) - math.lgamma(p.b) - math.lgamma(p.r) + p.r * math.log(p.alpha)
    ll = fixed + np_lgamma(p.r + x) + np_lgamma(p.b + x) - np_lgamma(p.a + p.b + x) + np.where(pos, m + np.log(e3 + e4), a3)
    ends = np_digamma(p.a + p.b + x)
    grads = [
        math.log(p.alpha) - digamma(p.r) + np_digamma(p.r + x) - (1.0 - wt) * ln_at - wt * ln_ax,
        p.r / p.alpha - (p.r + x) * ((1.0 - wt) / (p.alpha + age) + wt / (p.alpha + tx)),
        digamma(p.a + p.b) - ends + wt / p.a,
        digamma(p.a + p.b) - digamma(p.b) + np_digamma(p.b + x) - ends - wt / b_x,
    ]
    return float(np.sum(w * ll)), np.array([float(np.sum(w * g)) for g in grads])


def likelihood_terms(p: BetaGeoParams, x, tx, age) -> list[np.ndarray]:
    """Log-likelihood of every row, its gradient in (r, alpha, a, b), and the upper triangle of its Hessian.

    With w the share of A4 in exp(A3) + exp(A4), their logarithm has the Hessian
    (1 - w) A3'' + w A4'' + w (1 - w) (A4' - A3') (A4' - A3')^T.
    """
    r, alpha, a, b = p.r, p.alpha, p.a, p.b
    rx, at, ax = r + x, alpha + age, alpha + tx
    b_x = b + np.maximum(x, 1.0) - 1.0
    ln_at, ln_ax = np.log(at), np.log(ax)
    a3, a4 = -rx * ln_at, np.log(a) - np.log(b_x) - rx * ln_ax
    m = np.maximum(a3, a4)
    e3, e4 = np.exp(a3 - m), np.exp(a4 - m)
    w = np.where(x > 0, e4 / (e3 + e4), 0.0)
    fixed = math.lgamma(a + b) - math.lgamma(b) - math.lgamma(r) + r * math.log(alpha)
    ll = fixed + np_lgamma(rx) + np_lgamma(b + x) - np_lgamma(a + b + x) + np.where(x > 0, m + np.log(e3 + e4), a3)
    ends, more = np_digamma(a + b + x), np_trigamma(a + b + x)
    both, twice = digamma(a + b), trigamma(a + b)
    grad = [
        math.log(alpha) - digamma(r) + np_digamma(rx) - (1.0 - w) * ln_at - w * ln_ax,
        r / alpha - rx * ((1.0 - w) / at + w / ax),
        both - ends + w / a,
        both - digamma(b) + np_digamma(b + x) - ends - w / b_x,
    ]
    apart = w * (1.0 - w)
    d = [ln_at - ln_ax, rx / at - rx / ax, 1.0 / a, -1.0 / b_x]  # A4' - A3'
    second = {
        (0, 0): np_trigamma(rx) - trigamma(r),
        (0, 1): 1.0 / alpha - (1.0 - w) / at - w / ax,
        (1, 1): -r / alpha**2 + rx * ((1.0 - w) / at**2 + w / ax**2),
        (2, 2): twice - more - w / a**2,
        (2, 3): twice - more,
        (3, 3): twice - trigamma(b) + np_trigamma(b + x) - more + w / b_x**2,
    }
    hess = [apart * d[i] * d[j] + second.get((i, j), 0.0) for i in range(4) for j in range(i, 4)]
    return [ll, *grad, *hess]


def likelihood_sums(grouped: DataFrame, terms, k: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    """Sums over a table whose last column is the weight: weights, log-likelihood, gradient and Hessian in ``k`` parameters.

    ``terms`` maps the other columns (arrays) to the terms of every row.  A task adds up its rows, one row each
    goes on to the final sum.
    """
    n = 2 + k + k * (k + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n)
        for batch in batches:
            *columns, weight = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            with np.errstate(all="ignore"):
                total += [weight.sum(), *[float(np.sum(weight * t)) for t in terms(*columns)]]
        yield pa.record_batch([pa.array([v]) for v in total], names=[f"s{i}" for i in range(n)])

    parts = grouped.mapInArrow(run, ", ".join(f"s{i} double" for i in range(n)))
    row = list(parts.agg(*[F.sum(f"s{i}") for i in range(n)]).first())
    hess = np.zeros((k, k))
    hess[np.triu_indices(k)] = row[2 + k :]
    return row[0], row[1], np.array(row[2 : 2 + k]), hess + np.triu(hess, 1).T


def penalised_newton(theta, sums, penalizer: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Penalised mean negative log-likelihood, gradient and Hessian in log parameters."""
    weight, ll, grad, hess = sums
    pv = np.exp(theta)
    f, g = penalised(theta, ll, grad, weight, penalizer)
    slope = (-grad / weight + 2 * penalizer * pv) * pv
    return f, g, np.diag(slope + 2 * penalizer * pv**2) - hess / weight * np.outer(pv, pv)


def standard_errors(names: Sequence[str], values: np.ndarray, hessian: np.ndarray | None, rows: float) -> dict[str, float | None]:
    """Of the parameters, from the Hessian in log parameters at the optimum; None where it does not curve upwards."""
    if hessian is None or not np.all(np.isfinite(hessian)) or np.linalg.eigvalsh(hessian)[0] <= 1e-12:
        return dict.fromkeys(names)
    spread = np.sqrt(np.diag(np.linalg.inv(hessian)) / rows)
    return {name: float(v * s) for name, v, s in zip(names, values, spread, strict=True)}


def penalised(theta, ll: float, grad: np.ndarray, total_w: float, penalizer: float) -> tuple[float, np.ndarray]:
    """Penalised mean negative log-likelihood and its gradient in log parameters."""
    pv = np.exp(theta)
    f = -ll / total_w + penalizer * float(np.sum(pv**2))
    g = (-grad / total_w + 2 * penalizer * pv) * pv
    return (f if math.isfinite(f) else math.inf, g)


def objective_values(grouped: DataFrame, params: Sequence[BetaGeoParams], penalizer: float) -> list[tuple[float, np.ndarray]]:
    """The fit's objective and gradient at each of ``params``, by one aggregate over (x, tx, T, w)."""
    aggs = ["sum(w) AS n"]
    aggs += [f"sum(w * ({term})) AS s{k}_{j}" for k, p in enumerate(params) for j, term in enumerate(_row_terms(p))]
    row = grouped.selectExpr(*aggs).first()
    return [
        penalised(
            np.log([p.r, p.alpha, p.a, p.b]), row[f"s{k}_0"], np.array([row[f"s{k}_{j}"] for j in range(1, 5)]), row["n"], penalizer
        )
        for k, p in enumerate(params)
    ]


#: Warm start: the table binned to this many steps of tx, T and (logarithmic) x, so of bounded size whatever
#: the data; the driver fits the bins and the full fit starts there.
WARM_BINS = 24


def _warm_start(grouped: DataFrame, penalizer: float):
    """(start point, inverse-Hessian estimate) fitted to the binned table, at most about WARM_BINS ** 3 rows."""
    start = np.full(4, 0.1)
    bins = F.lit(float(WARM_BINS))
    most = grouped.agg(F.max("x"), F.max("T")).first()
    steps = [
        F.floor(F.log1p("x") / F.lit(max(math.log1p(most[0]), 1e-9)) * bins).alias("i"),
        F.floor(F.col("tx") / F.lit(most[1]) * bins).alias("j"),
        F.floor(F.col("T") / F.lit(most[1]) * bins).alias("k"),
    ]
    means = [(F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c) for c in ("x", "tx", "T")]
    coarse = grouped.groupBy((F.col("x") > 0).alias("repeat"), *steps).agg(*means, F.sum("w").alias("w")).collect()
    x, tx, age, w = (np.array([r[c] for r in coarse], dtype=float) for c in ("x", "tx", "T", "w"))

    def evaluate(thetas):
        out = []
        for th in thetas:
            with np.errstate(all="ignore"):
                out.append(penalised(th, *_np_row_sums(BetaGeoParams(*np.exp(th)), x, tx, age, w), w.sum(), penalizer))
        return out

    res = bfgs(evaluate, start, gtol=1e-5, max_iter=500)
    return (res.x, res.inverse_hessian) if np.all(np.isfinite(res.x)) else (start, None)


def grouped_inputs(df: DataFrame, frequency: str, recency: str, T: str, scale: float) -> DataFrame:
    """Customers counted by (x, tx, T), the times scaled."""
    return (
        df.select(
            F.col(frequency).cast("double").alias("x"),
            (F.col(recency).cast("double") * F.lit(scale)).alias("tx"),
            (F.col(T).cast("double") * F.lit(scale)).alias("T"),
        )
        .groupBy("x", "tx", "T")
        .agg(F.count("*").cast("double").alias("w"))
    )


def fit_bgnbd(
    df: DataFrame,
    frequency: str = "frequency",
    recency: str = "recency",
    T: str = "T",
    penalizer: float = 0.001,
    tol: float = 1e-7,
    max_iter: int = 200,
    warm_start: bool = True,
    scale_times: bool = True,
) -> FitResult:
    """Maximum-likelihood BG/NBD parameters (penalised), fitted with Spark aggregates.

    With ``warm_start`` the optimisation starts from a fit to a binned table of
    bounded size (driver-side); the result is the optimum of the full objective,
    reached in fewer Spark jobs; every Newton iteration is one.  ``scale_times=False`` fits the times as they are.
    A fit that did not converge, or ended at the boundary of the parameter space,
    says so in the result and in a warning.
    """
    checked = check_inputs(df, frequency, recency, T)
    scale = 1.0 / checked["max_t"] if scale_times else 1.0
    grouped = materialize(grouped_inputs(df, frequency, recency, T, scale), "bgnbd_grouped")

    def evaluate(theta):
        params = BetaGeoParams(*np.exp(theta).tolist())
        return penalised_newton(theta, likelihood_sums(grouped, partial(likelihood_terms, params), 4), penalizer)

    start = _warm_start(grouped, penalizer)[0] if warm_start else np.full(4, 0.1)
    res = newton(evaluate, start, gtol=tol, max_iter=max_iter)
    r, alpha, a, b = np.exp(res.x).tolist()
    return fit_result("BG/NBD", BetaGeoParams(r, alpha / scale, a, b), res, checked["n"])


class BetaGeoModel:
    """Fitter-style wrapper: ``fit`` a DataFrame, then build column expressions."""

    def __init__(self, penalizer_coef: float = 0.0):
        self.penalizer_coef = penalizer_coef
        self.result: FitResult | None = None

    @property
    def params(self) -> BetaGeoParams:
        if self.result is None:
            raise ValueError("fit the model first")
        return self.result.params

    def fit(self, df: DataFrame, frequency: str = "frequency", recency: str = "recency", T: str = "T", **kw):
        self.result = fit_bgnbd(df, frequency, recency, T, self.penalizer_coef, **kw)
        return self

    def conditional_expected_number_of_purchases_up_to_time(self, t, frequency, recency, T) -> Column:
        return expected_purchases(self.params, t, frequency, recency, T)

    predict = conditional_expected_number_of_purchases_up_to_time

    def probability_of_n_purchases_up_to_time(self, t, n: int) -> Column:
        return probability_of_n_purchases(self.params, t, n)
