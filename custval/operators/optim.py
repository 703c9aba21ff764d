"""Driver-side helpers for the model fits: digamma, a trust-region Newton loop and a small BFGS loop.

The objective, its gradient and its Hessian are sums over the customers, made by Spark;
this module only moves a parameter vector of 3-4 numbers.  A Newton iteration is one
evaluation (one Spark job).  BFGS, which needs no Hessian, fits the binned tables of the
warm starts: every iteration tries the full step first and, only if it fails, a whole
batch of shorter steps at once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np


def digamma(x: float) -> float:
    """psi(x) for x > 0: recurrence up to x >= 6, then the asymptotic series."""
    if x <= 0:
        raise ValueError("digamma needs x > 0")
    acc = 0.0
    while x < 6.0:
        acc -= 1.0 / x
        x += 1.0
    inv = 1.0 / x
    inv2 = inv * inv
    series = inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252 - inv2 * (1.0 / 240 - inv2 / 132))))
    return acc + math.log(x) - 0.5 * inv - series


@dataclass
class OptimResult:
    x: np.ndarray
    fun: float
    grad: np.ndarray
    iterations: int
    converged: bool
    inverse_hessian: np.ndarray | None = None
    hessian: np.ndarray | None = None


STEPS = (1.0, 0.5, 0.25, 0.1, 0.03, 0.01, 1e-3, 1e-4, 1e-6)


def bfgs(
    evaluate: Callable[[Sequence[np.ndarray]], list[tuple[float, np.ndarray]]],
    x0: Sequence[float],
    gtol: float = 1e-7,
    max_iter: int = 200,
    h0: np.ndarray | None = None,
) -> OptimResult:
    """Minimise with BFGS; ``evaluate`` maps a list of points to (f, grad) pairs.

    The line search tries the full step, then all shorter :data:`STEPS` in one
    ``evaluate`` call, and takes the longest step meeting the Armijo condition.
    """
    x = np.asarray(x0, dtype=float)
    f, g = evaluate([x])[0]
    h = np.eye(len(x)) if h0 is None else np.array(h0, dtype=float)
    scale_first = h0 is None
    for it in range(1, max_iter + 1):
        if not np.all(np.isfinite(g)):
            return OptimResult(x, f, g, it - 1, False, h)
        if np.max(np.abs(g)) < gtol:
            return OptimResult(x, f, g, it - 1, True, h)
        p = -h @ g
        slope = float(g @ p)
        if slope >= 0:
            h = np.eye(len(x))
            p = -g
            slope = float(g @ p)
        # The full step usually succeeds: try it alone, then all shorter steps in one batch.
        chosen = None
        for steps in (STEPS[:1], STEPS[1:]):
            candidates = [x + s * p for s in steps]
            for s, xc, (fc, gc) in zip(steps, candidates, evaluate(candidates)):
                if math.isfinite(fc) and fc <= f + 1e-4 * s * slope and np.all(np.isfinite(gc)):
                    chosen = (xc, fc, gc)
                    break
            if chosen is not None:
                break
        if chosen is None:
            # no step decreases f any more (floating point): converged only if the gradient says so
            return OptimResult(x, f, g, it, bool(np.max(np.abs(g)) < gtol), h)
        x_new, f_new, g_new = chosen
        s_vec, y_vec = x_new - x, g_new - g
        sy = float(s_vec @ y_vec)
        if sy > 1e-12:
            if it == 1 and scale_first:
                h = np.eye(len(x)) * (sy / float(y_vec @ y_vec))
            rho = 1.0 / sy
            eye = np.eye(len(x))
            h = (eye - rho * np.outer(s_vec, y_vec)) @ h @ (eye - rho * np.outer(y_vec, s_vec))
            h += rho * np.outer(s_vec, s_vec)
        if abs(f - f_new) <= 1e-15 * max(1.0, abs(f)) and np.max(np.abs(g_new)) < gtol:
            return OptimResult(x_new, f_new, g_new, it, True, h)
        x, f, g = x_new, f_new, g_new
    return OptimResult(x, f, g, max_iter, bool(np.max(np.abs(g)) < gtol), h)


def trust_step(g: np.ndarray, h: np.ndarray, radius: float) -> np.ndarray:
    """The step of least g p + p h p / 2 with |p| <= radius (h of any sign)."""
    values, vectors = np.linalg.eigh(h)
    c = vectors.T @ g
    floor = max(0.0, -float(values[0]))

    def step(shift: float) -> np.ndarray:
        return -c / (values + shift)

    tiny = 1e-12 * max(1.0, float(np.abs(values).max()))
    if values[0] > tiny and np.linalg.norm(step(0.0)) <= radius:
        return vectors @ step(0.0)
    low, high = floor + tiny, floor + tiny + float(np.linalg.norm(c)) / radius + 1.0
    if np.linalg.norm(step(low)) < radius:  # the gradient has no part along the lowest direction: go that way to the rim
        p = step(low)
        p[0] += math.copysign(math.sqrt(max(radius**2 - float(p @ p), 0.0)), -c[0] or 1.0)
        return vectors @ p
    for _ in range(200):
        middle = (low + high) / 2.0
        low, high = (middle, high) if np.linalg.norm(step(middle)) > radius else (low, middle)
    return vectors @ step(high)


def newton(
    evaluate: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]],
    x0: Sequence[float],
    gtol: float = 1e-7,
    max_iter: int = 200,
    radius: float = 1.0,
) -> OptimResult:
    """Minimise with Newton steps inside a trust region; ``evaluate`` gives f, gradient and Hessian at a point."""
    x = np.asarray(x0, dtype=float)
    f, g, h = evaluate(x)
    it = 0
    while it < max_iter and np.all(np.isfinite(g)) and np.all(np.isfinite(h)) and np.max(np.abs(g)) >= gtol and radius > 1e-14:
        it += 1
        p = trust_step(g, h, radius)
        expected = -float(g @ p + 0.5 * p @ h @ p)
        f_new, g_new, h_new = evaluate(x + p)
        whole = math.isfinite(f_new) and np.all(np.isfinite(g_new)) and np.all(np.isfinite(h_new))
        # where f cannot be told apart any more, the gradient says whether the step is good
        flat = whole and abs(f_new - f) <= 1e-13 * max(1.0, abs(f)) and np.max(np.abs(g_new)) < np.max(np.abs(g))
        gained = (f - f_new) / expected if whole and expected > 0 else -1.0
        if gained > 0.75 and np.linalg.norm(p) > 0.9 * radius:
            radius = min(2.0 * radius, 16.0)
        elif gained < 0.25 and not flat:
            radius = 0.25 * float(np.linalg.norm(p))
        if gained > 1e-4 or flat:
            x, f, g, h = x + p, f_new, g_new, h_new
    converged = bool(np.all(np.isfinite(g)) and np.max(np.abs(g)) < gtol)
    return OptimResult(x, f, g, it, converged, None, h)


def trigamma(x: float) -> float:
    """The derivative of psi(x), x > 0."""
    if x <= 0:
        raise ValueError("trigamma needs x > 0")
    acc = 0.0
    while x < 8.0:
        acc += 1.0 / (x * x)
        x += 1.0
    inv = 1.0 / x
    inv2 = inv * inv
    # 1/x + 1/2x**2 + B2/x**3 + B4/x**5 + ..., Bernoulli numbers
    series = inv2 * (1.0 / 6 - inv2 * (1.0 / 30 - inv2 * (1.0 / 42 - inv2 * (1.0 / 30 - inv2 * (5.0 / 66 - inv2 * 691.0 / 2730)))))
    return acc + inv + 0.5 * inv2 + inv * series
