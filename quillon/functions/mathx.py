"""Distribution functions and small numerical kernels in numpy and the standard library."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

_NORMAL = NormalDist()
EULER = 0.5772156649


def norm_cdf(x):
    """Standard normal distribution function of a number or an array."""
    return np.vectorize(lambda v: 0.5 * math.erfc(-v / math.sqrt(2)), otypes=[float])(x) if np.ndim(x) else 0.5 * math.erfc(-x / math.sqrt(2))


def norm_pdf(x):
    return np.exp(-0.5 * np.square(x)) / math.sqrt(2 * math.pi)


def norm_ppf(p: float) -> float:
    return -math.inf if p <= 0 else math.inf if p >= 1 else _NORMAL.inv_cdf(p)


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction (Lentz)."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    f = d
    for m in range(1, 500):
        n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1 / ((1 + n * d) or tiny)
        c = (1 + n / c) or tiny
        f *= d * c
        n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + n * d) or tiny)
        c = (1 + n / c) or tiny
        f *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * f


def t_sf2(t: float, df: float) -> float:
    """Two-sided p-value of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t))


def expected_max_sharpe(trials: int) -> float:
    """Expected maximum of ``trials`` Sharpe ratios without skill: a mix of two normal quantiles."""
    if trials <= 1:
        return 0.0
    return (1 - EULER) * norm_ppf(1 - 1 / trials) + EULER * norm_ppf(1 - 1 / (trials * math.e))


def min_backtest_years(trials: int, sharpe: float) -> float | None:
    """Years of history that ``trials`` tries need before this annual Sharpe ratio is beyond luck; none if it never is."""
    if sharpe <= 0:
        return None
    if trials <= 1:
        return 0.0
    return (expected_max_sharpe(trials) / sharpe) ** 2


def nelder_mead(f, start: np.ndarray, steps: int = 400, tolerance: float = 1e-10, scale: float = 0.1) -> np.ndarray:
    """Minimum of ``f`` by a simplex."""
    n = len(start)
    points = [np.array(start, dtype=float)]
    for k in range(n):
        p = np.array(start, dtype=float)
        p[k] += scale * (abs(p[k]) or 1.0)
        points.append(p)
    values = [f(p) for p in points]
    for _ in range(steps * n):
        order = np.argsort(values, kind="stable")
        points, values = [points[k] for k in order], [values[k] for k in order]
        if abs(values[-1] - values[0]) < tolerance and max(np.abs(p - points[0]).max() for p in points) < 1e-8:
            break
        middle = np.mean(points[:-1], axis=0)
        try_at = lambda c: middle + c * (points[-1] - middle)  # noqa: B023, E731
        reflected = try_at(-1.0)
        value = f(reflected)
        if value < values[0]:
            far = try_at(-2.0)
            far_value = f(far)
            points[-1], values[-1] = (far, far_value) if far_value < value else (reflected, value)
        elif value < values[-2]:
            points[-1], values[-1] = reflected, value
        else:
            near = try_at(-0.5 if value < values[-1] else 0.5)
            near_value = f(near)
            if near_value < min(value, values[-1]):
                points[-1], values[-1] = near, near_value
            else:
                points = [points[0], *[points[0] + 0.5 * (p - points[0]) for p in points[1:]]]
                values = [values[0], *[f(p) for p in points[1:]]]
    return points[int(np.argmin(values))]


def golden(f, low: float, high: float, steps: int = 80) -> float:
    """Minimum of a function of one number on an interval."""
    r = (math.sqrt(5) - 1) / 2
    a, b = high - r * (high - low), low + r * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(steps):
        if fa <= fb:
            high, b, fb = b, a, fa
            a = high - r * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + r * (high - low)
            fb = f(b)
    return (low + high) / 2
