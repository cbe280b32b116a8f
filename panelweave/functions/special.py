"""Numeric helpers for the models: gamma family, distribution tails, normal quantile.

Plain numpy on small arrays; used on the driver for p-values and inside tasks for
the beta likelihood.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SHIFT = 8


def _raise_argument(x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shift arguments above 8, where the asymptotic series are accurate."""
    x = np.asarray(x, dtype=float)
    return x + _SHIFT, [x + k for k in range(_SHIFT)]


def gammaln(x):
    big, low = _raise_argument(x)
    inv2 = 1.0 / (big * big)
    series = (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 * (1 / 1680 - inv2 / 1188)))) / big
    value = (big - 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + series
    return value - sum(np.log(t) for t in low)


def digamma(x):
    big, low = _raise_argument(x)
    inv2 = 1.0 / (big * big)
    series = inv2 * (1 / 12 - inv2 * (1 / 120 - inv2 * (1 / 252 - inv2 * (1 / 240 - inv2 / 132))))
    return np.log(big) - 0.5 / big - series - sum(1.0 / t for t in low)


def trigamma(x):
    big, low = _raise_argument(x)
    inv = 1.0 / big
    inv2 = inv * inv
    series = inv2 * inv * (1 / 6 - inv2 * (1 / 30 - inv2 * (1 / 42 - inv2 * (1 / 30 - inv2 * 5 / 66))))
    return inv + 0.5 * inv2 + series + sum(1.0 / (t * t) for t in low)


def betainc(a, b, x, terms: int = 400):
    """Regularised incomplete beta by the modified Lentz continued fraction."""
    a, b, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, b, x))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    p, q, z = np.where(flip, b, a), np.where(flip, a, b), np.where(flip, 1.0 - x, x)
    tiny = 1e-300
    with np.errstate(divide="ignore", invalid="ignore"):
        log_front = gammaln(p + q) - gammaln(p) - gammaln(q) + p * np.log(z) + q * np.log1p(-z)
        front = np.where((z > 0) & (z < 1), np.exp(log_front), 0.0) / p
    c = np.ones_like(z)
    d = 1.0 - (p + q) * z / (p + 1.0)
    d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, terms):
        for coef in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1.0 + coef * d
            c = 1.0 + coef / c
            d = 1.0 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h *= d * c
        if np.all(np.abs(d * c - 1.0) < 1e-15):
            break
    value = np.where(z >= 1.0, 1.0, front * h)
    return np.where(flip, 1.0 - value, value)


def erfc(x):
    """Complementary error function of an array: a Taylor series near zero, a continued fraction beyond."""
    x = np.asarray(x, dtype=float)
    z = np.abs(x)
    small = z < 2.5
    t = np.where(small, z, 0.0)
    term = total = t.copy()
    for k in range(1, 60):
        term = term * (-t * t) / k
        total = total + term / (2 * k + 1)
    near = 1.0 - 2.0 / np.sqrt(np.pi) * total
    far = np.where(small, 2.5, z)
    f = np.zeros_like(far)
    for k in range(80, 0, -1):
        f = k / 2.0 / (far + f)
    tail = np.exp(-far * far) / np.sqrt(np.pi) / (far + f)
    value = np.where(small, near, tail)
    return np.where(x < 0, 2.0 - value, value)


def normal_quantile(p):
    """Inverse of the standard normal distribution function over an array, 0 < p < 1.

    A series in log(p) starts the search in the smaller tail; Halley steps on the complementary error function end it.
    """
    p = np.asarray(p, dtype=float)
    low = np.minimum(p, 1.0 - p)
    r = np.sqrt(-2.0 * np.log(low))
    x = np.where(low < 0.1, r - np.log(2.0 * np.pi * np.maximum(r * r, 1.0)) / (2.0 * np.maximum(r, 1.0)), np.sqrt(2 * np.pi) * (0.5 - low))
    x = np.maximum(x, 0.0)
    for _ in range(6):
        density = np.exp(-0.5 * x * x) / np.sqrt(2.0 * np.pi)
        e = (0.5 * erfc(x / np.sqrt(2.0)) - low) / density
        x = x + e / (1.0 - 0.5 * x * e)
    return np.where(p < 0.5, -x, x)


def chi2_tail(x: float, df: float) -> float:
    """P(X > x) of a chi-squared variable."""
    a, z = df / 2.0, x / 2.0
    if z <= 0:
        return 1.0
    front = float(np.exp(-z + a * np.log(z) - gammaln(a)))
    if z < a + 1.0:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1.0
            term *= z / k
            total += term
        return float(1.0 - total * front)
    b = z + 1.0 - a
    c = 1e300
    d = 1.0 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2.0
        d = 1.0 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1.0) < 1e-16:
            break
    return float(front * h)


def t_tail(t: float, df: float) -> float:
    """Two-sided P(|T| > |t|)."""
    return float(betainc(df / 2.0, 0.5, df / (df + t * t))[0])


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    return float(betainc(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))[0])
