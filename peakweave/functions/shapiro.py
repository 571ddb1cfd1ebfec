"""Shapiro-Wilk W and p-value after Royston's published approximation (AS R94)."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from peakweave.functions.tails import inverse_normal, normal_sf

# Polynomial coefficients of the published algorithm, constant term first.
_C1 = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
_C2 = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)

MIN_N, MAX_N = 3, 5000


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return float(np.polynomial.polynomial.polyval(x, coefficients))


@lru_cache(maxsize=MAX_N)
def _weights(n: int) -> np.ndarray:
    """Weights of the ordered sample, antisymmetric."""
    if n == 3:
        return np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    m = inverse_normal((np.arange(1, n + 1) - 0.375) / (n + 0.25))
    length = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.empty(n)
    last = m[-1] / math.sqrt(length) + _poly(_C1, u)
    if n > 5:
        second = m[-2] / math.sqrt(length) + _poly(_C2, u)
        phi = (length - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[-2], a[1] = second, -second
    else:
        phi = (length - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a[1:-1] = m[1:-1] / math.sqrt(phi)
    a[-1], a[0] = last, -last
    return a


def shapiro_wilk(values: np.ndarray) -> tuple[float, float] | None:
    """(W, p), or None for too few, too many or all-equal values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if not MIN_N <= n <= MAX_N or x[-1] - x[0] <= 0:
        return None
    x = (x - np.median(x)) / (x[-1] - x[0])
    centred = x - x.mean()
    a = _weights(n)
    ss = float(centred @ centred)
    w = min(1.0, float(a @ x) ** 2 / (ss * float(a @ a)))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    if 1 - w <= 0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, sd = _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_SD, n))
    else:
        ln = math.log(n)
        mean, sd = _poly(_LARGE_MEAN, ln), math.exp(_poly(_LARGE_SD, ln))
    return w, float(normal_sf(np.array((y - mean) / sd)))
