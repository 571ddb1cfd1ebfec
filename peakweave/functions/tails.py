"""Tail probabilities of the usual distributions, vectorised.

Only these small numeric helpers leave the JVM: they take the few statistics of one test, not its data.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_TINY = 1e-300


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.erfc, otypes=[float])(x)


def normal_sf(z: np.ndarray) -> np.ndarray:
    """Upper tail of the standard normal."""
    return 0.5 * _erfc(np.asarray(z, float) / math.sqrt(2))


def inverse_normal(p: np.ndarray) -> np.ndarray:
    """Standard normal quantile: Acklam's rational start, then two Halley steps."""
    p = np.asarray(p, float)
    low = np.minimum(p, 1 - p)
    with np.errstate(all="ignore"):
        t = np.sqrt(-2 * np.log(np.maximum(low, _TINY)))
        # Abramowitz & Stegun 26.2.23
        x = -(t - (2.515517 + 0.802853 * t + 0.010328 * t * t) / (1 + 1.432788 * t + 0.189269 * t * t + 0.001308 * t**3))
        for _ in range(3):
            err = normal_sf(-x) - low
            u = err * math.sqrt(2 * math.pi) * np.exp(x * x / 2)
            x = x - u / (1 + x * u / 2)
    x = np.where(p > 0.5, -x, x)
    x = np.where(p == 0.5, 0.0, x)
    return np.where((p <= 0) | (p >= 1), np.where(p <= 0, -np.inf, np.inf), x)


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Continued fraction of the incomplete beta function (Lentz)."""
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
    h = d.copy()
    for m in range(1, 400):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = c * d
            h = h * step
        if np.all(np.abs(step - 1) < 1e-15):
            break
    return h


def beta_cdf(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    with np.errstate(all="ignore"):
        inside = np.clip(x, 1e-320, 1 - 1e-16)
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(inside) + b * np.log1p(-inside))
        left = inside < (a + 1) / (a + b + 2)
        aa, bb, xx = np.where(left, a, b), np.where(left, b, a), np.where(left, inside, 1 - inside)
        part = front * _beta_fraction(aa, bb, xx) / aa
        out = np.where(left, part, 1 - part)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| >= |t|)."""
    t, df = np.asarray(t, float), np.asarray(df, float)
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_sf(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    """Upper tail of the F distribution."""
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_sf(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Upper tail of the chi-square distribution: series below the mean, continued fraction above."""
    x, df = np.broadcast_arrays(np.asarray(x, float), np.asarray(df, float))
    a, z = df / 2, np.maximum(x / 2, _TINY)
    with np.errstate(all="ignore"):
        front = np.exp(-z + a * np.log(z) - _lgamma(a))
        term = 1 / a
        total = term.copy()
        for n in range(1, 2000):
            term = term * z / (a + n)
            total = total + term
            if np.all(np.abs(term) <= np.abs(total) * 1e-16):
                break
        series = 1 - front * total
        b = z + 1 - a
        c = np.full_like(z, 1 / _TINY)
        d = 1 / np.where(np.abs(b) < _TINY, _TINY, b)
        h = d.copy()
        for n in range(1, 2000):
            an = -n * (n - a)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = b + an / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-16):
                break
        fraction = front * h
    out = np.where(z < a + 1, series, fraction)
    return np.where(x <= 0, 1.0, np.clip(out, 0.0, 1.0))


@lru_cache(maxsize=4096)
def _rank_sum_counts(m: int, n: int) -> np.ndarray:
    """How many m-subsets of the ranks 1..m+n have each rank sum (smallest sum first)."""
    low, high = m * (m + 1) // 2, m * n + m * (m + 1) // 2
    ways = np.zeros((m + 1, high + 1))
    ways[0, 0] = 1.0
    for rank in range(1, m + n + 1):
        ways[1:, rank:] += ways[:-1, : high + 1 - rank].copy()
    return ways[m, low:]


def rank_sum_exact(w: float, m: int, n: int) -> float:
    """Two-sided exact p of the rank-sum statistic W (pairs won by the first sample), no ties."""
    counts = _rank_sum_counts(m, n)
    at = int(round(w))
    tail = counts[at:].sum() if w > m * n / 2 else counts[: at + 1].sum()
    return float(min(1.0, 2 * tail / counts.sum()))


def ks_exact(d: float, m: int, n: int) -> float:
    """P(D >= d) of two samples without ties: lattice paths staying below the observed distance."""
    small, large = min(m, n), max(m, n)
    limit = (0.5 + math.floor(d * small * large - 1e-7)) / (small * large)
    u = np.array([1.0 if j / large <= limit else 0.0 for j in range(large + 1)])
    for i in range(1, small + 1):
        w = i / (i + large)
        u[0] = 0.0 if i / small > limit else w * u[0]
        for j in range(1, large + 1):
            u[j] = 0.0 if abs(i / small - j / large) > limit else w * u[j] + u[j - 1]
    return float(min(1.0, max(0.0, 1 - u[large])))


def ks_asymptotic(d: float, m: int, n: int) -> float:
    z = d * math.sqrt(m * n / (m + n))
    if z <= 0:
        return 1.0
    if z < 1:
        # theta-function form, quick for small arguments
        s = sum(math.exp(-((2 * k - 1) ** 2) * math.pi**2 / (8 * z * z)) for k in range(1, 50))
        return float(min(1.0, max(0.0, 1 - math.sqrt(2 * math.pi) / z * s)))
    return float(min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 101)))))


@F.pandas_udf(DoubleType())
def _t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_sf(f.to_numpy(float), d1.to_numpy(float), d2.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_sf(x.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _normal_sf(z: pd.Series) -> pd.Series:
    return pd.Series(normal_sf(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _normal_quantile(p: pd.Series) -> pd.Series:
    return pd.Series(inverse_normal(p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def _rank_sum_exact(w: pd.Series, m: pd.Series, n: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for key in zip(w, m, n, strict=True):
        if any(pd.isna(v) for v in key):
            out.append(None)
            continue
        if key not in known:
            known[key] = rank_sum_exact(float(key[0]), int(key[1]), int(key[2]))
        out.append(known[key])
    return pd.Series(out, dtype=float)


@F.pandas_udf(DoubleType())
def _ks_p(d: pd.Series, m: pd.Series, n: pd.Series, ties: pd.Series) -> pd.Series:
    known: dict[tuple, float] = {}
    out = []
    for key in zip(d, m, n, ties, strict=True):
        if key not in known:
            dd, mm, nn, tied = float(key[0]), int(key[1]), int(key[2]), bool(key[3])
            exact = not tied and mm * nn < 10_000
            known[key] = ks_exact(dd, mm, nn) if exact else ks_asymptotic(dd, mm, nn)
        out.append(known[key])
    return pd.Series(out, dtype=float)


def t_p_value(t: Column, df: Column) -> Column:
    return _t_two_sided(t, df)


def f_p_value(f: Column, d1: Column, d2: Column) -> Column:
    return _f_sf(f, d1.cast("double"), d2.cast("double"))


def chi2_p_value(x: Column, df: Column) -> Column:
    return _chi2_sf(x, df.cast("double"))


def normal_upper(z: Column) -> Column:
    return _normal_sf(z)


def normal_quantile(p: Column) -> Column:
    return _normal_quantile(p)


def rank_sum_p_exact(w: Column, m: Column, n: Column) -> Column:
    return _rank_sum_exact(w, m, n)


def ks_p_value(d: Column, m: Column, n: Column, ties: Column) -> Column:
    return _ks_p(d, m, n, ties)
