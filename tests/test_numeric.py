"""Numeric helpers against closed forms, published values and literal definitions."""

import math

import numpy as np
import pytest

from peakweave.functions import tails
from peakweave.functions.shapiro import shapiro_wilk
from peakweave.operators.distance import cross_moments
from peakweave.operators.padjust import hommel_adjusted


def test_normal_quantile_inverts_tail():
    p = np.array([1e-12, 1e-5, 0.02, 0.5, 0.7, 0.999])
    assert np.allclose(tails.normal_sf(-tails.inverse_normal(p)), p, rtol=1e-10)


def test_t_tail_closed_forms():
    # one degree of freedom is Cauchy, two has an algebraic form
    t = np.array([0.3, 1.0, 12.7])
    assert np.allclose(tails.t_two_sided(t, 1), 1 - 2 / math.pi * np.arctan(t))
    assert np.allclose(tails.t_two_sided(t, 2), 1 - t / np.sqrt(2 + t * t))


def test_f_and_chi_square_tails():
    assert tails.f_sf(3.804, 18, 144) == pytest.approx(2.97e-06, rel=2e-3)
    assert tails.f_sf(2.745, 18, 109) == pytest.approx(0.000658, rel=2e-3)
    x = np.array([0.1, 2.0, 30.0])
    assert np.allclose(tails.chi2_sf(x, 2), np.exp(-x / 2))
    assert np.allclose(tails.chi2_sf(x, 1), 2 * tails.normal_sf(np.sqrt(x)))
    assert np.allclose(tails.f_sf(4.0, 1, 9), tails.t_two_sided(2.0, 9))


def test_rank_sum_exact_by_enumeration():
    from itertools import combinations

    for m, n in ((3, 4), (5, 2), (4, 4)):
        sums = [sum(c) - m * (m + 1) / 2 for c in combinations(range(1, m + n + 1), m)]
        for w in range(m * n + 1):
            tail = np.mean([s >= w for s in sums]) if w > m * n / 2 else np.mean([s <= w for s in sums])
            assert tails.rank_sum_exact(w, m, n) == pytest.approx(min(1, 2 * tail))


def test_ks_exact_by_enumeration():
    from itertools import combinations

    m, n = 4, 3
    ds = []
    for c in combinations(range(m + n), m):
        a = b = d = 0
        for k in range(m + n):
            a, b = a + (k in c), b + (k not in c)
            d = max(d, abs(a / m - b / n))
        ds.append(d)
    for d in sorted(set(ds)):
        assert tails.ks_exact(d, m, n) == pytest.approx(np.mean([x >= d - 1e-9 for x in ds]))


def test_ks_asymptotic_series_agree():
    for z in (0.9, 1.0, 1.3):
        d, n = z / math.sqrt(50), 100
        lhs = tails.ks_asymptotic(d, n, n)
        rhs = 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * z * z) for k in range(1, 200))
        assert lhs == pytest.approx(rhs, abs=1e-9)


def test_shapiro_published_example():
    w, p = shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]))
    assert w == pytest.approx(0.79, abs=0.002)
    assert p == pytest.approx(0.0067, abs=0.0003)


def test_shapiro_edges():
    assert shapiro_wilk(np.array([1.0, 2.0])) is None
    assert shapiro_wilk(np.array([2.0, 2.0, 2.0])) is None
    w, p = shapiro_wilk(np.array([1.0, 2.0, 3.0]))
    assert w == pytest.approx(1.0) and p == pytest.approx(1.0)
    rng = np.random.default_rng(1)
    assert shapiro_wilk(rng.normal(size=300))[1] > 0.01
    assert shapiro_wilk(rng.exponential(size=300))[1] < 1e-10


def closed_hommel(p):
    """Adjusted p as the largest Simes p-value over all sets holding the hypothesis."""
    from itertools import combinations

    n = len(p)
    out = np.zeros(n)
    for size in range(1, n + 1):
        for c in combinations(range(n), size):
            q = np.sort(p[list(c)])
            simes = np.min(size * q / np.arange(1, size + 1))
            out[list(c)] = np.maximum(out[list(c)], simes)
    return np.minimum(out, 1)


def test_hommel_is_closed_simes_testing():
    rng = np.random.default_rng(3)
    for k in range(60):
        p = np.sort(rng.random(rng.integers(1, 10)) ** rng.integers(1, 4))
        if k % 3 == 0:
            p = np.round(p, 1)
        assert np.allclose(hommel_adjusted(p), closed_hommel(p))


def test_cross_moments_of_equal_and_wide_rows(spark):
    """Rows wider than a column block, most of them equal but for their id, with nulls: the same sums as in one block."""
    same = [1.0, 0.0, None, 2.0, 5.0, 0.0]
    data = [(i, same) for i in range(40)] + [(40 + i, [float(i), 1.0, 2.0, None, float(-i), 3.0]) for i in range(5)]
    rows = spark.createDataFrame(data, "id int, x array<double>")
    whole, cut = ({(r["a"], r["b"]): tuple(r)[2:] for r in cross_moments(rows, block_cols=c, block_rows=8).collect()} for c in (512, 2))
    assert len(whole) == 15 and cut == whole
