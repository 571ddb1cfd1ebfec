"""Corrections for many tests, by family.

A correction depends on a p-value's place among the others, so it is worked out once per distinct
p-value with the bucketed running totals and extremes, however many tests share a family.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import running_extremes, value_positions
from peakweave.session import materialize

METHODS = ("bonferroni", "holm", "hochberg", "hommel", "BH", "BY", "fdr", "none")


def _capped(x: Column) -> Column:
    return F.least(F.lit(1.0), x)


def p_adjust(df: DataFrame, family: Sequence[str], p: str = "p_value", methods: Sequence[str] = ("BH",)) -> DataFrame:
    """Add `p_{method}` for each method; tests without a p-value are left out of their family."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {sorted(unknown)}")
    keys = list(family)
    base = df.filter(F.col(p).isNotNull())
    places = value_positions(base, keys, p)
    n, before, upto = F.col("n_total"), F.col("n_before"), F.col("n_before") + F.col("n")
    pv = F.col(p)
    # of equal p-values the first counts for holm, whose values never fall, the last for the step-up methods
    raw = {"holm": pv * (n - before), "hochberg": pv * (n - upto + 1), "step_up": pv * n / upto}
    used = [m for m in ("holm", "hochberg") if m in methods] + (["step_up"] if {"BH", "BY", "fdr"} & set(methods) else [])
    table = places
    if used:
        walks = [(f"_raw_{m}", f"_{m}", "max" if m == "holm" else "min", m == "holm") for m in used]
        table = running_extremes(
            places.withColumns({f"_raw_{m}": raw[m] for m in used}), keys, p, walks
        ).drop(*[f"_raw_{m}" for m in used])
    if "BY" in methods:
        table = table.withColumn("p_BY", _capped(F.col("_step_up") * harmonic(n)))
    if "bonferroni" in methods:
        table = table.withColumn("p_bonferroni", _capped(pv * n))
    for m in ("BH", "fdr"):
        if m in methods:
            table = table.withColumn(f"p_{m}", _capped(F.col("_step_up")))
    for m in ("holm", "hochberg"):
        if m in methods:
            table = table.withColumn(f"p_{m}", _capped(F.col(f"_{m}")))
    if "none" in methods:
        table = table.withColumn("p_none", pv)
    if "hommel" in methods:
        table = hommel(table, keys, p)
    return base.join(table.select(*keys, p, *[f"p_{m}" for m in methods]), [*keys, p])


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n: the sum itself up to 1000, beyond that its asymptotic series (error below 1e-16)."""
    small = F.aggregate(
        F.sequence(F.lit(1), F.least(n, F.lit(1000)).cast("int")), F.lit(0.0), lambda acc, k: acc + 1 / k
    )
    x = n.cast("double")
    # Euler's constant
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    return F.when(n <= 1000, small).otherwise(series)


#: Distinct p-values of a family that one task adjusts, about.
HOMMEL_PART = 1 << 18


#: Passes over all points of a hull before the rest is walked point by point.
HULL_PASSES = 40


def lower_hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points, with x rising, are vertices of their lower convex hull."""
    kept = np.arange(len(x))
    for _ in range(HULL_PASSES):
        if len(kept) < 3:
            return kept
        u, v = x[kept], y[kept]
        above = (v[1:-1] - v[:-2]) * (u[2:] - u[1:-1]) >= (v[2:] - v[1:-1]) * (u[1:-1] - u[:-2])
        if not above.any():
            return kept
        # of two neighbours only one goes, as the other may become a vertex
        above[1:] &= ~(above[:-1] & (np.arange(1, len(above)) % 2 == 1))
        kept = np.concatenate([kept[:1], kept[1:-1][~above], kept[-1:]])
    hull: list[int] = []
    for c in kept.tolist():
        while len(hull) >= 2 and (y[hull[-1]] - y[hull[-2]]) * (x[c] - x[hull[-1]]) >= (y[c] - y[hull[-1]]) * (x[hull[-1]] - x[hull[-2]]):
            hull.pop()
        hull.append(c)
    return np.array(hull)


def hommel_adjusted(p: np.ndarray) -> np.ndarray:
    """Hommel's adjusted p-values of a family's sorted p-values."""
    if len(p) < 2:
        return p.copy()
    x = np.arange(1.0, len(p) + 1)
    kept = lower_hull(x, p)
    return hommel_by_hull(p, x[kept], p[kept], len(p))


def hommel_by_hull(p: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Hommel's adjusted p-values of some p-values of a family of n, from its hull (x, y).

    The adjusted value of p is the greatest min(m p, q_m), q_m being the combined value of the m largest: m times the smallest
    slope from (n-m, 0) to the points (j, p_(j)) beyond. That slope touches a vertex of the lower hull of all points, which of
    them follows from where its edges meet the axis. As m p rises and q_m never does, the best m is found by bisection.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        # where the edge from a vertex to the next meets the axis; edges without slope never do
        rise = np.diff(y)
        meets = np.where(rise > 0, x[1:] - y[1:] * np.diff(x) / rise, -np.inf)
    meets = np.maximum.accumulate(meets) if len(meets) else meets

    def combined(m: np.ndarray) -> np.ndarray:
        at = n - m
        first = np.searchsorted(x, at, side="right")
        touch = np.maximum(np.searchsorted(meets, at, side="left"), first)
        best = np.full(len(m), np.inf)
        for near in (touch - 1, touch, touch + 1):
            v = np.clip(near, first, len(x) - 1)
            best = np.minimum(best, y[v] / (x[v] - at))
        return m * best

    lo, hi = np.ones(len(p), np.int64), np.full(len(p), n, np.int64)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        below = mid * p <= combined(mid)
        lo, hi = np.where(below, mid, lo), np.where(below, hi, mid - 1)
    out = np.minimum(lo * p, combined(lo))
    after = np.minimum(lo + 1, n)
    return np.minimum(np.maximum(np.maximum(out, np.minimum(after * p, combined(after))), p), 1.0)


def hommel(table: DataFrame, family: Sequence[str], p: str) -> DataFrame:
    """Add p_hommel to distinct p-values with their counts (`value_positions`), for families of any size.

    Tasks reduce the p-values they hold to a lower hull; the hulls of a family are merged, and every part of about HOMMEL_PART
    distinct p-values is adjusted beside the merged one. A hull is a few points of many, unless the p-values themselves are convex.
    """
    family = list(family)
    table = materialize(table, "hommel-places")
    kinds = ", ".join(f"`{f}` {table.schema[f].dataType.simpleString()}" for f in family)
    point = f"{kinds}, " * bool(family) + "_x double, _y double, _of long"

    def hull_of(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_x", kind="stable")
        return group.iloc[lower_hull(group["_x"].to_numpy(float), group["_y"].to_numpy(float))]

    def local(batches):
        for batch in batches:
            if len(batch):
                yield from (hull_of(g) for _, g in batch.groupby(family, dropna=False, sort=False)) if family else [hull_of(batch)]

    points = table.select(*family, (F.col("n_before") + F.col("n")).cast("double").alias("_x"), F.col(p).cast("double").alias("_y"), F.col("n_total").alias("_of"))
    hulls = points.mapInPandas(local, point).groupBy(*family).applyInPandas(hull_of, point)
    sizes = table.groupBy(*family).agg(F.ceil(F.count(F.lit(1)) / HOMMEL_PART).alias("_parts"))
    names = [F.col(f).alias(f"_k{i}") for i, f in enumerate(family)]
    sizes = sizes.select(*names, "_parts")
    same = F.lit(True)
    for i, f in enumerate(family):
        same = same & F.col(f).eqNullSafe(F.col(f"_k{i}"))
    keys = [f"_k{i}" for i in range(len(family))]
    dealt = table.join(sizes, same).withColumn("_part", F.pmod(F.xxhash64(p), F.col("_parts"))).drop("_parts", *keys)
    beside = hulls.join(sizes, same).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_parts", *keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields) + ", p_hommel double"

    def adjust(group: pd.DataFrame, hull: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return group.assign(p_hommel=pd.Series(dtype=float))
        hull = hull.sort_values("_x", kind="stable")
        adjusted = hommel_by_hull(group[p].to_numpy(float), hull["_x"].to_numpy(float), hull["_y"].to_numpy(float), int(hull["_of"].iat[0]))
        return group.assign(p_hommel=adjusted)

    return dealt.groupBy(*family, "_part").cogroup(beside.groupBy(*family, "_part")).applyInPandas(
        lambda group, hull: adjust(group.drop(columns="_part"), hull), schema
    )
