"""Filling missing cells of the files-by-features matrix.

Imputers that use one number per feature are written as a small table of fill values. `fill_missing` then
makes the missing cells: for each technique its files against its features, because only those
can be missing rather than structurally zero. `implicit` keeps them implied where only figures of the filled matrix are asked for.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.blanks import BLANK
from peakweave.operators.implicit import missing_cells
from peakweave.operators.ordering import exact_quantiles


def fill_missing(
    df: DataFrame,
    fills: DataFrame | None,
    default: Column | float | None = None,
    file: str = "file",
    feature: str = "feature",
    value: str = "value",
    technique: str | None = None,
    change: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Dense long table: measured cells as they are, missing ones from `fills(feature, fill)` or the default.

    Measured cells pass through; only the others are made (`implicit.missing_cells`), so no grid is joined or shuffled.
    `change`, as a rounding, is done to every value, but to a fill only once a feature.
    """
    marks = [] if technique is None else [technique]
    kind = df.schema[value].dataType
    changed = change or (lambda v: v)
    there = df.filter(F.col(value).isNotNull()).select(file, feature, *marks, changed(F.col(value)).alias(value), F.lit(False).alias("imputed"))
    fill = lambda f: changed(F.coalesce(f, _lit(default)).cast(kind))
    if isinstance(default, Column):
        made = fill(F.col("fill"))
        absent = missing_cells(df, fills, file, feature, value, technique)
    else:
        made = F.col("fill").cast(kind)
        absent = missing_cells(df, fills, file, feature, value, technique, fill)
    return there.unionByName(absent.select(file, feature, *marks, made.alias(value), F.lit(True).alias("imputed")))


def _lit(x: Column | float | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def impute_none(df: DataFrame, **_: str) -> DataFrame:
    return df


def zero_fills(df: DataFrame, feature: str = "feature") -> DataFrame:
    return df.select(feature, F.lit(0.0).alias("fill")).distinct()


def impute_zero(df: DataFrame, **cols: str) -> DataFrame:
    return fill_missing(df, None, 0.0, **cols)


def mean_fills(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return df.groupBy(feature).agg(F.avg(value).alias("fill"))


def impute_mean(df: DataFrame, feature: str = "feature", value: str = "value", **cols: str) -> DataFrame:
    return fill_missing(df, mean_fills(df, feature, value), feature=feature, value=value, **cols)


def median_fills(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    return exact_quantiles(df, [feature], value, [0.5], ["fill"])


def impute_median(df: DataFrame, feature: str = "feature", value: str = "value", **cols: str) -> DataFrame:
    return fill_missing(df, median_fills(df, feature, value), feature=feature, value=value, **cols)


def half_min_fills(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """Half of the smallest positive value; features without one get zero."""
    smallest = F.min(F.when(F.col(value) > 0, F.col(value)))
    return df.groupBy(feature).agg(F.coalesce(smallest / 2, F.lit(0.0)).alias("fill"))


def impute_half_min(df: DataFrame, feature: str = "feature", value: str = "value", **cols: str) -> DataFrame:
    return fill_missing(df, half_min_fills(df, feature, value), feature=feature, value=value, **cols)


def impute_half_min_technique(
    df: DataFrame, technique: str = "technique", file: str = "file", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Half of the smallest value of the whole technique."""
    smallest = df.groupBy(technique).agg((F.min(value) / 2).alias("fill"))
    # halves of whole values need not be whole
    known = df.filter(F.col(technique).isNotNull()).withColumn(value, F.col(value).cast("double"))
    return fill_missing(known, smallest, None, file, feature, value, technique)


def two_smallest(df: DataFrame, value: str = "value") -> DataFrame:
    """The two smallest values of the table, a repeated one counting twice, as one row (lo, hi)."""
    low = df.select(value).filter(F.col(value).isNotNull()).orderBy(value).limit(2)
    return low.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))


def impute_uniform_lod(
    df: DataFrame, seed: int = 0, divide: float = 1.0, file: str = "file", feature: str = "feature",
    value: str = "value", technique: str | None = None,
) -> DataFrame:
    """Uniform draws between the two smallest values; the draw depends on seed, file and feature only."""
    bounds = F.broadcast(two_smallest(df, value))
    # 53 leading bits of the hash as a number in [0, 1)
    u = F.shiftrightunsigned(F.xxhash64(file, feature, F.lit(seed)), 11) / F.lit(float(1 << 53))
    draw = (F.col("lo") + (F.col("hi") - F.col("lo")) * u) / F.lit(float(divide))
    out = fill_missing(df, None, None, file, feature, value, technique).join(bounds, F.lit(True))
    return out.withColumn(value, F.coalesce(F.col(value), draw)).drop("lo", "hi")


def blank_lod_fills(
    blanks: DataFrame, feature: str = "feature", value: str = "value", type_col: str = "type", k: float = 3.0
) -> DataFrame:
    """Detection limit of features seen in at least two blanks: blank mean plus k deviations."""
    stats = blanks.filter(F.col(type_col) == BLANK).groupBy(feature).agg(
        F.count(value).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s")
    )
    return stats.filter(F.col("_n") >= 2).select(feature, (F.col("_m") + k * F.col("_s")).alias("fill"))


def impute_blank_lod(
    df: DataFrame, peaks: DataFrame, file: str = "file", feature: str = "feature", value: str = "value",
    type_col: str = "type", technique: str | None = None, change: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Detection limit from the blanks, else the smallest value of the data set."""
    lowest = F.broadcast(df.agg(F.min(value).alias("_lowest")))
    limits = blank_lod_fills(peaks, feature, value, type_col)
    fills = df.select(feature).distinct().join(limits, feature, "left").join(lowest, F.lit(True))
    return fill_missing(df, fills.select(feature, F.coalesce("fill", "_lowest").alias("fill")), None, file, feature, value, technique, change)


IMPUTERS: dict[str, Callable[..., DataFrame]] = {
    "zero": impute_zero,
    "mean": impute_mean,
    "median": impute_median,
    "half_min": impute_half_min,
    "uniform_lod": impute_uniform_lod,
    "none": impute_none,
}

