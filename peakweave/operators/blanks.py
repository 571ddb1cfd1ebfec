"""Removing what the blanks and the internal standards explain."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import attach_group_stats

BLANK = "Blanks"


def _blank_stats(value: str, type_col: str) -> tuple[Column, Column, Column]:
    blank_value = F.when(F.col(type_col) == BLANK, F.col(value))
    return (
        F.count(F.when(F.col(type_col) == BLANK, 1)).alias("_blanks"),
        F.avg(blank_value).alias("_blank_mean"),
        F.stddev_samp(blank_value).alias("_blank_sd"),
    )


def blank_subtract(
    df: DataFrame,
    keys: Sequence[str] = ("feature",),
    value: str = "value",
    type_col: str = "type",
    k: float = 3.0,
) -> DataFrame:
    """Subtract the blank mean of each group and keep samples above k blank standard deviations.

    Groups without blanks pass unchanged. With a single blank the deviation is unknown, so no sample of
    the group can be shown to exceed it and all are dropped.
    """
    stats = attach_group_stats(df, keys, *_blank_stats(value, type_col))
    corrected = F.col(value) - F.col("_blank_mean")
    no_blank = F.col("_blanks") == 0
    above = (F.col(type_col) != BLANK) & (corrected > 0) & (corrected > F.lit(k) * F.col("_blank_sd"))
    return (
        stats.filter(no_blank | above)
        .withColumn(value, F.when(no_blank, F.col(value)).otherwise(corrected))
        .select(*df.columns)
    )


def blank_subtract_mean(
    df: DataFrame, keys: Sequence[str] = ("feature",), value: str = "value", type_col: str = "type"
) -> DataFrame:
    """Older form: subtract the blank mean only and drop the blanks; negative rests are kept for later filters."""
    stats = attach_group_stats(df, keys, *_blank_stats(value, type_col))
    no_blank = F.col("_blanks") == 0
    return (
        stats.filter(no_blank | (F.col(type_col) != BLANK))
        .withColumn(value, F.when(no_blank, F.col(value)).otherwise(F.col(value) - F.col("_blank_mean")))
        .select(*df.columns)
    )


def in_box(mz_range: tuple[float, float], rt_range: tuple[float, float] | None = None,
           mz: str = "mz", rt: str = "rt", open_rt: bool = True) -> Column:
    """Peaks inside a rectangle: m/z bounds inclusive, retention time bounds open unless told otherwise."""
    inside = (F.col(mz) >= mz_range[0]) & (F.col(mz) <= mz_range[1])
    if rt_range is None:
        return inside
    lo, hi = rt_range
    if open_rt:
        return inside & (F.col(rt) > lo) & (F.col(rt) < hi)
    return inside & (F.col(rt) >= lo) & (F.col(rt) <= hi)


def remove_benchmarks(
    df: DataFrame,
    masses: Sequence[float],
    mz_tol: float,
    rt_range: tuple[float, float] | None = None,
    mz: str = "mz",
    rt: str = "rt",
) -> DataFrame:
    """Drop peaks of internal standards. Nothing matching keeps everything, and null peaks are kept."""
    if not masses:
        return df
    hits = reduce(lambda a, b: a | b, [in_box((m - mz_tol, m + mz_tol), rt_range, mz, rt) for m in masses])
    return df.filter(~F.coalesce(hits, F.lit(False)))


def remove_box(df: DataFrame, mz_range: tuple[float, float], rt_range: tuple[float, float] | None = None,
               mz: str = "mz", rt: str = "rt") -> DataFrame:
    """Drop peaks inside one rectangle, such as a solvent peak."""
    return df.filter(~F.coalesce(in_box(mz_range, rt_range, mz, rt), F.lit(False)))


# Internal standards used when liquid chromatography runs are aligned, and the solvent box of the
# gas chromatography runs.
LC_STANDARD_MASSES = (156.0957, 198.1723, 246.2568, 305.1956, 342.1722)
LC_STANDARD_TOLERANCE = 0.0005
GC_SOLVENT_MZ = (98.0, 98.5)
GC_SOLVENT_RT = (13.4, 13.5)
