"""Normalisations of the long table, by file or by feature."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import attach_group_stats


def norm_tsn(df: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """Divide by the file's total; a zero total divides by one."""
    out = attach_group_stats(df, [file], F.sum(value).alias("_sum"))
    total = F.when(F.col("_sum") == 0, F.lit(1.0)).otherwise(F.col("_sum"))
    return out.withColumn(value, F.col(value) / total).select(*df.columns)


def norm_minmax(df: DataFrame, value: str = "value", feature: str = "feature", constant: str = "zero") -> DataFrame:
    """Scale each feature to 0..1; a constant feature becomes 0 (or NaN with constant='nan')."""
    out = attach_group_stats(df, [feature], F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    flat = F.lit(0.0 if constant == "zero" else float("nan"))
    scaled = F.when(width == 0, flat).otherwise((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0)))
    return out.withColumn(value, F.when(F.col(value).isNotNull(), scaled)).select(*df.columns)


def fit_scale(df: DataFrame, value: str = "value", feature: str = "feature") -> DataFrame:
    """Centre and sample deviation per feature, to be fitted on training files only."""
    return df.groupBy(feature).agg(F.avg(value).alias("center"), F.stddev_samp(value).alias("scale"))


def apply_scale(
    df: DataFrame, fitted: DataFrame, value: str = "value", feature: str = "feature", constant: str = "zero"
) -> DataFrame:
    """Standardise with fitted centres and scales; constant or single-valued features become 0 (or NaN)."""
    flat = F.lit(0.0 if constant == "zero" else float("nan"))
    usable = F.col("scale").isNotNull() & (F.col("scale") != 0)
    scaled = F.when(usable, (F.col(value) - F.col("center")) / F.nullif(F.col("scale"), F.lit(0.0))).otherwise(flat)
    return (
        df.join(fitted, feature)
        .withColumn(value, F.when(F.col(value).isNotNull(), scaled))
        .select(*df.columns)
    )


def norm_zscore(df: DataFrame, value: str = "value", feature: str = "feature", constant: str = "zero") -> DataFrame:
    return apply_scale(df, fit_scale(df, value, feature), value, feature, constant)


def norm_log10(df: DataFrame, value: str = "value", offset: float = 1.0) -> DataFrame:
    if offset <= 0:
        raise ValueError("offset must be positive")
    return df.withColumn(value, F.log10(F.col(value) + F.lit(float(offset))))


def norm_ln(df: DataFrame, value: str = "value") -> DataFrame:
    """Natural logarithm; zero and negative values become null."""
    return df.withColumn(value, F.log(F.col(value)))


def norm_none(df: DataFrame) -> DataFrame:
    return df


def clr(df: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """Centred log ratio; every value must be positive (others become null)."""
    logged = norm_ln(df, value)
    out = attach_group_stats(logged, [file], F.avg(value).alias("_mean_log"))
    return out.withColumn(value, F.col(value) - F.col("_mean_log")).select(*df.columns)


def robust_clr(df: DataFrame, value: str = "value", file: str = "file") -> DataFrame:
    """Log of the non-zero parts minus their mean log within the file; zeros stay zero."""
    log_part = F.when(F.col(value) > 0, F.log(F.col(value)))
    out = attach_group_stats(df, [file], F.avg(log_part).alias("_mean_log"))
    moved = F.when(F.col(value) > 0, F.log(F.col(value)) - F.col("_mean_log")).when(F.col(value) == 0, F.lit(0.0))
    return out.withColumn(value, moved).select(*df.columns)


NORMALIZERS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "tsn": norm_tsn,
    "minmax": norm_minmax,
    "zscore": norm_zscore,
    "log10": norm_log10,
    "ln": norm_ln,
    "robust_clr": robust_clr,
    "none": norm_none,
}
