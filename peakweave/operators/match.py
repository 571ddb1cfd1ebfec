"""Matching features to reference compounds by mass.

A tolerance join is written as an equality join on mass cells, each library mass being listed in
its own and both neighbouring cells, followed by the exact condition. It runs on distinct masses of
both sides, so a mass carried by very many features is compared once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_SLACK = 1 + 1e-6


def match_masses(masses: DataFrame, library: DataFrame, tol: float, mz: str = "mean_mz", mass: str = "mass") -> DataFrame:
    """Distinct (library mass, feature mass) pairs with mass - tol <= mz <= mass + tol."""
    width = tol * _SLACK
    left = masses.filter(F.col(mz).isNotNull()).select(mz).distinct().withColumn("_cell", F.floor(F.col(mz) / width))
    cell = F.floor(F.col(mass) / width)
    right = (
        library.filter(F.col(mass).isNotNull())
        .select(mass)
        .distinct()
        .withColumn("_cell", F.explode(F.array(cell - 1, cell, cell + 1)))
    )
    inside = (F.col(mz) <= F.col(mass) + F.lit(tol)) & (F.col(mz) >= F.col(mass) - F.lit(tol))
    return left.join(right, "_cell").filter(inside).select(mass, mz)


def library_hits(
    features: DataFrame, library: DataFrame, tol: float,
    feature: str = "feature", mz: str = "mean_mz", mass: str = "mass",
) -> DataFrame:
    """One row per (library mass, matching feature)."""
    return match_masses(features, library, tol, mz, mass).join(features.select(feature, mz), mz).select(mass, feature, mz)


def match_library(
    features: DataFrame, library: DataFrame, tol: float, mode: str = "first", order: Sequence[str] = ("name",),
    feature: str = "feature", mz: str = "mean_mz", mass: str = "mass",
) -> DataFrame:
    """Library rows with a match, their features joined by `, ` in name order.

    `first` keeps one library row per mass (the first along `order`), `all` keeps every row.
    """
    hits = library_hits(features, library, tol, feature, mz, mass)
    joined = hits.groupBy(mass).agg(
        F.array_join(F.array_sort(F.collect_set(F.col(feature).cast("string"))), ", ").alias("features"),
        F.count(F.lit(1)).alias("n_features"),
    )
    if mode == "first":
        w = Window.partitionBy(mass).orderBy(*order)
        library = library.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")
    elif mode != "all":
        raise ValueError("mode is 'first' or 'all'")
    return library.join(joined, mass)


def annotate_and_average(
    values: DataFrame, hits: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value",
) -> DataFrame:
    """Mean value per feature, hit and class over features that have a hit.

    A feature's means do not depend on its hits, so values are averaged once, and the means meet the hits.
    """
    hits = hits.select(feature, *[k for k in keys if k in hits.columns]).distinct()
    classes = [k for k in keys if k not in hits.columns]
    means = values.join(hits.select(feature), feature, "left_semi").groupBy(feature, *classes).agg(F.avg(value).alias("mean_value"))
    return means.join(hits, feature).select(feature, *keys, "mean_value")


def annotate_by_joined_name(
    values: DataFrame, matched: DataFrame, keys: Sequence[str], feature: str = "feature", value: str = "value",
) -> DataFrame:
    """The literal older form: joins on the concatenated feature text, so only single-feature hits are found."""
    named = matched.withColumnRenamed("features", "_text")
    joined = values.join(named, F.col(feature).cast("string") == F.col("_text"))
    return joined.groupBy(feature, *keys).agg(F.avg(value).alias("mean_value"))


def attach_labels(df: DataFrame, labels: DataFrame, columns: Sequence[str], file: str = "file") -> DataFrame:
    """Left join of the label columns by file; the label table is broadcast only when Spark measures it small."""
    return df.join(labels.select(file, *columns), file, "left")
