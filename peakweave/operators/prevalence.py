"""How often features occur: cutoffs, per-file shares, shared and common features, duplicates, centroids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import attach_group_stats


def intensity_cutoff(df: DataFrame, thr: float, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows strictly above the threshold, and the removed rest; a null value belongs to neither."""
    return df.filter(F.col(value) > thr), df.filter(F.col(value) <= thr)


def tsn_by_file(df: DataFrame, values: Sequence[str] = ("value",), file: str = "file", suffix: str = "_share") -> DataFrame:
    """Share of each positive value in its file's total; every listed value must be positive."""
    kept = df
    for v in values:
        kept = kept.filter(F.col(v) > 0)
    summed = attach_group_stats(kept, [file], *[F.sum(v).alias(f"_sum_{v}") for v in values])
    return summed.select(*df.columns, *[(F.col(v) / F.col(f"_sum_{v}")).alias(f"{v}{suffix}") for v in values])


def shared_features(
    df: DataFrame, by: str = "file", feature: str = "feature", min_groups: int = 2, out: str = "presence"
) -> DataFrame:
    """Label rows `shared` when their feature occurs in at least min_groups distinct files, else `unique`."""
    marked = attach_group_stats(df, [feature], F.countDistinct(by).alias("_groups"))
    return marked.withColumn(out, F.when(F.col("_groups") >= min_groups, "shared").otherwise("unique")).drop("_groups")


def keep_shared(df: DataFrame, by: str = "file", feature: str = "feature", min_groups: int = 2) -> DataFrame:
    """Only rows whose feature occurs in at least min_groups distinct files."""
    good = df.groupBy(feature).agg(F.countDistinct(by).alias("_groups")).filter(F.col("_groups") >= min_groups)
    return df.join(good.select(feature), feature, "left_semi")


def presence_class(df: DataFrame, by: str, n_groups: int, feature: str = "feature", out: str = "presence") -> DataFrame:
    """Older three-way split: `similar` in more than n-1 groups, `unique` in one, `other` between."""
    marked = attach_group_stats(df, [feature], F.countDistinct(by).alias("_groups"))
    label = (
        F.when(F.col("_groups") > n_groups - 1, "similar").when(F.col("_groups") < 2, "unique").otherwise("other")
    )
    return marked.withColumn(out, label).drop("_groups")


def replicate_consistency(df: DataFrame, keys: Sequence[str], replicate: str = "replicate", more_than: int = 1) -> DataFrame:
    """Rows whose key was seen in more than one replicate."""
    good = df.groupBy(*keys).agg(F.countDistinct(replicate).alias("_r")).filter(F.col("_r") > more_than)
    return df.join(good.select(*keys), list(keys), "left_semi")


def collapse_duplicates(
    df: DataFrame, keys: Sequence[str] = ("file", "feature"), value: str = "value"
) -> DataFrame:
    """Mean of repeated measurements of one cell; nulls are skipped."""
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def duplicate_report(df: DataFrame, keys: Sequence[str] = ("file", "feature")) -> DataFrame:
    """Cells measured more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def common_features(df: DataFrame, across: str, feature: str = "feature", n_groups: int | None = None) -> DataFrame:
    """Features present in all groups of `across` (or in n_groups of them)."""
    per = df.groupBy(feature).agg(F.countDistinct(across).alias("_g"))
    if n_groups is not None:
        return per.filter(F.col("_g") >= n_groups).select(feature)
    total = df.agg(F.countDistinct(across).alias("_all"))
    return per.join(F.broadcast(total), F.col("_g") == F.col("_all")).select(feature)


def restrict_to(df: DataFrame, features: DataFrame, feature: str = "feature") -> DataFrame:
    """Rows of the listed features."""
    return df.join(features.select(feature), feature, "left_semi")


def beyond_list(df: DataFrame, hits: DataFrame, feature: str = "feature", mz: str = "mz", rt: str = "rt") -> DataFrame:
    """Mean position of the features that no library explains."""
    missed = df.join(hits.select(feature), feature, "left_anti")
    return missed.groupBy(feature).agg(F.avg(mz).alias("mean_mz"), F.avg(rt).alias("mean_rt"))


def feature_centroids(df: DataFrame, feature: str = "feature", mz: str = "mz", rt: str = "rt", digits: int = 4) -> DataFrame:
    """Mean m/z and retention time per feature, rounded half up."""
    return df.groupBy(feature).agg(
        F.round(F.avg(mz), digits).alias("mean_mz"), F.round(F.avg(rt), digits).alias("mean_rt")
    )


# The technique combinations analysed together.
COMBINATIONS = {
    "GC": ("GC",),
    "HPLC": ("HPLC",),
    "ICP": ("ICP",),
    "GC_HPLC": ("GC", "HPLC"),
    "GC_ICP": ("GC", "ICP"),
    "HPLC_ICP": ("HPLC", "ICP"),
    "GC_HPLC_ICP": ("GC", "HPLC", "ICP"),
}


def combine_techniques(df: DataFrame, technique: str = "technique", out: str = "combo",
                       position: Sequence[str] = ("mz", "rt")) -> DataFrame:
    """One long table keyed by combination instead of seven tables.

    Metals have no position, so combinations holding them leave m/z and retention time empty.
    """
    members: Column = F.array(
        *[F.when(F.col(technique).isin(*parts), F.lit(name)) for name, parts in COMBINATIONS.items()]
    )
    exploded = df.withColumn(out, F.explode(F.filter(members, lambda c: c.isNotNull())))
    mixed = F.col(out).contains("ICP")
    for p in position:
        if p in df.columns:
            exploded = exploded.withColumn(p, F.when(~mixed, F.col(p)))
    return exploded


def drop_small_classes(df: DataFrame, label: str, min_n: int, unit: str = "file") -> DataFrame:
    """Drop classes with fewer than min_n distinct units."""
    good = df.groupBy(label).agg(F.countDistinct(unit).alias("_n")).filter(F.col("_n") >= min_n)
    return df.join(good.select(label), label, "left_semi")
