"""Missing-value rules over the long table. A cell without a row is missing; no matrix is built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.prevalence import collapse_duplicates, restrict_to
from peakweave.session import materialize


def _one_row(df: DataFrame, *aggs: Column) -> DataFrame:
    """A grand total: one row, so broadcasting it is always safe."""
    return F.broadcast(df.agg(*aggs))


def rule80(df: DataFrame, thr: float = 0.8, file: str = "file", feature: str = "feature", value: str = "value") -> DataFrame:
    """Features measured in at least the given share of all files."""
    total = _one_row(df, F.countDistinct(file).alias("_files"))
    seen = df.filter(F.col(value).isNotNull()).groupBy(feature).agg(F.countDistinct(file).alias("_seen"))
    return seen.join(total, F.col("_seen") / F.col("_files") >= thr).select(feature)


def rule80_by_class(
    df: DataFrame, label: str, thr: float = 0.8, file: str = "file", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Features measured in at least the given share of the files of every class."""
    sizes = df.groupBy(label).agg(F.countDistinct(file).alias("_size"))
    n_classes = _one_row(sizes, F.count(F.lit(1)).alias("_classes"))
    seen = df.filter(F.col(value).isNotNull()).groupBy(feature, label).agg(F.countDistinct(file).alias("_seen"))
    passed = (
        seen.join(sizes, label)
        .filter(F.col("_seen") / F.col("_size") >= thr)
        .groupBy(feature)
        .agg(F.count(F.lit(1)).alias("_ok"))
    )
    return passed.join(n_classes, F.col("_ok") == F.col("_classes")).select(feature)


def prevalent_in_any_class(
    df: DataFrame,
    label: str = "subcategory",
    share: float = 0.9,
    file: str = "file",
    feature: str = "feature",
    value: str = "value",
    technique: str = "technique",
) -> DataFrame:
    """Features with non-zero values in more than the given share of one class's files of their technique."""
    sizes = df.groupBy(technique, label).agg(F.countDistinct(file).alias("_size"))
    seen = (
        df.filter(F.col(value) != 0)
        .groupBy(feature, technique, label)
        .agg(F.countDistinct(file).alias("_seen"))
    )
    return (
        seen.join(sizes, [technique, label])
        .filter(F.col("_seen") / F.col("_size") > share)
        .select(feature)
        .distinct()
    )


def mostly_missing(
    df: DataFrame,
    min_share: float = 0.1,
    file: str = "file",
    feature: str = "feature",
    value: str = "value",
    technique: str = "technique",
) -> DataFrame:
    """Features measured in less than the given share of the files of their own technique."""
    sizes = df.groupBy(technique).agg(F.countDistinct(file).alias("_size"))
    seen = df.groupBy(feature, technique).agg(
        F.countDistinct(F.when(F.col(value).isNotNull(), F.col(file))).alias("_seen")
    )
    return seen.join(sizes, technique).filter(F.col("_seen") / F.col("_size") < min_share).select(feature)


def min_samples(df: DataFrame, more_than: int = 1, file: str = "file", feature: str = "feature", value: str = "value") -> DataFrame:
    """Features with a non-zero value in more than one file."""
    seen = df.filter(F.col(value) != 0).groupBy(feature).agg(F.countDistinct(file).alias("_seen"))
    return seen.filter(F.col("_seen") > more_than).select(feature)


def min_classes(df: DataFrame, label: str = "subcategory", more_than: int = 1, feature: str = "feature", value: str = "value") -> DataFrame:
    """Features with non-zero values in more than one class."""
    seen = df.filter(F.col(value) != 0).groupBy(feature).agg(F.countDistinct(label).alias("_seen"))
    return seen.filter(F.col("_seen") > more_than).select(feature)


def feature_profile(
    df: DataFrame, label: str = "subcategory", points: int = 3, file: str = "file", feature: str = "feature",
    value: str = "value", technique: str = "technique", collapsed: bool = False,
) -> DataFrame:
    """Everything the cleaning rules ask about a feature, from one pass over collapsed cells.

    Cells are first counted per feature and class; all rules are then sums over that small table. `collapsed` says that a
    file has one row per feature, technique and class, so that plain counts do for distinct ones. Class sizes come
    from the files of the whole table. `classes_enough` counts classes with enough values, the files of a
    class outside the feature's technique being measured zeros.
    """
    present = F.col(value).isNotNull()
    files = F.count if collapsed else F.countDistinct
    counts = df.groupBy(feature, technique, label).agg(
        files(F.when(present, F.col(file))).alias("_seen"),
        files(F.when(present & (F.col(value) != 0), F.col(file))).alias("_nonzero"),
    )
    # one row per technique and class, read four times below
    own = materialize(df.groupBy(technique, label).agg(F.countDistinct(file).alias("_own")), "class-sizes")
    totals = own.groupBy(technique).agg(F.sum("_own").alias("_files"))
    # each class lists the files of every technique; the technique names form one row
    names = _one_row(own, F.collect_set(technique).alias("_names"))
    per_class = own.groupBy(label).agg(
        F.sum("_own").alias("_class"), F.map_from_entries(F.collect_list(F.struct(technique, "_own"))).alias("_by")
    )
    zeros = (
        per_class.join(names, F.lit(True))
        .select(label, "_class", "_by", F.explode("_names").alias(technique))
        .withColumn("_own", F.try_element_at("_by", F.col(technique)))
        .withColumn("_zeros", F.col("_class") - F.coalesce("_own", F.lit(0)))
        .drop("_class", "_by")
    )
    free = zeros.groupBy(technique).agg(F.count(F.when(F.col("_zeros") >= points, 1)).alias("_free"))
    extra = (F.col("_zeros") < points) & (F.col("_seen") + F.col("_zeros") >= points)
    return (
        counts.join(zeros, [technique, label])
        .groupBy(feature, technique)
        .agg(
            F.sum("_seen").alias("files_seen"),
            F.sum("_nonzero").alias("files_nonzero"),
            F.count(F.when(F.col("_nonzero") > 0, 1)).alias("classes_nonzero"),
            F.max(F.col("_nonzero") / F.col("_own")).alias("best_share"),
            F.count(F.when(extra, 1)).alias("_extra"),
        )
        .join(totals, technique)
        .join(free, technique)
        .select(
            feature, technique, "files_seen", "files_nonzero", "classes_nonzero", "best_share",
            (F.col("files_seen") / F.col("_files")).alias("technique_share"),
            (F.col("_extra") + F.col("_free")).alias("classes_enough"),
        )
    )


def min_points_two_classes(
    df: DataFrame, label: str = "subcategory", points: int = 3, classes: int = 2, file: str = "file",
    feature: str = "feature", value: str = "value", technique: str = "technique",
) -> DataFrame:
    """Features with enough values in at least two classes, measured zeros of other techniques included."""
    profile = feature_profile(df, label, points, file, feature, value, technique)
    return profile.filter(F.col("classes_enough") >= classes).select(feature)


def filter_source(df: DataFrame, source: str | None, col: str = "source") -> DataFrame:
    """Environmental, Store-Bought, or everything (None)."""
    return df if source is None else df.filter(F.col(col) == source)


def comprehensive_filter(
    df: DataFrame,
    source: str | None = None,
    steps: Sequence[int] = (4, 5, 6),
    label: str = "subcategory",
    use_rescue: bool = True,
    carry: Sequence[str] = ("plastic_type", "subcategory", "source", "polymer"),
    file: str = "file",
    feature: str = "feature",
    value: str = "value",
    technique: str = "technique",
) -> DataFrame:
    """The cleaning pipeline: choose a source, average duplicates, drop sparse features, then steps 4 to 6.

    A feature missing nearly everywhere is still kept when one class shows it consistently (`use_rescue`).
    """
    keys = [file, feature, technique, *[c for c in carry if c in df.columns and c not in (file, feature, technique)]]
    # the profile and the final selection both read the cells
    cells = materialize(collapse_duplicates(filter_source(df, source), keys, value), "cells")
    keep = F.col("technique_share") >= 0.1
    if use_rescue:
        keep = keep | (F.col("best_share") > 0.9)
    if 4 in steps:
        keep = keep & (F.col("files_nonzero") > 1)
    if 5 in steps:
        keep = keep & (F.col("classes_nonzero") > 1)
    if 6 in steps:
        keep = keep & (F.col("classes_enough") >= 2)
    good = feature_profile(cells, label, 3, file, feature, value, technique, collapsed=True).filter(keep)
    return restrict_to(cells, good, feature)


def missing_share(df: DataFrame, file: str = "file", feature: str = "feature", value: str = "value") -> DataFrame:
    """Share of empty cells of the files-by-features matrix."""
    present = df.filter(F.col(value).isNotNull())
    pairs = present.select(file, feature).distinct().agg(F.count(F.lit(1)).alias("present_cells"))
    sides = df.agg(F.countDistinct(file).alias("n_files"), F.countDistinct(feature).alias("n_features"))
    return pairs.join(F.broadcast(sides), F.lit(True)).select(
        "n_files",
        "n_features",
        "present_cells",
        (1 - F.col("present_cells") / (F.col("n_files") * F.col("n_features"))).alias("missing_share"),
    )


def missingness_correlation(
    df: DataFrame, file: str = "file", feature: str = "feature", value: str = "value", mz: str = "mz", rt: str = "rt"
) -> DataFrame:
    """Correlation of each feature's number of missing files with its mean response, m/z and retention time."""
    total = _one_row(df, F.countDistinct(file).alias("_files"))
    cells = collapse_duplicates(df, [file, feature], value)
    response = cells.groupBy(feature).agg(
        F.count(value).alias("_present"), F.avg(value).alias("_response")
    )
    place = df.groupBy(feature).agg(F.avg(mz).alias("_mz"), F.avg(rt).alias("_rt"))
    per = response.join(place, feature).join(total, F.lit(True)).withColumn(
        "_missing", (F.col("_files") - F.col("_present")).cast("double")
    )
    return per.agg(
        F.corr("_response", "_missing").alias("r_response"),
        F.corr("_mz", "_missing").alias("r_mz"),
        F.corr("_rt", "_missing").alias("r_rt"),
    )


def sparse_in_groups(
    df: DataFrame, label: str, more_than: int = 2, groups: int = 2, invert: bool = False,
    file: str = "file", feature: str = "feature", value: str = "value",
) -> DataFrame:
    """Features with more than 2 values in at most 2 groups; `invert` returns the well-covered ones."""
    seen = df.groupBy(feature, label).agg(
        F.countDistinct(F.when(F.col(value).isNotNull(), F.col(file))).alias("_n")
    )
    full = seen.groupBy(feature).agg(F.count(F.when(F.col("_n") > more_than, 1)).alias("_full"))
    covered = F.col("_full") > groups
    return full.filter(covered if invert else ~covered).select(feature)


def coverage_sweep(
    df: DataFrame, thresholds: Sequence[float], file: str = "file", value: str = "value"
) -> DataFrame:
    """Mean share of signal and mean number of peaks left per file at each threshold.

    All thresholds are counted in one pass over the peaks; files with nothing left leave the mean.
    """
    aggs = [F.sum(value).alias("_all")]
    for i, t in enumerate(thresholds):
        above = F.when(F.col(value) > F.lit(float(t)), F.col(value))
        aggs += [F.sum(above).alias(f"_s{i}"), F.count(above).alias(f"_n{i}")]
    per_file = df.groupBy(file).agg(*aggs)
    rows = F.array(
        *[
            F.struct(
                F.lit(float(t)).alias("threshold"),
                (F.col(f"_s{i}") * 100 / F.col("_all")).alias("cover"),
                F.col(f"_n{i}").alias("peaks"),
            )
            for i, t in enumerate(thresholds)
        ]
    )
    return (
        per_file.select(F.explode(rows).alias("r"))
        .select("r.*")
        .filter(F.col("peaks") > 0)
        .groupBy("threshold")
        .agg(
            F.avg("cover").alias("mean_coverage"),
            F.avg("peaks").alias("mean_peaks"),
            F.count(F.lit(1)).alias("n_files"),
        )
    )


def flag_structural_zeros(cells: DataFrame, files: DataFrame, file: str = "file", technique: str = "technique") -> DataFrame:
    """Mark cells whose file was measured by another technique than the feature: there zero is known, not missing."""
    own = files.select(file, F.col(technique).alias("_file_technique")).distinct()
    joined = cells.join(own, file, "left")
    return joined.withColumn("structural_zero", F.col("_file_technique") != F.col(technique)).drop("_file_technique")
