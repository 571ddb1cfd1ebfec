"""Train/test splits, folds and balancing with exact sizes, reproducible under any partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import attach_group_stats, seeded_positions

STORE, FIELD = "Store-Bought", "Environmental"


def stratified_split(df: DataFrame, label: str, p: float, seed: int = 123, key: Sequence[str] = ("file",), out: str = "in_train") -> DataFrame:
    """Mark ceil(p n) rows of each class for training."""
    sized = attach_group_stats(df, [label], F.count(F.lit(1)).alias("_n"))
    placed = seeded_positions(sized, [label], key, seed, "_pos")
    return placed.withColumn(out, F.col("_pos") <= F.ceil(F.lit(p) * F.col("_n"))).drop("_n", "_pos")


def require_rows(df: DataFrame, message: str) -> DataFrame:
    if df.limit(1).count() == 0:
        raise ValueError(message)
    return df


def source_split(df: DataFrame, source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Train on store-bought samples, test on environmental ones."""
    train = require_rows(df.filter(F.col(source) == STORE), "no store-bought samples for training")
    test = require_rows(df.filter(F.col(source) == FIELD), "no environmental samples for testing")
    return train, test


def source_split_half(
    df: DataFrame, label: str, source: str = "source", seed: int = 123, key: Sequence[str] = ("file",)
) -> tuple[DataFrame, DataFrame]:
    """Train on store-bought samples and half of the environmental ones of each class, test on the other half."""
    field = stratified_split(df.filter(F.col(source) == FIELD), label, 0.5, seed, key)
    train = df.filter(F.col(source) == STORE).unionByName(field.filter("in_train").drop("in_train"))
    test = field.filter("NOT in_train").drop("in_train")
    return require_rows(train, "training data is empty"), require_rows(test, "test data is empty")


def balance_classes(
    df: DataFrame, label: str, strata: str | None = None, seed: int = 1234, key: Sequence[str] = ("file",)
) -> DataFrame:
    """Down-sample every class to the size of the smallest, keeping the strata of each class in proportion.

    Rows take turns between strata: a row's place within its stratum over the stratum's size orders the class.
    """
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    smallest = F.broadcast(sizes.agg(F.min("_n").alias("_least")))
    if strata is None:
        placed = seeded_positions(df, [label], key, seed, "_pos")
    else:
        sized = attach_group_stats(df, [label, strata], F.count(F.lit(1)).alias("_sn"))
        inner = seeded_positions(sized, [label, strata], key, seed, "_spos")
        # place within the stratum as a share of it, in steps fine enough for any class
        share = inner.withColumn("_share", (F.col("_spos") - 0.5) / F.col("_sn"))
        from peakweave.operators.ordering import row_positions

        placed = row_positions(share, [label], ["_share", strata, *key], F.floor(F.col("_share") * 4096).cast("int"), "_pos")
    return placed.join(smallest, F.col("_pos") <= F.col("_least")).select(*df.columns)


#: Folds of a cross-validation when none are asked for: a fixed number, so that it does not grow with the rows.
DEFAULT_FOLDS = 5


def fold_count(df: DataFrame, label: str) -> int:
    """As many folds as the smallest class has rows, but at least two: for a few dozen samples, given as `folds`."""
    least = df.groupBy(label).count().agg(F.min("count")).first()[0]
    return max(2, int(least or 0))


def stratified_folds(df: DataFrame, label: str, k: int, seed: int = 123, key: Sequence[str] = ("file",), out: str = "fold") -> DataFrame:
    """Deal the rows of each class out to k folds; class sizes per fold differ by at most one."""
    placed = seeded_positions(df, [label], key, seed, "_pos")
    return placed.withColumn(out, ((F.col("_pos") - 1) % k).cast("int")).drop("_pos")
