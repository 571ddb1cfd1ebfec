"""Name operators that need to see other rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import attach_group_stats, hash_bucket, row_positions


def replicate_suffix(
    df: DataFrame, name: str, order: Sequence[str], bucket: Column | None = None, out: str | None = None
) -> DataFrame:
    """Make repeated names unique as `x_rep1`, `x_rep2`, ...; a name that occurs once stays as it is.

    Replicates are numbered along `order`; pass a `bucket` that never decreases along it to split names
    held by very many rows. Without one they are numbered by a hash of the order columns.
    """
    counted = attach_group_stats(df, [name], F.count(F.lit(1)).alias("_copies"))
    if bucket is None:
        counted = counted.withColumn("_h", F.xxhash64(*order))
        placed = row_positions(counted, [name], ["_h", *order], hash_bucket(F.col("_h")), "_rep").drop("_h")
    else:
        placed = row_positions(counted, [name], order, bucket, "_rep")
    numbered = F.concat(F.col(name), F.lit("_rep"), F.col("_rep").cast("string"))
    target = out or name
    named = placed.withColumn(target, F.when(F.col("_copies") > 1, numbered).otherwise(F.col(name)))
    return named.select(*df.columns, *[c for c in (target,) if c not in df.columns])


def group_replicate_columns(
    df: DataFrame, keys: Sequence[str], name: str, position: str
) -> DataFrame:
    """Long spectra whose sample columns repeat: keep repeated names only and number them `_rep{n}`.

    One row per (wavenumber, sample column); `position` is the column's place in the file.
    """
    columns = df.select(name, position).distinct()
    repeated = attach_group_stats(columns, [name], F.count(F.lit(1)).alias("_copies")).filter(F.col("_copies") > 1)
    numbered = row_positions(repeated, [name], [position], F.floor(F.col(position) / 4096).cast("int"), "rep")
    return df.join(numbered.drop("_copies"), [name, position]).select(
        *keys,
        F.concat(F.col(name), F.lit("_rep"), F.col("rep").cast("string")).alias("sample"),
        *[c for c in df.columns if c not in (*keys, name, position)],
    )


def factor_codes(df: DataFrame, col: str, out: str = "code") -> DataFrame:
    """Zero-based code of each level in alphabetical order. Levels are few, so they are ranked apart from the rows."""
    from pyspark.sql import Window

    levels = df.filter(F.col(col).isNotNull()).select(col).distinct()
    coded = levels.withColumn(out, (F.row_number().over(Window.orderBy(col)) - 1).cast("int"))
    return df.join(coded, col, "left")
