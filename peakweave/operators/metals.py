"""Trace metals: the wide element table made long, and the best gas mode of each isotope."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.functions.names import drop_elements_by_pattern, drop_gas_mode
from peakweave.operators.prevalence import common_features, restrict_to
from peakweave.operators.reshape import to_long


def best_metal_mode(qc: DataFrame, name: str = "name", recovery: str = "recovery", uncertainty: str = "uncertainty") -> DataFrame:
    """Per isotope number keep the mode with the best recovery, else the smallest uncertainty, else the first name.

    Modes of one isotope are compared by a minimum, not sorted.
    """
    isotope = F.regexp_extract(F.col(name), r"^[^ ]*", 0)
    order = F.struct(
        F.col(recovery).isNull().alias("a"), (-F.col(recovery)).alias("b"),
        F.col(uncertainty).isNull().alias("c"), F.col(uncertainty).alias("d"), F.col(name).alias("e"),
    )
    keep = qc.groupBy(isotope.alias("isotope")).agg(F.min_by(F.struct(*qc.columns), order).alias("r"))
    return keep.select("isotope", "r.*")


def metals_to_long(wide: DataFrame, file: str = "file") -> DataFrame:
    """One row per file and element column, in the usual gas mode, with text values cast to numbers."""
    long = to_long(wide, [file], "feature", "value")
    return drop_gas_mode(long.withColumn("value", F.col("value").try_cast("double")))


def metal_fingerprint(long: DataFrame, qc: DataFrame, batch: str = "batch") -> DataFrame:
    """Elements measured in their best mode, present in all batches, without those of seawater."""
    chosen = best_metal_mode(qc).select(F.col("name").alias("feature"))
    kept = restrict_to(long, chosen)
    kept = restrict_to(kept, common_features(kept, batch))
    return drop_elements_by_pattern(kept).withColumn("technique", F.lit("ICP"))
