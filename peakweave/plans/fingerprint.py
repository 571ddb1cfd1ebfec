"""Raw peaks to a labelled fingerprint, and important features to chemical names.

Steps that several later ones read are written once to the shared folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.functions.names import SOURCE_DEFAULT, SOURCE_RULES, classify_by_name
from peakweave.operators.align import align_features
from peakweave.operators.blanks import blank_subtract, remove_benchmarks
from peakweave.operators.match import annotate_and_average, attach_labels, library_hits
from peakweave.operators.prevalence import beyond_list, collapse_duplicates, feature_centroids, keep_shared, tsn_by_file
from peakweave.operators.summary import top_k_by_mean
from peakweave.session import materialize


def fingerprint(
    peaks: DataFrame, rt_tol: float, mz_tol: float, technique: str, run_type: str, split_time: float | None = None,
    rt_tol_late: float | None = None, benchmarks: Sequence[float] = (), benchmark_tol: float = 0.0005,
    blank_keys: Sequence[str] = ("feature",),
) -> DataFrame:
    """Align, drop internal standards, subtract blanks and keep features seen in at least two files."""
    aligned = align_features(peaks, rt_tol, mz_tol, split_time, rt_tol_late, run_type)
    cleaned = materialize(remove_benchmarks(aligned, benchmarks, benchmark_tol).filter(F.col("feature").isNotNull()), "aligned")
    above_blank = materialize(blank_subtract(cleaned, blank_keys), "above-blank")
    return keep_shared(above_blank).select(
        "file", "feature", "mz", "rt", "value",
        classify_by_name(F.col("file").cast("string"), SOURCE_RULES, SOURCE_DEFAULT).alias("source"),
        F.lit(technique).alias("technique"),
    )


def strongest_features(
    aligned: DataFrame, labels: DataFrame, label: str = "plastic_type", k: int = 10, blank_keys: Sequence[str] = ("feature",)
) -> DataFrame:
    """Aligned peaks to the strongest features of each class by mean share of the file's signal."""
    used = aligned.filter(F.col("feature").isNotNull()).select("file", "feature", "value", "type", *[k for k in blank_keys if k != "feature"])
    # both the count of files and the shares per file read what is left above the blanks
    shared = keep_shared(materialize(blank_subtract(used, blank_keys), "above-blank"))
    shares = tsn_by_file(shared)
    cells = collapse_duplicates(shares, ("file", "feature"), "value_share")
    labelled = attach_labels(cells, labels, [label]).filter(F.col(label).isNotNull())
    return top_k_by_mean(labelled, label, k, "feature", "value_share")


def identify(
    values: DataFrame, important: DataFrame, library: DataFrame, tol: float, label: str,
) -> tuple[DataFrame, DataFrame]:
    """Mean value per important feature, library compound and class; and the features no compound explains."""
    picked = values.join(important.select("feature"), "feature", "left_semi")
    centroids = feature_centroids(picked)
    hits = library_hits(centroids, library, tol)
    named = hits.join(library.select("mass", "name").distinct(), "mass").select("feature", "name").distinct()
    return annotate_and_average(values, named, ["name", label]), beyond_list(picked, hits)
