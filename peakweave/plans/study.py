"""Whole classifier studies: screening of preparation methods, and train/test runs over data combinations."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.cluster import average_resolution
from peakweave.operators.distance import correlation_matrix, correlation_preservation
from peakweave.operators.implicit import Implicit, implicit
from peakweave.operators.impute import IMPUTERS, half_min_fills, impute_blank_lod, impute_half_min_technique, mean_fills, median_fills, zero_fills
from peakweave.operators.impute_models import impute_knn
from peakweave.operators.metrics import confusion_table
from peakweave.operators.models import Fitted, random_forest, rf_stability, scores
from peakweave.operators.normalize import NORMALIZERS
from peakweave.operators.ordering import index_features
from peakweave.operators.prevalence import drop_small_classes, restrict_to
from peakweave.operators.project import pca
from peakweave.operators.reshape import array_to_long, to_rows, to_vectors
from peakweave.operators.selection import recursive_elimination, refit_top
from peakweave.operators.splits import FIELD, STORE, source_split, source_split_half, stratified_split
from peakweave.operators.summary import rank_rows
from peakweave.operators.tests import ks_two_sample, pairwise_tests
from peakweave.session import cut_lineage

SPLITS = ("store_to_field", "store_and_half_field", "store_only", "field_only")

RANK_ORDER = ("cv_mean DESC", "cv_sd ASC", "resolution DESC", "preservation DESC", "ks_p ASC")


def split_samples(samples: DataFrame, label: str, split: str, p: float = 0.7, seed: int = 123, key: str = "file") -> tuple[DataFrame, DataFrame]:
    """Train and test samples under one of the four designs."""
    if split == "store_to_field":
        return source_split(samples)
    if split == "store_and_half_field":
        return source_split_half(samples, label, seed=seed, key=(key,))
    if split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    one = samples.filter(F.col("source") == (STORE if split == "store_only" else FIELD))
    marked = stratified_split(one, label, p, seed, (key,))
    return marked.filter("in_train").drop("in_train"), marked.filter("NOT in_train").drop("in_train")


#: Imputers that are one number per feature, and normalisers with a form for implied cells.
FILLS = {"zero": zero_fills, "mean": mean_fills, "median": median_fills, "half_min": half_min_fills}
IMPLIED: dict[str, Callable[[Implicit], Implicit]] = {
    "zscore": Implicit.zscore, "minmax": Implicit.minmax, "log10": lambda m: m.mapped(lambda v: F.log10(v + 1.0)),
    "ln": lambda m: m.mapped(lambda v: F.coalesce(F.log(v), F.lit(0.0))), "tsn": lambda m: m, "none": lambda m: m,
}


def prepare(cells: DataFrame, imputer: str | Callable[[DataFrame], DataFrame], normalizer: str, file: str = "file", peaks: DataFrame | None = None) -> DataFrame:
    """Dense normalised long cells.

    The imputer is a name in IMPUTERS, "knn", "half_min_technique" (the cells have a technique), "blank_lod" (`peaks` have the
    blanks), or any function of the cells.
    """
    if callable(imputer):
        filled = imputer(cells)
    elif imputer == "knn":
        rows, index = to_rows(cells, file, "feature", "value", fill=None)
        long = array_to_long(impute_knn(rows, key=file), file, "x", "idx", "value")
        filled = long.join(index, "idx")
    elif imputer == "half_min_technique":
        filled = impute_half_min_technique(cells, file=file)
    elif imputer == "blank_lod":
        filled = impute_blank_lod(cells.select(file, "feature", "value"), peaks, file=file)
    else:
        filled = IMPUTERS[imputer](cells.select(file, "feature", "value"))
    return NORMALIZERS[normalizer](filled.select(file, "feature", "value"))


def prepare_rows(cells: DataFrame, imputer: str | Callable[[DataFrame], DataFrame], normalizer: str, file: str = "file", peaks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """One dense array per file, and the feature index, of `prepare`. Where a fill per feature says it all, cells stay implied up to the arrays."""
    if not callable(imputer) and imputer in FILLS and normalizer in IMPLIED:
        cells = cells.select(file, "feature", "value")
        matrix = implicit(cells, FILLS[imputer](cells), file=file)
        return IMPLIED[normalizer](matrix).dense_rows(matrix.file_totals() if normalizer == "tsn" else None)
    return to_rows(prepare(cells, imputer, normalizer, file, peaks), file, "feature", "value")


def _samples(cells: DataFrame, label: str, carry: Sequence[str], file: str) -> DataFrame:
    names = cells.select(file, label, *carry).distinct()
    return drop_small_classes(names, label, 2, file)


def screen_preprocessing(
    cells: DataFrame, label: str, imputers: Sequence[str] = ("mean", "zero", "half_min", "median"),
    normalizers: Sequence[str] = ("tsn", "minmax", "zscore", "none"), split: str = "store_to_field",
    settings: Sequence[dict] | None = None, folds: int | None = None, file: str = "file", fit: Callable[..., Fitted] = random_forest,
) -> DataFrame:
    """One row per imputation and normalisation with all its scores, ranked; rank 1 is the method to use.

    Scores: separation of the classes on two components, how well feature correlations survive, distance of the
    imputed from the measured distribution, stability of a forest over folds, and accuracy on test samples.
    """
    spark = cells.sparkSession
    # everything used by all combinations is written once
    samples = cut_lineage(_samples(cells, label, ("source",), file))
    kept = cut_lineage(cells.join(samples.select(file), file, "left_semi").select(file, "feature", "value"))
    index = cut_lineage(index_features(kept))
    before = cut_lineage(correlation_matrix(to_rows(kept, file, "feature", "value", index=index, fill=None)[0]))
    results = []
    for imputer in imputers:
        for normalizer in normalizers:
            ready = cut_lineage(prepare(kept, imputer, normalizer, file))
            rows, _ = to_rows(ready, file, "feature", "value", index=index)
            vectors = cut_lineage(to_vectors(rows.join(samples, file)))
            points, _, _ = pca(vectors, 2, True, False, key=file, carry=(label,))
            resolution = average_resolution(points, label).first()[0]
            preservation = correlation_preservation(before, correlation_matrix(rows)).first()[0]
            both = kept.select("value", F.lit("measured").alias("_set")).unionAll(ready.select("value", F.lit("filled")))
            ks = ks_two_sample(both, "_set", [], "value", ["filled", "measured"]).first()
            mean, sd = rf_stability(vectors, label, settings, file, folds)
            train, test = split_samples(vectors, label, split, key=file)
            s = scores(fit(train, label, file, settings=settings, folds=folds), test)
            results.append(
                (imputer, normalizer, resolution, preservation, ks["p_value"], mean, sd, s["accuracy"], s["kappa"], s["auc"])
            )
    table = spark.createDataFrame(
        results,
        "imputation string, normalization string, resolution double, preservation double, ks_p double, "
        "cv_mean double, cv_sd double, test_accuracy double, test_kappa double, test_auc double",
    )
    return rank_methods(table)


def rank_methods(table: DataFrame) -> DataFrame:
    """Order of merit: accuracy over folds, its spread, class separation, correlations kept, distribution distance."""
    return rank_rows(table, [F.expr(o.split()[0]).desc() if o.endswith("DESC") else F.expr(o.split()[0]).asc() for o in RANK_ORDER]
                     + [F.asc("imputation"), F.asc("normalization")])


def run_classifier_study(
    cells: DataFrame, label: str, split: str = "store_to_field", fit: Callable[..., Fitted] = random_forest,
    imputer: str = "zero", normalizer: str = "none", do_pairwise: bool = False, top_sizes: Sequence[int] = (),
    rfe_sizes: Sequence[int] = (), folds: int | None = None, file: str = "file", peaks: DataFrame | None = None, **fit_args: object,
) -> dict[str, DataFrame]:
    """Fingerprint cells (file, feature, value, label, source) to metrics, predictions, confusion and refits."""
    cells = cut_lineage(cells)
    samples = cut_lineage(_samples(cells, label, ("source",), file))
    used = cells.join(samples.select(file), file, "left_semi")
    out: dict[str, DataFrame] = {}
    if do_pairwise:
        tests = pairwise_tests(used, label)
        out["tests"] = tests
        used = restrict_to(used, tests.filter("significant").select("feature").distinct())
    rows, index = prepare_rows(used, imputer, normalizer, file, peaks)
    vectors = cut_lineage(to_vectors(rows.join(samples, file)))
    train, test = split_samples(vectors, label, split, key=file)

    def refit(data: DataFrame, by: str) -> Fitted:
        return fit(data, by, file, folds=folds, **fit_args) if "folds" in inspect.signature(fit).parameters else fit(data, by, file, **fit_args)

    fitted = refit(train, label)
    s = scores(fitted, test)
    spark = cells.sparkSession
    predictions = fitted.predictions(test)
    out |= {
        "metrics": spark.createDataFrame(
            [("all", float(s["accuracy"]), s["kappa"], s["auc"])], "features string, accuracy double, kappa double, auc double"
        ),
        "predictions": predictions,
        "probabilities": fitted.probabilities(test),
        "confusion": confusion_table(predictions),
        "feature_index": index,
    }
    if top_sizes:
        out["top_n"] = refit_top(train, test, label, fitted, refit, top_sizes)
    if rfe_sizes:
        out["elimination"] = recursive_elimination(train, test, label, rfe_sizes, refit, folds=folds, key=file)
    return out


def run_all_designs(
    combos: DataFrame, label: str, splits: Sequence[str] = SPLITS, combo: str = "combo", **options: object
) -> DataFrame:
    """Metrics of every data combination under every design; combinations are named in a small list."""
    names = sorted(r[0] for r in combos.select(combo).distinct().collect())
    parts = None
    for name in names:
        for split in splits:
            got = run_classifier_study(combos.filter(F.col(combo) == name), label, split, **options)["metrics"]
            one = got.select(F.lit(name).alias("combo"), F.lit(split).alias("split"), "*")
            parts = one if parts is None else parts.unionByName(one)
    return parts
