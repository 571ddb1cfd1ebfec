"""Choosing features around a classifier: rankings, shuffling, partial dependence, adding and removing.

Model fits are Spark jobs; the loops here only decide which fit comes next. By default a subset is
scored on held-out training folds; `score_on='test'` scores it on the test rows instead.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.discriminant import add_features, drop_features, subset_scores_of
from peakweave.operators.metrics import class_auc, multiclass_auc
from peakweave.operators.models import Fitted, importances, probabilities_to_long, scores, slice_features
from peakweave.operators.ordering import hash_bucket, row_positions, seeded_positions
from peakweave.operators.splits import DEFAULT_FOLDS, stratified_folds
from peakweave.session import cut_lineage

Fit = Callable[[DataFrame, str], Fitted]
TOP_SETS = (100, 50, 25, 10)


def ranked_features(fitted: Fitted) -> list[int]:
    return [i for i, _ in sorted(importances(fitted), key=lambda t: (-t[1], t[0]))]


def refit_top(train: DataFrame, test: DataFrame, label: str, fitted: Fitted, fit: Fit, sizes: Sequence[int] = TOP_SETS) -> DataFrame:
    """Refit on the most important features; a set larger than the number available uses all of them."""
    order = ranked_features(fitted)
    rows = []
    for n in sizes:
        chosen = order[: min(n, len(order))]
        model = fit(slice_features(train, chosen), label)
        s = scores(model, slice_features(test, chosen))
        rows.append((n, len(chosen), s["accuracy"], s["kappa"], s["auc"]))
    return train.sparkSession.createDataFrame(rows, "top_n int, n_features int, accuracy double, kappa double, auc double")


def shuffle_feature(rows: DataFrame, idx: int, seed: int, key: str = "file", features: str = "features") -> DataFrame:
    """Give every row the value of another row for one feature: two seeded orders of the rows are matched."""
    target = seeded_positions(rows, [], [key], seed, "_to")
    donors = seeded_positions(
        rows.select(key, vector_to_array(features)[idx].alias("_value")), [], [key], seed + 7919, "_from"
    ).select("_from", "_value")
    array = vector_to_array(features)
    swapped = F.transform(array, lambda v, i: F.when(i == idx, F.col("_value")).otherwise(v))
    return target.join(donors, F.col("_to") == F.col("_from")).withColumn(features, array_to_vector(swapped)).drop(
        "_to", "_from", "_value"
    )


def shuffle_features(rows: DataFrame, candidates: Sequence[int], repeats: int, seed: int, key: str = "file", features: str = "features") -> DataFrame:
    """`shuffle_feature` for every candidate and repeat in one job: the key becomes a struct of (_idx, _repeat, key)."""
    plan = F.explode(F.array(*[F.struct(F.lit(int(i)).alias("_idx"), F.lit(r).alias("_repeat"), F.lit(int(seed + 31 * r + i)).alias("_seed")) for i in candidates for r in range(repeats)]))
    each = rows.select(key, plan.alias("_p")).select(key, "_p.*")
    group = ["_idx", "_repeat"]

    def placed(df: DataFrame, seeded, out: str) -> DataFrame:
        hashed = df.withColumn("_hash", F.xxhash64(F.col(key), seeded))
        return row_positions(hashed, group, ["_hash", key], hash_bucket(F.col("_hash")), out).drop("_hash", "_seed")

    values = rows.select(key, vector_to_array(features).alias("_values"))
    donors = placed(each, F.col("_seed") + 7919, "_at").join(values, key).select(*group, "_at", F.get("_values", F.col("_idx")).alias("_value"))
    target = placed(each, F.col("_seed"), "_at").join(donors, [*group, "_at"]).join(rows, key)
    swapped = F.transform(vector_to_array(features), lambda v, i: F.when(i == F.col("_idx"), F.col("_value")).otherwise(v))
    named = F.struct("_idx", "_repeat", F.col(key).alias("key"))
    return target.withColumn(features, array_to_vector(swapped)).withColumn(key, named).select(*rows.columns)


def permutation_importance(fitted: Fitted, rows: DataFrame, candidates: Sequence[int], repeats: int = 10, seed: int = 282,
                           key: str = "file", per_class: bool = False, metric: str = "accuracy") -> DataFrame:
    """Drop in accuracy, or with metric="auc" in area under the curve, when a feature is shuffled, over all rows or for each class.

    All features and repeats are scored in one job. Areas (Hand and Till's mean, or each class against the others) of all of them come
    from one table of probabilities, keyed by (feature, repeat).
    """
    cached = cut_lineage(rows)
    scored = fitted.score(shuffle_features(cached, candidates, repeats, seed, key))
    group = ["idx", "repeat"]
    if metric == "accuracy":
        hit = F.avg((F.col("actual") == F.col("predicted")).cast("double"))
        classed = (F.col("actual") if per_class else F.lit("all")).alias("class")
        base = fitted.score(cached).groupBy(classed).agg(hit.alias("_base"))
        parts = scored.groupBy(classed, F.col("sample._idx").alias("idx"), F.col("sample._repeat").alias("repeat")).agg(hit.alias("_now"))
    elif metric == "auc":
        area = (lambda d, keys=(): class_auc(d, keys=keys)) if per_class else (lambda d, keys=(): multiclass_auc(d, keys=keys).withColumn("class", F.lit("all")))
        base = area(fitted.probabilities(cached)).select("class", F.col("auc").alias("_base"))
        told = probabilities_to_long(scored, fitted.classes).withColumns({"idx": F.col("sample._idx"), "repeat": F.col("sample._repeat")})
        parts = area(told, group).select("class", *group, F.col("auc").alias("_now"))
    else:
        raise ValueError("metric must be accuracy or auc")
    lost = F.col("_base") - F.col("_now")
    return parts.join(base, "class").groupBy("class", "idx").agg(F.avg(lost).alias("importance"), F.stddev_samp(lost).alias("sd"))


def partial_dependence(fitted: Fitted, rows: DataFrame, idx: int, grid: Sequence[float], key: str = "file",
                       features: str = "features") -> DataFrame:
    """Mean class probabilities when one feature is set to each grid value."""
    array = vector_to_array(features)
    spread = rows.withColumn("_grid", F.explode(F.array(*[F.lit(float(g)) for g in grid])))
    set_to = spread.withColumn(
        features, array_to_vector(F.transform(array, lambda v, i: F.when(i == idx, F.col("_grid")).otherwise(v)))
    )
    # the grid value rides along as the sample name
    probs = fitted.probabilities(set_to.withColumn(key, F.col("_grid")))
    return probs.groupBy(F.col("sample").alias("grid"), "class").agg(F.avg("prob").alias("mean_prob"))


def feature_grid(rows: DataFrame, idx: int, points: int = 10, features: str = "features") -> list[float]:
    """Evenly spaced values between a feature's extremes."""
    lo, hi = rows.select(vector_to_array(features)[idx].alias("v")).agg(F.min("v"), F.max("v")).first()
    return [float(v) for v in np.linspace(lo, hi, points)]


def subset_scores(train: DataFrame, test: DataFrame | None, label: str, chosen: Sequence[int], fit: Fit,
                  score_on: str = "folds", folds: int | None = None, seed: int = 123, key: str = "file") -> dict[str, float]:
    """Mean accuracy, kappa and area under the curve of a feature subset."""
    if score_on == "test":
        return _clean(scores(fit(slice_features(train, chosen), label), slice_features(test, chosen)))
    k = folds or DEFAULT_FOLDS
    rows = cut_lineage(stratified_folds(slice_features(train, chosen), label, k, seed, (key,)))
    each = [
        _clean(scores(fit(rows.filter(F.col("fold") != f).drop("fold"), label), rows.filter(F.col("fold") == f)))
        for f in range(k)
    ]
    return {m: float(np.mean([e[m] for e in each])) for m in ("accuracy", "kappa", "auc")}


def _clean(s: dict[str, float | None]) -> dict[str, float]:
    return {m: 0.0 if v is None else float(v) for m, v in s.items()}


def forward_addition(
    train: DataFrame, test: DataFrame | None, label: str, base: Sequence[int], candidates: Sequence[int], fit: Fit | None = None,
    score_on: str = "folds", max_rounds: int | None = None, folds: int | None = None, key: str = "file",
) -> dict:
    """Add the first feature that improves accuracy, kappa and area together; stop when a whole pass adds none.

    `max_rounds` ends it earlier; `converged` tells whether a whole pass added none. Subsets are scored by linear discriminants, all
    of a pass in one job (`discriminant`); with `fit` every subset is fitted anew on every fold.
    """
    if fit is None:
        return add_features(subset_scores_of(train, test, label, score_on, folds, key=key), base, candidates, max_rounds)
    chosen, remaining = list(base), [c for c in candidates if c not in base]
    best = subset_scores(train, test, label, chosen, fit, score_on, folds, key=key)
    converged = False
    for _ in range(len(remaining) + 1 if max_rounds is None else max_rounds):
        added = None
        for c in remaining:
            s = subset_scores(train, test, label, [*chosen, c], fit, score_on, folds, key=key)
            if all(s[m] > best[m] for m in best):
                added, best = c, s
                break
        if added is None:
            converged = True
            break
        chosen.append(added)
        remaining.remove(added)
    return {"features": chosen, "converged": converged, **best}


def recursive_elimination(
    train: DataFrame, test: DataFrame | None, label: str, sizes: Sequence[int], fit: Fit, score_on: str = "folds",
    folds: int | None = None, key: str = "file",
) -> DataFrame:
    """Cut the feature list to each size in turn, weakest first, and score every size."""
    chosen = list(range(train.select("features").first()["features"].size))
    rows = []
    for size in sorted(set(sizes), reverse=True):
        if size < len(chosen):
            ranked = ranked_features(fit(slice_features(train, chosen), label))
            chosen = [chosen[i] for i in sorted(ranked[:size])]
        s = subset_scores(train, test, label, chosen, fit, score_on, folds, key=key)
        rows.append((len(chosen), s["accuracy"], s["kappa"], s["auc"], chosen))
    return train.sparkSession.createDataFrame(
        rows, "n_features int, accuracy double, kappa double, auc double, features array<int>"
    )


def backward_elimination(
    train: DataFrame, test: DataFrame | None, label: str, start: Sequence[int], fit: Fit | None = None, score_on: str = "folds",
    max_removals: int | None = None, folds: int | None = None, key: str = "file",
) -> dict:
    """Drop features one by one, weakest first, as long as accuracy does not fall below the baseline.

    `max_removals` ends it earlier; `converged` tells whether every feature was tried. Subsets are scored by linear discriminants, all
    of a pass in one job (`discriminant`); with `fit` every subset is fitted anew on every fold, and its importances rank the features.
    """
    if fit is None:
        return drop_features(subset_scores_of(train, test, label, score_on, folds, key=key), start, None, max_removals)
    chosen = list(start)
    ranked = ranked_features(fit(slice_features(train, chosen), label))
    weakest_first = [chosen[i] for i in reversed(ranked)]
    best = subset_scores(train, test, label, chosen, fit, score_on, folds, key=key)
    removed, converged = 0, True
    for c in weakest_first:
        if len(chosen) == 1 or removed == max_removals:
            converged = len(chosen) == 1
            break
        trial = [x for x in chosen if x != c]
        s = subset_scores(train, test, label, trial, fit, score_on, folds, key=key)
        if s["accuracy"] >= best["accuracy"]:
            chosen, best, removed = trial, s, removed + 1
    return {"features": chosen, "converged": converged, **best}
