"""Classifiers on sample vectors: fitting with a small grid and cross-validation, probabilities, importances.

Input rows are (key, label text, features vector). Labels are indexed once so that every model and fold
knows the same classes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from itertools import product
from math import floor, log2, sqrt

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    NaiveBayes,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import StandardScaler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.distance import nearest_neighbours
from peakweave.operators.metrics import accuracy_kappa
from peakweave.operators.splits import DEFAULT_FOLDS, stratified_folds
from peakweave.session import cut_lineage


@dataclass
class Fitted:
    """A fitted classifier with its class names and the settings chosen."""

    model: object
    classes: list[str]
    settings: dict
    cv_accuracy: float | None
    score: Callable[[DataFrame], DataFrame] = field(repr=False)

    def probabilities(self, rows: DataFrame) -> DataFrame:
        """(sample, actual, class, prob) long."""
        return probabilities_to_long(self.score(rows), self.classes)

    def predictions(self, rows: DataFrame) -> DataFrame:
        """(sample, actual, predicted)."""
        return self.score(rows).select("sample", "actual", "predicted")


def probabilities_to_long(scored: DataFrame, classes: Sequence[str]) -> DataFrame:
    """One row per sample and class from an array of probabilities."""
    names = F.array(*[F.lit(c) for c in classes])
    return scored.select("sample", "actual", F.posexplode("probs").alias("_k", "prob")).select(
        "sample", "actual", F.element_at(names, F.col("_k") + 1).alias("class"), "prob"
    )


def label_names(df: DataFrame, label: str) -> list[str]:
    return sorted(r[0] for r in df.select(F.col(label).cast("string")).distinct().collect())


def _index(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Class number as Spark ML expects it."""
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string"))
    meta = {"ml_attr": {"name": "y", "type": "nominal", "vals": list(classes)}}
    return df.withColumn("y", (at - 1).cast("double").alias("y", metadata=meta))


def _to_one(scores):
    """Non-negative scores made to add up to one."""
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
    return F.transform(scores, lambda s: s / total)


def margin_curves(margins: DataFrame, classes: int, rounds: int = 50) -> list[tuple[float, float]]:
    """(slope, offset) for each class of the logistic curve from its margin to its probability, fitted to rows (y, raw) by Newton steps.

    Each step is one sum over the rows for all classes. As usual for such curves, a class with n members among m rows is fitted to (n + 1) / (n + 2)
    for members and 1 / (m - n + 2) for others, so that margins that part the rows perfectly give no infinite slope.
    """
    each = cut_lineage(margins.select("y", F.posexplode("raw").alias("c", "m")).select("c", "m", (F.col("y") == F.col("c")).alias("own")))
    found = {r["c"]: (r["n"], r["own"]) for r in each.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("int")).alias("own")).collect()}
    curves = {c: np.array([1.0, 0.0]) for c in found}
    high = {c: (own + 1) / (own + 2) for c, (_, own) in found.items()}
    low = {c: 1 / (n - own + 2) for c, (n, own) in found.items()}
    pick = lambda of: F.element_at(F.array(*(F.lit(float(of(c))) for c in range(classes))), F.col("c") + 1)
    at = lambda table, i=None: pick(lambda c: (table[c] if i is None else table[c][i]) if c in table else 0.0)
    losses: dict[int, float] = {}
    tried, step = dict(curves), {}
    for _ in range(rounds):
        z = at(tried, 0) * F.col("m") + at(tried, 1)
        t = F.when(F.col("own"), at(high)).otherwise(at(low))
        p = 1 / (1 + F.exp(-z))
        w = p * (1 - p)
        # log(1 + exp(z)) without overflow
        loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - t * z
        sums = each.groupBy("c").agg(F.sum(loss), F.sum((p - t) * F.col("m")), F.sum(p - t), F.sum(w * F.col("m") * F.col("m")), F.sum(w * F.col("m")), F.sum(w)).collect()
        moving = False
        for c, cost, ga, gb, haa, hab, hbb in sums:
            if c in losses and cost > losses[c] + 1e-12 * abs(losses[c]):  # too far: half the step
                step[c] = step[c] / 2
            else:
                curves[c], losses[c] = tried[c], cost
                step[c] = -np.linalg.solve(np.array([[haa + 1e-10, hab], [hab, hbb + 1e-10]]), [ga, gb])
            moving = moving or np.abs(step[c]).max() > 1e-8 * (1 + np.abs(curves[c]).max())
            tried[c] = curves[c] + step[c]
        if not moving:
            break
    return [tuple(map(float, curves.get(c, (1.0, 0.0)))) for c in range(classes)]


def _scorer(model, label: str, key: str, classes: Sequence[str], curves: Sequence[tuple[float, float]] | None = None):
    """Probabilities of the model, or with `curves` those of its margins."""
    names = F.array(*[F.lit(c) for c in classes])

    def score(rows: DataFrame) -> DataFrame:
        out = model.transform(rows)
        if curves is None:
            probs = vector_to_array("probability")
        else:
            slope, offset = (F.array(*(F.lit(float(c[i])) for c in curves)) for i in range(2))
            raw = vector_to_array("rawPrediction")
            probs = _to_one(F.transform(raw, lambda m, i: 1 / (1 + F.exp(-(F.get(slope, i) * m + F.get(offset, i))))))
        return out.select(
            F.col(key).alias("sample"),
            F.col(label).cast("string").alias("actual"),
            F.element_at(names, (F.col("prediction") + 1).cast("int")).alias("predicted"),
            probs.alias("probs"),
        )

    return score


def cv_accuracies(build, rows: DataFrame, label: str, key: str, classes: Sequence[str], k: int, fold: str = "fold") -> list[float]:
    """Accuracy of each fold for one setting; rows carry the fold column."""
    names, out = F.array(*[F.lit(c) for c in classes]), []
    for f in range(k):
        train, test = rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f)
        guess = F.element_at(names, (F.col("prediction") + 1).cast("int"))
        row = build().fit(train).transform(test).agg(F.avg((F.col(label).cast("string") == guess).cast("double"))).first()
        if row[0] is not None:
            out.append(float(row[0]))
    return out


def tune(
    builders: Sequence[tuple[dict, Callable[[], object]]], df: DataFrame, label: str, key: str = "file", raw: bool = False,
    folds: int | None = None, seed: int = 123,
) -> Fitted:
    """Fit the setting with the best cross-validated accuracy; a single setting is fitted straight away.

    Models that give margins only (`raw`) get probabilities from logistic curves, fitted to the margins of one fold by the model of the others.
    """
    classes = label_names(df, label)
    rows = _index(df.select(key, label, "features"), label, classes)
    k = folds or DEFAULT_FOLDS
    # solvers pass over the rows many times: they are written once, whatever led to them
    rows = cut_lineage(stratified_folds(rows, label, k, seed, (key,)) if raw or len(builders) > 1 else rows)
    best, settings, build = None, *builders[0]
    if len(builders) > 1:
        scored = [(float(np.mean(cv_accuracies(build, rows, label, key, classes, k) or [0.0])), settings, build) for settings, build in builders]
        best, settings, build = max(scored, key=lambda s: s[0])
    curves = None
    if raw:
        part = build().fit(rows.filter("fold != 0")).transform(rows.filter("fold = 0"))
        curves = margin_curves(part.select("y", vector_to_array("rawPrediction").alias("raw")), len(classes))
    model = build().fit(rows)
    return Fitted(model, classes, settings, best, _scorer(model, label, key, classes, curves))


def _width(df: DataFrame) -> int:
    return df.select("features").first()["features"].size


def forest_settings(width: int, trees: Sequence[int] = (100, 500, 1000, 2500)) -> list[dict]:
    """Numbers of trees against two numbers of candidate features per split."""
    tries = sorted({max(1, floor(sqrt(width))), max(1, floor(log2(width)))})
    return [{"numTrees": int(t), "featureSubsetStrategy": str(m)} for t, m in product(trees, tries)]


def random_forest(df: DataFrame, label: str, key: str = "file", settings: Sequence[dict] | None = None,
                  folds: int | None = None, seed: int = 123, max_depth: int = 8) -> Fitted:
    settings = forest_settings(_width(df)) if settings is None else settings

    def make(s: dict):
        return lambda: RandomForestClassifier(labelCol="y", featuresCol="features", seed=seed, maxDepth=max_depth, **s)

    return tune([(s, make(s)) for s in settings], df, label, key, False, folds, seed)


# one-against-rest models fitted at the same time
_PARALLEL = 4

# The grid searched for boosted trees.
BOOST_GRID = tuple(
    {"stepSize": step, "minInstancesPerNode": leaf, "maxDepth": depth}
    for step, leaf, depth in product((0.01, 0.1), (1, 2), (1, 2, 3))
)


def gbm_ovr(df: DataFrame, label: str, key: str = "file", settings: Sequence[dict] = BOOST_GRID, trees: int = 100,
            folds: int | None = None, seed: int = 123) -> Fitted:
    """Boosted trees, one class against the rest."""

    def make(s: dict):
        return lambda: OneVsRest(
            classifier=GBTClassifier(maxIter=s.get("maxIter", trees), seed=seed, featuresCol="features", labelCol="y",
                                     **{k: v for k, v in s.items() if k != "maxIter"}),
            labelCol="y", featuresCol="features", parallelism=_PARALLEL,
        )

    return tune([(s, make(s)) for s in settings], df, label, key, True, folds, seed)


# Costs tried for the linear support vector machine.
SVM_COSTS = (0.01, 0.1, 1.0, 10.0, 100.0)


def linear_svm_ovr(df: DataFrame, label: str, key: str = "file", costs: Sequence[float] = SVM_COSTS,
                   folds: int | None = None, seed: int = 123, max_iter: int = 100) -> Fitted:
    """Linear support vector machine, one class against the rest, on features standardised by the training rows."""
    n = df.count()

    def make(cost: float):
        return lambda: Pipeline(
            stages=[
                StandardScaler(inputCol="features", outputCol="_z", withMean=True, withStd=True),
                OneVsRest(
                    classifier=LinearSVC(regParam=1 / (cost * n), featuresCol="_z", labelCol="y", standardization=False, maxIter=max_iter),
                    labelCol="y", featuresCol="_z", parallelism=_PARALLEL,
                ),
            ]
        )

    return tune([({"cost": c}, make(c)) for c in costs], df, label, key, True, folds, seed)


def elastic_net_lambdas(count: int = 50) -> list[float]:
    return [float(10**e) for e in np.linspace(-4, 1, count)]


def elastic_net(df: DataFrame, label: str, key: str = "file", lambdas: Sequence[float] | None = None, alpha: float = 0.5,
                folds: int | None = None, seed: int = 123, max_iter: int = 100) -> Fitted:
    lambdas = elastic_net_lambdas() if lambdas is None else lambdas

    def make(lam: float):
        return lambda: LogisticRegression(
            family="multinomial", elasticNetParam=alpha, regParam=lam, labelCol="y", featuresCol="features", maxIter=max_iter
        )

    return tune([({"lambda": v}, make(v)) for v in lambdas], df, label, key, False, folds, seed)


def multinomial_logit(df: DataFrame, label: str, key: str = "file", max_iter: int = 100) -> Fitted:
    build = lambda: LogisticRegression(family="multinomial", labelCol="y", featuresCol="features", maxIter=max_iter)
    return tune([({}, build)], df, label, key)


def naive_bayes(df: DataFrame, label: str, key: str = "file", kind: str = "gaussian", smoothing: float = 0.0) -> Fitted:
    """Gaussian or multinomial (non-negative features only)."""
    build = lambda: NaiveBayes(modelType=kind, smoothing=smoothing, labelCol="y", featuresCol="features")
    return tune([({"kind": kind}, build)], df, label, key)


def knn_votes(test: DataFrame, train: DataFrame, label: str, k: int, key: str = "file", array: str = "x") -> DataFrame:
    """(sample, class, prob): share of the k nearest training rows of each class; classes without a vote are left out."""
    near = nearest_neighbours(test, train, k, key, array, carry=(label,))
    return near.groupBy(F.col(key).alias("sample"), F.col(label).alias("class")).agg(
        (F.count(F.lit(1)) / F.lit(float(k))).alias("prob")
    )


def knn_classify(test: DataFrame, train: DataFrame, label: str, k: int, key: str = "file", array: str = "x") -> DataFrame:
    """Majority class of the k nearest training rows; ties go to the first class in order."""
    votes = knn_votes(test, train, label, k, key, array)
    best = votes.groupBy("sample").agg(F.min_by("class", F.struct(-F.col("prob"), F.col("class"))).alias("predicted"), F.max("prob").alias("prob"))
    if label not in test.columns:
        return best
    truth = test.select(F.col(key).alias("sample"), F.col(label).alias("actual"))
    return best.join(truth, "sample").select("sample", "actual", "predicted", "prob")


def knn_choose_k(df: DataFrame, label: str, ks: Sequence[int] = tuple(range(1, 10)), folds: int = 5, key: str = "file",
                 array: str = "x", seed: int = 123) -> DataFrame:
    """Cross-validated accuracy for each k. Neighbours are searched once per fold, for the largest k."""
    rows = cut_lineage(stratified_folds(df.select(key, label, array), label, folds, seed, (key,)))
    most = max(ks)
    truth = rows.select(key, F.col(label).alias("_actual"))
    parts = None
    for f in range(folds):
        near = nearest_neighbours(rows.filter(F.col("fold") == f), rows.filter(F.col("fold") != f), most, key, array, carry=(label,))
        parts = near if parts is None else parts.unionByName(near)
    votes = (
        parts.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))
        .filter(F.col("rank") <= F.col("k"))
        .groupBy("k", key, label)
        .agg(F.count(F.lit(1)).alias("_v"))
        .groupBy("k", key)
        .agg(F.min_by(label, F.struct(-F.col("_v"), F.col(label))).alias("_predicted"))
    )
    return votes.join(truth, key).groupBy("k").agg(F.avg((F.col("_predicted") == F.col("_actual")).cast("double")).alias("accuracy"))


def fold_scores(df: DataFrame, label: str, settings: Sequence[dict], key: str = "file", folds: int | None = None, seed: int = 123,
                max_depth: int = 8) -> list[float]:
    """Fold accuracies of a forest over all settings, the raw material of its stability."""
    classes = label_names(df, label)
    k = folds or DEFAULT_FOLDS
    rows = cut_lineage(stratified_folds(_index(df.select(key, label, "features"), label, classes), label, k, seed, (key,)))
    out: list[float] = []
    for s in settings:
        build = lambda s=s: RandomForestClassifier(labelCol="y", featuresCol="features", seed=seed, maxDepth=max_depth, **s)
        out += cv_accuracies(build, rows, label, key, classes, k)
    return out


def rf_stability(df: DataFrame, label: str, settings: Sequence[dict] | None = None, key: str = "file",
                 folds: int | None = None, seed: int = 123) -> tuple[float, float]:
    """Mean and standard deviation of the fold accuracies over all settings."""
    settings = forest_settings(_width(df)) if settings is None else settings
    scores = fold_scores(df, label, settings, key, folds, seed)
    return float(np.mean(scores)), float(np.std(scores, ddof=1)) if len(scores) > 1 else float("nan")


def slice_features(df: DataFrame, indices: Sequence[int], features: str = "features") -> DataFrame:
    """Keep the listed vector positions."""
    cut = VectorSlicer(inputCol=features, outputCol="_cut", indices=[int(i) for i in indices])
    return cut.transform(df).drop(features).withColumnRenamed("_cut", features)


def importances(fitted: Fitted) -> list[tuple[int, float]]:
    """(feature index, importance) of a forest, a boosted model or a linear model."""
    model = fitted.model
    if hasattr(model, "stages"):
        model = model.stages[-1]
    if hasattr(model, "featureImportances"):
        values = model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        values = np.abs(model.coefficientMatrix.toArray()).sum(0)
    elif hasattr(model, "models"):
        each = [
            m.featureImportances.toArray() if hasattr(m, "featureImportances") else np.abs(m.coefficients.toArray())
            for m in model.models
        ]
        values = np.mean(each, axis=0)
    else:
        raise ValueError("the model has no importances")
    return [(i, float(v)) for i, v in enumerate(values)]


def scaled_importances(fitted: Fitted, above: float = 50.0) -> list[tuple[int, float]]:
    """Importances scaled to 0..100, those above a limit."""
    values = importances(fitted)
    low, high = min(v for _, v in values), max(v for _, v in values)
    width = (high - low) or 1.0
    return [(i, 100 * (v - low) / width) for i, v in values if 100 * (v - low) / width > above]


def importance_table(fitted: Fitted, df: DataFrame) -> DataFrame:
    ranked = sorted(importances(fitted), key=lambda t: (-t[1], t[0]))
    rows = [(i, v, r + 1) for r, (i, v) in enumerate(ranked)]
    return df.sparkSession.createDataFrame(rows, "idx int, importance double, rank int")


def scores(fitted: Fitted, test: DataFrame) -> dict[str, float | None]:
    """Accuracy, kappa and multi-class area under the curve on test rows."""
    from peakweave.operators.metrics import multiclass_auc

    scored = cut_lineage(fitted.score(test))
    row = accuracy_kappa(scored).first()
    auc = multiclass_auc(probabilities_to_long(scored, fitted.classes)).first()["auc"]
    return {"accuracy": row["accuracy"], "kappa": row["kappa"], "auc": auc}


CLASSIFIERS: dict[str, Callable[..., Fitted]] = {
    "random_forest": random_forest,
    "gbm": gbm_ovr,
    "linear_svm": linear_svm_ovr,
    "elastic_net": elastic_net,
    "multinomial_logit": multinomial_logit,
    "naive_bayes": naive_bayes,
}

