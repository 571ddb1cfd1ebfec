"""Scores of classifiers from predictions (sample, actual, predicted) and probabilities (sample, actual, class, prob)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import attach_group_stats
from peakweave.operators.tests import pair_distribution
from peakweave.functions.names import strip_replicate_suffix


def confusion_counts(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    return pred.groupBy(actual, predicted).agg(F.count(F.lit(1)).alias("freq"))


def confusion_table(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Counts of every actual class against every predicted class, zeros included, with row totals and percent."""
    counts = confusion_counts(pred, actual, predicted)
    # one row holding the few predicted names
    names = F.broadcast(counts.agg(F.collect_set(predicted).alias("_names")))
    grid = counts.select(actual).distinct().join(names, F.lit(True)).select(actual, F.explode("_names").alias(predicted))
    full = grid.join(counts, [actual, predicted], "left").withColumn("freq", F.coalesce("freq", F.lit(0).cast("long")))
    totals = attach_group_stats(full, [actual], F.sum("freq").alias("total"))
    percent = F.round(F.col("freq") / F.col("total") * 100, 2)
    label = F.when(F.col(actual) == F.col(predicted), F.concat(F.round(percent, 1).cast("string"), F.lit("%"))).otherwise("")
    return totals.select(actual, predicted, "freq", "total", percent.alias("percent"), label.alias("label"))


def accuracy_kappa(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Accuracy and Cohen's kappa."""
    counts = confusion_counts(pred, actual, predicted)
    n = F.broadcast(counts.agg(F.sum("freq").alias("_n"), F.sum(F.when(F.col(actual) == F.col(predicted), F.col("freq")).otherwise(0)).alias("_ok")))
    sides = (
        counts.select(F.col(actual).alias("c"), F.col("freq").alias("_r"), F.lit(0).cast("long").alias("_p"))
        .unionAll(counts.select(F.col(predicted), F.lit(0).cast("long"), F.col("freq")))
        .groupBy("c")
        .agg(F.sum("_r").alias("_r"), F.sum("_p").alias("_p"))
        .agg(F.sum(F.col("_r").cast("double") * F.col("_p")).alias("_chance"))
    )
    acc = F.col("_ok") / F.col("_n")
    chance = F.col("_chance") / (F.col("_n").cast("double") * F.col("_n"))
    return sides.join(n, F.lit(True)).select(
        acc.alias("accuracy"), ((acc - chance) / F.nullif(1 - chance, F.lit(0.0))).alias("kappa")
    )


def balanced_accuracy(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Mean recall of the classes that occur; for two classes the mean of sensitivity and specificity."""
    hit = (F.col(actual) == F.col(predicted)).cast("int")
    recall = pred.filter(F.col(actual).isNotNull()).groupBy(actual).agg(F.avg(F.coalesce(hit, F.lit(0))).alias("_r"))
    return recall.agg(F.avg("_r").alias("balanced_accuracy"))


def pair_areas(probs: DataFrame, classes: Sequence | None = None, actual: str = "actual", cls: str = "class",
               prob: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, label_a, label_b, auc) of every two classes: the mean of the areas by the one's and by the other's probability."""
    named = probs.withColumn("_score_of", F.col(cls).cast("string"))
    pairs = pair_distribution(named, actual, classes, [*keys, "_score_of"], prob, own="_score_of")
    area = F.col("w") / (F.col("n_a") * F.col("n_b"))
    # w counts pairs won by the first class of the pair, scored by that class or by the other
    side = F.when(F.col("_score_of") == F.col("label_a").cast("string"), area).otherwise(1 - area)
    return pairs.groupBy(*keys, "label_a", "label_b").agg(F.avg(side).alias("auc"))


def multiclass_auc(probs: DataFrame, classes: Sequence | None = None, actual: str = "actual", cls: str = "class",
                   prob: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """Hand and Till's average over class pairs of the two areas under the curve, for each value of `keys`, all from one table."""
    return pair_areas(probs, classes, actual, cls, prob, keys).groupBy(*keys).agg(F.avg("auc").alias("auc"))


def class_auc(probs: DataFrame, actual: str = "actual", cls: str = "class", prob: str = "prob", keys: Sequence[str] = ()) -> DataFrame:
    """(keys, class, auc): each class against all others together, by its own probability."""
    own = F.col(cls).cast("string")
    sides = probs.withColumn("_score_of", own).withColumn("_own", F.when(F.col(actual).cast("string") == own, "1").otherwise("2"))
    pairs = pair_distribution(sides, "_own", None, [*keys, "_score_of"], prob)
    return pairs.select(*keys, F.col("_score_of").alias("class"), (F.col("w") / (F.col("n_a") * F.col("n_b"))).alias("auc"))


def brier(probs: DataFrame, sample: str = "sample", actual: str = "actual", cls: str = "class", prob: str = "prob") -> DataFrame:
    """Brier score averaged over samples and classes, and the same relative to equal guessing."""
    truth = (F.col(actual).cast("string") == F.col(cls).cast("string")).cast("double")
    base = probs.agg(
        F.avg((F.col(prob) - truth) * (F.col(prob) - truth)).alias("brier"), F.countDistinct(cls).alias("_k")
    )
    k = F.col("_k").cast("double")
    return base.select("brier", (F.col("brier") / F.nullif((k - 1) / (k * k), F.lit(0.0))).alias("normalised_brier"))


def class_errors(pred: DataFrame, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Share of wrong predictions per class."""
    wrong = (F.col(actual) != F.col(predicted)).cast("int")
    return pred.groupBy(actual).agg(F.avg(wrong).alias("error"), F.count(F.lit(1)).alias("n"))


def mean_probability(probs: DataFrame, name: str = "sample", cls: str = "class", prob: str = "prob") -> DataFrame:
    """Mean probability of each class per sample name without its replicate number."""
    return (
        probs.withColumn(name, strip_replicate_suffix(F.col(name)))
        .groupBy(name, cls)
        .agg(F.avg(prob).alias("mean_prob"))
    )
