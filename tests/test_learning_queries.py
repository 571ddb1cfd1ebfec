"""Learning queries do their whole job: all features, all repeats, searches to their end."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from peakweave.operators import discriminant, models, selection

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")


def test_shuffling_in_one_job_equals_one_by_one(spark):
    rows = spark.range(40).select(F.col("id").alias("file"), F.lit("a").alias("label"), array_to_vector(F.array(*[(F.col("id") * 10 + i).cast("double") for i in range(3)])).alias("features"))
    got = {(r.file._idx, r.file._repeat, r.file.key): r.features for r in selection.shuffle_features(rows, [0, 2], 2, 5).collect()}
    want = {(i, n, r.file): r.features for i in (0, 2) for n in range(2) for r in selection.shuffle_feature(rows, i, 5 + 31 * n + i).collect()}
    assert got == want and len(got) == 160


@needs_tables
def test_all_features_are_shuffled(spark):
    got = entry.queries()["permutation_importance"](spark, SF).collect()
    assert sorted(r.idx for r in got) == list(range(64)) and all(r.sd is not None for r in got)


@needs_tables
@pytest.mark.parametrize("name", ["forward_addition", "backward_elimination"])
def test_searches_run_to_their_end(spark, name):
    got = entry.queries()[name](spark, SF).first()
    assert got.converged and 1 <= len(got.features) <= 64 and 0.1 < got.accuracy <= 1


def rows_with_signal(spark, n=90, width=7, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, width))
    x[:, 2] += y
    x[:, 4] -= 0.7 * (y == 1)
    x[:, 6] = x[:, 2]  # a copy
    rows = [(i, "abc"[c], i % 4, x[i].tolist()) for i, c in enumerate(y)]
    df = spark.createDataFrame(rows, "file long, label string, fold int, x array<double>")
    return y, x, np.arange(n) % 4, df.withColumn("features", array_to_vector("x")).repartition(3)


def refitted(y, x, fold, subset, only=None):
    """Mean accuracy, kappa and Hand-Till area over folds of discriminants fitted from the rows themselves."""
    out = []
    for f in np.unique(fold) if only is None else [only]:
        t, h = fold != f, fold == f
        n = np.array([(y[t] == c).sum() for c in range(3)])
        means = np.array([x[t][y[t] == c].mean(axis=0) for c in range(3)])
        centred = x[t] - means[y[t]]
        within = centred.T @ centred / (t.sum() - 3)
        within += np.eye(x.shape[1]) * discriminant.RIDGE * np.trace(within) / x.shape[1]
        a = np.linalg.solve(within[np.ix_(subset, subset)], means[:, subset].T).T
        score = x[h][:, subset] @ a.T - (a * means[:, subset]).sum(axis=1) / 2 + np.log(n / n.sum())
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p = np.round(p / p.sum(axis=1, keepdims=True), 12)
        guess, truth = score.argmax(axis=1), y[h]
        hit = (guess == truth).mean()
        chance = sum((guess == c).mean() * (truth == c).mean() for c in range(3))
        area = lambda c, i, j: np.mean([(p[u, c] > p[v, c]) + (p[u, c] == p[v, c]) / 2 for u in np.flatnonzero(truth == i) for v in np.flatnonzero(truth == j)])
        out.append((hit, (hit - chance) / (1 - chance), np.mean([(area(i, i, j) + area(j, j, i)) / 2 for i in range(3) for j in range(i + 1, 3)])))
    return np.mean(out, axis=0)


def test_subset_scores_equal_refits(spark):
    y, x, fold, df = rows_with_signal(spark)
    scores = discriminant.SubsetScores(df, "label", 4)
    subsets = [[2], [0, 2], [2, 4, 6], [1, 3, 5], list(range(7))]
    got = [(*ak, u) for ak, u in zip(scores.accuracy_kappa(subsets), scores.areas(subsets), strict=True)]
    assert np.allclose(got, [refitted(y, x, fold, s) for s in subsets], atol=1e-9)


def test_searches_equal_a_literal_loop_of_refits(spark):
    y, x, fold, df = rows_with_signal(spark)
    scores = discriminant.SubsetScores(df, "label", 4)
    chosen, left = [0], [1, 2, 3, 4, 5, 6]
    best = refitted(y, x, fold, chosen)
    while True:
        step = next((c for c in left if (refitted(y, x, fold, [*chosen, c]) > best + 1e-12).all()), None)
        if step is None:
            break
        chosen.append(step)
        left.remove(step)
        best = refitted(y, x, fold, chosen)
    got = discriminant.add_features(scores, [0], range(1, 7))
    assert got["features"] == chosen and got["converged"] and np.allclose([got[m] for m in ("accuracy", "kappa", "auc")], best)
    chosen, order = list(range(7)), [3, 6, 0, 1, 5, 2, 4]
    best = refitted(y, x, fold, chosen)[0]
    for c in order:
        trial = [i for i in chosen if i != c]
        accuracy = refitted(y, x, fold, trial)[0]
        if accuracy >= best - 1e-12:
            chosen, best = trial, accuracy
    got = discriminant.drop_features(scores, range(7), order)
    assert got["features"] == chosen and got["converged"] and abs(got["accuracy"] - best) < 1e-9
    assert not discriminant.add_features(scores, [0], range(1, 7), most_rounds=1)["converged"]


def test_scores_on_test_rows_and_strengths(spark):
    y, x, fold, df = rows_with_signal(spark)
    train, test = df.filter("fold < 3").drop("fold"), df.filter("fold = 3").drop("fold")
    got = discriminant.subset_scores_of(train, test, "label", "test").of([2, 4])
    assert np.allclose([got[m] for m in ("accuracy", "kappa", "auc")], refitted(y, x, fold, [2, 4], only=3), atol=1e-9)
    plain = spark.createDataFrame([(c, i % 4, [float(i % 5), 9.0 * (c == "b") + i % 3, 1.0]) for i, c in enumerate("ab" * 30)], "label string, fold int, x array<double>")
    strength = discriminant.SubsetScores(plain.withColumn("features", array_to_vector("x")), "label", 4).sums.strengths()
    assert strength[1] > 5 * strength[0] and strength[2] == 0


@needs_tables
def test_all_sets_are_refitted(spark):
    assert [r.top_n for r in entry.queries()["refit_top"](spark, SF).collect()] == list(selection.TOP_SETS)


def test_margin_curves_equal_a_direct_fit(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 3, 400)
    raw = rng.normal(0, 1, (400, 3)) + 1.5 * (y[:, None] == np.arange(3))
    raw[:, 2] = np.where(y == 2, 5.0, -5.0)  # parted perfectly
    df = spark.createDataFrame([(float(c), m.tolist()) for c, m in zip(y, raw, strict=True)], "y double, raw array<double>")
    got = models.margin_curves(df, 3)
    for c in range(3):
        own, m = y == c, raw[:, c]
        t = np.where(own, (own.sum() + 1) / (own.sum() + 2), 1 / ((~own).sum() + 2))
        p = 1 / (1 + np.exp(-(got[c][0] * m + got[c][1])))
        assert abs(((p - t) * m).sum()) < 1e-5 and abs((p - t).sum()) < 1e-5  # the gradient is 0
    assert all(a > 0 for a, _ in got)


def test_machine_probabilities_add_up_and_follow_the_classes(spark):
    _, _, _, df = rows_with_signal(spark, 120)
    fitted = models.linear_svm_ovr(df.drop("fold"), "label", costs=[1.0], max_iter=20)
    rows = fitted.score(df).collect()
    assert all(abs(sum(r.probs) - 1) < 1e-9 and min(r.probs) >= 0 for r in rows)
    own = np.mean([r.probs["abc".index(r.actual)] for r in rows])
    assert own > 1 / 3 + 0.05 and {r.predicted for r in rows} <= set("abc")
