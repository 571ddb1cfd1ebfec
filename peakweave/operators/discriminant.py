"""Linear discriminants of feature subsets from sums written once: the cheap fits that a feature search needs by the thousand.

One pass over the rows gives, for each fold, the sums of every class and the products of every two features. The discriminant of any subset, fitted on
all folds but one, is then a linear solve on a part of those tables. The subsets of a search's step are scored together: one pass over the
rows, keyed by (subset, fold), gives confusion counts, and another, only for subsets that are better by those, the areas under curves.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.metrics import multiclass_auc
from peakweave.operators.splits import DEFAULT_FOLDS, stratified_folds
from peakweave.session import cut_lineage

#: Numbers in the coefficients that go to the tasks of one scoring pass.
COEFFICIENTS = 8 << 20
#: Share of the mean variance added to every variance, so that equal or constant features can be solved for.
RIDGE = 1e-6
NEVER = -1e30


@dataclass
class FoldSums:
    """Counts (fold, class), sums (fold, class, feature) and products (fold, feature, feature) of features less `shift`."""

    classes: list[str]
    shift: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def fitted(self, subsets: Sequence[Sequence[int]], trained_on: Sequence[int]) -> np.ndarray:
        """(subset, class, feature + 1): coefficients, the constant last, of the discriminants fitted on some folds. Features outside of a subset have 0."""
        on = list(trained_on)
        n, width = self.counts[on].sum(axis=0), len(self.shift)
        means = self.sums[on].sum(axis=0) / np.maximum(n, 1)[:, None]
        within = self.products[on].sum(axis=0) - (means.T * n) @ means
        within = within / max(n.sum() - (n > 0).sum(), 1)
        within += np.eye(width) * (RIDGE * max(float(np.trace(within)) / max(width, 1), 1e-12))
        prior = np.where(n > 0, np.log(np.maximum(n, 1) / max(n.sum(), 1)), NEVER)
        out = np.zeros((len(subsets), len(n), width + 1))
        for k, subset in enumerate(subsets):
            at = np.array(sorted(subset), np.int64)
            a = np.linalg.solve(within[np.ix_(at, at)], means[:, at].T).T if len(at) else np.zeros((len(n), 0))
            out[k][:, at] = a
            out[k][:, -1] = prior - (a * means[:, at]).sum(axis=1) / 2 - a @ self.shift[at]
        return out

    def strengths(self) -> np.ndarray:
        """Importance of each feature in the discriminant of all: its coefficients, times its deviation within classes, summed up."""
        every = range(len(self.counts))
        a = self.fitted([range(len(self.shift))], every)[0][:, :-1]
        n = self.counts.sum(axis=0)
        means = self.sums.sum(axis=0) / np.maximum(n, 1)[:, None]
        spread = np.sqrt(np.maximum(np.diag(self.products.sum(axis=0)) - (means**2 * n[:, None]).sum(axis=0), 0) / max(n.sum(), 1))
        return np.abs(a - a.mean(axis=0)).sum(axis=0) * spread


def _coded(rows: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label).cast("string")) - 1
    return rows.select(code.cast("int").alias("y"), F.col("fold").cast("int").alias("fold"), vector_to_array("features").alias("x"))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    y, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("y", "fold"))
    return y, fold, batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def fold_sums(rows: DataFrame, label: str, folds: int, classes: Sequence[str], most_features: int = 4000) -> FoldSums:
    """Sums of rows (label, fold, features). Products of every two features come to the driver once per fold, so `most_features` bounds them."""
    shift = np.zeros(0) if rows.isEmpty() else rows.agg(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray()
    width, k = len(shift), len(classes)
    if width > most_features:
        raise ValueError(f"more than {most_features} features: rank them first, or search with a classifier's own fits")

    def add(batches):
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            y, fold, x = _matrix(batch)
            x = x - shift
            for f in np.unique(fold):
                here, part = sums.setdefault(int(f), (np.zeros((k, width + 1)), np.zeros((width, width))))
                own = fold == f
                np.add.at(here, y[own], np.concatenate([np.ones((own.sum(), 1)), x[own]], 1))
                part += x[own].T @ x[own]
        for f, (here, part) in sums.items():
            lines = [(f, 0, c, here[c].tolist()) for c in range(k)] + [(f, 1, i, part[i].tolist()) for i in range(width)]
            columns = list(zip(*lines, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[i], pa.int32()) for i in range(3)] + [pa.array(columns[3], pa.list_(pa.float64()))], ["fold", "what", "i", "x"])

    parts = _coded(rows, label, classes).mapInArrow(add, "fold int, what int, i int, x array<double>")
    total = parts.groupBy("fold", "what", "i").agg(Summarizer.sum(array_to_vector("x")).alias("x"))
    out = FoldSums(list(classes), shift, np.zeros((folds, k)), np.zeros((folds, k, width)), np.zeros((folds, width, width)))
    for f, what, i, x in total.toLocalIterator():
        x = x.toArray()
        if what:
            out.products[f, i] = x
        else:
            out.counts[f, i], out.sums[f, i] = x[0], x[1:]
    return out


class SubsetScores:
    """Scores of feature subsets on held-out folds: each fold by the discriminant of the others."""

    def __init__(self, rows: DataFrame, label: str, folds: int, scored: Sequence[int] | None = None, classes: Sequence[str] | None = None):
        if classes is None:
            classes = sorted(r[0] for r in rows.select(F.col(label).cast("string")).distinct().collect())
        self.label, self.scored = label, list(range(folds)) if scored is None else list(scored)
        self.rows = rows
        self.sums = fold_sums(rows, label, folds, classes)

    def _weights(self, subsets: Sequence[Sequence[int]]) -> dict[int, np.ndarray]:
        every = range(len(self.sums.counts))
        return {f: self.sums.fitted(subsets, [g for g in every if g != f and (g not in self.scored or len(self.scored) > 1)]) for f in self.scored}

    def _chunks(self, subsets: Sequence[Sequence[int]]):
        size = len(self.scored) * len(self.sums.classes) * (len(self.sums.shift) + 1)
        step = max(1, COEFFICIENTS // max(1, size))
        for at in range(0, len(subsets), step):
            yield at, subsets[at : at + step]

    def accuracy_kappa(self, subsets: Sequence[Sequence[int]]) -> list[tuple[float, float]]:
        """Mean accuracy and kappa over folds of every subset, from confusion counts."""
        out = []
        for _, some in self._chunks(subsets):
            weights, k = self._weights(some), len(self.sums.classes)

            def count(batches, weights=weights, k=k):
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    y, fold, x = _matrix(batch)
                    for f, w in weights.items():
                        own = fold == f
                        if own.any():
                            guess = np.einsum("np,scp->nsc", x[own], w[:, :, :-1], optimize=True) + w[:, :, -1]
                            guess = guess.argmax(axis=2)
                            cell = (np.arange(guess.shape[1]) * k + y[own][:, None]) * k + guess
                            code, n = np.unique(cell, return_counts=True)
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), f), pa.int32()), pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["fold", "cell", "n"])

            found = _coded(self.rows, self.label, self.sums.classes).mapInArrow(count, "fold int, cell long, n long")
            table = {f: np.zeros(len(some) * k * k) for f in self.scored}
            for f, cell, n in found.groupBy("fold", "cell").agg(F.sum("n")).toLocalIterator():
                table[f][cell] = n
            each = np.stack([t.reshape(len(some), k, k) for t in table.values()], 1)
            n = np.maximum(each.sum(axis=(2, 3)), 1)
            hit = np.trace(each, axis1=2, axis2=3) / n
            chance = (each.sum(axis=3) * each.sum(axis=2)).sum(axis=2) / n**2
            kappa = np.divide(hit - chance, 1 - chance, out=np.zeros_like(hit), where=chance < 1)
            out += list(zip(hit.mean(axis=1).tolist(), kappa.mean(axis=1).tolist(), strict=True))
        return out

    def areas(self, subsets: Sequence[Sequence[int]]) -> list[float]:
        """Mean multi-class area under the curve over folds of every subset, all from one table of probabilities."""
        out = [0.0] * len(subsets)
        names = self.sums.classes
        for at, some in self._chunks(subsets):
            weights, k = self._weights(some), len(names)

            def tell(batches, weights=weights, k=k):
                for batch in batches:
                    if not batch.num_rows:
                        continue
                    y, fold, x = _matrix(batch)
                    for f, w in weights.items():
                        own = fold == f
                        if own.any():
                            score = np.einsum("np,scp->nsc", x[own], w[:, :, :-1], optimize=True) + w[:, :, -1]
                            score = np.exp(score - score.max(axis=2, keepdims=True))
                            prob = np.round(score / score.sum(axis=2, keepdims=True), 12)
                            n, s, _ = prob.shape
                            columns = [np.full(prob.size, f), np.tile(np.repeat(np.arange(s), k), n), np.repeat(y[own], s * k), np.tile(np.arange(k), n * s)]
                            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in columns), pa.array(prob.ravel())], ["fold", "subset", "actual", "class", "prob"])

            told = _coded(self.rows, self.label, names).mapInArrow(tell, "fold int, subset int, actual int, class int, prob double")
            found = multiclass_auc(told, list(range(k)), keys=["subset", "fold"]).groupBy("subset").agg(F.sum(F.coalesce("auc", F.lit(0.0))).alias("auc"))
            for r in found.toLocalIterator():
                out[at + r["subset"]] = r["auc"] / len(self.scored)
        return out

    def of(self, subset: Sequence[int]) -> dict[str, float]:
        (accuracy, kappa), auc = self.accuracy_kappa([subset])[0], self.areas([subset])[0]
        return {"accuracy": accuracy, "kappa": kappa, "auc": auc}


def subset_scores_of(train: DataFrame, test: DataFrame | None, label: str, score_on: str = "folds", folds: int | None = None, seed: int = 123, key: str = "file") -> SubsetScores:
    """Scores on training folds, or with `score_on='test'` of fits on all training rows on the test rows."""
    if score_on == "test":
        both = train.select(label, "features", F.lit(0).alias("fold")).unionByName(test.select(label, "features", F.lit(1).alias("fold")))
        return SubsetScores(cut_lineage(both), label, 2, [1])
    k = folds or DEFAULT_FOLDS
    return SubsetScores(cut_lineage(stratified_folds(train.select(key, label, "features"), label, k, seed, (key,))), label, k)


def add_features(scores: SubsetScores, base: Sequence[int], candidates: Sequence[int], most_rounds: int | None = None) -> dict:
    """From `base`, add the first candidate that betters accuracy, kappa and area together; stop when none of all does.

    A round scores all candidates left in one pass; areas are asked only of those better by accuracy and kappa.
    """
    chosen, left = list(base), [c for c in candidates if c not in set(base)]
    best, rounds, converged = scores.of(chosen), 0, not left
    while left and rounds != most_rounds:
        rounds += 1
        trials = [[*chosen, c] for c in left]
        better = [(i, a, k) for i, (a, k) in enumerate(scores.accuracy_kappa(trials)) if a > best["accuracy"] and k > best["kappa"]]
        step, asked = None, 0
        while step is None and asked < len(better):  # the first ones most likely do: more are asked for only if they don't
            some = better[asked : asked + max(2, 3 * asked)]
            areas = scores.areas([trials[i] for i, _, _ in some])
            step = next(((i, a, k, u) for (i, a, k), u in zip(some, areas, strict=True) if u > best["auc"]), None)
            asked += len(some)
        if step is None:
            converged = True
            break
        i, *found = step
        best = dict(zip(("accuracy", "kappa", "auc"), found, strict=True))
        chosen.append(left.pop(i))
        converged = not left
    return {"features": chosen, "converged": converged, "rounds": rounds, **best}


def drop_features(scores: SubsetScores, start: Sequence[int], order: Sequence[int] | None = None, most_removals: int | None = None) -> dict:
    """Try to drop the features one after another, weakest first (or in `order`); one goes if accuracy without it is no lower.

    Until one goes, all trials start from the same features, so each pass scores all that are left to try and takes the first that may go.
    """
    chosen = list(start)
    if order is None:
        strength = scores.sums.strengths()
        order = sorted(chosen, key=lambda i: (strength[i], -i))
    left, best, removed, passes = list(order), scores.of(chosen), 0, 0
    while left and len(chosen) > 1 and removed != most_removals:
        passes += 1
        trials = [[x for x in chosen if x != c] for c in left]
        found = scores.accuracy_kappa(trials)
        step = next((i for i, (accuracy, _) in enumerate(found) if accuracy >= best["accuracy"]), None)
        if step is None:
            left = []
            break
        chosen, best = trials[step], {"accuracy": found[step][0], "kappa": found[step][1]}
        left, removed = left[step + 1 :], removed + 1
    if "auc" not in best:
        best["auc"] = scores.areas([chosen])[0]
    return {"features": chosen, "converged": not left or len(chosen) == 1, "passes": passes, **best}
