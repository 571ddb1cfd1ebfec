"""Text quality by a linear-chain conditional random field over lines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import field, run_sums, text_slices, texts_of
from peakweave.llm.shingles import mixed

#: Of each line itself; each also stands in the features of the lines before and after it.
OWN = 14
FEATURES = 1 + 3 * OWN
GOOD = 1

_BYTE_HASH = mixed(np.arange(1, 257, dtype=np.uint64))
_KIND = np.zeros((256, 6))
for _i, _set in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), b".,;:'\"-()", b"!?")):
    _KIND[list(_set), _i] = 1


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length, lines): the features and the length of every line, and the number of lines per text.

    Shares of kinds of characters, the length of words, and how often words repeat, of the line and of both neighbours;
    an empty text has one empty line.
    """
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 0x0A)
    begins = np.concatenate(([0], ends[:-1] + 1))
    length = ends - begins
    lines = np.array([t.count(b"\n") + 1 for t in texts], np.int64)
    size = np.maximum(length, 1)

    def per_line(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
        return sums[ends] - sums[begins]

    kinds = [per_line(_KIND[:, i].astype(bool)[data]) for i in range(6)]
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    start, stop = edge[0::2], edge[1::2]
    line_of = np.searchsorted(ends, start)
    words = np.bincount(line_of, minlength=len(ends))
    some = np.maximum(words, 1)
    step = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[data])))
    bag = step[stop] - step[start]  # words of the same letters count as the same
    same_line = np.zeros(len(start), bool)
    same_line[1:] = line_of[1:] == line_of[:-1]
    again = np.zeros(len(start), bool)
    again[1:] = same_line[1:] & (bag[1:] == bag[:-1])
    tail = data[np.maximum(stop - 1, 0)] if len(stop) else np.zeros(0, np.uint8)
    letters = _KIND[:, [0, 1, 2, 3, 4]].any(axis=1)
    odd_tail = np.bincount(line_of, weights=~letters[tail], minlength=len(ends))
    lone = np.bincount(line_of, weights=(stop - start) <= 1, minlength=len(ends))
    repeats = np.bincount(line_of, weights=again, minlength=len(ends))
    letter = kinds[0] + kinds[1] + kinds[3]
    other = size - letter - kinds[2] - kinds[4] - kinds[5] - per_line(space)
    own = np.stack(
        [
            kinds[0] / size, kinds[1] / size, kinds[2] / size, kinds[3] / size, kinds[4] / size, kinds[5] / size, np.clip(other, 0, None) / size,
            np.minimum(kinds[1] / np.maximum(letter, 1), 1), repeats / some, odd_tail / some, lone / some,
            np.minimum(np.bincount(line_of, weights=stop - start, minlength=len(ends)) / some / 10, 3), np.log1p(words) / 5, (length == 0) * 1.0,
        ],
        axis=1,
    )
    first = np.zeros(len(ends), bool)
    first[np.cumsum(lines) - lines] = True
    before = np.vstack((np.zeros((1, OWN)), own[:-1])) * ~first[:, None]
    last = np.zeros(len(ends), bool)
    last[np.cumsum(lines) - 1] = True
    after = np.vstack((own[1:], np.zeros((1, OWN)))) * ~last[:, None]
    return np.hstack((np.ones((len(ends), 1)), own, before, after)), length, lines


def marginals(scores: np.ndarray, change: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many texts at once: P(good) per line, P(state, next state) per line but each last, log Z per text.

    scores has the two states' scores of every line, one text after another; change the score of each change of state.
    """
    begin = np.cumsum(lines) - lines
    order = np.argsort(-lines, kind="stable")
    steps = int(lines.max()) if len(lines) else 0
    active = np.searchsorted(-lines[order], -np.arange(1, steps + 1), side="right")  # texts that have a line t
    emit = np.exp(scores - scores.max(axis=1, keepdims=True))
    shift = scores.max(axis=1)
    move = np.exp(change)
    ahead, scale = np.empty_like(emit), np.empty(len(emit))
    for t in range(steps):
        at = begin[order[: active[t]]] + t
        x = emit[at] if t == 0 else (ahead[at - 1] @ move) * emit[at]
        scale[at] = x.sum(axis=1)
        ahead[at] = x / scale[at, None]
    behind = np.ones_like(emit)
    pair = np.zeros((len(emit), 2, 2))
    for t in range(steps - 2, -1, -1):
        at = begin[order[: active[t + 1]]] + t
        rest = emit[at + 1] * behind[at + 1] / scale[at + 1, None]
        behind[at] = rest @ move.T
        pair[at] = ahead[at][:, :, None] * move[None] * rest[:, None, :]
    both = ahead * behind
    both /= both.sum(axis=1, keepdims=True)
    return both[:, GOOD], pair, run_sums(np.log(scale) + shift, lines)


class LineField:
    """Weights of the field, and of the logistic curve from a text's mean marginal to its score."""

    def __init__(self, weights: np.ndarray, change: np.ndarray, curve: tuple[float, float]):
        self.weights, self.change, self.curve = weights, change, curve

    def line_scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 2))
        out[:, GOOD] = features @ self.weights
        return out

    def document_means(self, features: np.ndarray, length: np.ndarray, lines: np.ndarray) -> np.ndarray:
        """Marginals of good lines, each weighted by its length (an empty line by one)."""
        good, _, _ = marginals(self.line_scores(features), self.change, lines)
        weight = np.maximum(length, 1)
        return run_sums(good * weight, lines) / run_sums(weight, lines)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        slope, offset = self.curve
        return 1 / (1 + np.exp(-(slope * self.document_means(*line_features(texts)) + offset)))


def descend(gradient: Callable[[np.ndarray], np.ndarray], start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    """Adam with a falling rate."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x -= rate * (1 - 0.9 * k / rounds) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
    return x


def fit(texts: list[bytes], labels: np.ndarray, rounds: int = 80, passes: int = 3) -> LineField:
    """Maximum likelihood of line labels, which are first their text's and then what the field itself finds in bad texts.

    A bad text may hold good lines: after each pass, lines of bad texts whose marginal says good become good, as long
    as half of the text by length stays bad. Lines of good texts stay good.
    """
    features, length, lines = line_features(texts)
    weight = np.maximum(length, 1)
    doc = np.repeat(np.arange(len(texts)), lines)
    target = labels[doc].astype(np.int64)
    last = np.zeros(len(features), bool)
    last[np.cumsum(lines) - 1] = True
    # texts count alike, whatever their number of lines
    share = (1 / np.sqrt(lines))[doc]
    weights, change = np.zeros(FEATURES), np.zeros((2, 2))
    for _ in range(passes):
        here = np.flatnonzero(~last)
        seen = np.zeros((2, 2))
        np.add.at(seen, (target[here], target[here + 1]), share[here])

        def gradient(x: np.ndarray) -> np.ndarray:
            model = LineField(x[:FEATURES], x[FEATURES:].reshape(2, 2), (1, 0))
            good, pair, _ = marginals(model.line_scores(features), model.change, lines)
            g = features.T @ ((good - target) * share)
            c = (pair * share[:, None, None]).sum(axis=0) - seen
            return np.concatenate((g, c.ravel())) / len(texts) + 1e-4 * x

        x = descend(gradient, np.concatenate((weights, change.ravel())), rounds, 0.3)
        weights, change = x[:FEATURES], x[FEATURES:].reshape(2, 2)
        model = LineField(weights, change, (1, 0))
        good, _, _ = marginals(model.line_scores(features), change, lines)
        flip = (labels[doc] == 0) & (good > 0.5)
        bad_left = run_sums(weight * ~flip, lines) / run_sums(weight, lines)
        target = np.where(labels[doc] == 1, 1, (flip & (bad_left[doc] >= 0.5)).astype(np.int64))
    means = model.document_means(features, length, lines)

    def curve_gradient(x: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-(x[0] * means + x[1])))
        return np.array([((p - labels) * means).mean(), (p - labels).mean()]) + 1e-4 * x

    return LineField(weights, change, tuple(descend(curve_gradient, np.array([8.0, -4.0]), 400, 0.2)))


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learnt: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", *, most_rows: int = 2000, most_bytes: int = 40_000) -> LineField:
    """A field fitted on at most `most_rows` labelled rows that are not held out and have texts of at most `most_bytes` bytes.

    Which rows, a hash of the id decides. The bound is on fitting only; scoring reads every text whole. Rows without
    a label of 0 or 1 are not used; without rows of both labels the score is the share of good ones (one half without any).
    """
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).alias("_label"))
    known = known.where(~held_out(F.col("_id")))
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most_rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where(F.octet_length("_text") <= most_bytes)
    # an id with several texts is taken with the first of them
    rows = texts.join(F.broadcast(chosen), "_id").groupBy("_id", "_label").agg(F.min("_text").alias("_text"))
    found = sorted(tuple(r) for r in rows.toLocalIterator())
    labelled = np.array([r[1] for r in found], np.int64)
    if len(set(labelled.tolist())) < 2:
        share = float(np.clip(labelled.mean(), 0.01, 0.99)) if len(labelled) else 0.5
        return LineField(np.zeros(FEATURES), np.zeros((2, 2)), (0.0, float(np.log(share / (1 - share)))))
    return fit([r[2].encode("utf-8") for r in found], labelled)


def score_quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text", *, carry: Sequence[str] = (), score_col: str = "score") -> DataFrame:
    """(id_col, carry, score) of every whole text: from 0 to 1, higher for better; columns in `carry` go along with their row.

    Each line is good or bad by its own features and its neighbours' and by the states beside it; the marginals, weighted by
    length, make the document's score. Only the text is read. Null counts as empty: one empty line. Null and repeated
    ids stay row by row; an empty table gives an empty result; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                scores = model.scores([t.encode("utf-8") for t in texts_of(part, text_col).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in shown), pa.array(scores, pa.float64())], [*shown, score_col])

    shown = list(dict.fromkeys([id_col, *carry]))
    rows = docs.select(*dict.fromkeys([*shown, text_col]))
    return rows.mapInArrow(run, T.StructType([*(field(docs, c) for c in shown), T.StructField(score_col, T.DoubleType())]))
