"""Periodic runs of words, found with string synchronising sets."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from peakweave.llm.frames import field, text_slices, texts_of

#: A run has at least LEAST words and TIMES periods.
LEAST, TIMES = 6, 4
#: Periods below this are found by comparing the words that far apart; synchronising sets begin here.
SMALL = 4
MIX = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def same_next(ids: np.ndarray, size: int, ends: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the windows of `2 * size` words from those of `size` words, and the positions whose window occurs again.

    A window's name is the first position of its document where it occurs; one that occurs once, or would leave its document, is
    named by itself. Only windows that begin and end with a repeated half can repeat, so few positions are sorted.
    """
    out = np.arange(len(ids), dtype=ids.dtype)
    live = live[live + 2 * size <= ends[live]]
    many = np.bincount(ids, minlength=len(ids)) > 1
    live = live[many[ids[live]] & many[ids[live + size]]]
    if not len(live):
        return out, live
    key = ids[live].astype(np.int64) * len(ids) + ids[live + size]
    order = np.argsort(key, kind="stable")
    first = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    names = live[order][first][np.cumsum(first) - 1]
    out[live[order]] = names
    many = np.bincount(names, minlength=len(ids)) > 1
    return out, live[many[out[live]]]


def maximal(first: np.ndarray, last: np.ndarray, period: np.ndarray, names: list[np.ndarray], starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the longest stretch with the period around [first, last + period): steps of falling size both ways."""
    right, left = last + period, first.copy()
    top = len(names) - 1
    open_ones = np.arange(len(right))
    while len(open_ones):  # steps of the largest size, for as long as they hold
        y = right[open_ones]
        fits = y + (1 << top) <= ends[open_ones]
        x = np.where(fits, y, 0)
        fits &= names[top][x] == names[top][np.where(fits, y - period[open_ones], 0)]
        open_ones = open_ones[fits]
        right[open_ones] += 1 << top
    open_ones = np.arange(len(left))
    while len(open_ones):
        x = left[open_ones] - (1 << top)
        fits = x >= starts[open_ones]
        x = np.where(fits, x, 0)
        fits &= names[top][x] == names[top][np.where(fits, x + period[open_ones], 0)]
        open_ones = open_ones[fits]
        left[open_ones] -= 1 << top
    for level in range(top - 1, -1, -1):
        fits = right + (1 << level) <= ends
        fits &= names[level][np.where(fits, right, 0)] == names[level][np.where(fits, right - period, 0)]
        right[fits] += 1 << level
        x = left - (1 << level)
        fits = x >= starts
        fits &= names[level][np.where(fits, x, 0)] == names[level][np.where(fits, x + period, 0)]
        left[fits] -= 1 << level
    return left, right


def synchronising(names: np.ndarray, size: int, ends: np.ndarray, regular: np.ndarray) -> np.ndarray:
    """Positions i of the synchronising set of scale `size`: the smallest hash among the windows at i .. i + size is at one of its ends.

    Membership follows from the 2 * size words at i alone. `regular` windows, those of at least LEAST words and TIMES periods, have no hash.
    """
    n = len(names)
    hashed = (names.astype(np.uint64) + np.uint64(1)) * MIX
    hashed[regular] = NEVER
    low = np.concatenate((hashed, np.full(size, NEVER)))
    width = 1
    while width < size:
        low[: len(low) - width] = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    at_end = np.concatenate((hashed, np.full(size, NEVER)))[size : size + n]
    low = np.minimum(low[:n], at_end)
    return np.flatnonzero((np.arange(n) + 2 * size <= ends) & (low != NEVER) & ((hashed == low) | (at_end == low)))


def find_runs(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows (begin, end, period) of all runs, by begin, then period, in the joined word numbers of several documents.

    `bounds` are the documents' ends after a 0. A run is a longest stretch of a document in which words `period` apart are equal, of that
    smallest period, at least `least` words and `times` (4 or more) periods long.

    Periods below SMALL are found by comparing words. At scale s = 4, 8, ... for periods in [s, 2s): windows of s words that hold
    `times` periods (and `least` words) lie in runs found before and get no hash. A run of period q in [s, 2s) holds a synchronising position in its first s words, since not
    all windows there can have a small period (else the run had). At four periods its context of 2s words occurs again q words later, inside the
    run, and nowhere between (else the run had a smaller period). So of each context the neighbouring occurrences whose distance is in [s, 2s)
    propose that period; neighbours of one chain are one proposal, which is then extended to both sides and kept if long enough.
    The scales end when no repeated window has its next occurrence that far away.
    """
    n = len(words)
    sizes = np.diff(bounds)
    starts, ends = np.repeat(bounds[:-1], sizes), np.repeat(bounds[1:], sizes)
    found = []

    def keep(begin: np.ndarray, end: np.ndarray, period: np.ndarray) -> None:
        long = (end - begin >= least) & (end - begin >= times * period)
        found.append(np.stack([begin[long], end[long], period[long]], 1))

    smaller = np.zeros((0, 2), np.int64)
    for period in range(1, min(SMALL, n)):
        same = np.zeros(n + 1, np.int8)
        same[: n - period] = (words[period:] == words[:-period]) & (starts[period:] == starts[:-period])
        edge = np.diff(np.concatenate(([0], same)))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + period
        long = (end - begin >= least) & (end - begin >= times * period)
        begin, end = begin[long], end[long]
        if len(smaller) and len(begin):  # a stretch of a smaller period that divides this one is the same stretch
            known = set(map(tuple, smaller.tolist()))
            new = np.array([(b, e) not in known for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
            begin, end = begin[new], end[new]
        smaller = np.concatenate([smaller, np.stack([begin, end], 1)])
        keep(begin, end, np.full(len(begin), period))
    live = np.arange(n)
    pair = starts.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
    _, first, code = np.unique(pair, return_index=True, return_inverse=True) if n else (None, np.zeros(0, np.int64), np.zeros(0, np.int64))
    names = [first[code].astype(np.int64)]
    counts = np.bincount(names[0], minlength=n)
    live = live[counts[names[0]] > 1]
    scale = 1
    while len(live) and scale <= n // 2:
        name, live = same_next(names[-1], scale, ends, live)
        names.append(name)
        if scale >= SMALL and len(live):
            order = live[np.argsort(name[live], kind="stable")]
            apart = np.diff(order)[name[order][1:] == name[order][:-1]]
            if not (apart >= scale).any():
                break
            known = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
            known = known[(known[:, 2] * times <= scale) & (known[:, 1] - known[:, 0] >= scale) & (scale >= least)]
            edge = np.zeros(n + 1, np.int64)
            np.add.at(edge, known[:, 0], 1)
            np.add.at(edge, known[:, 1] - scale + 1, -1)
            sync = synchronising(names[-2], scale, ends, np.cumsum(edge)[:n] > 0)
            again = np.zeros(n, bool)
            again[live] = True
            sync = sync[again[sync]]
            order = sync[np.argsort(name[sync], kind="stable")]
            here, there = order[:-1], order[1:]
            near = (name[here] == name[there]) & (there - here >= scale) & (there - here < 2 * scale)
            here, period = here[near], (there - here)[near]
            if len(here):
                order = np.lexsort((here, period))
                here, period = here[order], period[order]
                cut = np.concatenate(([True], (period[1:] != period[:-1]) | (here[1:] - here[:-1] > 2 * scale)))
                first, last = here[cut], here[np.concatenate((cut[1:], [True]))]
                begin, end = maximal(first, last, period[cut], names, starts[first], ends[first])
                one = np.unique(np.stack([begin, end, period[cut]], 1), axis=0)
                keep(one[:, 0], one[:, 1], one[:, 2])
        scale *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def planted(sizes: np.ndarray, ids: list) -> list[tuple[int, int, int]]:
    """(row, a, p) of the documents whose words from number a on become periodic with period p: one in ten ids that are not null."""
    out = []
    for row, (n, doc) in enumerate(zip(sizes.tolist(), ids, strict=True)):
        h = zlib.crc32(str(doc).encode()) if doc is not None and n else 1
        if h % 10 == 0:
            g = h // 10
            a = g % n
            out.append((row, a, 1 + (n - a) // (3 + g % 8)))
    return out


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, plant: bool = False, with_text: bool = False) -> DataFrame:
    """Runs of each whole text and the text without their repeats.

    Returns one row per row: (id_col, n_words, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256, and with `with_text` `collapsed`
    and `runs`, an array of (start, length, period)). start, length and period are those of the run of most periods (ties: smallest start, then
    period). A word is dropped if a run contains it after that run's first period; the others are joined by one space.
    Words are what white space of ASCII separates. With `plant` the texts get test repeats first (see `planted`).

    A task works on a few MB of text at once, a longer text alone; work per scale is linear in the words that still repeat. Null text counts as empty:
    no run, null figures, digests of the empty string. Null and repeated ids are rows like others (a null id gets no test repeat).
    An empty table gives an empty result; other columns are ignored.
    """
    run_type = T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))
    numbers = ("n_words", "n_runs", "start", "length", "period", "exponent_milli")
    fields = [field(docs, id_col), *(T.StructField(c, T.LongType()) for c in numbers), T.StructField("runs_sha256", T.StringType()), T.StructField("collapsed_sha256", T.StringType())]
    if with_text:
        fields += [T.StructField("collapsed", T.StringType()), T.StructField("runs", run_type)]
    schema = T.StructType(fields)
    arrow_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                parts = pc.ascii_split_whitespace(texts_of(part, text_col))
                flat, real = parts.flatten(), None
                real = pc.not_equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
                owner = np.repeat(np.arange(part.num_rows), pc.list_value_length(parts).to_numpy(zero_copy_only=False))[real]
                coded = pc.dictionary_encode(flat.filter(pa.array(real)))
                words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                sizes = np.bincount(owner, minlength=part.num_rows)
                bounds = np.concatenate(([0], np.cumsum(sizes)))
                if plant:
                    for row, a, p in planted(sizes, part.column(id_col).to_pylist()):
                        low, high = bounds[row] + a, bounds[row + 1]
                        words[low:high] = words[low + np.arange(high - low) % p]
                runs = find_runs(words, bounds)
                drop = np.zeros(len(words) + 1, np.int64)
                np.add.at(drop, runs[:, 0] + runs[:, 2], 1)
                np.add.at(drop, runs[:, 1], -1)
                stay = np.cumsum(drop)[:-1] == 0
                left = np.concatenate(([0], np.cumsum(np.bincount(owner[stay], minlength=part.num_rows))))
                kept = coded.dictionary.take(pa.array(words[stay]))
                lists = pa.ListArray.from_arrays(pa.array(left, pa.int32()), kept)
                texts = pc.binary_join(lists, " ")
                cuts = np.searchsorted(runs[:, 0], bounds)
                figures, digests, listed = [], [], []
                for row in range(part.num_rows):
                    own = [(b - int(bounds[row]), e - b, p) for b, e, p in runs[cuts[row] : cuts[row + 1]].tolist()]
                    best = (None,) * 4
                    if own:
                        top = own[0]
                        for r in own[1:]:  # by start, then period: only a greater exponent wins
                            if r[1] * top[2] > top[1] * r[2]:
                                top = r
                        best = (*top, 1000 * top[1] // top[2])
                    figures.append((int(sizes[row]), len(own), *best))
                    digests.append(hashlib.sha256("".join(f"{s},{length},{p}\n" for s, length, p in own).encode()).hexdigest())
                    listed.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own] if with_text else None)
                whole = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts.to_pylist()]
                columns = [pa.array(c, pa.int64()) for c in zip(*figures, strict=True)]
                out = [part.column(id_col), *columns, pa.array(digests, pa.string()), pa.array(whole, pa.string())]
                yield pa.RecordBatch.from_arrays(out + ([texts, pa.array(listed, arrow_runs)] if with_text else []), [f.name for f in schema])
            pa.default_memory_pool().release_unused()

    return docs.select(id_col, text_col).mapInArrow(run, schema)
