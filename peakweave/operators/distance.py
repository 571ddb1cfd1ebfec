"""Distances and correlations between samples or features.

A distance matrix needs every pair, so the work is cut into blocks: rows are spread over blocks of bounded
size and each task compares two blocks with dense array arithmetic. Consumers that want less than the matrix
(neighbours, clusters, silhouettes) reduce inside the block and never write the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.functions.tails import t_p_value
from peakweave.operators.normalize import clr, robust_clr
from peakweave.operators.ordering import average_ranks
from peakweave.operators.reshape import to_rows

# rows of a tile, which is compared at once, and of a block at least: two of 512 rows and a thousand columns take 8 MB
BLOCK_ROWS = 512
# blocks at most: every row goes to as many tasks, so what is shuffled grows with the rows and not with their square
BLOCKS = 48
# the same where a task leaves little of its pairs: few enough that a table of ten thousand rows has them all
FEW_BLOCKS = 16
# rows of partial results that a task holds before it merges them
HELD_ROWS = 1 << 19
# pairs of rows that are measured at once
MEASURED = 1 << 15
# numbers in a row from which on ruling pairs out by matrix products takes less than measuring them
LONG = 8


def _id_type(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.simpleString()


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, dtype=float) for x in column])


def block_count(df: DataFrame, block_rows: int = BLOCK_ROWS, most: int | None = None) -> int:
    """Blocks of about `block_rows` rows, or `most` larger ones."""
    blocks = max(1, math.ceil(df.count() / block_rows))
    return blocks if most is None else min(blocks, most)


def with_block(df: DataFrame, key: str, blocks: int, out: str = "_block") -> DataFrame:
    """Spread rows over blocks by a hash of their id, so block sizes stay near the average."""
    return df.withColumn(out, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int"))


def block_pairs(
    rows: DataFrame, key: str, fn: Callable[[pd.DataFrame, pd.DataFrame, bool], pd.DataFrame], schema: str,
    block_rows: int = BLOCK_ROWS, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None, most: int | None = None,
) -> DataFrame:
    """Run fn(left, right, same) on tiles of at most `block_rows` rows, such that every pair of rows meets in one.

    A task holds two blocks, of which there are BLOCKS (or `most`) at most, and compares them tile by tile; results leave it a tile at a
    time, or added up by `merge`.
    """
    blocks = block_count(rows, block_rows, BLOCKS if most is None else min(most, BLOCKS))
    b = F.col("_block")
    # block b takes part in the pairs (b, b..) and (..b, b)
    partners = F.transform(
        F.sequence(F.lit(0), F.lit(blocks - 1)),
        lambda o: F.struct(F.least(b, o).alias("lo"), F.greatest(b, o).alias("hi")),
    )
    spread = with_block(rows, key, blocks).withColumn("_p", F.explode(partners)).select("*", "_p.lo", "_p.hi").drop("_p")

    def tiles(group: pd.DataFrame) -> list[pd.DataFrame]:
        # blocks are as large as their hashes make them: one of a few rows more is still one tile
        if len(group) <= 2 * block_rows:
            return [group] if len(group) else []
        return [group.iloc[a : a + block_rows] for a in range(0, len(group), block_rows)]

    def results(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
        lo, hi = int(group["lo"].iloc[0]), int(group["hi"].iloc[0])
        left = tiles(group[group["_block"] == lo])
        if lo == hi:
            for i, one in enumerate(left):
                yield fn(one, one, True)
                for other in left[i + 1 :]:
                    yield fn(one, other, False)
        else:
            right = tiles(group[group["_block"] == hi])
            for one in left:
                for other in right:
                    yield fn(one, other, False)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = results(pd.concat(list(batches), ignore_index=True))
        if merge is None:
            yield from found
            return
        held: list[pd.DataFrame] = []
        n, most_held = 0, HELD_ROWS
        for part in found:
            held.append(part)
            n += len(part)
            if n > most_held:
                held = [merge(pd.concat(held, ignore_index=True))]
                n = len(held[0])
                most_held = max(HELD_ROWS, 2 * n)
        if held:
            yield merge(pd.concat(held, ignore_index=True))

    # comparing two blocks costs far more than their bytes suggest, so tiny partitions are not merged
    parts = min(blocks * (blocks + 1) // 2, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.repartition(parts, "lo", "hi").groupBy("lo", "hi").applyInPandas(compare, schema)


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of |x-y| / (|x|+|y|), skipping 0/0 terms and scaling up for the terms skipped."""
    out = np.empty((len(a), len(b)))
    for i, x in enumerate(a):
        top, bottom = np.abs(x - b), np.abs(x) + np.abs(b)
        used = bottom > 0
        total = np.where(used, top / np.where(used, bottom, 1), 0).sum(1)
        n = used.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            out[i] = np.where(n > 0, total * (a.shape[1] / n), np.nan)
    return out


def _euclidean(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((x - b) ** 2).sum(1)) for x in a])


def metric_function(metric: str, p: float = 2.0) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    metrics = {
        "euclidean": _euclidean,
        "maximum": lambda a, b: np.stack([np.abs(x - b).max(1) for x in a]),
        "manhattan": lambda a, b: np.stack([np.abs(x - b).sum(1) for x in a]),
        "canberra": _canberra,
        "minkowski": lambda a, b: np.stack([(np.abs(x - b) ** p).sum(1) ** (1 / p) for x in a]),
    }
    if metric not in metrics:
        raise ValueError(f"unknown metric {metric}")
    return metrics[metric]


def _tame(*tables: np.ndarray) -> bool:
    return all(x.size and np.abs(x).max() < 1e150 for x in tables)


def _squares(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by matrix products, and how far rounding may have moved those of each pair."""
    both = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    return both - 2 * (a @ b.T), 1e-12 * (1 + a.shape[1]) * both + 1e-300


def _measured(a: np.ndarray, b: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows r of a and c of b, as `_euclidean` has them."""
    d = np.empty(len(r))
    for at in range(0, len(r), MEASURED):
        d[at : at + MEASURED] = np.sqrt(((a[r[at : at + MEASURED]] - b[c[at : at + MEASURED]]) ** 2).sum(1))
    return d


def close_in_block(a: np.ndarray, b: np.ndarray, at_most: float, metric: str, p: float = 2.0, but: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the pairs at most `at_most` apart, `but` some; Euclidean ones that products rule out are not measured."""
    if metric == "euclidean" and 0 <= at_most < 1e150 and a.shape[1] >= LONG and _tame(a, b):
        near, slack = _squares(a, b)
        may = near <= at_most * at_most * (1 + 1e-9) + slack
        r, c = np.nonzero(may if but is None else may & ~but)
        if len(r) <= near.size // 4:
            d = _measured(a, b, r, c)
            kept = d <= at_most
            return r[kept], c[kept], d[kept]
    d = metric_function(metric, p)(a, b)
    r, c = np.nonzero(d <= at_most if but is None else (d <= at_most) & ~but)
    return r, c, d[r, c]


def distances_in_block(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """All distances, to about eleven digits; Euclidean ones by matrix products, but of rows so near that those lose digits."""
    if metric != "euclidean" or not _tame(a, b):
        return metric_function(metric)(a, b)
    both = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :]
    squares = a @ b.T
    squares *= 2
    np.subtract(both, squares, out=squares)
    both *= 0.01
    both += 1e-200
    r, c = np.nonzero(squares < both)
    if len(r) > squares.size // 4:
        return _euclidean(a, b)
    out = np.sqrt(np.maximum(squares, 0, out=squares), out=squares)
    out[r, c] = _measured(a, b, r, c)
    return out


def spanning_forest(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Places of pairs that join what all pairs (i, j) join, fewer than there are ids. Pairs with a missing id join nothing."""
    there = np.flatnonzero(~(pd.isna(i) | pd.isna(j)))
    if not len(there):
        return there
    _, at = np.unique(np.concatenate([i[there], j[there]]), return_inverse=True)
    a, b = at[: len(there)], at[len(there) :]
    root, edge, kept = np.arange(at.max() + 1), np.arange(len(there)), []
    while len(edge):
        low, high = np.minimum(root[a[edge]], root[b[edge]]), np.maximum(root[a[edge]], root[b[edge]])
        apart = low != high
        edge, low, high = edge[apart], low[apart], high[apart]
        # every root that still meets a smaller one goes below one of those
        tops, first = np.unique(high, return_index=True)
        root[tops] = low[first]
        kept.append(edge[first])
        while (root[root] != root).any():
            root = root[root]
    return there[np.sort(np.concatenate(kept))]


def _ordered(ids_a: np.ndarray, ids_b: np.ndarray, d: np.ndarray, keep: np.ndarray) -> pd.DataFrame:
    r, c = np.nonzero(keep)
    return _sorted_ids(ids_a[r], ids_b[c], d[r, c])


def _sorted_ids(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> pd.DataFrame:
    swap = a > b
    return pd.DataFrame({"i": np.where(swap, b, a), "j": np.where(swap, a, b), "value": value})


def pairwise_distance(
    rows: DataFrame, key: str = "file", array: str = "x", metric: str = "euclidean", p: float = 2.0,
    at_most: float | None = None, forest: bool = False,
) -> DataFrame:
    """Distances (i, j, value) with i < j between dense rows; `at_most` writes close pairs only.

    With `forest` a task leaves of its close pairs no more than join the same rows: for clusters at this very height, whose
    pairs would grow with the square of the table.
    """
    measure = metric_function(metric, p)
    kind = _id_type(rows, key)
    if forest and at_most is None:
        raise ValueError("a forest needs a height")

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"i": left[key], "j": left[key], "value": pd.Series(dtype=float)})
        a, b = _stack(left[array]), _stack(right[array])
        ids_a, ids_b = left[key].to_numpy(), right[key].to_numpy()
        if at_most is not None:
            but = np.tril(np.ones((len(a), len(b)), bool)) if same else None
            r, c, d = close_in_block(a, b, at_most, metric, p, but)
            return _sorted_ids(ids_a[r], ids_b[c], d)
        d = measure(a, b)
        return _ordered(ids_a, ids_b, d, np.ones_like(d, bool) if not same else np.triu(np.ones_like(d, bool), 1))

    def thinned(pairs: pd.DataFrame) -> pd.DataFrame:
        return pairs.iloc[spanning_forest(pairs["i"].to_numpy(), pairs["j"].to_numpy())]

    fewer = {"merge": thinned, "most": FEW_BLOCKS} if forest else {}
    return block_pairs(rows.select(key, array), key, compare, f"i {kind}, j {kind}, value double", **fewer)


def aitchison_distance(cells: DataFrame, robust: bool = False, file: str = "file", feature: str = "feature", value: str = "value") -> DataFrame:
    """Euclidean distance after the centred log ratio; the robust form uses the non-zero parts only."""
    ratios = (robust_clr if robust else clr)(cells, value, file)
    rows, _ = to_rows(ratios, file, feature, value)
    return pairwise_distance(rows, file, "x", "euclidean")


def gower_rows(
    rows: DataFrame, ranges: np.ndarray, key: str = "file", array: str = "x", categories: Sequence[str] = (),
) -> DataFrame:
    """Gower distances from dense rows with nulls and category columns, given each column's range."""
    kind = _id_type(rows, key)
    measure = gower_block(ranges, array, categories)

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        if len(left) == 0 or len(right) == 0:
            return pd.DataFrame({"i": left[key], "j": left[key], "value": pd.Series(dtype=float)})
        d = measure(left, right)
        keep = np.ones_like(d, bool) if not same else np.triu(np.ones_like(d, bool), 1)
        return _ordered(left[key].to_numpy(), right[key].to_numpy(), d, keep)

    return block_pairs(rows.select(key, array, *categories), key, compare, f"i {kind}, j {kind}, value double")


def gower_block(ranges: np.ndarray, array: str, categories: Sequence[str]) -> Callable:
    """Mean over the columns both rows have of |a-b|/range, and 0 or 1 for categories."""
    scale = np.where(ranges > 0, ranges, 1.0)

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> np.ndarray:
        a, b = _stack(left[array]), _stack(right[array])
        total = np.empty((len(a), len(b)))
        n = np.empty_like(total)
        for i, x in enumerate(a):
            part = np.abs(x - b) / scale
            both = ~np.isnan(part)
            total[i], n[i] = np.where(both, part, 0).sum(1), both.sum(1)
        for c in categories:
            u, v = left[c].to_numpy(dtype=object), right[c].to_numpy(dtype=object)
            both = pd.notna(u)[:, None] & pd.notna(v)[None, :]
            total += both & (u[:, None] != v[None, :])
            n += both
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(n > 0, total / n, np.nan)

    return measure


def column_ranges(rows: DataFrame, array: str = "x") -> np.ndarray:
    """Range of every column of dense rows: as many numbers as there are columns."""
    found = (
        rows.select(F.posexplode(array).alias("k", "v"))
        .groupBy("k")
        .agg((F.max("v") - F.min("v")).alias("r"))
        .orderBy("k")
        .collect()
    )
    return np.array([np.nan if r["r"] is None else float(r["r"]) for r in found])


def gower_distance(rows: DataFrame, key: str = "file", array: str = "x", categories: Sequence[str] = ()) -> DataFrame:
    return gower_rows(rows, column_ranges(rows, array), key, array, categories)


def nearest_in_block(a: np.ndarray, b: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, row of b, distance) of the k rows of b nearest to each row of a, of equal ones the first, by row of a.

    Euclidean distances are bounded by matrix products first, whose rounding is allowed for; only rows that can be among
    the k are measured.
    """
    k = min(k, len(b))
    tame = all(x.size and np.abs(x).max() < 1e150 for x in (a, b))
    if metric == "euclidean" and tame:
        aa, bb = (a * a).sum(1), (b * b).sum(1)
        near = bb[None, :] - 2 * (a @ b.T)
        slack = 1e-12 * (1 + a.shape[1]) * (aa + bb.max()) + 1e-300
        r, c = np.nonzero(near <= (np.partition(near, k - 1, axis=1)[:, k - 1] + slack)[:, None])
        d = np.empty(len(r))
        for at in range(0, len(r), MEASURED):
            d[at : at + MEASURED] = np.sqrt(((a[r[at : at + MEASURED]] - b[c[at : at + MEASURED]]) ** 2).sum(1))
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        first = np.searchsorted(r, np.arange(len(a)))
        kept = (first[:, None] + np.arange(k)).ravel()
        return r[kept], c[kept], d[kept]
    d = metric_function(metric)(a, b)
    near = np.argsort(d, axis=1, kind="stable")[:, :k]
    r, c = np.repeat(np.arange(len(a)), k), near.ravel()
    return r, c, d[r, c]


def nearest_neighbours(
    test: DataFrame, train: DataFrame, k: int, key: str = "file", array: str = "x", metric: str = "euclidean",
    carry: Sequence[str] = (), block_rows: int = 2048,
) -> DataFrame:
    """The k nearest training rows of each test row, ties by training id.

    Each block keeps k candidates per test row; only those meet again to choose the final k. Of either side there are
    at most half of BLOCKS blocks, which a task compares tile by tile.
    """
    blocks = block_count(train, block_rows, BLOCKS // 2)
    test_blocks = block_count(test, block_rows, BLOCKS // 2)
    metric_function(metric)
    left = with_block(test.select(key, array), key, test_blocks, "_tb").withColumn(
        "_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    )
    right = with_block(train.select(F.col(key).alias("n_id"), F.col(array).alias("n_x"), *carry), "n_id", blocks).withColumn(
        "_tb", F.explode(F.sequence(F.lit(0), F.lit(test_blocks - 1)))
    )
    kind = _id_type(test, key)
    extra = "".join(f", `{c}` {_id_type(train, c)}" for c in carry)

    def candidates(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = [key, "n_id", "distance", *carry]
        if len(q) == 0 or len(t) == 0:
            return pd.DataFrame({c: [] for c in cols})
        t = t.sort_values("n_id", kind="stable")
        a, b = _stack(q[array]), _stack(t["n_x"])
        found = []
        for i in range(0, len(a), BLOCK_ROWS):
            best = None
            for j in range(0, len(b), block_rows):
                r, c, d = nearest_in_block(a[i : i + BLOCK_ROWS], b[j : j + block_rows], k, metric)
                new = r, c + j, d
                if best is not None:
                    # places rise with the ids, so that equal distances stay in their order
                    r, c, d = (np.concatenate(z) for z in zip(best, new, strict=True))
                    order = np.lexsort((c, d, r))
                    r, c, d = r[order], c[order], d[order]
                    kept = np.arange(len(r)) - np.searchsorted(r, r) < k
                    new = r[kept], c[kept], d[kept]
                best = new
            found.append((best[0] + i, *best[1:]))
        r, c, d = (np.concatenate(z) for z in zip(*found, strict=True))
        out = {key: q[key].to_numpy()[r], "n_id": t["n_id"].to_numpy()[c], "distance": d}
        return pd.DataFrame(out | {name: t[name].to_numpy()[c] for name in carry})

    from peakweave.operators.summary import top_k

    found = left.groupBy("_tb", "_block").cogroup(right.groupBy("_tb", "_block")).applyInPandas(
        candidates, f"`{key}` {kind}, n_id {_id_type(train, key)}, distance double{extra}"
    )
    return top_k(found, [key], [F.asc("distance"), F.asc("n_id")], k)


MOMENTS = ("n", "sx", "sy", "sxx", "syy", "sxy")


def _block_sums(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The six sums of every column of x with every column of y over the rows in which both are present."""
    mx, my = (~np.isnan(x)).astype(float), (~np.isnan(y)).astype(float)
    zx, zy = np.where(mx > 0, x, 0.0), np.where(my > 0, y, 0.0)
    return [mx.T @ my, zx.T @ my, mx.T @ zy, (zx**2).T @ my, mx.T @ zy**2, zx.T @ zy]


def _as_rows(parts: list[np.ndarray], lo: int, hi: int) -> pd.DataFrame:
    r, c = np.indices(parts[0].shape)
    a, b = r.ravel() + lo, c.ravel() + hi
    keep = a < b
    data = {"a": a[keep].astype("int32"), "b": b[keep].astype("int32")}
    return pd.DataFrame(data | {name: part.ravel()[keep] for name, part in zip(MOMENTS, parts, strict=True)})


def cross_moments(rows: DataFrame, array: str = "x", block_cols: int = 512, block_rows: int = 2048) -> DataFrame:
    """Pairwise-complete sums (n, sx, sy, sxx, syy, sxy) of every two columns a < b of dense rows with nulls.

    Rows of up to `block_cols` columns are reduced where they are: a task holds six blocks of sums. Wider rows are cut into
    column blocks; a group then holds two of them for about `block_rows` rows, so memory does not grow with the width.
    Sums of the tasks are added up at the end.
    """
    spec = "a int, b int, " + ", ".join(f"{c} double" for c in MOMENTS)
    x = rows.select(F.col(array).cast("array<double>").alias(array))
    first = x.select(F.size(array)).first()
    width = first[0] if first else 0

    def partial(batches):
        sums = None
        for batch in batches:
            if len(batch):
                block = _stack(batch[array])
                parts = _block_sums(block, block)
                sums = parts if sums is None else [u + v for u, v in zip(sums, parts, strict=True)]
        if sums is not None:
            yield _as_rows(sums, 0, 0)

    def of_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
        lo, hi = int(pdf["lo"].iat[0]), int(pdf["hi"].iat[0])
        return _as_rows(_block_sums(_stack(pdf["p"]), _stack(pdf["q"])), lo, hi)

    if width <= block_cols:
        sums = x.mapInPandas(partial, spec)
    else:
        total = rows.count()
        starts = list(range(0, width, block_cols))
        pairs = F.array(*[F.struct(F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for lo in starts for hi in starts if lo <= hi])
        # by all columns, so that equal values of different samples are spread
        block = F.pmod(F.xxhash64(*[F.col(c) for c in rows.columns]), F.lit(max(1, -(-total // block_rows))))
        dealt = rows.select(block.alias("_rows"), F.col(array).cast("array<double>").alias(array)).withColumn("_p", F.explode(pairs))
        part = lambda c: F.slice(array, F.col(f"_p.{c}") + 1, F.lit(block_cols))
        dealt = dealt.select("_rows", "_p.lo", "_p.hi", part("lo").alias("p"), part("hi").alias("q"))
        sums = dealt.groupBy("_rows", "lo", "hi").applyInPandas(of_blocks, spec)
    return sums.groupBy("a", "b").agg(*[F.sum(c).alias(c) for c in MOMENTS])


def centre_columns(rows: DataFrame, array: str = "x") -> DataFrame:
    """Subtract column means, so that sums of squares keep their precision."""
    means = rows.select(F.posexplode(array).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"))
    packed = means.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda s: s["m"]).alias("_mean"))
    return rows.join(F.broadcast(packed), F.lit(True)).withColumn(
        array, F.zip_with(F.col(array).cast("array<double>"), F.col("_mean"), lambda x, m: x - m)
    ).drop("_mean")


def correlation_matrix(rows: DataFrame, array: str = "x") -> DataFrame:
    """Pearson r of every two columns (i < j) over the rows in which both are present."""
    s = cross_moments(centre_columns(rows, array), array)
    n = F.col("n")
    cov = n * F.col("sxy") - F.col("sx") * F.col("sy")
    spread = (n * F.col("sxx") - F.col("sx") * F.col("sx")) * (n * F.col("syy") - F.col("sy") * F.col("sy"))
    r = F.when(spread > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(spread))))
    return s.filter(n >= 2).select(F.col("a").alias("i"), F.col("b").alias("j"), r.alias("value"), n.cast("long").alias("n"))


def spearman_with_p(
    cells: DataFrame, file: str = "file", feature: str = "feature", value: str = "value",
) -> tuple[DataFrame, DataFrame]:
    """Spearman r of feature pairs with p-values from the t approximation, and the feature index.

    Cells are ranked within each feature; pairs use the files in which both are present.
    """
    ranks = average_ranks(cells.select(file, feature, value), [feature], value)
    rows, index = to_rows(ranks, file, feature, "avg_rank", fill=None)
    r = correlation_matrix(rows)
    rho, df = F.col("value"), F.col("n") - 2
    t = rho * F.sqrt(df / F.nullif(1 - rho * rho, F.lit(0.0)))
    p = F.when(F.abs(rho) >= 1, F.lit(0.0)).when(df > 0, t_p_value(t, df.cast("double")))
    return r.withColumn("p_value", p), index


def strong_pairs(table: DataFrame, min_cor: float = 0.8, alpha: float = 0.05) -> DataFrame:
    return table.filter((F.col("value") > min_cor) & (F.col("p_value") < alpha))


def overall_correlation(matrix: DataFrame, flag_above: float = 0.8) -> DataFrame:
    """Mean |r| of all pairs and whether any exceeds the limit."""
    return matrix.agg(
        F.avg(F.abs("value")).alias("mean_abs_r"),
        F.coalesce(F.max((F.abs("value") > flag_above).cast("int")), F.lit(0)).alias("any_high"),
    )


def correlation_preservation(before: DataFrame, after: DataFrame) -> DataFrame:
    """Correlation between the entries of two correlation matrices."""
    joined = before.select("i", "j", F.col("value").alias("_u")).join(after.select("i", "j", F.col("value").alias("_v")), ["i", "j"])
    return joined.filter(F.col("_u").isNotNull() & F.col("_v").isNotNull()).agg(F.corr("_u", "_v").alias("preservation"))
