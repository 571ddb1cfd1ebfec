"""Imputers that learn from other samples: neighbours, random forests, low-rank structure.

They take dense sample rows with nulls, `(file, x array<double>)`, and return the same rows filled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators.distance import BLOCKS, _id_type, _stack, column_ranges, with_block
from peakweave.operators.project import leading_components
from peakweave.session import cut_lineage, materialize

#: Donors of a leaf, numbers in the donors of a task, rows that search at once, leaves they visit in one step, numbers measured at once.
LEAF, DONOR_NUMBERS, SEARCHING, VISITED, MEASURED = 64, 1 << 22, 256, 32, 1 << 18


def impute_knn(rows: DataFrame, k: int = 5, key: str = "file", array: str = "x", categories: Sequence[str] = (),
               block_rows: int = 512) -> DataFrame:
    """Median of the k nearest samples that have the value, by Gower distance, ties by sample id.

    Donors of a cell are the nearest samples having that cell. Samples with gaps meet all samples, a block of either side in a task, which
    proposes k donors per missing cell; the proposals of all blocks are then cut to k. A cell nobody has stays null. A task keeps its donors
    in leaves that have the same cells and are near each other, and measures those only that can hold a nearer one, so that few pairs
    are compared unless rows are wide. There are at most half of BLOCKS blocks a side, those of donors of about DONOR_NUMBERS numbers.
    """
    rows = materialize(rows, "knn-rows")
    gap = F.exists(array, lambda v: v.isNull() | F.isnan(v))
    n, with_gaps, width = rows.agg(F.count(F.lit(1)), F.count(F.when(gap, 1)), F.coalesce(F.max(F.size(array)), F.lit(0))).first()
    few = lambda x: max(1, min(math.ceil(x), BLOCKS // 2))
    blocks, donor_blocks = few(with_gaps / block_rows), few(n * max(1, width) / DONOR_NUMBERS)
    ranges = column_ranges(rows, array)
    scale = np.where(ranges > 0, ranges, 1.0)
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    spread = rows.select(key, array, *categories)
    left = with_block(spread.filter(gap), key, blocks).withColumn("_other", every(donor_blocks))
    # new names, because both sides come from the same rows
    right = with_block(spread, key, donor_blocks).select(
        F.col(key).alias("r_id"), F.col(array).alias("r_x"), *[F.col(c).alias(f"r_{c}") for c in categories],
        F.col("_block").alias("r_other"),
    ).withColumn("r_block", every(blocks))
    theirs = {"r_id": key, "r_x": array} | {f"r_{c}": c for c in categories}
    kind = _id_type(rows, key)

    def propose(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({c: [] for c in (key, "k", "donor", "d", "v")})
        # a donor's place stands for its id, so that equal distances are in the order of the ids
        b = b.rename(columns=theirs).sort_values(key, kind="stable")
        xa, xb = _stack(a[array]), _stack(b[array])
        ids_a, ids_b = a[key].to_numpy(), b[key].to_numpy()
        named = [(a[c].to_numpy(dtype=object), b[c].to_numpy(dtype=object)) for c in categories]
        row, col, place, d = nearest_donors(xa, xb, scale, k, lambda r, c: ids_a[r] == ids_b[c], named, min(LEAF, block_rows))
        return pd.DataFrame({key: ids_a[row], "k": col.astype("int32"), "donor": ids_b[place], "d": d, "v": xb[place, col]})

    # a search takes far longer than its bytes suggest, so tiny partitions are not merged, and few tasks get two
    parts = min(8 * blocks * donor_blocks, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left, right = left.repartition(parts, "_block", "_other"), right.repartition(parts, "r_block", "r_other")
    proposals = left.groupBy("_block", "_other").cogroup(right.groupBy("r_block", "r_other")).applyInPandas(
        propose, f"`{key}` {kind}, k int, donor {kind}, d double, v double"
    )
    from peakweave.operators.summary import top_k

    donors = top_k(proposals, [key, "k"], [F.asc("d"), F.asc("donor")], k)
    # at most k values per cell
    filled = donors.groupBy(key, "k").agg(F.expr("percentile(v, 0.5)").alias("fill"))
    packed = filled.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("k", "fill"))).alias("_fill"))
    joined = rows.join(packed, key, "left")
    return joined.withColumn(
        array, F.transform(array, lambda v, i: F.coalesce(v, F.try_element_at("_fill", i)))
    ).drop("_fill")


def _leaves(x: np.ndarray, there: np.ndarray, scale: np.ndarray, size: int) -> tuple[list[np.ndarray], int]:
    """Places of all rows in leaves of at most `size`, and how many of these, the last, hold rows that have different columns.

    Rows of a leaf have the same columns, and are halved along the widest until they are few; those whose like are too few share leaves.
    """
    packed = np.packbits(there, axis=1)
    order = np.lexsort(packed.T) if packed.shape[1] else np.arange(len(x))
    cuts = np.flatnonzero((packed[order[1:]] != packed[order[:-1]]).any(axis=1)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(x)]])
    many = ends - starts >= max(1, size // 4)
    todo, leaves = [order[i:j] for i, j in zip(starts[many], ends[many], strict=True)], []
    while todo:
        at = todo.pop()
        if len(at) <= size:
            leaves.append(at)
            continue
        some = x[at]
        wide = (some.max(axis=0) - some.min(axis=0)) / scale
        half = len(at) // 2
        at = at[np.argpartition(some[:, np.where(there[at[0]], wide, -1).argmax()], half)] if there.shape[1] else at
        todo += [at[:half], at[half:]]
    rest = order[np.repeat(~many, ends - starts)]
    mixed = [rest[i : i + size] for i in range(0, len(rest), size)]
    return leaves + mixed, len(mixed)


def nearest_donors(
    xa: np.ndarray, xb: np.ndarray, scale: np.ndarray, k: int, same: Callable[[np.ndarray, np.ndarray], np.ndarray],
    categories: Sequence[tuple[np.ndarray, np.ndarray]] = (), leaf: int = LEAF,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row of a, column, row of b, distance) of the k rows of b, but the `same`, that have a column which row a lacks and are nearest to it.

    Distances are those of `gower_block`, ties by the place in b. The columns a leaf's rows have tell how many a row of a shares with
    them, and their lowest and highest values how near one can be at least.
    """
    m, w = xa.shape
    there_a, there_b = ~np.isnan(xa), ~np.isnan(xb)
    leaves, mixed = _leaves(xb, there_b, scale, leaf)
    held = np.full((len(leaves), max(map(len, leaves))), -1)
    for i, at in enumerate(leaves):
        held[i, : len(at)] = at
    has = np.array([there_b[at].any(axis=0) for at in leaves])
    low, high = np.full(has.shape, -np.inf), np.full(has.shape, np.inf)
    # infinite values have no differences, so that rows that hold some share fewer columns than they have
    bounded = len(leaves) - mixed if not (np.isinf(xa).any() or np.isinf(xb).any()) and np.isfinite(scale).all() else 0
    for i in range(bounded):
        some, own = xb[leaves[i]], has[i]
        low[i, own], high[i, own] = some.min(axis=0)[own], some.max(axis=0)[own]
    found = []

    def search(rows: np.ndarray) -> None:
        x, there = xa[rows], there_a[rows]
        bound = np.zeros((len(rows), len(leaves)))
        for c in range(w):
            bound += np.fmax(np.fmax(low[:, c] - x[:, c, None], x[:, c, None] - high[:, c]), 0) / scale[c]
        shared = there.astype(float) @ has.T.astype(float) + len(categories)
        useful = ((~there).astype(float) @ has.T.astype(float) > 0) & (shared > 0)
        bound = np.where(useful, bound / np.maximum(shared, 1) * (1 - 1e-9), np.inf)
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, axis=1)
        slot_row, slot_col = np.nonzero(~there)
        first = np.searchsorted(slot_row, np.arange(len(rows)))
        limit = np.full(len(slot_row), np.inf)
        slots, places, ds = np.empty(0, int), np.empty(0, int), np.empty(0)
        at, step = 0, 1
        while at < len(leaves):
            allowed = np.maximum.reduceat(limit, first)[:, None]
            go = (bound[:, at : at + step] <= allowed) & np.isfinite(bound[:, at : at + step])
            # bounds rise, so that a row which visits none is done
            live = np.flatnonzero(go.any(axis=1))
            if not len(live):
                break
            go = go[live]
            r, visit = np.nonzero(go)
            donors = held[order[live, at : at + step]]
            d = np.full(donors.shape, np.nan)
            few = max(1, MEASURED // (held.shape[1] * max(1, w)))
            for i in range(0, len(r), few):
                q, v = r[i : i + few], visit[i : i + few]
                d[q, v] = measured(rows[live[q]], donors[q, v])
            # those that may be among the k of a cell, NaN is not
            q, v, j = np.nonzero(d <= allowed[live][:, :, None])
            near, of = d[q, v, j], donors[q, v, j]
            sizes = np.diff(first, append=len(slot_row))[live[q]]
            s = np.repeat(first[live[q]], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            near, of = np.repeat(near, sizes), np.repeat(of, sizes)
            having = there_b[of, slot_col[s]] & (near <= limit[s])
            slots, places, ds = (np.concatenate(z) for z in ((slots, s[having]), (places, of[having]), (ds, near[having])))
            ranked = np.lexsort((places, ds, slots))
            slots, places, ds = slots[ranked], places[ranked], ds[ranked]
            counts = np.bincount(slots, minlength=len(limit))
            kept = np.arange(len(slots)) - np.repeat(np.cumsum(counts) - counts, counts) < k
            slots, places, ds = slots[kept], places[kept], ds[kept]
            counts = np.minimum(counts, k)
            full = counts == k
            limit[full] = ds[np.cumsum(counts)[full] - 1]
            at, step = at + step, min(2 * step, VISITED)
        found.append((rows[slot_row[slots]], slot_col[slots], places, ds))

    def measured(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of each row of a to the rows of b beside it; NaN to itself, and where there is none."""
        parts, n = np.empty((w, *b.shape)), np.zeros(b.shape)
        for (x, y), width, part in zip(columns, scale, parts, strict=True):
            np.abs(x[a][:, None] - y[b], out=part)
            part /= width
            both = ~np.isnan(part)
            n += both
            if not both.all():
                part[~both] = 0
        # in the order in which a row of numbers is added up, so that ties are those of `gower_block`
        total = parts.sum(axis=0) if w < 8 else np.ascontiguousarray(np.moveaxis(parts, 0, -1)).sum(axis=-1)
        for u, v in categories:
            p, q = u[a][:, None], v[b]
            known = pd.notna(p) & pd.notna(q)
            total, n = total + (known & (p != q)), n + known
        with np.errstate(invalid="ignore", divide="ignore"):
            d = total / n
        d[(b < 0) | same(a[:, None], b)] = np.nan
        return d

    columns = [(np.ascontiguousarray(xa[:, c]), np.ascontiguousarray(xb[:, c])) for c in range(w)]
    gaps = np.flatnonzero((~there_a).any(axis=1))
    for i in range(0, len(gaps), SEARCHING):
        search(gaps[i : i + SEARCHING])
    none = [(np.empty(0, int), np.empty(0, int), np.empty(0, int), np.empty(0))]
    return tuple(np.concatenate(z) for z in zip(*(found or none), strict=True))


def _column_means(rows: DataFrame, array: str) -> list[float]:
    found = rows.select(F.posexplode(array).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m")).orderBy("k").collect()
    return [0.0 if r["m"] is None else float(r["m"]) for r in found]


def impute_forest(
    rows: DataFrame, key: str = "file", array: str = "x", max_iter: int = 10, trees: int = 100, seed: int = 1,
    max_features: int = 200,
) -> DataFrame:
    """Iterative imputation: each column is predicted from the others by a forest, columns with fewest gaps first.

    Stops when the relative change of the filled cells rises. One forest per column and round, so wide tables are
    refused.
    """
    width = rows.select(F.size(array)).first()[0]
    if width > max_features:
        raise ValueError(f"{width} columns exceed max_features={max_features}")
    gaps = (
        rows.select(F.posexplode(array).alias("k", "v")).groupBy("k")
        .agg(F.count(F.when(F.col("v").isNull(), 1)).alias("n")).filter("n > 0").orderBy("n", "k").collect()
    )
    means = F.array(*[F.lit(m) for m in _column_means(rows, array)])
    current = cut_lineage(
        rows.select("*", F.transform(array, lambda v: v.isNull()).alias("_gap")).withColumn(
            array, F.transform(array, lambda v, i: F.coalesce(v, F.element_at(means, i + 1)))
        )
    )
    last_change = None
    for _ in range(max_iter):
        step = current
        for g in gaps:
            c = g["k"]
            others = [i for i in range(width) if i != c]
            if not others:
                continue
            vec = step.withColumn("_v", array_to_vector(array))
            cut = VectorSlicer(inputCol="_v", outputCol="_f", indices=others).transform(vec).withColumn("_y", F.col(array)[c])
            model = RandomForestRegressor(featuresCol="_f", labelCol="_y", predictionCol="_p", numTrees=trees, seed=seed).fit(
                cut.filter(~F.col("_gap")[c])
            )
            step = model.transform(cut).withColumn(
                array, F.transform(array, lambda v, i: F.when((i == c) & F.col("_gap")[c], F.col("_p")).otherwise(v))
            ).drop("_v", "_f", "_y", "_p")
            step = cut_lineage(step)
        change = _relative_change(current, step, key, array)
        if last_change is not None and change >= last_change:
            break
        current, last_change = step, change
        if change == 0.0:
            break
    return current.drop("_gap")


def _relative_change(old: DataFrame, new: DataFrame, key: str, array: str) -> float:
    joined = old.select(key, F.col(array).alias("_o"), "_gap").join(new.select(key, F.col(array).alias("_n")), key)
    cells = joined.select(F.explode(F.arrays_zip("_o", "_n", "_gap")).alias("z")).filter("z._gap")
    row = cells.agg(
        F.sum((F.col("z._n") - F.col("z._o")) ** 2).alias("d"), F.sum(F.col("z._n") ** 2).alias("s")
    ).first()
    return 0.0 if not row["s"] else float(row["d"] / row["s"])


def impute_low_rank(
    rows: DataFrame, rank: int = 5, lam: float = 1.0, thresh: float = 1e-5, maxit: int = 100, key: str = "file", array: str = "x",
) -> DataFrame:
    """Fill cells from a soft-thresholded singular value decomposition, refitted until the fit settles; raises if it does not in `maxit` rounds.

    Each round decomposes the filled matrix, shrinks the singular values by lambda and refills the gaps from the
    reconstruction; measured cells never change. Rounds are checkpointed. Only `rank` and a few more vectors meet the rows (`project.leading_components`).
    """
    means = F.array(*[F.lit(m) for m in _column_means(rows, array)])
    current = cut_lineage(
        rows.select("*", F.transform(array, lambda v: v.isNull()).alias("_gap")).withColumn(
            array, F.transform(array, lambda v, i: F.coalesce(v, F.element_at(means, i + 1)))
        )
    )
    count = current.count()
    for _ in range(maxit):
        found = leading_components(current, rank, center=False, array=array, tol=1e-7)
        v, s = found.basis, np.sqrt(found.variances * max(count - 1, 1))
        shrink = np.maximum(s - lam, 0.0) / np.where(s > 0, s, 1.0)
        # reconstruction of a row: x V diag(shrink) V'
        basis, weights = v, shrink

        def refill(batches, basis=basis, weights=weights):
            for batch in batches:
                x = _stack(batch[array])
                gap = np.stack([np.asarray(g, bool) for g in batch["_gap"]])
                fit = (x @ basis * weights) @ basis.T
                batch = batch.copy()
                batch[array] = list(np.where(gap, fit, x))
                yield batch

        step = cut_lineage(current.mapInPandas(refill, current.schema))
        change = _relative_change(current, step, key, array)
        current = step
        if change < thresh:
            return current.drop("_gap")
    raise RuntimeError(f"the fit did not settle in {maxit} rounds")
