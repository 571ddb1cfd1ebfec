"""Medoids without a table of pairs: sums of distances are bounded by those of rows already measured, which rules most rows out unseen."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.operators.distance import BLOCK_ROWS, FEW_BLOCKS, _stack, block_pairs, distances_in_block, metric_function
from peakweave.operators.pivots import METRICS, _stacked
from peakweave.operators.summary import top_k
from peakweave.session import materialize

#: Rows of each cluster that are measured in the first pass; every pass takes twice as many, up to the second figure; rows left are then measured in blocks.
TRIED, MOST_TRIED = 64, 4096
#: Distances that a task holds at once, those of one product of matrices, numbers in the rows of a tile.
HELD, STEP, TILE = 1 << 22, 1 << 17, 1 << 18
SLACK = 1e-9


def _points(df: DataFrame, key: str, array: str) -> tuple[list, np.ndarray]:
    """The few rows of a table."""
    rows = [(r[key], r[array]) for r in df.select(key, array).collect()]
    return [k for k, _ in rows], np.array([x for _, x in rows], float)


def _in_pieces(batch: pa.RecordBatch, points: int):
    """A batch cut such that the distances of its rows to the points are at most HELD."""
    few = max(1, HELD // max(1, points))
    return (batch.slice(at, few) for at in range(0, batch.num_rows, few))


def nearest_points(rows: DataFrame, ids: Sequence, points: np.ndarray, key: str, array: str, metric: str) -> DataFrame:
    """(key, array, _at, _d): the nearest of a few points, of equal ones the smallest id, and its distance; a point belongs to itself."""
    order = np.argsort(np.array(ids, object), kind="stable")
    names, points = [ids[i] for i in order], points[order]

    def go(batches):
        for batch in batches:
            if batch.num_rows:
                d = metric_function(metric)(_stacked(batch.column(array)), points)
                at = d.argmin(axis=1)
                place = {name: i for i, name in enumerate(names)}
                own = np.array([place.get(k, -1) for k in batch.column(key).to_pylist()])
                at = np.where(own >= 0, own, at)
                chosen = pa.array([names[i] for i in at], batch.schema.field(key).type)
                yield pa.RecordBatch.from_arrays([*batch.columns, chosen, pa.array(d[np.arange(len(at)), at])], [*batch.schema.names, "_at", "_d"])

    rows = rows.select(key, array)
    schema = T.StructType([*rows.schema.fields, T.StructField("_at", rows.schema[key].dataType), T.StructField("_d", T.DoubleType())])
    return rows.mapInArrow(go, schema)


def central_rows(rows: DataFrame, key: str, array: str, cluster: str, metric: str) -> tuple[dict, int]:
    """{cluster: id of the row with the least sum of distances in it, ties by id}, and how many rows were measured.

    With S(x) the sum of a measured row x and n the rows of its cluster, S(y) is at least |S(x) - n d(x, y)|. A pass measures the rows of lowest bound of
    each cluster and raises the bounds of the others; a cluster is done when no bound left is as low as its best sum. Rows that passes of up to MOST_TRIED
    have not ruled out are measured block by block, as vectors without structure are. Distances are those of `distances_in_block`, which are off by far less
    than SLACK; rows whose sums are that close to the least are added up again, literally.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(cluster).agg(F.count(F.lit(1))).collect()}  # one row a cluster
    state = materialize(rows.select(key, array, cluster, F.lit(0.0).alias("_low")), "medoids-bounds")
    # by cluster: the least sum so far, and of each different row of about that sum the least id
    least: dict = {}
    near: dict = {}
    measured, many = 0, TRIED
    kind = lambda c: state.schema[c].dataType
    sums_schema = T.StructType([T.StructField(cluster, kind(cluster)), T.StructField(key, kind(key)), T.StructField("_s", T.DoubleType())])

    def keep(found) -> None:
        """Rows (cluster, id, numbers, sum) that may be the best. Sums that are no numbers count as infinite, and as those of one row."""
        found = [(c, k, x, np.inf if np.isnan(total) else total) for c, k, x, total in found]
        for c, _, _, total in found:
            least[c] = min(total, least.get(c, total))
        for c, k, x, total in found:
            same = np.asarray(x, float).tobytes() if np.isfinite(total) else b""
            if total <= least[c] * (1 + SLACK):
                old = near.setdefault(c, {}).get(same)
                near[c][same] = (total, k if old is None else min(old[1], k))
        for c in near:
            near[c] = {x: v for x, v in near[c].items() if v[0] <= least[c] * (1 + SLACK)}

    def sums_of(points: dict, distances) -> dict:
        """{(cluster, id): sum of the distances of all rows of the cluster to a point of it}."""

        def add(batches):
            most = max(len(ks) for ks, _ in points.values())
            for batch in (piece for whole in batches for piece in _in_pieces(whole, most)):
                mine = np.array(batch.column(cluster).to_pylist(), object)
                x = _stacked(batch.column(array))
                for c, (ks, p) in points.items():
                    here = mine == c
                    if here.any():
                        sums = distances(x[here], p).sum(axis=0)
                        yield pa.RecordBatch.from_arrays([pa.array([c] * len(ks), batch.schema.field(cluster).type), pa.array(ks, batch.schema.field(key).type), pa.array(sums)], [cluster, key, "_s"])

        sums = state.select(key, array, cluster).mapInArrow(add, sums_schema).groupBy(cluster, key).agg(F.sum("_s")).collect()
        return {(c, k): s for c, k, s in sums}

    def best(others: Sequence = ()) -> dict:
        """Of each cluster; `others` have literal sums, by which the rows in `near` are then compared with them."""
        several = {c: ([k for _, k in rows.values()], np.array([np.frombuffer(x) for x in rows])) for c, rows in near.items() if len(rows) + len(others) > 1}
        exact = sums_of(several, metric_function(metric)) if several else {}
        first = {c: min((exact.get((c, k), 0.0), k) for _, k in rows.values()) for c, rows in near.items()}
        for c, k, total in others:
            first[c] = min((total, k), first.get(c, (np.inf, k)))
        return {c: k for c, (_, k) in first.items()}

    while True:
        limits = [(c, float(least[c] * (1 + SLACK))) for c in least] or [(c, float("inf")) for c in counts]
        known = state.sparkSession.createDataFrame(limits, T.StructType([T.StructField(cluster, kind(cluster)), T.StructField("_limit", T.DoubleType())]))
        bounded = state.join(F.broadcast(known), cluster)  # one row a cluster
        if many > MOST_TRIED:
            marked = bounded.select(key, array, cluster, (F.col("_low") <= F.col("_limit")).alias("_open"))
            left = marked.filter("_open").count()
            if not left:
                return best(), measured
            sums = _sums_by_blocks(marked, key, array, cluster, lambda x, y: distances_in_block(x, y, metric), sums_schema)
            lows = sums.groupBy(cluster).agg(F.min("_s").alias("_least"))
            close = sums.join(F.broadcast(lows), cluster).filter(F.col("_s") <= F.col("_least") * (1 + SLACK)).select(cluster, key, "_s")  # one row a cluster
            same = state.select(key, array, cluster).join(close, [cluster, key]).groupBy(cluster, array).agg(F.min(key).alias(key), F.min("_s").alias("_s"))
            same = materialize(same, "medoids-least")
            if same.count() <= MOST_TRIED:
                keep(same.select(cluster, key, array, "_s").toLocalIterator())
                return best(), measured + left
            # very many different rows of the same sum
            marked = state.select(key, array, cluster).join(same.select(cluster, key, F.lit(True).alias("_open")), [cluster, key], "left")
            sums = _sums_by_blocks(marked.withColumn("_open", F.coalesce("_open", F.lit(False))), key, array, cluster, metric_function(metric), sums_schema)
            return best(sums.groupBy(cluster).agg(F.min_by(key, F.struct("_s", key)), F.min("_s")).collect()), measured + left  # one row a cluster
        tried = top_k(bounded.filter("_low <= _limit"), [cluster], [F.asc("_low"), F.xxhash64(key), F.asc(key)], many).select(cluster, key, array).collect()
        if not tried:
            return best(), measured
        measured += len(tried)
        many *= 2
        by: dict = {}
        for c, k, x in tried:
            by.setdefault(c, ([], []))
            by[c][0].append(k)
            by[c][1].append(x)
        points = {c: (ks, np.array(xs, float)) for c, (ks, xs) in by.items()}
        total = sums_of(points, lambda x, p: distances_in_block(x, p, metric))
        keep((c, k, x, total[c, k]) for c, k, x in tried)
        sizes = {c: np.array([total[c, k] for k in ks]) for c, (ks, _) in points.items()}

        def raise_bounds(batches, points=points, sizes=sizes):
            most = max(len(ks) for ks, _ in points.values())
            for batch in (piece for whole in batches for piece in _in_pieces(whole, most)):
                mine, ids, x = np.array(batch.column(cluster).to_pylist(), object), batch.column(key).to_pylist(), _stacked(batch.column(array))
                low = batch.column("_low").to_numpy().copy()
                for c, (ks, p) in points.items():
                    here = np.flatnonzero(mine == c)
                    if len(here):
                        d = distances_in_block(x[here], p, metric)
                        bound = np.abs(sizes[c] - counts[c] * d) - SLACK * (sizes[c] + counts[c] * d)
                        low[here] = np.maximum(low[here], bound.max(axis=1))
                        done = set(ks)
                        low[[i for i in here if ids[i] in done]] = np.inf
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, array, cluster)), pa.array(low)], [key, array, cluster, "_low"])

        state = materialize(state.mapInArrow(raise_bounds, state.schema), "medoids-bounds")


def _sums_by_blocks(marked: DataFrame, key: str, array: str, cluster: str, distances, schema: T.StructType) -> DataFrame:
    """(cluster, key, sum of the distances to all rows of the cluster) of the rows marked `_open`."""

    def in_steps(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums of the distances by row of x and by row of y, of which STEP are held at once."""
        rows, columns = np.empty(len(x)), np.zeros(len(y))
        few = max(1, STEP // len(y))
        for i in range(0, len(x), few):
            d = distances(x[i : i + few], y)
            rows[i : i + few] = d.sum(axis=1)
            columns += d.sum(axis=0)
        return rows, columns

    def compare(left: pd.DataFrame, right: pd.DataFrame, same: bool) -> pd.DataFrame:
        found = [(left[cluster].to_numpy()[:0], left[key].to_numpy()[:0], np.empty(0))]

        def add(rows: pd.DataFrame, total: np.ndarray) -> None:
            found.append((rows[cluster].to_numpy(), rows[key].to_numpy(), total))

        ours, theirs = (t.groupby(cluster).indices for t in (left, right))
        for c in ours.keys() & theirs.keys():
            a, b = left.iloc[ours[c]], right.iloc[theirs[c]]
            p, q = a["_open"].to_numpy(bool), b["_open"].to_numpy(bool) & (not same)
            if not (p.any() or q.any()):
                continue
            xa, xb = _stack(a[array]), _stack(b[array])
            if p.mean() + q.mean() > 1:
                rows, columns = in_steps(xa, xb)
                add(a[p], rows[p])
                add(b[q], columns[q])
                continue
            if p.any():
                add(a[p], in_steps(xa[p], xb)[0])
            if q.any():
                add(b[q], in_steps(xb[q], xa)[0])
        return pd.DataFrame(dict(zip((cluster, key, "_s"), (np.concatenate(z) for z in zip(*found, strict=True)), strict=True)))

    def added_up(parts: pd.DataFrame) -> pd.DataFrame:
        return parts.groupby([cluster, key], sort=False, as_index=False)["_s"].sum()

    # large tiles, as a cluster may have few rows of one, but of bounded numbers
    width = marked.select(F.size(array)).first()[0]
    sums = block_pairs(marked, key, compare, schema, max(BLOCK_ROWS, min(4 * BLOCK_ROWS, TILE // max(1, width))), added_up, FEW_BLOCKS)
    return materialize(sums.groupBy(cluster, key).agg(F.sum("_s").alias("_s")), "medoids-sums")


def k_medoids_of(rows: DataFrame, k: int, key: str = "file", array: str = "x", metric: str = "euclidean") -> DataFrame:
    """(key, medoid): alternate assignment and medoid update until the medoids stay, on rows (key, array) with distinct ids.

    Starts from the most central row and then the rows farthest from those chosen, as `cluster.k_medoids` does on a distance table. Rows are compared with
    the k medoids and with the candidates of `central_rows` only; nothing of the size of all pairs is made. The sum of distances to the own medoid falls in
    every round, so it ends.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    rows = materialize(rows.select(key, array), "medoids-rows")
    found, _ = central_rows(rows.withColumn("_all", F.lit(0)), key, array, "_all", metric)
    medoids = list(found.values())
    while medoids:
        ids, points = _points(rows.filter(F.col(key).isin(medoids)), key, array)
        near = nearest_points(rows, ids, points, key, array, metric)
        if len(medoids) < k:
            far = near.filter(~F.col(key).isin(medoids)).orderBy(F.desc("_d"), key).select(key).first()
            if far is not None:
                medoids.append(far[0])
                continue
            k = len(medoids)
        assigned = materialize(near.select(key, array, F.col("_at").alias("medoid")), "medoids-assigned")
        moved, _ = central_rows(assigned, key, array, "medoid", metric)
        if set(moved.values()) == set(medoids):
            return assigned.select(key, "medoid")
        medoids = [moved[m] for m in medoids]
    return rows.select(key, F.col(key).alias("medoid"))
