"""Aligning peaks into features by retention time and m/z.

The rule: peaks are taken in order as anchors, and each anchor claims the peaks in its box that no earlier
anchor claimed. Every peak acts as an anchor, claimed or not, so nothing has to be decided one after the other:
a peak belongs to the first peak in the order whose box holds it. That turns the greedy
pass into a search for a smallest neighbour, which splits freely over tasks.

Peaks at one position share box and answer, so the search runs on distinct positions; a position repeated in
millions of files costs one row. Positions are cut into tiles with a margin of one tolerance, and each tile
is searched on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.operators.ordering import log_bucket, row_positions
from peakweave.session import materialize

# tile size in tolerances: wide along retention time, where the search is by bisection
_TILE_RT = 64
_TILE_MZ = 8
# cells are a little wider than the tolerance, so rounding cannot move a neighbour two cells away
_SLACK = 1 + 1e-6

# what names a tile: its place, and its cell when it is cut
_TILE = ("part", "tc", "ts", "cc", "cs")

_ANCHOR_SCHEMA = "setting int, part int, rt double, mz double, a_rt double, a_mz double"


def _count_before(a_code: np.ndarray, a_key: np.ndarray, q_code: np.ndarray, q_key: np.ndarray) -> np.ndarray:
    """For each query, how many anchors have a smaller (code, key)."""
    n, q = len(a_code), len(q_code)
    code = np.concatenate([a_code, q_code])
    key = np.concatenate([a_key, q_key])
    is_anchor = np.concatenate([np.ones(n, np.int8), np.zeros(q, np.int8)])
    order = np.lexsort((is_anchor, key, code))
    seen = np.cumsum(is_anchor[order])
    out = np.empty(q, np.int64)
    at = order[is_anchor[order] == 0] - n
    out[at] = seen[is_anchor[order] == 0]
    return out


def first_reaching(values: np.ndarray, at_least: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each query, the first position from `start` on whose value is `at_least` or more; the number of values if there is none.

    A tree of maxima is climbed and descended, so a query takes steps in the logarithm of the values, however many fall short.
    """
    depth = max(1, len(values) - 1).bit_length()
    level = np.full(1 << depth, -np.inf)
    level[: len(values)] = values
    tree = [level]
    for _ in range(depth):
        tree.append(np.maximum(tree[-1][0::2], tree[-1][1::2]))
    at = start.astype(np.int64).copy()
    height = np.full(len(at), -1)
    open_ = np.flatnonzero(at < len(level))
    for k in range(depth + 1):
        # a node that begins its parent is left to the parent, but for the root
        asked = open_ if k == depth else open_[at[open_] % 2 == 1]
        hit = tree[k][at[asked]] >= at_least[asked]
        height[asked[hit]] = k
        at[asked[~hit]] += 1
        open_ = open_[height[open_] < 0]
        if k < depth:
            at[open_] //= 2
            open_ = open_[at[open_] < len(tree[k + 1])]
    for k in range(depth, 0, -1):
        down = np.flatnonzero(height == k)
        left = 2 * at[down]
        at[down] = np.where(tree[k - 1][left] >= at_least[down], left, left + 1)
        height[down] = k - 1
    return np.where(height == 0, at, len(values))


def first_anchor(
    rt: np.ndarray, mz: np.ndarray, own: np.ndarray, rt_tol: np.ndarray, mz_tol: float, tile: np.ndarray, base: np.ndarray
) -> np.ndarray:
    """For each own position, the index of the first position of its tile, in (rt, mz) order, whose box holds it.

    Positions come sorted by (tile, rt, mz); `base` is the first m/z strip of the tile. Many tiles are
    searched at once, strip by strip: a search starts at the first anchor late enough and finds the first whose m/z fits.
    The own strip goes first, because its anchors nearly always fit; in a neighbouring strip only one side of the m/z can fail.
    """
    strip = np.floor(mz / (mz_tol * _SLACK)).astype(np.int64)
    width = _TILE_MZ + 4
    code = tile * width + (strip - base) + 2
    order = np.argsort(code, kind="stable")
    a_code, a_key, a_mz = code[order], (rt + rt_tol)[order], mz[order]
    q = np.flatnonzero(own)
    best = q.copy()
    where = np.full(len(rt), -1, np.int64)
    where[q] = np.arange(len(q))
    for shift in (0, -1, 1):
        wanted = code[q] + shift
        at = _count_before(a_code, a_key, wanted, rt[q])
        stop = np.searchsorted(a_code, wanted, side="right")
        todo = np.flatnonzero(at < stop)
        # an anchor later than the best one known cannot win
        todo = todo[order[at[todo]] < best[todo]]
        if shift:
            reach, needed = (a_mz + mz_tol, mz[q[todo]]) if shift < 0 else (mz_tol - a_mz, -mz[q[todo]])
            found = first_reaching(reach, needed, at[todo])
            todo, found = todo[found < stop[todo]], found[found < stop[todo]]
            best[todo] = np.minimum(best[todo], order[found])
            continue
        at = at[todo]
        while len(todo):
            m, x = a_mz[at], mz[q[todo]]
            fits = (x <= m + mz_tol) & (x >= m - mz_tol)
            best[todo[fits]] = order[at[fits]]
            todo, at = todo[~fits], at[~fits] + 1
            live = at < stop[todo]
            live[live] = order[at[live]] < best[todo[live]]
            todo, at = todo[live], at[live]
    return best


def _search_tiles(settings: Sequence[Sequence[float]], mz_tol: float, enough: int = 200_000):
    """Search sorted tiles batch by batch, once for each setting: small tiles together, a tile always whole."""
    tols = np.asarray(settings, float)

    def run(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        part, rt, mz, ts, own = (rows[c].to_numpy() for c in ("part", "rt", "mz", "ts", "own"))
        new = np.zeros(len(rows), bool)
        new[0] = True
        for c in _TILE:
            v = rows[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        for setting, tol in enumerate(tols):
            best = first_anchor(rt, mz, own, tol[part], mz_tol, np.cumsum(new) - 1, ts * _TILE_MZ)
            yield pd.DataFrame(
                {"setting": setting, "part": part[own], "rt": rt[own], "mz": mz[own], "a_rt": rt[best], "a_mz": mz[best]}
            )

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        size, limit = 0, enough
        for batch in batches:
            held.append(batch)
            size += len(batch)
            if size < limit:
                continue
            rows = pd.concat(held, ignore_index=True)
            end = rows.iloc[-1]
            last = np.logical_and.reduce([rows[c].to_numpy() == end[c] for c in _TILE])
            ready, rest = rows[~last], rows[last]
            if len(ready):
                yield from run(ready)
            held, size = [rest], len(rest)
            limit = max(enough, 2 * size)
        if size:
            yield from run(pd.concat(held, ignore_index=True))

    return search


def assign_anchors(points: DataFrame, settings: Sequence[Sequence[float]], mz_tol: float, tile_rows: int = 1_000_000) -> DataFrame:
    """Distinct (part, rt, mz) with the position of the anchor that claims them, for each setting: a tolerance for every part.

    Tiles are laid out for the largest tolerances and sorted once; all settings are searched in them. A tile holds its own positions and a margin: earlier retention times and both m/z neighbours. A tile with more
    than `tile_rows` positions is cut into single cells, each with the margin of a cell. A cell is one tolerance wide
    both ways, so its distinct positions are limited by the digits an instrument reports, not by the number of files.
    """
    largest = [max(tols) for tols in zip(*settings, strict=True)]
    rt_tol = F.element_at(F.array(*[F.lit(float(t)) for t in largest]), F.col("part") + 1)
    tile_c, tile_s = F.floor(F.col("c") / _TILE_RT), F.floor(F.col("s") / _TILE_MZ)
    placed = points.withColumn("c", F.floor(F.col("rt") / (rt_tol * _SLACK))).withColumn(
        "s", F.floor(F.col("mz") / (mz_tol * _SLACK))
    )
    crowded = (
        placed.groupBy("part", tile_c.alias("tc"), tile_s.alias("ts"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > tile_rows)
        .select("part", "tc", "ts", F.lit(True).alias("crowded"))
    )
    # the cells that need a position: its own, the next one in time, and the m/z neighbours of both
    cells = F.array(
        *[F.struct((F.col("c") + dc).alias("cc"), (F.col("s") + ds).alias("cs")) for dc in (0, 1) for ds in (-1, 0, 1)]
    )
    tiles = F.array_distinct(
        F.transform(cells, lambda x: F.struct(F.floor(x["cc"] / _TILE_RT).alias("tc"), F.floor(x["cs"] / _TILE_MZ).alias("ts")))
    )
    in_tiles = placed.withColumn("_t", F.explode(tiles)).select("part", "rt", "mz", "c", "s", "_t.tc", "_t.ts")
    inside = F.filter(
        cells, lambda x: (F.floor(x["cc"] / _TILE_RT) == F.col("tc")) & (F.floor(x["cs"] / _TILE_MZ) == F.col("ts"))
    )
    whole = F.array(F.struct(F.lit(None).cast("long").alias("cc"), F.lit(None).cast("long").alias("cs")))
    cut = in_tiles.join(crowded, ["part", "tc", "ts"], "left").withColumn(
        "_x", F.explode(F.when(F.col("crowded"), inside).otherwise(whole))
    )
    own_cell = F.col("_x.cc").isNull() | ((F.col("_x.cc") == F.col("c")) & (F.col("_x.cs") == F.col("s")))
    searched = cut.select(
        "part", "tc", "ts",
        F.coalesce("_x.cc", F.lit(-1)).alias("cc"), F.coalesce("_x.cs", F.lit(-1)).alias("cs"),
        "rt", "mz", ((F.col("tc") == tile_c) & (F.col("ts") == tile_s) & own_cell).alias("own"),
    )
    # an explicit number of partitions: the search costs far more than the bytes suggest
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = searched.repartition(parts, *_TILE).sortWithinPartitions(*_TILE, "rt", "mz")
    return spread.mapInPandas(_search_tiles([list(s) for s in settings], mz_tol), _ANCHOR_SCHEMA)


def _parts(run_type: str, rt: str, split_time: float | None, late: bool) -> Column:
    """The part of a run that a peak is in; the parts are aligned apart."""
    if run_type not in ("ATDGCMS", "HPLCTOFMS"):
        raise ValueError("run_type must be ATDGCMS or HPLCTOFMS")
    if run_type == "HPLCTOFMS" and (split_time is None or not late):
        raise ValueError("HPLCTOFMS needs split_time and rt_tol_late")
    return F.when(F.col(rt) > F.lit(split_time), 1).otherwise(0) if run_type == "HPLCTOFMS" else F.lit(0)


def _positions(peaks: DataFrame, part: Column, rt: str, mz: str) -> DataFrame:
    """Distinct (part, rt, mz) of the peaks that have a position."""
    placed = peaks.filter(F.col(rt).isNotNull() & F.col(mz).isNotNull())
    return placed.select(part.alias("part"), F.col(rt).cast("double").alias("rt"), F.col(mz).cast("double").alias("mz")).distinct()


def align_features(
    df: DataFrame,
    rt_tol: float,
    mz_tol: float,
    split_time: float | None = None,
    rt_tol_late: float | None = None,
    run_type: str = "ATDGCMS",
    rt: str = "rt",
    mz: str = "mz",
    out: str = "feature",
    tile_rows: int = 1_000_000,
) -> DataFrame:
    """Add the feature each peak belongs to; peaks without a position get none.

    With `split_time` early and late peaks are aligned apart, each with its own tolerance. Ids count the
    anchors in (rt, mz) order: `Compound_{n}.{type}`, or `Compound_RT1_{n}.{type}` and `Compound_RT2_{n}.{type}`.
    """
    split = run_type == "HPLCTOFMS"
    peaks = df.withColumn("_part", _parts(run_type, rt, split_time, rt_tol_late is not None))
    points = _positions(peaks, F.col("_part"), rt, mz)
    rt_tols = [rt_tol, rt_tol_late] if split else [rt_tol]
    # read again to number the anchors, so the search must not run twice
    claimed = materialize(assign_anchors(points, [rt_tols], mz_tol, tile_rows), "anchors")
    anchors = claimed.select("part", "a_rt", "a_mz").distinct()
    numbered = row_positions(anchors, ["part"], ["a_rt", "a_mz"], log_bucket(F.col("a_rt"), 4096), "nr")
    middle = F.concat(F.lit("RT"), F.col("part") + 1, F.lit("_")) if split else F.lit("")
    named = claimed.join(numbered, ["part", "a_rt", "a_mz"]).select(
        F.col("part").alias("_part"),
        F.col("rt").alias("_rt"),
        F.col("mz").alias("_mz"),
        F.concat(F.lit("Compound_"), middle, F.col("nr"), F.lit(f".{run_type}")).alias(out),
    )
    on = (peaks["_part"] == named["_part"]) & (peaks[rt] == named["_rt"]) & (peaks[mz] == named["_mz"])
    return peaks.join(named, on, "left").select(*[peaks[c] for c in df.columns], named[out])


def alignment_sweep(
    df: DataFrame,
    settings: Sequence[tuple[float, float | None]],
    mz_tol: float,
    benchmarks: Sequence[float],
    window: float = 0.0001,
    split_time: float | None = None,
    run_type: str = "ATDGCMS",
    rt: str = "rt",
    mz: str = "mz",
) -> DataFrame:
    """Per tolerance setting, the number of features overall and inside each benchmark's m/z window.

    A good tolerance leaves one feature per benchmark. `scope` is `all` or the benchmark mass, `part` is `early` or, after
    `split_time`, `late`. Positions are read and laid out once for all settings; features are counted by their anchors, without numbering them.
    """
    split = run_type == "HPLCTOFMS"
    part = _parts(run_type, rt, split_time, all(late is not None for _, late in settings))
    points = materialize(_positions(df, part, rt, mz), "positions")
    tols = [(early, late) if split else (early,) for early, late in settings]
    claimed = assign_anchors(points, tols, mz_tol)
    names = [F.struct(F.lit("all").alias("scope"))]
    for b in benchmarks:
        names.append(F.when(F.col("mz").between(b - window, b + window), F.struct(F.lit(str(b)).alias("scope"))))
    scope = F.explode(F.filter(F.array(*names), lambda s: s.isNotNull()))
    stage = F.when(F.col("rt") > F.lit(split_time), "late").otherwise("early") if split_time is not None else F.lit("early")
    anchor = F.struct("part", "a_rt", "a_mz").alias("anchor")
    counted = (
        claimed.select("setting", scope.alias("named"), stage.alias("stage"), anchor)
        .groupBy("setting", F.col("named.scope").alias("scope"), F.col("stage").alias("part"))
        .agg(F.countDistinct("anchor").alias("n_features"))
    )
    of_setting = lambda values: F.element_at(F.array(*[F.lit(v).cast("double") for v in values]), F.col("setting") + 1)
    early, late = zip(*settings, strict=True)
    return counted.select(of_setting(early).alias("rt_tol"), of_setting(late).alias("rt_tol_late"), "scope", "part", "n_features")


def brute_force_alignment(rows: Iterator[tuple], rt_tol: float, mz_tol: float) -> list[int]:
    """The rule taken literally, for tests on a few hundred peaks: ids from 1 for rows in (rt, mz) order."""
    peaks = list(rows)
    ids = [0] * len(peaks)
    count = 0
    for rt_a, mz_a in peaks:
        claimed = [
            k for k, (r, m) in enumerate(peaks)
            if ids[k] == 0 and rt_a - rt_tol <= r <= rt_a + rt_tol and mz_a - mz_tol <= m <= mz_a + mz_tol
        ]
        if claimed:
            count += 1
            for k in claimed:
                ids[k] = count
    return ids
