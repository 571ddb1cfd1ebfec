"""Alignment equals the rule taken literally, on random, chained and repeated peaks."""

import numpy as np
import pytest

from peakweave.operators.align import align_features, alignment_sweep, brute_force_alignment, first_anchor, first_reaching


def peaks(seed):
    rng = np.random.default_rng(seed)
    kind = seed % 4
    n = int(rng.integers(5, 150))
    if kind == 0:
        rt, mz = rng.random(n) * 3, rng.random(n) * 2
    elif kind == 1:  # a chain far longer than the tolerance
        rt, mz = np.arange(n) * 0.04, 100 + np.arange(n) * 0.02
    elif kind == 2:  # few positions, often repeated, at exact tolerances
        rt, mz = rng.integers(0, 8, n) * 0.1, rng.integers(0, 8, n) * 0.05
    else:
        rt, mz = np.full(n, 2.5), np.full(n, 77.0)
    order = np.lexsort((mz, rt))
    return rt[order], mz[order]


def ids(spark, rt, mz, parts=4, **kw):
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rt, mz))], "id int, rt double, mz double")
    got = align_features(df.repartition(parts), **kw).collect()
    return [r["feature"] for r in sorted(got, key=lambda r: r["id"])]


@pytest.mark.parametrize("seed", range(8))
def test_equals_literal_rule(spark, seed):
    rt, mz = peaks(seed)
    want = [f"Compound_{k}.ATDGCMS" for k in brute_force_alignment(zip(rt, mz), 0.1, 0.05)]
    assert ids(spark, rt, mz, rt_tol=0.1, mz_tol=0.05) == want


@pytest.mark.parametrize("parts", [1, 64])
def test_partitioning_does_not_matter(spark, parts):
    rt, mz = peaks(0)
    assert ids(spark, rt, mz, parts, rt_tol=0.1, mz_tol=0.05) == ids(spark, rt, mz, 7, rt_tol=0.1, mz_tol=0.05)


@pytest.mark.parametrize("seed", [0, 1, 2, 4, 6])
def test_crowded_tiles_are_cut_into_cells(spark, seed):
    rt, mz = peaks(seed)
    want = [f"Compound_{k}.ATDGCMS" for k in brute_force_alignment(zip(rt, mz), 0.1, 0.05)]
    assert ids(spark, rt, mz, rt_tol=0.1, mz_tol=0.05, tile_rows=3) == want


def test_split_runs_and_nulls(spark):
    rt, mz = peaks(4)
    late = rt > 1.0
    want = [""] * len(rt)
    for part, tol in ((~late, 0.4), (late, 0.28)):
        found = brute_force_alignment(zip(rt[part], mz[part]), tol, 0.0005)
        for k, i in zip(np.flatnonzero(part), found):
            want[k] = f"Compound_RT{2 if late[k] else 1}_{i}.HPLCTOFMS"
    assert ids(spark, rt, mz, rt_tol=0.4, mz_tol=0.0005, split_time=1.0, rt_tol_late=0.28, run_type="HPLCTOFMS") == want
    df = spark.createDataFrame([(None, 5.0), (1.0, 5.0), (1.0, None)], "rt double, mz double")
    got = {(r["rt"], r["mz"]): r["feature"] for r in align_features(df, 0.1, 0.1).collect()}
    assert got == {(None, 5.0): None, (1.0, 5.0): "Compound_1.ATDGCMS", (1.0, None): None}


def test_bad_arguments(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "rt double, mz double")
    with pytest.raises(ValueError):
        align_features(df, 0.1, 0.1, run_type="OTHER")
    with pytest.raises(ValueError):
        align_features(df, 0.1, 0.1, run_type="HPLCTOFMS")


def test_internal_standards_collapse(spark):
    masses = (156.0957, 198.1723, 246.2568, 305.1956, 342.1722)
    rng = np.random.default_rng(0)
    data = [(float(3 + m / 100 + rng.uniform(-0.05, 0.05)), m + float(rng.uniform(-1e-4, 1e-4))) for m in masses for _ in range(30)]
    df = spark.createDataFrame(data, "rt double, mz double")
    got = alignment_sweep(df, [(0.4, 0.28)], 0.0005, masses, 0.0005, 6.0, "HPLCTOFMS").filter("scope <> 'all'").collect()
    assert len(got) >= 5 and all(r["n_features"] == 1 for r in got)


def test_first_reaching_equals_a_scan():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 8, 37, 200):
        values, start = rng.integers(0, 30, n).astype(float), rng.integers(0, n + 1, 300)
        at_least = rng.integers(0, 33, 300).astype(float)
        want = [next((i for i in range(s, n) if values[i] >= x), n) for s, x in zip(start, at_least)]
        assert first_reaching(values, at_least, start).tolist() == want


def test_a_cell_of_200_000_positions():
    """Anchors of the lower strip mostly too far away in m/z, so a walk from anchor to anchor would take billions of steps."""
    rng = np.random.default_rng(6)
    n, tol = 200_000, 1.0
    rt = rng.random(n)
    mz = np.where(rng.random(n) < 0.5, rng.random(n) * 0.01, 1.5 + rng.random(n) * 0.3)
    order = np.lexsort((mz, rt))
    rt, mz = rt[order], mz[order]
    best = first_anchor(rt, mz, np.ones(n, bool), np.full(n, 0.5), tol, np.zeros(n, np.int64), np.zeros(n, np.int64))
    for i in rng.integers(0, n, 300):
        box = (rt >= rt[i] - 0.5) & (rt[i] + 0.5 >= rt) & (np.abs(mz - mz[i]) <= tol)
        held = np.flatnonzero((rt[i] <= rt + 0.5) & box)
        assert best[i] == held[0]


def test_sweep_equals_one_alignment_after_another(spark):
    rt, mz = (np.concatenate(x) for x in zip(peaks(0), peaks(2)))
    df = spark.createDataFrame(list(zip(rt.tolist(), mz.tolist())), "rt double, mz double")
    settings = [(0.1, 0.05), (0.3, 0.2), (0.05, 0.4)]
    got = {(r["rt_tol"], r["rt_tol_late"], r["scope"], r["part"]): r["n_features"] for r in alignment_sweep(df, settings, 0.05, [0.2], 0.1, 0.5, "HPLCTOFMS").collect()}
    for early, late in settings:
        rows = align_features(df, early, 0.05, 0.5, late, "HPLCTOFMS").collect()
        for scope, lo, hi in (("all", -1e9, 1e9), ("0.2", 0.2 - 0.1, 0.2 + 0.1)):
            for part in ("early", "late"):
                names = {r["feature"] for r in rows if lo <= r["mz"] <= hi and (r["rt"] > 0.5) == (part == "late")}
                assert got.get((early, late, scope, part), 0) == len(names)
