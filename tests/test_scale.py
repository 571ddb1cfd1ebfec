"""Steps whose memory, shuffled bytes or passes must not grow faster than the tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.operators import cluster, distance, impute_models, match, medoids, padjust, pivots
from peakweave.queries import registry


@pytest.fixture(scope="module")
def peak_tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("peaks"))
    tables = {
        "lineitem": spark.createDataFrame(
            [(o, 1, o % 7, o % 3 if o % 11 else None, 10.0 + o % 5, 1.0, 0.01) for o in range(60)],
            "l_orderkey long, l_linenumber int, l_partkey int, l_suppkey int, l_extendedprice double, l_quantity double, l_discount double",
        ),
        "supplier": spark.createDataFrame([(s, s % 2) for s in range(3)], "s_suppkey int, s_nationkey int"),
        "nation": spark.createDataFrame([(0, "A", 0), (1, "B", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "region": spark.createDataFrame([(0, "R")], "r_regionkey int, r_name string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return folder


@pytest.mark.parametrize(("read", "cell"), [(registry.cells, "file"), (registry.sample_cells, "sample")])
def test_cells_are_gathered_in_tasks_of_bounded_rows(spark, peak_tables, monkeypatch, read, cell):
    monkeypatch.setattr(registry, "GATHERED", 5)
    found = read(spark, peak_tables)
    assert found.rdd.getNumPartitions() == 12
    peaks = registry.peaks(spark, peak_tables).filter(F.col(cell).isNotNull())
    assert found.count() == peaks.select(cell, "feature").distinct().count()
    total = found.agg(F.sum("value")).first()[0]
    assert total == pytest.approx(peaks.groupBy(cell, "feature").agg(F.avg("value").alias("v")).agg(F.sum("v")).first()[0])


def test_values_are_averaged_before_they_meet_their_hits(spark, collect):
    values = spark.createDataFrame([(1, "a", 2.0), (1, "a", 4.0), (1, None, 5.0), (2, "a", 7.0), (3, "b", 9.0)], "feature int, class string, value double")
    hits = spark.createDataFrame([(1, "x"), (1, "x"), (1, "y"), (3, None)], "feature int, name string")
    out = match.annotate_and_average(values, hits, ["name", "class"])
    assert out.columns == ["feature", "name", "class", "mean_value"]
    assert {tuple(r) for r in out.collect()} == {(1, "x", "a", 3.0), (1, "y", "a", 3.0), (1, "x", None, 5.0), (1, "y", None, 5.0), (3, None, "b", 9.0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("avg("), "the means are taken below the join with the hits"


def test_hommel_takes_families_of_any_size(spark):
    many = spark.range(1_200_000).select(F.lit("f").alias("family"), ((F.col("id") % 500 + 1) / 1000.0).alias("p_value"))
    got = padjust.p_adjust(many, ["family"], "p_value", ["hommel"]).select("p_value", "p_hommel").distinct().orderBy("p_value").toPandas()
    p = np.repeat(np.arange(1, 501) / 1000.0, 2400)
    assert np.allclose(got["p_hommel"], padjust.hommel_adjusted(p)[2399::2400], rtol=1e-12)


def test_hommel_in_parts_beside_one_hull(spark, monkeypatch):
    monkeypatch.setattr(padjust, "HOMMEL_PART", 7)
    rng = np.random.default_rng(3)
    p = {"a": np.sort(np.round(rng.random(90) ** 3, 3)), "b": np.sort(rng.random(20)), "c": np.array([0.2])}
    df = spark.createDataFrame([(f, float(v)) for f, vs in p.items() for v in vs], "family string, p_value double")
    got = padjust.p_adjust(df, ["family"], "p_value", ["hommel"]).orderBy("family", "p_value").toPandas()
    for f, vs in p.items():
        n = len(vs)
        # literal form: greatest min(m p, q_m), q_m the combined value of the m largest
        q = [min(m * vs[n - m + k - 1] / k for k in range(1, m + 1)) for m in range(1, n + 1)]
        want = [max(min((m + 1) * v, q[m]) for m in range(n)) for v in vs]
        assert np.allclose(got[got["family"] == f]["p_hommel"], want)
    alone = padjust.p_adjust(df.filter("family = 'b'").drop("family"), [], "p_value", ["hommel"]).orderBy("p_value").toPandas()
    assert np.allclose(alone["p_hommel"], padjust.hommel_adjusted(p["b"]))


def test_hull_of_a_cascade_is_walked_to_its_end():
    x = np.arange(1.0, 400)
    y = np.append((x[:-1] / 400) ** 2, 0.1 * 1.0)
    kept = padjust.lower_hull(x, y)
    slopes = np.diff(y[kept]) / np.diff(x[kept])
    assert (np.diff(slopes) > 0).all() and kept[-1] == len(x) - 1


def _rows(spark, n=90, width=3, seed=2):
    x = np.round(np.random.default_rng(seed).random((n, width)), 1)
    return x, spark.createDataFrame([(i, int(i % 4), [float(v) for v in x[i]]) for i in range(n)], "file int, cluster int, x array<double>")


def test_rows_go_to_a_bounded_number_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(distance, "BLOCKS", 3)
    _, df = _rows(spark)

    def pairs(left, right, same):
        import pandas as pd

        assert len(left) <= 10 and len(right) <= 10
        a, b = left["file"].to_numpy(), right["file"].to_numpy()
        r, c = np.nonzero(np.triu(np.ones((len(a), len(b))), 1) if same else np.ones((len(a), len(b))))
        return pd.DataFrame({"i": np.minimum(a[r], b[c]), "j": np.maximum(a[r], b[c])})

    out = distance.block_pairs(df.select("file"), "file", pairs, "i int, j int", 5)
    sent = [tuple(r) for r in out.collect()]
    assert len(sent) == len(set(sent)) == 90 * 89 // 2
    # every row is sent to as many tasks as there are blocks
    assert out._jdf.queryExecution().toString().count("sequence(0, 2") > 0


def test_tiles_give_the_same_distances_and_silhouettes(spark, monkeypatch):
    _, df = _rows(spark)
    want = {(r.i, r.j): r.value for r in distance.pairwise_distance(df).collect()}
    wide = {r.file: (r.neighbour, r.width) for r in cluster.silhouette_rows(df).collect()}
    original = distance.block_pairs

    def small(rows, key, fn, schema, **kw):
        return original(rows, key, fn, schema, 7, **kw)

    monkeypatch.setattr(distance, "BLOCKS", 2)
    monkeypatch.setattr(distance, "HELD_ROWS", 30)
    monkeypatch.setattr(distance, "block_pairs", small)
    monkeypatch.setattr(cluster, "block_pairs", small)
    assert {(r.i, r.j): r.value for r in distance.pairwise_distance(df).collect()} == want
    got = {r.file: (r.neighbour, r.width) for r in cluster.silhouette_rows(df).collect()}
    assert got.keys() == wide.keys() and all(got[f][0] == wide[f][0] and abs(got[f][1] - wide[f][1]) < 1e-12 for f in wide)


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_neighbours_by_tiles_are_those_of_all_distances(spark, monkeypatch, metric):
    monkeypatch.setattr(distance, "BLOCKS", 4)
    monkeypatch.setattr(distance, "BLOCK_ROWS", 8)
    x, df = _rows(spark)
    got = distance.nearest_neighbours(df, df, 5, metric=metric, carry=("cluster",), block_rows=6).orderBy("file", "rank").collect()
    d = distance.metric_function(metric)(x, x)
    want = [(i, int(j), d[i, j]) for i in range(90) for j in np.argsort(d[i], kind="stable")[:5]]
    assert [(r.file, r.n_id, r.distance) for r in got] == want


def test_near_rows_by_products_keep_ties_and_copies():
    rng = np.random.default_rng(4)
    a = np.concatenate([rng.standard_normal((40, 16)), np.zeros((30, 16)), 1e6 + rng.standard_normal((20, 16)) * 1e-6])
    r, c, d = distance.nearest_in_block(a, a, 9, "euclidean")
    full = distance.metric_function("euclidean")(a, a)
    near = np.argsort(full, axis=1, kind="stable")[:, :9]
    assert (c.reshape(len(a), -1) == near).all() and (d.reshape(len(a), -1) == np.take_along_axis(full, near, 1)).all()


def test_knn_imputation_by_tiles_is_that_of_whole_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = np.round(rng.random((70, 4)), 1)
    gone = rng.random(x.shape) < 0.3
    df = spark.createDataFrame([(i, [None if gone[i, c] else float(x[i, c]) for c in range(4)]) for i in range(70)], "file int, x array<double>")
    want = {r.file: r.x for r in impute_models.impute_knn(df).collect()}
    monkeypatch.setattr(impute_models, "BLOCKS", 4)
    tiled = impute_models.impute_knn(df, block_rows=4)
    assert {r.file: r.x for r in tiled.collect()} == want
    assert "sequence(0, 1" in tiled._jdf.queryExecution().toString(), "rows go to two blocks, not to 18"


def test_donors_are_searched_without_measuring_most_pairs():
    rng = np.random.default_rng(8)
    x = rng.random((6000, 4))
    x[rng.random(x.shape) < 0.1] = np.nan
    x[3000:3200] = x[:200]
    gaps = np.flatnonzero(np.isnan(x).any(axis=1))[:80]
    measured = []

    def same(a, b):
        measured.append(b.size)
        return gaps[a] == b

    row, col, place, d = impute_models.nearest_donors(x[gaps], x, np.ones(4), 5, same, leaf=16)
    want = []
    for r, i in enumerate(gaps):
        part = np.abs(x[i] - x)
        n = (~np.isnan(part)).sum(1)
        full = np.where((n > 0) & (np.arange(len(x)) != i), np.nansum(part, 1) / np.maximum(n, 1), np.nan)
        for c in np.flatnonzero(np.isnan(x[i])):
            order = [j for j in np.argsort(full, kind="stable") if not np.isnan(full[j]) and not np.isnan(x[j, c])]
            want += [(r, c, j, full[j]) for j in order[:5]]
    assert list(zip(row, col, place, d, strict=True)) == want
    assert sum(measured) < 0.1 * len(gaps) * len(x)


def test_donors_of_rows_without_shared_columns_infinite_values_and_categories():
    x = np.array([[np.nan, 1.0, 2.0], [5.0, np.nan, np.nan], [6.0, 1.0, np.inf], [7.0, 3.0, 2.0], [8.0, 1.0, np.inf]])
    ids = np.arange(5)
    row, col, place, _ = impute_models.nearest_donors(x[:1], x, np.ones(3), 2, lambda a, b: a == b, leaf=2)
    with np.errstate(invalid="ignore"):
        want = [j for _, j in sorted((np.inf if j != 3 else 1.0, j) for j in (2, 3, 4))][:2]
    assert list(zip(row, col, place, strict=True)) == [(0, 0, j) for j in want]
    kinds = np.array(["a", "a", "b", None, "a"], object)
    found = impute_models.nearest_donors(x[:1], x, np.ones(3), 5, lambda a, b: ids[a] == ids[b], [(kinds[:1], kinds)], leaf=2)
    # row 1 shares its category only
    assert found[2].tolist()[0] == 1 and found[3].tolist()[0] == 0.0


def test_passes_over_candidate_medoids_grow(spark, monkeypatch):
    x = np.random.default_rng(6).standard_normal((300, 24))
    df = spark.createDataFrame([(i, 0, [float(v) for v in x[i]]) for i in range(300)], "file int, c int, x array<double>")
    passes = []
    top = medoids.top_k
    monkeypatch.setattr(medoids, "TRIED", 2)
    monkeypatch.setattr(medoids, "HELD", 1000)
    monkeypatch.setattr(medoids, "top_k", lambda *a: passes.append(a[-1]) or top(*a))
    best, _ = medoids.central_rows(df, "file", "x", "c", "euclidean")
    d = distance.metric_function("euclidean")(x, x)
    assert best == {0: int(d.sum(1).argmin())}
    assert passes[:4] == [2, 4, 8, 16] and len(passes) < 12


def _joined(ids, pairs):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    return {i: top(i) for i in ids}


def test_a_forest_joins_what_all_pairs_join():
    rng = np.random.default_rng(7)
    for n, m in ((1, 3), (30, 20), (30, 400), (400, 380)):
        i, j = rng.integers(0, n, m) * 7, rng.integers(0, n, m) * 7
        kept = distance.spanning_forest(i, j)
        want = _joined(range(0, 7 * n, 7), zip(i.tolist(), j.tolist(), strict=True))
        assert _joined(range(0, 7 * n, 7), zip(i[kept].tolist(), j[kept].tolist(), strict=True)) == want
        assert len(kept) == n - len(set(want.values()))
    # a missing id is no row that two others could meet at
    kept = distance.spanning_forest(np.array([1.0, 2.0, 1.0, np.nan]), np.array([np.nan, np.nan, 2.0, np.nan]))
    assert kept.tolist() == [2]
    assert distance.spanning_forest(np.array(["a", None], object), np.array(["b", "a"], object)).tolist() == [0]


@pytest.mark.parametrize("shift", [0.0, 1e6])
def test_close_pairs_and_distances_by_products_are_those_of_the_metric(shift):
    rng = np.random.default_rng(8)
    a = np.concatenate([rng.standard_normal((60, 8)), np.zeros((5, 8)), np.round(rng.random((40, 8)), 1)]) + shift
    full = distance.metric_function("euclidean")(a, a)
    for at_most in (0.0, 0.5, 1.5, float(full[3, 70])):
        r, c, d = distance.close_in_block(a, a, at_most, "euclidean")
        assert (np.stack([r, c]) == np.stack(np.nonzero(full <= at_most))).all() and (d == full[r, c]).all()
    assert np.allclose(distance.distances_in_block(a, a, "euclidean"), full, rtol=1e-11, atol=0)
    odd = a.copy()
    odd[2, 1], odd[3, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        full = distance.metric_function("euclidean")(odd, odd)
        assert (distance.close_in_block(odd, odd, 0.5, "euclidean")[0] == np.nonzero(full <= 0.5)[0]).all()
        assert np.array_equal(distance.distances_in_block(odd, odd, "euclidean"), full, equal_nan=True)


def test_clusters_by_height_need_a_forest_of_each_task_only(spark, monkeypatch):
    x, df = _rows(spark, 200)
    original = distance.block_pairs
    monkeypatch.setattr(distance, "HELD_ROWS", 50)
    monkeypatch.setattr(distance, "FEW_BLOCKS", 2)
    monkeypatch.setattr(distance, "block_pairs", lambda rows, key, fn, schema, **kw: original(rows, key, fn, schema, 16, **kw))
    every = distance.pairwise_distance(df, at_most=0.15)
    forest = distance.pairwise_distance(df, at_most=0.15, forest=True)
    d = distance.metric_function("euclidean")(x, x)
    want = _joined(range(200), [(a, b) for a, b in zip(*(z.tolist() for z in np.nonzero(d <= 0.15)), strict=True) if a < b])
    pairs = {(r.i, r.j): r.value for r in every.collect()}
    kept = {(r.i, r.j): r.value for r in forest.collect()}
    assert kept.items() <= pairs.items() and pairs.keys() == {(a, b) for a in range(200) for b in range(a + 1, 200) if d[a, b] <= 0.15}
    assert len(kept) <= 3 * 199 and len(set(want.values())) > 1
    assert {r.file: r.cluster for r in cluster.threshold_clusters(df.select("file"), forest, 0.15).collect()} == want
    close = df.selectExpr("file", "transform(x, v -> v / 100) as x")
    assert distance.pairwise_distance(close, at_most=1.0, forest=True).count() <= 3 * 199 < distance.pairwise_distance(close, at_most=1.0).count()
    with pytest.raises(ValueError, match="height"):
        distance.pairwise_distance(df, forest=True)


@pytest.mark.parametrize("mostly", [-1.0, 9.0])
@pytest.mark.parametrize("metric", ["euclidean", "maximum"])
def test_near_clusters_by_cells_and_by_blocks(spark, monkeypatch, mostly, metric):
    x, df = _rows(spark, 150, seed=4)
    monkeypatch.setattr(pivots, "MOSTLY", mostly)
    ways = []
    for name in ("pairwise_distance", "_near_pairs"):
        monkeypatch.setattr(pivots, name, lambda *a, _f=getattr(pivots, name), _n=name, **kw: ways.append((_n, kw["forest"])) or _f(*a, **kw))
    d = distance.metric_function(metric)(x, x)
    want = _joined(range(150), [(a, b) for a, b in zip(*(z.tolist() for z in np.nonzero(d <= 0.12)), strict=True) if a < b])
    assert {r.file: r.cluster for r in pivots.near_clusters(df, 0.12, metric=metric).collect()} == want
    assert ways == [("pairwise_distance" if mostly < 0 else "_near_pairs", True)]


def test_silhouettes_send_a_row_to_few_blocks(spark, monkeypatch):
    _, df = _rows(spark)
    original = cluster.block_pairs
    monkeypatch.setattr(cluster, "FEW_BLOCKS", 3)
    monkeypatch.setattr(cluster, "block_pairs", lambda rows, key, fn, schema, **kw: original(rows, key, fn, schema, 7, **kw))
    plan = cluster.silhouette_rows(df)._jdf.queryExecution().toString()
    assert "sequence(0, 2" in plan and "sequence(0, 12" not in plan
