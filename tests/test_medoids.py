"""Medoids by bounds against the distance table."""

import numpy as np
import pytest

from peakweave.operators import medoids
from peakweave.operators.cluster import k_medoids, silhouette
from peakweave.operators.distance import metric_function, pairwise_distance


def frame(spark, seed, n=150, dims=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 4, (4, dims))[rng.integers(0, 4, n)] + rng.normal(0, 1, (n, dims))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "file long, x array<double>").repartition(3)


@pytest.mark.parametrize("tried", [4, 64])
def test_central_rows_are_those_of_least_sums(spark, tried, monkeypatch):
    monkeypatch.setattr(medoids, "TRIED", tried)
    x, df = frame(spark, 1)
    got, measured = medoids.central_rows(df.selectExpr("file", "x", "file % 3 AS part"), "file", "x", "part", "euclidean")
    for c in range(3):
        own = np.arange(c, len(x), 3)
        sums = metric_function("euclidean")(x[own], x[own]).sum(axis=1)
        assert got[c] == own[sums.argmin()]
    assert measured <= len(x) and (tried == 64 or measured <= 0.8 * len(x))


def test_equals_medoids_of_the_distance_table(spark, collect):
    _, df = frame(spark, 2)
    want = collect(k_medoids(pairwise_distance(df), df.select("file"), 4))
    assert collect(medoids.k_medoids_of(df, 4)) == want


def test_few_rows_and_none(spark, collect):
    _, df = frame(spark, 3, n=3)
    assert [a for a, b in collect(medoids.k_medoids_of(df, 9)) if a == b] == [0, 1, 2]
    assert medoids.k_medoids_of(df.limit(0), 2).collect() == []
    with pytest.raises(ValueError, match="metric"):
        medoids.k_medoids_of(df, 2, metric="canberra")


def test_rows_that_bounds_do_not_rule_out_are_measured_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(medoids, "TRIED", 4)
    monkeypatch.setattr(medoids, "MOST_TRIED", 8)
    x = np.random.default_rng(4).standard_normal((400, 24))
    x[300:] = x[:100]
    df = spark.createDataFrame([(int(i), int(i % 100) % 2, x[i].tolist()) for i in np.random.default_rng(5).permutation(400)], "file long, part int, x array<double>")
    passes, top = [], medoids.top_k
    monkeypatch.setattr(medoids, "top_k", lambda *a: passes.append(a[-1]) or top(*a))
    got, measured = medoids.central_rows(df, "file", "x", "part", "euclidean")
    for c in range(2):
        own = np.flatnonzero(np.arange(400) % 100 % 2 == c)
        sums = metric_function("euclidean")(x[own], x[own]).sum(axis=1)
        # copies have the same sum: the least id
        assert got[c] == min(own[sums <= sums.min() * (1 + 1e-12)])
    assert passes == [4, 8] and 100 < measured <= 400


def test_many_different_rows_of_the_same_sum(spark, monkeypatch):
    monkeypatch.setattr(medoids, "TRIED", 2)
    monkeypatch.setattr(medoids, "MOST_TRIED", 4)
    x = np.concatenate([np.zeros((2, 3)), np.eye(3), -np.eye(3), 2 * np.eye(3), -2 * np.eye(3), 5 * np.ones((1, 3)), -5 * np.ones((1, 3))])
    ring = [[float(np.cos(a)), float(np.sin(a)), 0.0] for a in np.arange(24) * np.pi / 12]
    df = spark.createDataFrame([(i, 0, v) for i, v in enumerate(ring)], "file long, part int, x array<double>")
    assert medoids.central_rows(df, "file", "x", "part", "euclidean")[0][0] in range(24)
    df = spark.createDataFrame([(100 - i, 0, v.tolist()) for i, v in enumerate(x)], "file long, part int, x array<double>")
    assert medoids.central_rows(df, "file", "x", "part", "euclidean")[0] == {0: 99}


def test_silhouettes_do_not_shuffle_pairs(spark):
    _, df = frame(spark, 6, n=40)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = silhouette(pairwise_distance(df), df.selectExpr("file", "file % 3 AS cluster"))
        plan = found._jdf.queryExecution().executedPlan().toString()
        # once for either block, and no pair is sorted by its ids
        assert plan.count("FlatMapGroupsInPandas") == 1 and "hashpartitioning(j" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
