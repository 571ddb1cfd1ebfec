"""Bucketed ranks, quantiles and running values against plain windows, under several partitionings."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from peakweave.operators import ordering


def frame(spark, seed, n=400):
    rng = np.random.default_rng(seed)
    group = np.where(rng.random(n) < 0.4, 0, rng.integers(1, 6, n))
    value = np.round(rng.normal(0, 10.0 ** rng.integers(-3, 6, n)), 3)
    value[rng.random(n) < 0.2] = 0.0
    return spark.createDataFrame(
        [(int(i), int(g), float(v)) for i, (g, v) in enumerate(zip(group, value))], "id int, g int, v double"
    )


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_average_ranks_match_window(spark, collect, parts):
    df = frame(spark, parts).repartition(parts)
    w = Window.partitionBy("g").orderBy("v")
    same = Window.partitionBy("g", "v")
    want = df.select("id", (F.rank().over(w) + (F.count("*").over(same) - 1) / 2).alias("r"))
    assert collect(ordering.average_ranks(df, ["g"], "v"), "id", "avg_rank") == collect(want)


def test_bucket_never_decreases(spark):
    values = sorted({0.0, 5e-324, 1e-300, -1e-300, 1e300, -1e300, 1.0, np.nextafter(1, 2), -1.0, 3.5, 3.5000001})
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = [r[1] for r in df.select("v", ordering.log_bucket(F.col("v"))).orderBy("v").collect()]
    assert got == sorted(got)


def test_exact_quantiles_match_numpy(spark):
    df = frame(spark, 5)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    got = {r["g"]: [r[f"q{i}"] for i in range(6)] for r in ordering.exact_quantiles(df, ["g"], "v", probs, [f"q{i}" for i in range(6)]).collect()}
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        assert np.allclose(got[g], np.quantile(part["v"], probs))


def test_crowded_buckets_are_cut_until_they_are_small(spark, monkeypatch):
    monkeypatch.setattr(ordering, "RANKED", 20)
    monkeypatch.setattr(ordering, "SPLIT", 4)
    rng = np.random.default_rng(6)
    values = np.concatenate([1000 + rng.random(700) * 1e-3, np.full(90, 1000.0005), rng.normal(0, 1, 40), [-0.0, 0.0]])
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)] + [(0, None), (7, None)], "g int, v double")
    probs = [0.0, 0.01, 0.3, 0.5, 0.77, 1.0]
    names = [f"q{i}" for i in range(6)]
    got = {r["g"]: [r[n] for n in names] for r in ordering.exact_quantiles(df, ["g"], "v", probs, names).collect()}
    assert got.keys() == {0, 1}
    for g in (0, 1):
        assert np.allclose(got[g], np.quantile(values[g::2], probs), rtol=0, atol=1e-12)
    assert ordering.exact_quantiles(df, [], "v", [0.5], ["m"]).first().m == pytest.approx(np.median(values))


def test_row_positions_and_seeded_positions(spark, collect):
    df = frame(spark, 9)
    got = ordering.row_positions(df, ["g"], ["v", "id"], ordering.log_bucket(F.col("v")))
    want = df.withColumn("position", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert collect(got, "id", "position") == collect(want, "id", "position")
    a = collect(ordering.seeded_positions(df, ["g"], ["id"], 1), "id", "position")
    b = collect(ordering.seeded_positions(df.repartition(13), ["g"], ["id"], 1), "id", "position")
    assert a == b
    for g in range(6):
        places = sorted(r["position"] for r in ordering.seeded_positions(df, ["g"], ["id"], 1).filter(f"g = {g}").collect())
        assert places == list(range(1, len(places) + 1))


def test_running_extremes(spark, collect):
    df = frame(spark, 11).dropDuplicates(["g", "v"]).withColumn("x", F.sin(F.col("id")))
    got = ordering.running_extremes(df, ["g"], "v", [("x", "up", "max", True), ("x", "down", "min", False)])
    up = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("g").orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.max("x").over(up).alias("up"), F.min("x").over(down).alias("down"))
    assert collect(got, "id", "up", "down") == collect(want)
