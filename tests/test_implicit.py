"""Implied cells against the matrix laid out."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.operators import implicit as module
from peakweave.operators.implicit import implicit, missing_cells
from peakweave.operators.impute import IMPUTERS, fill_missing, half_min_fills, impute_half_min_technique, mean_fills
from peakweave.operators.normalize import NORMALIZERS
from peakweave.plans import study


def frame(spark, seed=1, files=23, features=31):
    rng = np.random.default_rng(seed)
    rows = [(f"f{i}", f"x{j}", float(np.round(rng.lognormal(), 4))) for i in range(files) for j in range(features) if rng.random() < 0.3 or j == 0 and i == 0]
    rows += [("f0", "constant", 2.0), ("lonely", "x1", 5.0)]
    return rows, spark.createDataFrame(rows, "file string, feature string, value double").repartition(3)


@pytest.mark.parametrize(("features", "files", "rows"), [(4096, 1024, 1 << 19), (5, 4, 7)])
def test_missing_cells_are_those_without_a_value(spark, collect, features, files, rows, monkeypatch):
    monkeypatch.setattr(module, "FEATURES", features)
    monkeypatch.setattr(module, "FILES", files)
    monkeypatch.setattr(module, "ROWS", rows)
    cells, df = frame(spark)
    df = df.unionByName(spark.createDataFrame([("f1", "x0", None), (None, "x0", 1.0), ("f2", None, 1.0), ("f0", "constant", 2.5)], df.schema))
    there = {(a, b) for a, b, _ in cells}
    names = {b for _, b, _ in cells}
    want = sorted((a, b) for a in {a for a, _, _ in cells} for b in names if (a, b) not in there)
    assert collect(missing_cells(df, None), "file", "feature") == want


def test_techniques_have_their_own_grids(spark, collect):
    df = spark.createDataFrame([("a", "x", 1.0, "GC"), ("b", "y", 2.0, "GC"), ("c", "z", 3.0, "ICP"), ("d", "w", None, "ICP")], "file string, feature string, value double, technique string")
    got = collect(fill_missing(df, None, 0.5, technique="technique"), "file", "feature", "technique", "value", "imputed")
    assert got == sorted([
        ("a", "x", "GC", 1.0, False), ("a", "y", "GC", 0.5, True), ("b", "x", "GC", 0.5, True), ("b", "y", "GC", 2.0, False),
        ("c", "z", "ICP", 3.0, False), ("c", "w", "ICP", 0.5, True), ("d", "z", "ICP", 0.5, True), ("d", "w", "ICP", 0.5, True),
    ])
    assert fill_missing(df.limit(0), None, 0.0).count() == 0


@pytest.mark.parametrize("fills", [None, mean_fills, half_min_fills])
def test_moments_and_normalisers_equal_those_of_the_laid_out_matrix(spark, fills):
    _, df = frame(spark, 4)
    chosen = fills(df) if fills else df.select("feature", F.lit(0.0).alias("fill")).distinct()
    m = implicit(df, chosen)
    dense = m.long().cache()
    assert dense.count() == 24 * 32
    want = {r.feature: tuple(r)[1:] for r in dense.groupBy("feature").agg(F.sum(F.col("imputed").cast("int")), F.sum("value"), F.avg("value"), F.stddev_samp("value"), F.min("value"), F.max("value")).collect()}
    got = {r.feature: tuple(r)[1:] for r in m.moments().collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[f], want[f], atol=1e-9) for f in want)
    totals = {r.file: r.total for r in m.file_totals().collect()}
    assert all(abs(totals[r[0]] - r[1]) < 1e-9 for r in dense.groupBy("file").agg(F.sum("value")).collect())
    cells = lambda d: {(r.file, r.feature): r.value for r in d.collect()}
    for got, want in ((m.zscore(), "zscore"), (m.minmax(), "minmax"), (m.mapped(lambda v: F.log10(v + 1)), "log10")):
        one, two = cells(got.long()), cells(NORMALIZERS[want](dense.select("file", "feature", "value")))
        assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in two)


def test_dense_rows_lay_out_fills(spark):
    _, df = frame(spark, 5)
    m = implicit(df, mean_fills(df))
    rows, index = m.dense_rows(m.file_totals())
    order = {r.idx: r.feature for r in index.collect()}
    want = {(r.file, r.feature): r.value for r in NORMALIZERS["tsn"](m.long().select("file", "feature", "value")).collect()}
    got = {(r.file, order[i]): v for r in rows.collect() for i, v in enumerate(r.x)}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_imputers_keep_measured_cells(spark):
    cells, df = frame(spark, 6)
    for name in ("zero", "mean", "median", "half_min", "uniform_lod"):
        out = IMPUTERS[name](df)
        assert {(r.file, r.feature, r.value) for r in out.filter("NOT imputed").collect()} == set(cells)
        assert out.filter("value IS NULL").count() == 0 and out.count() == 24 * 32


@pytest.mark.parametrize("imputer", ["zero", "mean", "median", "half_min"])
@pytest.mark.parametrize("normalizer", ["zscore", "tsn", "ln"])
def test_arrays_equal_those_of_the_dense_table(spark, imputer, normalizer):
    _, df = frame(spark, 7)
    rows, index = study.prepare_rows(df, imputer, normalizer)
    order = {r.idx: r.feature for r in index.collect()}
    dense = {(r.file, r.feature): r.value or 0.0 for r in study.prepare(df, imputer, normalizer).collect()}
    got = {(r.file, order[i]): v for r in rows.collect() for i, v in enumerate(r.x)}
    assert got.keys() == dense.keys() and all(abs(got[k] - dense[k]) < 1e-9 for k in dense)


@pytest.mark.parametrize("held", [1 << 17, 3])
def test_missing_cells_of_features_that_go_on_over_many_batches(spark, collect, held, monkeypatch):
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "RUN", 4)
    cells, df = frame(spark, 5)
    names, there = {b for _, b, _ in cells}, {(a, b) for a, b, _ in cells}
    want = sorted((a, b) for a in {a for a, _, _ in cells} for b in names if (a, b) not in there)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert collect(missing_cells(df.unionByName(df), None), "file", "feature") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_fills_are_changed_once_a_feature_and_lists_leave_the_tasks(spark, collect):
    _, df = frame(spark, 6)
    plain = {(a, b): v for a, b, v in collect(IMPUTERS["mean"](df), "file", "feature", "value")}
    filled = IMPUTERS["mean"](df, change=lambda v: F.round(v, 2))
    assert all(abs(v - plain[a, b]) <= 0.005 + 1e-9 and abs(v * 100 - round(v * 100)) < 1e-6 for a, b, v in collect(filled, "file", "feature", "value"))
    absent = filled.filter("imputed").select("value")._jdf.queryExecution().executedPlan().toString()
    # neither is a value rounded nor a row made in Python for each missing cell
    assert "round(" not in absent.split("MapInArrow")[0] and "explode" in absent.lower()


def test_fills_of_a_technique(spark, collect):
    df = spark.createDataFrame([("a", "x", 4, "GC"), ("b", "y", 3, "GC"), ("c", "z", 9, "ICP"), ("d", "w", None, "ICP"), ("e", "v", 1, None)], "file string, feature string, value int, technique string")
    got = collect(impute_half_min_technique(df), "file", "feature", "technique", "value", "imputed")
    assert got == sorted([
        ("a", "x", "GC", 4.0, False), ("a", "y", "GC", 1.5, True), ("b", "x", "GC", 1.5, True), ("b", "y", "GC", 3.0, False),
        ("c", "z", "ICP", 9.0, False), ("c", "w", "ICP", 4.5, True), ("d", "z", "ICP", 4.5, True), ("d", "w", "ICP", 4.5, True),
    ])


@pytest.mark.parametrize(("names", "files", "share", "run"), [(5, 9, 0.3, 4), (40, 1100, 0.01, 512), (9, 700, 0.002, 512), (7, 3, 0.9, 4), (6, 600, 1.0, 64), (3, 2000, 0.0, 512), (10, 50, 0.1, 2)])
def test_products_are_all_cells_but_the_measured(names, files, share, run):
    there = np.random.default_rng(names).random((names, files)) < share
    name, file = np.nonzero(there)
    got = np.zeros(there.shape, int)
    for inner, names_of, outer, files_of in module._rectangles(names, files, np.repeat(name, 2), np.repeat(file, 2), run):
        for a, b, c, d in zip(inner, inner[1:], outer, outer[1:], strict=False):
            assert (b - a) * (d - c) <= max(run, module.PRODUCT)
            np.add.at(got, np.ix_(names_of[a:b], files_of[c:d]), 1)
    assert (got == ~there).all()


def test_features_that_lack_the_same_files_leave_the_tasks_together(spark, tmp_path):
    n = 600
    cells = spark.range(1200).select((F.col("id") % n).alias("file"), F.col("id").alias("feature"), F.lit(1.0).alias("value")).coalesce(1)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        missing_cells(cells, mean_fills(cells)).write.parquet(str(tmp_path / "out"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1200 * (n - 1)
    # files in one order for nearly all features: they repeat and compress
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < 0.25 * 1200 * (n - 1)
