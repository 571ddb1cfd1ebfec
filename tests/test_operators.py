"""Edge cases on tiny hand-made tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakweave.functions import names
from peakweave.operators import (
    blanks, cluster, distance, impute, impute_models, match, metals, metrics, missing, models, naming, normalize, padjust,
    prevalence, project, regression, reshape, selection, splits, summary, tests,
)
from peakweave.sources import files


def test_blank_subtraction_edges(spark, collect):
    data = [
        # no blank: unchanged; one blank: all dropped; equal blanks: keep above zero; spread: strictly above 3 sd
        ("a", "s1", 5.0, "Sample"), ("a", "s2", 1.0, "Sample"),
        ("b", "s1", 100.0, "Sample"), ("b", "k1", 1.0, "Blanks"),
        ("c", "s1", 12.0, "Sample"), ("c", "s2", 10.0, "Sample"), ("c", "k1", 10.0, "Blanks"), ("c", "k2", 10.0, "Blanks"),
        ("d", "s1", 10 + 3 * math.sqrt(2), "Sample"), ("d", "s2", 20.0, "Sample"), ("d", "k1", 9.0, "Blanks"), ("d", "k2", 11.0, "Blanks"),
        ("e", "k1", 4.0, "Blanks"),
    ]
    df = spark.createDataFrame(data, "feature string, file string, value double, type string")
    got = collect(blanks.blank_subtract(df), "feature", "file", "value")
    assert got == [("a", "s1", 5.0), ("a", "s2", 1.0), ("c", "s1", 2.0), ("d", "s2", 10.0)]
    older = collect(blanks.blank_subtract_mean(df), "feature", "file", "value")
    assert ("c", "s2", 0.0) in older and ("b", "s1", 99.0) in older and len(older) == 7


def test_benchmarks_keep_everything_without_match(spark):
    df = spark.createDataFrame([(100.0, 1.0), (156.0957, 2.0), (156.0961, 3.0), (156.0963, 3.0), (None, 4.0)], "mz double, rt double")
    assert blanks.remove_benchmarks(df, [999.0], 0.1).count() == 5
    assert blanks.remove_benchmarks(df, [], 0.1).count() == 5
    left = blanks.remove_benchmarks(df, blanks.LC_STANDARD_MASSES, blanks.LC_STANDARD_TOLERANCE)
    assert sorted(r["rt"] for r in left.collect()) == [1.0, 3.0, 4.0]
    boxed = spark.createDataFrame([(98.2, 13.45), (98.2, 13.5), (97.0, 13.45)], "mz double, rt double")
    assert blanks.remove_box(boxed, blanks.GC_SOLVENT_MZ, blanks.GC_SOLVENT_RT).count() == 2


def test_shares_sum_to_one(spark):
    df = spark.createDataFrame([("f", 1.0), ("f", 3.0), ("f", 0.0), ("g", 2.0)], "file string, value double")
    got = prevalence.tsn_by_file(df).groupBy("file").agg(F.sum("value_share").alias("s"), F.count("*").alias("n")).collect()
    assert {(r["file"], r["s"], r["n"]) for r in got} == {("f", 1.0, 2), ("g", 1.0, 1)}


def test_minmax_and_zscore_constant_columns(spark, collect):
    df = spark.createDataFrame([("x", "a", 2.0), ("y", "a", 2.0), ("x", "b", 1.0), ("y", "b", 3.0)], "file string, feature string, value double")
    assert collect(normalize.norm_minmax(df)) == [("x", "a", 0.0), ("x", "b", 0.0), ("y", "a", 0.0), ("y", "b", 1.0)]
    z = {(r[0], r[1]): r[2] for r in normalize.norm_zscore(df).collect()}
    assert z[("x", "a")] == 0.0 and z[("y", "b")] == pytest.approx(1 / math.sqrt(2))
    assert all(math.isnan(r["value"]) for r in normalize.norm_minmax(df, constant="nan").filter("feature = 'a'").collect())
    zero = spark.createDataFrame([("x", 0.0), ("x", 0.0)], "file string, value double")
    assert collect(normalize.norm_tsn(zero), "value") == [(0.0,), (0.0,)]
    with pytest.raises(ValueError):
        normalize.norm_log10(df, offset=0)
    parts = normalize.robust_clr(spark.createDataFrame([("x", 0.0), ("x", math.e), ("x", math.e**3)], "file string, value double"))
    assert [r[0] for r in collect(parts, "value")] == pytest.approx([-1.0, 0.0, 1.0])


def test_structural_zeros_and_cleaning(spark):
    # two techniques: 6 GC files of two classes, 6 ICP files
    data = []
    for c in ("p", "q"):
        for k in range(3):
            data += [(f"g{c}{k}", "fg", "GC", c, 1.0), (f"i{c}{k}", "fi", "ICP", c, 1.0)]
    data += [("gp0", "rare", "GC", "p", 2.0)]
    df = spark.createDataFrame(data, "file string, feature string, technique string, subcategory string, value double")
    profile = {r["feature"]: r for r in missing.feature_profile(df).collect()}
    assert profile["rare"]["classes_enough"] == 2  # three zero files of the other technique in both classes
    assert profile["rare"]["files_nonzero"] == 1 and profile["fg"]["technique_share"] == 1.0
    kept = {r["feature"] for r in missing.comprehensive_filter(df).collect()}
    assert kept == {"fg", "fi"}
    assert {r["feature"] for r in missing.comprehensive_filter(df, steps=()).collect()} == {"fg", "fi", "rare"}
    flags = missing.flag_structural_zeros(df.select("file", F.lit("GC").alias("technique")).distinct(), df).collect()
    assert {r["structural_zero"] for r in flags if r["file"].startswith("i")} == {True}


def test_half_min_without_positive_value(spark, collect):
    df = spark.createDataFrame([("x", "a", 0.0), ("y", "b", 4.0)], "file string, feature string, value double")
    assert collect(impute.impute_half_min(df), "file", "feature", "value") == [("x", "a", 0.0), ("x", "b", 2.0), ("y", "a", 0.0), ("y", "b", 4.0)]


def test_uniform_draws_repeat(spark, collect):
    df = spark.createDataFrame([(f"f{i}", f"m{i % 3}", float(i + 1)) for i in range(9)], "file string, feature string, value double")
    a = collect(impute.impute_uniform_lod(df, seed=3), "file", "feature", "value")
    assert a == collect(impute.impute_uniform_lod(df.repartition(5), seed=3), "file", "feature", "value")
    assert all(1.0 <= v <= 2.0 for f, m, v in a if (f, m) not in {(r["file"], r["feature"]) for r in df.collect()})


def test_imputation_stays_within_technique(spark, collect):
    df = spark.createDataFrame(
        [("a", "g1", "GC", 1.0), ("b", "g2", "GC", 3.0), ("c", "i1", "ICP", 9.0)], "file string, feature string, technique string, value double"
    )
    got = collect(impute.impute_zero(df, technique="technique"), "file", "feature", "value")
    assert got == [("a", "g1", 1.0), ("a", "g2", 0.0), ("b", "g1", 0.0), ("b", "g2", 3.0), ("c", "i1", 9.0)]


def gower_fill(x, k):
    """Literal k-nearest imputation for a small matrix."""
    lo, hi = np.nanmin(x, 0), np.nanmax(x, 0)
    scale = np.where(hi > lo, hi - lo, 1)
    out = x.copy()
    for i in range(len(x)):
        for c in np.flatnonzero(np.isnan(x[i])):
            found = []
            for j in range(len(x)):
                both = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if i != j and both.any() and not np.isnan(x[j, c]):
                    found.append((np.mean(np.abs(x[i] - x[j])[both] / scale[both]), j))
            out[i, c] = np.median([x[j, c] for _, j in sorted(found)[:k]])
    return out


def test_neighbour_imputation(spark):
    rng = np.random.default_rng(2)
    x = rng.random((40, 6))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "file int, x array<double>")
    got = {r["file"]: r["x"] for r in impute_models.impute_knn(rows, 3, block_rows=9).collect()}
    assert np.allclose([got[i] for i in range(40)], gower_fill(x, 3))


def test_low_rank_recovers_structure(spark):
    rng = np.random.default_rng(4)
    full = np.outer(rng.random(30) + 1, rng.random(5) + 1)
    x = full.copy()
    x[rng.random(x.shape) < 0.1] = np.nan
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "file int, x array<double>")
    got = {r["file"]: r["x"] for r in impute_models.impute_low_rank(rows, rank=1, lam=0.01, maxit=15).collect()}
    filled = np.array([got[i] for i in range(30)])
    gap = np.isnan(x)
    assert np.allclose(filled[~gap], x[~gap])
    assert np.abs(filled - full)[gap].max() < 0.1 < np.abs(np.nanmean(x, 0) - full)[gap].max()


def test_library_matches(spark, collect):
    feats = spark.createDataFrame([("f1", 100.0), ("f2", 100.0004), ("f3", 200.0)], "feature string, mean_mz double")
    lib = spark.createDataFrame([("z", 100.0002), ("y", 100.0002), ("w", 300.0), ("v", 199.9995)], "name string, mass double")
    assert collect(match.match_library(feats, lib, 0.0005), "name", "features", "n_features") == [("v", "f3", 1), ("y", "f1, f2", 2)]
    assert match.match_library(feats, lib, 0.0005, "all").count() == 3
    hits = match.library_hits(feats, lib, 0.0005)
    assert hits.count() == 3
    values = spark.createDataFrame([("f1", "c", 1.0), ("f2", "c", 3.0), ("f3", "c", 5.0)], "feature string, cls string, value double")
    literal = match.annotate_by_joined_name(values, match.match_library(feats, lib, 0.0005).select("features", "name"), ["name", "cls"])
    assert collect(literal, "feature", "mean_value") == [("f3", 5.0)]


def test_band_join_is_exact(spark):
    rng = np.random.default_rng(8)
    a, b = np.round(rng.random(150) * 3, 3), np.round(rng.random(80) * 3, 3)
    got = {tuple(r) for r in match.match_masses(
        spark.createDataFrame([(float(v),) for v in a], "mean_mz double"), spark.createDataFrame([(float(v),) for v in b], "mass double"), 0.01
    ).collect()}
    assert got == {(m, x) for m in set(b.tolist()) for x in set(a.tolist()) if m - 0.01 <= x <= m + 0.01}


def test_names(spark):
    row = spark.createDataFrame([("LAB_GC_2023_USE-03_R2_Day2.csv", "56 -> 72 Fe [ H2 ]", "12 Na", "x_rep3", "2a b")], "f string, m string, n string, r string, i string").select(
        names.file_stem(F.col("f")), names.clean_metal_name("m"), names.gas_mode("m"), names.gas_mode("n"), names.strip_replicate_suffix("r"), names.identifier("i"),
        names.classify_by_name("f", names.METAL_CATEGORY_RULES, names.METAL_CATEGORY_DEFAULT), names.classify_regex_ci(F.lit("sample pa66")), names.classify_regex_ci(F.lit("sample pa66"), True),
        names.excel_serial_to_date(F.lit("45000")), names.excel_serial_to_date(F.lit("n/a")),
    ).first()
    assert list(row)[:9] == ["LAB-GC-2023-USE-03-R2-Day2", "Fe", "H2", None, "x", "X2a.b", "Plastic drinking straws", "PA6", "PA66"]
    assert str(row[9]) == "2023-03-15" and row[10] is None


def test_replicates_numbered_only_when_repeated(spark, collect):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "file int, name string")
    assert collect(naming.replicate_suffix(df, "name", ["file"], F.col("file"))) == [(1, "a_rep1"), (2, "b"), (3, "a_rep2")]


def test_best_metal_mode(spark, collect):
    qc = spark.createDataFrame(
        [("56 Fe [ H2 ]", 90.0, 1.0), ("56 Fe [ N2O ]", 95.0, 9.0), ("63 Cu [ H2 ]", None, 5.0), ("63 Cu [ N2O ]", None, 4.0), ("9 Be [ H2 ]", None, None)],
        "name string, recovery double, uncertainty double",
    )
    assert [r[0] for r in collect(metals.best_metal_mode(qc), "name")] == ["56 Fe [ N2O ]", "63 Cu [ N2O ]", "9 Be [ H2 ]"]


def test_distances_against_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(23, 5))
    x[:, 3] = 0.0
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "file int, x array<double>")
    formulas = {
        "euclidean": lambda d: np.sqrt((d**2).sum()), "maximum": lambda d: np.abs(d).max(), "manhattan": lambda d: np.abs(d).sum(),
    }
    for metric, f in formulas.items():
        got = {(r["i"], r["j"]): r["value"] for r in distance.pairwise_distance(rows, metric=metric).collect()}
        assert len(got) == 23 * 22 // 2
        assert all(v == pytest.approx(f(x[i] - x[j])) for (i, j), v in got.items())
    can = {(r["i"], r["j"]): r["value"] for r in distance.pairwise_distance(rows, metric="canberra").collect()}
    a, b = np.delete(x[0], 3), np.delete(x[1], 3)
    assert can[(0, 1)] == pytest.approx((np.abs(a - b) / (np.abs(a) + np.abs(b))).sum() * 5 / 4)
    near = distance.nearest_neighbours(rows, rows, 3, block_rows=4).filter("rank = 2").collect()
    for r in near:
        d = np.sqrt(((x - x[r["file"]]) ** 2).sum(1))
        assert r["n_id"] == np.argsort(d)[1]


def test_small_blocks_give_the_same_matrix(spark, collect):
    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(i, [float(v) for v in rng.random(4)]) for i in range(30)], "file int, x array<double>")
    whole = collect(distance.pairwise_distance(rows))
    old = distance.BLOCK_ROWS
    got = collect(distance.block_pairs(rows, "file", _pairs_of(rows), "i int, j int, value double", 4))
    assert old == 512 and [g[:2] for g in got] == [w[:2] for w in whole]


def _pairs_of(rows):
    measure = distance.metric_function("euclidean")

    def fn(a, b, same):
        d = measure(distance._stack(a["x"]), distance._stack(b["x"])) if len(a) and len(b) else np.zeros((len(a), len(b)))
        keep = np.triu(np.ones_like(d, bool), 1) if same else np.ones_like(d, bool)
        return distance._ordered(a["file"].to_numpy(), b["file"].to_numpy(), d, keep)

    return fn


def test_correlations_with_gaps(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(50, 4)) + 1e6
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)], "file int, x array<double>")
    for r in distance.correlation_matrix(rows.repartition(6)).collect():
        both = ~np.isnan(x[:, r["i"]]) & ~np.isnan(x[:, r["j"]])
        assert r["n"] == both.sum()
        assert r["value"] == pytest.approx(np.corrcoef(x[both][:, r["i"]], x[both][:, r["j"]])[0, 1], abs=1e-8)


def test_components_of_a_long_chain(spark, collect):
    n = 64
    nodes = spark.range(n).withColumnRenamed("id", "file")
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(n - 1) if i != 40], "i long, j long, value double")
    got = dict(collect(cluster.threshold_clusters(nodes, edges, 1.0)))
    assert all(got[i] == (0 if i <= 40 else 41) for i in range(n))
    assert len(set(dict(collect(cluster.threshold_clusters(nodes, edges, 0.5))).values())) == n


def test_silhouettes_agree_and_singletons_are_zero(spark, collect):
    pts = [(0, 0.0, 0), (1, 1.0, 0), (2, 10.0, 1), (3, 11.0, 1), (4, 50.0, 2)]
    rows = spark.createDataFrame([(i, [x], c) for i, x, c in pts], "file int, x array<double>, cluster int")
    a = collect(cluster.silhouette_rows(rows), "file", "width")
    b = collect(cluster.silhouette(distance.pairwise_distance(rows), rows.select("file", "cluster")), "file", "width")
    assert [r[1] for r in a] == pytest.approx([r[1] for r in b])
    assert a[4][1] == 0.0 and a[0][1] == pytest.approx((10.5 - 1) / 10.5)


def test_medoids_find_obvious_groups(spark):
    pts = [0.0, 0.1, 0.2, 10.0, 10.1, 10.2]
    rows = spark.createDataFrame([(i, [v]) for i, v in enumerate(pts)], "file int, x array<double>")
    got = {r["file"]: r["medoid"] for r in cluster.k_medoids(distance.pairwise_distance(rows), rows.select("file"), 2).collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 4, 4: 4, 5: 4}


def test_pca_variance_and_contributions(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 4)) @ np.diag([5, 2, 1, 0.5])
    df = reshape.to_vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "file int, x array<double>"))
    scores, loadings, share = project.pca(df, 2)
    values = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1]
    assert share == pytest.approx(list(values[:2] / values.sum()))
    got = scores.toPandas()
    assert got["pc1"].mean() == pytest.approx(0, abs=1e-9) and got["pc1"].var() == pytest.approx(values[0])
    total = project.pca_contributions(loadings).groupBy("component").agg(F.sum("contribution")).collect()
    assert all(r[1] == pytest.approx(100) for r in total)


def test_corrections(spark):
    p = [0.01, 0.01, 0.03, 0.04, 0.2, 0.9]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(p)], "id int, p_value double")
    got = padjust.p_adjust(df, [], "p_value", ["bonferroni", "holm", "hochberg", "hommel", "BH", "BY", "fdr"]).orderBy("id").toPandas()
    assert got["p_holm"].tolist() == pytest.approx([0.06, 0.06, 0.12, 0.12, 0.4, 0.9])
    assert got["p_BH"].tolist() == pytest.approx([0.03, 0.03, 0.06, 0.06, 0.24, 0.9])
    assert got["p_hochberg"].tolist() == pytest.approx([0.05, 0.05, 0.12, 0.12, 0.4, 0.9])
    assert got["p_BY"].tolist() == pytest.approx([min(1, v * 2.45) for v in [0.03, 0.03, 0.06, 0.06, 0.24, 0.9]])
    assert got["p_fdr"].tolist() == got["p_BH"].tolist()
    for m in ("bonferroni", "holm", "hochberg", "hommel", "BH", "BY"):
        assert (np.diff(got[f"p_{m}"]) >= 0).all() and (got[f"p_{m}"] >= got["p_value"]).all()
    with pytest.raises(ValueError):
        padjust.p_adjust(df, [], "p_value", ["other"])


def test_rank_tests_on_small_samples(spark):
    a, b = [1.1, 2.2, 3.3, 4.4], [5.5, 6.6, 7.7]
    df = spark.createDataFrame([("f", "a", v) for v in a] + [("f", "b", v) for v in b], "feature string, cls string, value double")
    w = tests.wilcoxon_rank_sum(df, "cls").first()
    assert w["w"] == 0 and w["p_value"] == pytest.approx(2 / 35)
    k = tests.ks_two_sample(df, "cls").first()
    assert k["ks_d"] == 1.0 and k["p_value"] == pytest.approx(2 / 35)
    h = tests.kruskal(df, "cls").first()
    assert h["h"] == pytest.approx(4.5) and h["p_value"] == pytest.approx(0.0338948, abs=1e-6)
    t = tests.welch_t(df, "cls").first()
    d = np.mean(a) - np.mean(b)
    se = math.sqrt(np.var(a, ddof=1) / 4 + np.var(b, ddof=1) / 3)
    assert t["t"] == pytest.approx(d / se)
    f = tests.anova_oneway(df, "cls").first()
    pooled = (3 * np.var(a, ddof=1) + 2 * np.var(b, ddof=1)) / 5
    assert f["f"] == pytest.approx(d**2 / (pooled * (1 / 4 + 1 / 3)))


def test_pairwise_tests_choose_by_normality(spark):
    rng = np.random.default_rng(0)
    data = [("norm", c, float(v)) for c, m in (("a", 0), ("b", 3)) for v in rng.normal(m, 1, 30)]
    data += [("skew", c, float(v)) for c, m in (("a", 1), ("b", 9)) for v in rng.exponential(m, 30)]
    data += [("few", "a", 1.0), ("few", "a", 2.0), ("few", "b", 3.0)]
    df = spark.createDataFrame(data, "feature string, cls string, value double")
    got = {r["feature"]: r for r in tests.pairwise_tests(df, "cls").collect()}
    assert set(got) == {"norm", "skew"} and got["norm"]["test"] == "welch" and got["skew"]["test"] == "wilcoxon"
    assert got["norm"]["significant"] and got["norm"]["p_bonferroni"] == pytest.approx(2 * got["norm"]["p_value"])


def test_fligner_ignores_shift(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(0, 1, 40)
    df = spark.createDataFrame([("f", c, float(v * s)) for c, s in (("a", 1), ("b", 6)) for v in base], "feature string, cls string, value double")
    shifted = df.withColumn("value", F.when(F.col("cls") == "b", F.col("value") + 100).otherwise(F.col("value")))
    one, two = tests.fligner(df, "cls").first(), tests.fligner(shifted, "cls").first()
    assert one["p_value"] < 1e-4 and one["x2"] == pytest.approx(two["x2"])


def test_regression_checks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 3))
    x[:, 2] = x[:, 0] * 0.9 + rng.normal(0, 0.3, 200)
    y = 2 + x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1, 200)
    df = reshape.to_vectors(spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "file int, x array<double>, y double"))
    table, r2, model = regression.linear_model(df, "y")
    got = {r["term"]: r["estimate"] for r in table.collect()}
    assert got["intercept"] == pytest.approx(2, abs=0.05) and got["x1"] == pytest.approx(-2, abs=0.05) and r2 > 0.99
    factors = [r["vif"] for r in regression.vif(df).orderBy("idx").collect()]
    assert factors == pytest.approx(list(np.diag(np.linalg.inv(np.corrcoef(x.T)))))
    e = regression.residuals(df, "y", model).withColumn("m", F.lit(1))
    res = np.array([r["residual"] for r in e.orderBy("file").collect()])
    dw = regression.durbin_watson(e, ["m"], "file").first()["durbin_watson"]
    assert dw == pytest.approx((np.diff(res) ** 2).sum() / (res**2).sum())
    assert 0 <= regression.breusch_pagan(df, "y").first()["p_value"] <= 1


def test_split_sizes(spark):
    df = spark.createDataFrame([(i, "a" if i < 7 else "b", "Store-Bought" if i % 2 else "Environmental") for i in range(17)], "file int, y string, source string")
    got = splits.stratified_split(df, "y", 0.7).filter("in_train").groupBy("y").count().collect()
    assert {(r["y"], r["count"]) for r in got} == {("a", 5), ("b", 7)}
    train, test = splits.source_split_half(df, "y")
    assert train.count() + test.count() == 17 and {r["source"] for r in test.collect()} == {"Environmental"}
    with pytest.raises(ValueError):
        splits.source_split(df.filter("source = 'Store-Bought'"))
    balanced = splits.balance_classes(df, "y", "source").groupBy("y").count().collect()
    assert {r["count"] for r in balanced} == {7}
    assert splits.fold_count(df, "y") == 7


def test_scores(spark):
    pred = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "c")], "actual string, predicted string")
    s = metrics.accuracy_kappa(pred).first()
    assert s["accuracy"] == 0.75 and s["kappa"] == pytest.approx((0.75 - 5 / 16) / (1 - 5 / 16))
    assert metrics.balanced_accuracy(pred).first()[0] == pytest.approx(2.5 / 3)
    assert metrics.confusion_table(pred).count() == 9
    probs = spark.createDataFrame(
        [(i, a, c, p) for i, (a, ps) in enumerate([("a", (0.9, 0.1)), ("a", (0.6, 0.4)), ("b", (0.7, 0.3)), ("b", (0.2, 0.8))]) for c, p in zip("ab", ps)],
        "sample int, actual string, class string, prob double",
    )
    assert metrics.multiclass_auc(probs).first()["auc"] == pytest.approx(0.75)
    assert metrics.brier(probs).first()["brier"] == pytest.approx(np.mean([0.01, 0.16, 0.49, 0.04]))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    data = [(i, f"c{i % 3}", [float(v) for v in rng.normal(3 * (i % 3), 0.5, 2)] + [float(rng.normal())]) for i in range(90)]
    return reshape.to_vectors(spark.createDataFrame(data, "file int, y string, x array<double>")).persist()


@pytest.mark.parametrize("name", ["random_forest", "elastic_net", "naive_bayes"])
def test_classifiers_learn_blobs(blobs, name):
    options = {"random_forest": {"settings": [{"numTrees": 10}]}, "elastic_net": {"lambdas": [1e-3]}, "naive_bayes": {}}[name]
    fitted = models.CLASSIFIERS[name](blobs, "y", "file", **options)
    probs = fitted.probabilities(blobs)
    total = probs.groupBy("sample").agg(F.sum("prob").alias("s")).agg(F.min("s"), F.max("s")).first()
    assert total[0] == pytest.approx(1) and total[1] == pytest.approx(1)
    assert models.scores(fitted, blobs)["accuracy"] > 0.9


def test_shuffled_noise_does_not_matter(blobs):
    fitted = models.random_forest(blobs, "y", settings=[{"numTrees": 10}])
    ranked = dict((i, v) for i, v in models.importances(fitted))
    assert sum(ranked.values()) == pytest.approx(1) and ranked[2] < min(ranked[0], ranked[1])
    shuffled = selection.shuffle_feature(blobs, 0, 5)
    before = sorted(r["x"][0] for r in blobs.collect())
    after = sorted(float(r["features"][0]) for r in shuffled.collect())
    assert before == after
    kept = sorted((r["file"], float(r["features"][1])) for r in shuffled.collect())
    assert kept == sorted((r["file"], r["x"][1]) for r in blobs.collect())


def test_cross_validated_neighbours(blobs):
    got = {r["k"]: r["accuracy"] for r in models.knn_choose_k(blobs, "y", (1, 5)).collect()}
    assert set(got) == {1, 5} and min(got.values()) > 0.9


def test_files_round_trip(spark, tmp_path, collect):
    folder = tmp_path / "gc"
    folder.mkdir()
    head = "Start,End,Width,Base.Peak,Cpd,Label,Height,Ions,Area,RT,m.z\n"
    for name, area in (("A_R1.csv", 10), ("B_R2.csv", 20), ("2022-Blank.csv", 5)):
        (folder / name).write_text(head + f"1,2,3,x,c,l,4,i,{area},1.5,98.1\n")
    got = files.read_peaks(spark, str(folder), exclude=["2022"])
    assert collect(got, "file", "value") == [("A_R1.csv", 10.0), ("B_R2.csv", 20.0)]
    assert files.read_peaks(spark, str(folder), include=["2022-"]).count() == 1
    banner = tmp_path / "lc"
    banner.mkdir()
    (banner / "x.csv").write_text("Export v1,,\n" + head + "1,2,3,x,c,l,4,i,7,1.5,98.1\n")
    from peakweave.schema import GC_CSV

    assert collect(files.read_peaks(spark, str(banner), GC_CSV, skip=1), "value", "mz") == [(7.0, 98.1)]
    out = str(tmp_path / "out")
    files.write_table(got, out)
    with pytest.raises(Exception):
        files.write_table(got, out)


def test_summaries(spark, collect):
    df = spark.createDataFrame([("g", float(v)) for v in (1, 2, 3, 4, 100)], "k string, value double")
    box = summary.box_summary(df, ["k"]).first()
    assert (box["q1"], box["median"], box["q3"], box["whisker_high"], box["n_outside"]) == (2.0, 3.0, 4.0, 4.0, 1)
    hist = summary.histogram_by(df, ["k"], "value", 10)
    assert collect(hist, "bin", "n") == [(0, 4), (9, 1)]
    flat = spark.createDataFrame([("g", 2.0), ("g", 2.0)], "k string, value double")
    assert collect(summary.histogram_by(flat, ["k"], "value", 10), "bin", "n") == [(0, 2)]
    qq = collect(summary.qq_points(df, ["k"]), "value", "theoretical")
    assert qq[2][1] == pytest.approx(0, abs=1e-12) and qq[0][1] == pytest.approx(-qq[4][1])
    sets = summary.compare_sets(spark.createDataFrame([("a",), ("b",)], "feature string"), spark.createDataFrame([("b",), ("c",)], "feature string"))
    assert collect(sets) == [("a", "left_only"), ("b", "both"), ("c", "right_only")]


def test_pairs_of_large_classes_are_tested(spark):
    from peakweave.operators.tests import pairwise_tests, shapiro

    for n in (5000, 5001):
        df = spark.range(2 * n).select(F.lit("f").alias("feature"), (F.col("id") % 2).alias("label"), (F.randn(3) + F.col("id") % 2).alias("value"))
        got = pairwise_tests(df, "label").collect()
        assert [(r.n_a, r.n_b, r.test, r.significant) for r in got] == [(n, n, "welch", True)]
        assert {r.normality for r in shapiro(df, ["feature", "label"]).collect()} == {"shapiro" if n == 5000 else "moments"}
    skewed = df.withColumn("value", F.exp("value"))
    assert [r.test for r in pairwise_tests(skewed, "label").collect()] == ["wilcoxon"]


def test_banner_lines_go_by_position(spark, tmp_path, collect):
    from pyspark.sql.types import DoubleType, StringType

    from peakweave.schema import _schema
    from peakweave.sources import files

    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("Export,2023,7\nname,x,y\nfirst,1,2\nempty,,\nlast,bad,4\n")
    got = files.read_with_banner(spark, str(tmp_path), _schema(name=StringType(), x=DoubleType(), y=DoubleType()), 1)
    assert collect(got.select("name", F.coalesce("x", F.lit(-1.0)), F.coalesce("y", F.lit(-1.0)))) == sorted([("first", 1.0, 2.0), ("empty", -1.0, -1.0), ("last", -1.0, 4.0)] * 2)


def test_dense_rows_keep_place_and_gaps(spark):
    from peakweave.operators.reshape import to_rows

    cells = spark.createDataFrame([("a", 1, 2.0), ("a", 3, 4.0), ("b", 2, 5.0)], "file string, feature long, value double")
    rows = {r.file: r.x for r in to_rows(cells, fill=None)[0].collect()}
    assert sorted(v for v in rows["a"] if v is not None) == [2.0, 4.0] and rows["b"].count(None) == 2
    assert all(0.0 in r.x and len(r.x) == 3 for r in to_rows(cells)[0].collect())


def test_normal_quantiles_of_a_very_common_value(spark):
    from peakweave.operators.summary import qq_points

    df = spark.createDataFrame([("k", 1.0)] * 5000 + [("k", 2.0)] * 3, "k string, value double")
    assert sorted(r.position for r in qq_points(df, ["k"]).collect()) == list(range(1, 5004))


def test_moments_of_wide_rows_equal_those_of_narrow_ones(spark):
    from peakweave.operators.distance import cross_moments

    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 23))
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = spark.createDataFrame([([None if np.isnan(v) else float(v) for v in r],) for r in x], "x array<double>").repartition(3)
    one = {(r.a, r.b): tuple(r)[2:] for r in cross_moments(rows).collect()}
    cut = {(r.a, r.b): tuple(r)[2:] for r in cross_moments(rows, block_cols=7, block_rows=16).collect()}
    assert set(one) == set(cut) == {(a, b) for a in range(23) for b in range(a + 1, 23)}
    assert all(np.allclose(one[k], cut[k]) for k in one)
