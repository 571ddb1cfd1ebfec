"""Leading components by blocks of vectors against the direct decomposition."""

import inspect

import numpy as np
import pytest

from peakweave.operators.impute_models import impute_low_rank
from peakweave.operators.ordering import index_features
from peakweave.operators.project import leading_components, pca, wide_pca
from peakweave.operators.reshape import to_rows, to_vectors
from peakweave.queries import analysis


def frame(spark, seed, n, width, rank=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, rank)) @ rng.normal(0, 3, (rank, width)) + rng.normal(0, 0.3, (n, width)) + 5
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "file long, x array<double>").repartition(3)


@pytest.mark.parametrize(("n", "width", "rank"), [(80, 30, 4), (60, 700, 30), (40, 5, 2)])
@pytest.mark.parametrize("scale", [False, True])
def test_variances_equal_the_direct_ones(spark, n, width, rank, scale):
    x, df = frame(spark, width, n, width, rank)
    found = leading_components(df, 3, scale=scale)
    z = (x - x.mean(axis=0)) / (x.std(axis=0, ddof=1) if scale else 1)
    direct = np.linalg.svd(z, compute_uv=False) ** 2 / (n - 1)
    assert found.converged and np.allclose(found.variances, direct[:3], rtol=1e-9) and np.isclose(found.total, direct.sum())


def test_scores_equal_those_of_the_narrow_solver(spark):
    _, df = frame(spark, 7, 50, 12)
    want, loads, shares = pca(to_vectors(df), 2)
    got, loadings, own, converged = wide_pca(df, 2)
    a, b = ({r.file: (r.pc1, r.pc2) for r in t.collect()} for t in (got, want))
    assert converged and all(np.allclose(a[i], b[i], atol=1e-6) for i in b) and np.allclose(own, shares, atol=1e-9)
    a, b = ({(r.idx, r.component): r.loading for r in t.collect()} for t in (loadings, loads))
    assert all(abs(a[k] - b[k]) < 1e-7 for k in b)


def test_flat_spectrum_few_rows_and_none(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (300, 64))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "file long, x array<double>")
    found = leading_components(df, 5)
    assert found.converged and np.allclose(found.variances, np.linalg.eigvalsh(np.cov(x.T))[::-1][:5], rtol=1e-9)
    assert not leading_components(df, 5, most_rounds=1).converged
    assert leading_components(df.limit(1), 2).variances.tolist() == [0.0, 0.0]
    assert wide_pca(df.limit(0), 2)[0].collect() == []


def test_low_rank_fill_settles_or_says_so(spark):
    x, _ = frame(spark, 3, 40, 10, 2)
    gaps = np.random.default_rng(2).random(x.shape) < 0.15
    df = spark.createDataFrame([(i, [None if g else float(v) for v, g in zip(row, gap, strict=True)]) for i, (row, gap) in enumerate(zip(x, gaps, strict=True))], "file long, x array<double>")
    got = np.array([r.x for r in impute_low_rank(df, rank=3, lam=0.1).orderBy("file").collect()])
    assert np.allclose(got[~gaps], x[~gaps]) and np.abs(got - x)[gaps].mean() < 1.0
    with pytest.raises(RuntimeError, match="settle"):
        impute_low_rank(df, rank=3, maxit=1)


@pytest.mark.parametrize(("n", "width"), [(40, 300), (50, 12)])
@pytest.mark.parametrize(("center", "scale"), [(True, False), (True, True), (False, False)])
def test_sparse_rows_have_the_components_of_dense_ones(spark, n, width, center, scale):
    rng = np.random.default_rng(n)
    x = np.where(rng.random((n, width)) < 0.3, rng.normal(2, 1, (n, 2)) @ rng.normal(0, 3, (2, width)) + 4, 0.0)
    cells = spark.createDataFrame([(int(i), int(j), float(x[i, j]), "a") for i, j in zip(*np.nonzero(x), strict=True)], "file long, feature int, value double, label string")
    twice = cells.unionByName(cells.limit(20)).repartition(3)
    (dense, index), (sparse, _) = to_rows(cells, carry=["label"]), to_rows(twice, carry=["label"], sparse=True, index=index_features(cells))
    assert all(len(r.x.idx) == len(set(r.x.idx)) == np.count_nonzero(x[r.file]) for r in sparse.collect())
    want, loads, shares, _ = wide_pca(dense, 2, center, scale, carry=["label"])
    got, loadings, own, converged = wide_pca(sparse, 2, center, scale, carry=["label"])
    assert converged and got.columns == want.columns and np.allclose(own, shares, rtol=1e-8)
    a, b = ({r.file: (r.pc1, r.pc2) for r in t.collect()} for t in (got, want))
    assert a.keys() == b.keys() and all(np.allclose(a[i], b[i], atol=1e-5) for i in b)
    a, b = ({(r.idx, r.component): r.loading for r in t.collect()} for t in (loadings, loads))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in b)


def test_sparse_rows_that_are_none_equal_or_one(spark):
    cells = spark.createDataFrame([(i, j, 2.0) for i in range(3) for j in range(5)], "file long, feature int, value double")
    assert wide_pca(to_rows(cells.limit(0), sparse=True)[0], 2)[0].collect() == []
    for some in (cells, cells.filter("file = 1")):
        scores, loadings, shares, converged = wide_pca(to_rows(some, sparse=True)[0], 2)
        assert converged and all(abs(r.pc1) + abs(r.pc2) < 1e-9 for r in scores.collect()) and loadings.count() == 10 and max(shares) < 1e-9
    with pytest.raises(ValueError, match="sparse"):
        to_rows(cells, fill=None, sparse=True)
    assert "sparse=True" in inspect.getsource(analysis._wide_pca), "the query lays out no row"
