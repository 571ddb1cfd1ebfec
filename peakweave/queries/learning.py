"""Queries on splits, classifiers, their scores and feature selection."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.operators import metrics, models, reshape, selection, splits
from peakweave.plans import fingerprint, study
from peakweave.queries.registry import LABELS_SQL, POSITIONED_SQL, cents, labelled_files, positioned, query, rounded, table, vectors

# splits ----------------------------------------------------------------------------------------------------------


@query(
    "stratified_split",
    """WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL)
SELECT label, true AS in_train, CAST(ceil(0.7 * n) AS BIGINT) AS rows FROM n UNION ALL SELECT label, false, n - CAST(ceil(0.7 * n) AS BIGINT) FROM n""",
)
def _split(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("label"))
    return splits.stratified_split(t, "label", 0.7).groupBy("label", "in_train").agg(F.count(F.lit(1)).alias("rows"))


def _two(train, test):
    count = lambda d, part: d.groupBy("plastic_type").agg(F.count(F.lit(1)).alias("rows")).withColumn("part", F.lit(part))
    return count(train, "train").unionByName(count(test, "test")).select("plastic_type", "part", "rows")


@query(
    "source_split",
    f"""WITH {LABELS_SQL} SELECT plastic_type, CASE WHEN source = 'Store-Bought' THEN 'train' ELSE 'test' END AS part, count(*) AS rows FROM labelled_files GROUP BY ALL""",
)
def _source_split(spark, sf):
    return _two(*splits.source_split(labelled_files(spark, sf)))


@query(
    "source_split_half",
    f"""WITH {LABELS_SQL}, n AS (SELECT plastic_type, count(*) FILTER (source = 'Store-Bought') AS s, count(*) FILTER (source = 'Environmental') AS e FROM labelled_files GROUP BY ALL)
SELECT plastic_type, 'train' AS part, s + CAST(ceil(e * 0.5) AS BIGINT) AS rows FROM n UNION ALL SELECT plastic_type, 'test', e - CAST(ceil(e * 0.5) AS BIGINT) FROM n WHERE e > 1""",
)
def _half(spark, sf):
    return _two(*splits.source_split_half(labelled_files(spark, sf), "plastic_type"))


@query(
    "balance_classes",
    f"""WITH {LABELS_SQL}, n AS (SELECT plastic_type, count(*) AS n FROM labelled_files GROUP BY ALL)
SELECT plastic_type, (SELECT min(n) FROM n) AS rows FROM n""",
)
def _balance(spark, sf):
    out = splits.balance_classes(labelled_files(spark, sf), "plastic_type", "source")
    return out.groupBy("plastic_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "stratified_folds",
    """WITH n AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY ALL)
SELECT label, CAST(f AS INTEGER) AS fold, n // 5 + CASE WHEN f < n % 5 THEN 1 ELSE 0 END AS rows FROM n, range(5) r(f)""",
)
def _folds(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderkey").alias("file"), F.col("o_orderpriority").alias("label"))
    return splits.stratified_folds(t, "label", 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


# scores ----------------------------------------------------------------------------------------------------------

# stand-in predictions: two orders in three keep their priority, the others get one by their customer
_PRED_SQL = """names(k, p) AS (VALUES (0, '1-URGENT'), (1, '2-HIGH'), (2, '3-MEDIUM'), (3, '4-NOT SPECIFIED'), (4, '5-LOW')),
pred AS (SELECT o_orderkey AS sample, o_orderpriority AS actual, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE p END AS predicted
  FROM orders JOIN names ON k = o_custkey % 5)"""
_NAMES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def _pred(spark, sf):
    other = F.element_at(F.array(*[F.lit(n) for n in _NAMES]), (F.col("o_custkey") % 5 + 1).cast("int"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("sample"),
        F.col("o_orderpriority").alias("actual"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).otherwise(other).alias("predicted"),
    )


@query(
    "confusion_table",
    f"""WITH {_PRED_SQL}, c AS (SELECT a.p AS actual, b.p AS predicted FROM names a, names b), f AS (SELECT actual, predicted, count(*) AS freq FROM pred GROUP BY ALL),
g AS (SELECT c.actual, c.predicted, coalesce(freq, 0) AS freq FROM c LEFT JOIN f USING (actual, predicted)), t AS (SELECT *, CAST(sum(freq) OVER (PARTITION BY actual) AS BIGINT) AS total FROM g)
SELECT actual, predicted, freq, total, round(freq / total * 100, 2) AS percent, CASE WHEN actual = predicted THEN concat(CAST(round(round(freq / total * 100, 2), 1) AS VARCHAR), '%') ELSE '' END AS label FROM t""",
)
def _confusion(spark, sf):
    return metrics.confusion_table(_pred(spark, sf))


@query(
    "accuracy_kappa",
    f"""WITH {_PRED_SQL}, n AS (SELECT count(*) AS n, count(*) FILTER (actual = predicted) / count(*) AS acc FROM pred),
r AS (SELECT actual AS c, count(*) AS r FROM pred GROUP BY ALL), p AS (SELECT predicted AS c, count(*) AS p FROM pred GROUP BY ALL),
e AS (SELECT sum(CAST(r AS DOUBLE) * p) AS e FROM r JOIN p USING (c))
SELECT round(acc, 10) AS accuracy, round((acc - e / (CAST(n AS DOUBLE) * n)) / (1 - e / (CAST(n AS DOUBLE) * n)), 10) AS kappa FROM n, e""",
)
def _kappa(spark, sf):
    return rounded(metrics.accuracy_kappa(_pred(spark, sf)), "accuracy", "kappa", digits=10)


@query(
    "balanced_accuracy",
    f"""WITH {_PRED_SQL} SELECT round(avg(r), 10) AS balanced_accuracy FROM (SELECT actual, count(*) FILTER (actual = predicted) / count(*) AS r FROM pred GROUP BY actual)""",
)
def _balanced(spark, sf):
    return rounded(metrics.balanced_accuracy(_pred(spark, sf)), "balanced_accuracy", digits=10)


@query("class_errors", f"WITH {_PRED_SQL} SELECT actual, round(count(*) FILTER (actual <> predicted) / count(*), 10) AS error, count(*) AS n FROM pred GROUP BY actual")
def _errors(spark, sf):
    return rounded(metrics.class_errors(_pred(spark, sf)), "error", digits=10)


# ten scores per vector stand in for class probabilities: each adds up every tenth component of the whole vector, in
# whole millionths, so that sums do not depend on their order; a prime scale keeps means off the ties of rounding
_PROB_SQL = """pr AS (
  SELECT vec_id AS sample, CAST(label AS VARCHAR) AS actual, CAST(i % 10 AS VARCHAR) AS class,
         sum(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 1000000)) / 10000019 AS prob
  FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY ALL)"""


def _probs(spark, sf):
    score = lambda k: F.aggregate(
        F.filter("x", lambda v, i: i % 10 == k), F.lit(0.0), lambda total, v: total + F.floor(F.abs(v) * 1000000).cast("double")
    )
    v = vectors(spark, sf).withColumn("scores", F.array(*[score(k) / 10000019 for k in range(10)]))
    return v.select(
        F.col("file").alias("sample"), F.col("label").cast("string").alias("actual"), F.posexplode("scores").alias("k", "prob")
    ).select("sample", "actual", F.col("k").cast("string").alias("class"), "prob")


@query(
    "multiclass_auc",
    f"""WITH {_PROB_SQL}, u AS (SELECT a.class AS scored, a.actual AS ca, b.actual AS cb, avg(CASE WHEN a.prob > b.prob THEN 1.0 WHEN a.prob = b.prob THEN 0.5 ELSE 0.0 END) AS area
  FROM pr a JOIN pr b ON a.class = b.class AND a.actual = a.class AND b.actual <> a.actual GROUP BY ALL)
SELECT round(avg(area), 8) AS auc FROM u""",
)
def _auc(spark, sf):
    return rounded(metrics.multiclass_auc(_probs(spark, sf)), "auc")


@query(
    "brier",
    f"""WITH {_PROB_SQL}, b AS (SELECT avg((prob - CASE WHEN actual = class THEN 1 ELSE 0 END) ** 2) AS b FROM pr)
SELECT round(b, 8) AS brier, round(b / 0.09, 8) AS normalised_brier FROM b""",
)
def _brier(spark, sf):
    return rounded(metrics.brier(_probs(spark, sf)), "brier", "normalised_brier")


@query(
    "mean_probability",
    f"""WITH {_PROB_SQL} SELECT concat('S', actual) AS sample, class, round(avg(prob), 8) AS mean_prob FROM pr GROUP BY ALL""",
)
def _mean_prob(spark, sf):
    named = _probs(spark, sf).withColumn("sample", F.concat(F.lit("S"), "actual", F.lit("_rep"), (F.col("sample") % 5 + 1).cast("string")))
    return rounded(metrics.mean_probability(named), "mean_prob")


@query(
    "knn_classify",
    """WITH v AS (SELECT vec_id, label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS f FROM embeddings),
d AS (SELECT a.vec_id AS sample, b.vec_id AS other, any_value(b.label) AS label, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS d FROM v a JOIN v b ON a.f = b.f GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY d, other) AS rn FROM d),
votes AS (SELECT sample, label, count(*) / 7 AS prob FROM n WHERE rn <= 7 GROUP BY ALL),
best AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY prob DESC, label) AS rn FROM votes)
SELECT sample, e.label AS actual, best.label AS predicted, round(prob, 8) AS prob FROM best JOIN embeddings e ON e.vec_id = sample WHERE rn = 1""",
)
def _knn(spark, sf):
    v = vectors(spark, sf)
    return rounded(models.knn_classify(v, v, "label", 7), "prob")


@query("knn_choose_k")
def _choose_k(spark, sf):
    return models.knn_choose_k(vectors(spark, sf), "label", (1, 3, 5, 7, 9))


# models ----------------------------------------------------------------------------------------------------------


def _train_test(spark, sf):
    marked = splits.stratified_split(reshape.to_vectors(vectors(spark, sf)), "label", 0.7)
    return marked.filter("in_train").drop("in_train"), marked.filter("NOT in_train").drop("in_train")


_FITS = {
    "random_forest": partial(models.random_forest, settings=[{"numTrees": 20, "featureSubsetStrategy": s} for s in ("6", "8")], folds=2),
    "gbm_ovr": partial(models.gbm_ovr, settings=[{"stepSize": 0.1, "maxDepth": 2, "minInstancesPerNode": 1}], trees=3),
    "linear_svm_ovr": partial(models.linear_svm_ovr, costs=[1.0], max_iter=20),
    "elastic_net": partial(models.elastic_net, lambdas=[1e-3, 1e-1], folds=2, max_iter=30),
    "multinomial_logit": partial(models.multinomial_logit, max_iter=30),
    "naive_bayes": models.naive_bayes,
}

for _name, _fit in _FITS.items():

    def _run(spark, sf, fit=_fit):
        train, test = _train_test(spark, sf)
        return fit(train, "label").probabilities(test)

    query(_name)(_run)


def _small_forest(df, label, key="file", **_):
    return models.random_forest(df, label, key, settings=[{"numTrees": 15, "featureSubsetStrategy": "sqrt"}], max_depth=6)


@query("gini_importance")
def _importance(spark, sf):
    train, _ = _train_test(spark, sf)
    return models.importance_table(_small_forest(train, "label"), train)


@query("linear_importance")
def _linear_importance(spark, sf):
    train, _ = _train_test(spark, sf)
    return models.importance_table(models.elastic_net(train, "label", lambdas=[1e-2], max_iter=30), train)


@query("refit_top")
def _refit(spark, sf):
    train, test = _train_test(spark, sf)
    return selection.refit_top(train, test, "label", _small_forest(train, "label"), _small_forest)


@query("permutation_importance")
def _permutation(spark, sf):
    train, test = _train_test(spark, sf)
    return selection.permutation_importance(_small_forest(train, "label"), test, range(64), repeats=10)


@query("permutation_importance_auc")
def _permutation_auc(spark, sf):
    """Areas lost by each class, for the ten strongest features."""
    train, test = _train_test(spark, sf)
    forest = _small_forest(train, "label")
    return selection.permutation_importance(forest, test, selection.ranked_features(forest)[:10], repeats=10, per_class=True, metric="auc")


_CLASS_AREAS_SQL = """WITH p AS (SELECT o_orderstatus AS key, o_orderkey AS sample, 'c' || o_orderkey % 3 AS actual, 'c' || c AS class, (o_orderkey * (c + 7) * 7919 % 1009) / 1009.0 AS prob
  FROM orders, range(3) t(c))"""


def _class_probs(spark, sf):
    """Made-up scores of three classes for each order, keyed by its status."""
    each = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("key"), F.col("o_orderkey").alias("sample"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("c"))
    prob = (F.col("sample") * (F.col("c") + 7) * 7919 % 1009) / F.lit(1009.0)
    return each.select("key", "sample", F.concat(F.lit("c"), (F.col("sample") % 3).cast("string")).alias("actual"), F.concat(F.lit("c"), F.col("c").cast("string")).alias("class"), prob.alias("prob"))


@query(
    "class_auc",
    f"""{_CLASS_AREAS_SQL}, k AS (SELECT key, class, actual = class AS own, rank() OVER (PARTITION BY key, class ORDER BY prob) + (count(*) OVER (PARTITION BY key, class, prob) - 1) / 2.0 AS rk FROM p)
SELECT key, class, round((sum(rk) FILTER (own) - count(*) FILTER (own) * (count(*) FILTER (own) + 1) / 2.0) / (count(*) FILTER (own) * count(*) FILTER (NOT own)), 9) AS auc FROM k GROUP BY ALL""",
)
def _class_auc(spark, sf):
    return rounded(metrics.class_auc(_class_probs(spark, sf), keys=["key"]), "auc", digits=9)


@query(
    "auc_by_key",
    f"""{_CLASS_AREAS_SQL}, q AS (SELECT p.*, a.x AS label_a, a.y AS label_b FROM p, (SELECT 'c' || i AS x, 'c' || j AS y FROM range(3) a(i), range(3) b(j) WHERE i < j) a
  WHERE class IN (a.x, a.y) AND actual IN (a.x, a.y)),
k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY key, label_a, label_b, class, prob) - 1) / 2.0 AS rk FROM q WINDOW w AS (PARTITION BY key, label_a, label_b, class ORDER BY prob)),
areas AS (SELECT key, label_a, label_b, class, (sum(rk) FILTER (actual = class) - count(*) FILTER (actual = class) * (count(*) FILTER (actual = class) + 1) / 2.0) / (count(*) FILTER (actual = class) * count(*) FILTER (actual <> class)) AS u FROM k GROUP BY ALL),
pairs AS (SELECT key, label_a, label_b, avg(u) AS u FROM areas GROUP BY ALL)
SELECT key, round(avg(u), 9) AS auc FROM pairs GROUP BY key""",
)
def _auc_by_key(spark, sf):
    return rounded(metrics.multiclass_auc(_class_probs(spark, sf), keys=["key"]), "auc", digits=9)


@query("partial_dependence")
def _dependence(spark, sf):
    train, test = _train_test(spark, sf)
    forest = _small_forest(train, "label")
    each = [selection.partial_dependence(forest, test, i, selection.feature_grid(train, i)).withColumn("idx", F.lit(i)) for i in selection.ranked_features(forest)[:10]]
    return reduce(DataFrame.unionByName, each)


def _searched(spark, got):
    return spark.createDataFrame([(got["features"], got["accuracy"], got["converged"])], "features array<int>, accuracy double, converged boolean")


@query("forward_addition")
def _forward(spark, sf):
    train, test = _train_test(spark, sf)
    got = selection.forward_addition(train, test, "label", [0, 1], list(range(2, 64)))
    return _searched(spark, got)


@query("recursive_elimination")
def _rfe(spark, sf):
    train, test = _train_test(spark, sf)
    return selection.recursive_elimination(train, test, "label", [64, 16], _small_forest)


@query("backward_elimination")
def _backward(spark, sf):
    train, test = _train_test(spark, sf)
    got = selection.backward_elimination(train, test, "label", list(range(64)))
    return _searched(spark, got)


@query("rf_stability")
def _stability(spark, sf):
    mean, sd = models.rf_stability(reshape.to_vectors(vectors(spark, sf)), "label", [{"numTrees": 10, "featureSubsetStrategy": "sqrt"}], folds=3)
    return spark.createDataFrame([(mean, sd)], "cv_mean double, cv_sd double")


# studies ---------------------------------------------------------------------------------------------------------


def _study_cells(spark, sf):
    """Suppliers by brand, with the supplier's region as the class to learn."""
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        line.join(part, line["l_partkey"] == part["p_partkey"])
        .groupBy(F.col("l_suppkey").alias("file"), F.col("p_brand").alias("feature"))
        .agg(F.avg(cents("l_extendedprice")).alias("value"))
        .join(labelled_files(spark, sf), "file")
    )


_ONE = [{"numTrees": 10, "featureSubsetStrategy": "sqrt"}]


@query("run_classifier_study")
def _study(spark, sf):
    out = study.run_classifier_study(_study_cells(spark, sf), "plastic_type", "store_and_half_field", settings=_ONE, normalizer="tsn")
    return out["confusion"]


@query("screen_preprocessing")
def _screen(spark, sf):
    return study.screen_preprocessing(
        _study_cells(spark, sf), "plastic_type", ("mean", "zero"), ("tsn", "zscore"), "store_and_half_field", _ONE, folds=2
    )


@query("run_all_designs")
def _designs(spark, sf):
    cells = _study_cells(spark, sf).withColumn("combo", F.lit("GC"))
    return study.run_all_designs(cells, "plastic_type", settings=_ONE)


@query("fingerprint_pipeline")
def _pipeline(spark, sf):
    """Raw positions to a fingerprint: aligned, standards removed, blanks subtracted, shared features kept."""
    return fingerprint.fingerprint(positioned(spark, sf).drop("feature"), 5.0, 500.0, "GC", "ATDGCMS", benchmarks=[9_333_333.0], benchmark_tol=500.0)


@query(
    "identify",
    f"""WITH {POSITIONED_SQL}, {LABELS_SQL}, imp AS (SELECT DISTINCT feature FROM positioned WHERE value > 9000000),
cent AS (SELECT feature, round(avg(mz), 4) AS mean_mz FROM positioned WHERE feature IN (SELECT feature FROM imp) GROUP BY feature),
lib AS (SELECT p_name AS name, round(p_retailprice * 10000) + 120 AS mass FROM part),
h AS (SELECT DISTINCT feature, name FROM cent JOIN lib ON mean_mz <= mass + 30 AND mean_mz >= mass - 30)
SELECT feature, name, plastic_type, avg(value) AS mean_value FROM positioned p JOIN h USING (feature) JOIN labelled_files l ON p.file = l.file GROUP BY ALL""",
)
def _identify(spark, sf):
    values = positioned(spark, sf).join(labelled_files(spark, sf).select("file", "plastic_type"), "file")
    important = values.filter(F.col("value") > 9_000_000).select("feature").distinct()
    library = table(spark, sf, "part").select(F.col("p_name").alias("name"), (F.round(F.col("p_retailprice") * 10000) + 120).alias("mass"))
    return fingerprint.identify(values, important, library, 30.0, "plastic_type")[0]
