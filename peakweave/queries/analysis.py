"""Queries on distances, correlations, clusters, projections, statistical tests and corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakweave.operators import cluster, distance, medoids, padjust, pivots, project, regression, reshape, tests
from peakweave.operators.impute_models import impute_forest, impute_knn, impute_low_rank
from peakweave.operators.ordering import average_ranks
from peakweave.queries.registry import CELLS_SQL, VECTORS_SQL, cells, cents, query, rounded, table, vectors

_WIDE = "SELECT a.file AS i, b.file AS j, a.value AS x, b.value AS y FROM vec a JOIN vec b ON a.feature = b.feature AND a.file < b.file"
_METRIC_SQL = {
    "euclidean": "sqrt(sum((x - y) * (x - y)))",
    "maximum": "max(abs(x - y))",
    "manhattan": "sum(abs(x - y))",
    "canberra": "sum(abs(x - y) / (abs(x) + abs(y)))",
    "minkowski": "pow(sum(pow(abs(x - y), 3)), 1.0 / 3)",
}

for _name, _expr in _METRIC_SQL.items():

    def _run(spark, sf, metric=_name):
        return rounded(distance.pairwise_distance(vectors(spark, sf), metric=metric, p=3.0 if metric == "minkowski" else 2.0), "value")

    query(f"distance_{_name}", f"WITH {VECTORS_SQL}, w AS ({_WIDE}) SELECT i, j, round({_expr}, 8) AS value FROM w GROUP BY i, j")(_run)

# files against the positions of a dense matrix: customers' mean order value per priority, some cells empty
_ORDERS_SQL = """o AS (SELECT o_custkey AS file, o_orderpriority AS feature, avg(round(o_totalprice * 100)) AS value FROM orders GROUP BY ALL)"""


def _orders(spark, sf):
    t = table(spark, sf, "orders")
    return t.groupBy(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("feature")).agg(F.avg(cents("o_totalprice")).alias("value"))


_BRAND_SQL = """b AS (SELECT l_suppkey AS file, p_brand AS feature, avg(round(l_extendedprice * 100)) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""


def _brands(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return (
        line.join(part, line["l_partkey"] == part["p_partkey"])
        .groupBy(F.col("l_suppkey").alias("file"), F.col("p_brand").alias("feature"))
        .agg(F.avg(cents("l_extendedprice")).alias("value"))
    )


@query(
    "aitchison_distance",
    f"""WITH {_BRAND_SQL}, g AS (SELECT f.file, x.feature, coalesce(t.v, 0) AS v FROM (SELECT DISTINCT file FROM b) f CROSS JOIN (SELECT DISTINCT feature FROM b) x
LEFT JOIN (SELECT file, feature, ln(value) - avg(ln(value)) OVER (PARTITION BY file) AS v FROM b) t ON t.file = f.file AND t.feature = x.feature)
SELECT a.file AS i, c.file AS j, round(sqrt(sum((a.v - c.v) * (a.v - c.v))), 7) AS value FROM g a JOIN g c ON a.feature = c.feature AND a.file < c.file GROUP BY 1, 2""",
)
def _aitchison(spark, sf):
    return rounded(distance.aitchison_distance(_brands(spark, sf)), "value", digits=7)


@query(
    "robust_aitchison",
    f"""WITH {_ORDERS_SQL}, s AS (SELECT c_nationkey AS file, feature, sum(value) AS value FROM o JOIN customer ON o.file = c_custkey GROUP BY ALL),
t AS (SELECT file, feature, ln(value) - avg(ln(value)) OVER (PARTITION BY file) AS v FROM s)
SELECT a.file AS i, c.file AS j, round(sqrt(sum((a.v - c.v) * (a.v - c.v))), 7) AS value FROM t a JOIN t c ON a.feature = c.feature AND a.file < c.file GROUP BY 1, 2""",
)
def _robust(spark, sf):
    c = table(spark, sf, "customer")
    o = _orders(spark, sf).join(c, F.col("file") == c["c_custkey"]).groupBy(F.col("c_nationkey").alias("f"), "feature").agg(F.sum("value").alias("value"))
    return rounded(distance.aitchison_distance(o.withColumnRenamed("f", "file"), robust=True), "value", digits=7)


@query(
    "gower_distance",
    f"""WITH {VECTORS_SQL}, rg AS (SELECT feature, max(value) - min(value) AS w FROM vec GROUP BY feature),
w AS (SELECT a.file AS i, b.file AS j, abs(a.value - b.value) / rg.w AS d, a.label <> b.label AS c FROM vec a JOIN vec b ON a.feature = b.feature AND a.file < b.file JOIN rg ON rg.feature = a.feature)
SELECT i, j, round((sum(d) + CAST(any_value(c) AS INTEGER)) / (count(*) + 1), 8) AS value FROM w GROUP BY i, j""",
)
def _gower(spark, sf):
    return rounded(distance.gower_distance(vectors(spark, sf), categories=["label"]), "value")


@query(
    "correlation_matrix",
    f"""WITH {VECTORS_SQL} SELECT CAST(a.feature AS INTEGER) AS i, CAST(b.feature AS INTEGER) AS j, round(corr(a.value, b.value), 8) AS value, count(*) AS n
FROM vec a JOIN vec b ON a.file = b.file AND a.feature < b.feature GROUP BY 1, 2""",
)
def _corr(spark, sf):
    return rounded(distance.correlation_matrix(vectors(spark, sf)), "value")


@query(
    "correlation_with_gaps",
    f"""WITH {_ORDERS_SQL} SELECT a.feature AS fi, b.feature AS fj, round(corr(a.value, b.value), 8) AS value, count(*) AS n
FROM o a JOIN o b ON a.file = b.file AND a.feature < b.feature GROUP BY 1, 2""",
)
def _corr_gaps(spark, sf):
    rows, index = reshape.to_rows(_orders(spark, sf), fill=None)
    m = distance.correlation_matrix(rows)
    a = index.select(F.col("idx").alias("i"), F.col("feature").alias("ni"))
    b = index.select(F.col("idx").alias("j"), F.col("feature").alias("nj"))
    named = m.join(a, "i").join(b, "j")
    return rounded(named.select(F.least("ni", "nj").alias("fi"), F.greatest("ni", "nj").alias("fj"), "value", "n"), "value")


@query(
    "spearman",
    f"""WITH {_ORDERS_SQL}, k AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM o)
SELECT a.feature AS fi, b.feature AS fj, round(corr(a.rk, b.rk), 8) AS value, count(*) AS n FROM k a JOIN k b ON a.file = b.file AND a.feature < b.feature GROUP BY 1, 2""",
)
def _spearman(spark, sf):
    m, index = distance.spearman_with_p(_orders(spark, sf))
    a = index.select(F.col("idx").alias("i"), F.col("feature").alias("ni"))
    b = index.select(F.col("idx").alias("j"), F.col("feature").alias("nj"))
    named = m.join(a, "i").join(b, "j")
    return rounded(named.select(F.least("ni", "nj").alias("fi"), F.greatest("ni", "nj").alias("fj"), "value", "n"), "value")


@query("spearman_with_p")
def _spearman_p(spark, sf):
    return distance.spearman_with_p(_orders(spark, sf))[0]


@query(
    "overall_correlation",
    f"""WITH {VECTORS_SQL}, m AS (SELECT corr(a.value, b.value) AS r FROM vec a JOIN vec b ON a.file = b.file AND a.feature < b.feature GROUP BY a.feature, b.feature)
SELECT round(avg(abs(r)), 8) AS mean_abs_r, CAST(max(CASE WHEN abs(r) > 0.8 THEN 1 ELSE 0 END) AS INTEGER) AS any_high FROM m""",
)
def _overall(spark, sf):
    return rounded(distance.overall_correlation(distance.correlation_matrix(vectors(spark, sf))), "mean_abs_r")


@query(
    "correlation_preservation",
    f"""WITH {_ORDERS_SQL}, g AS (SELECT f.file, x.feature, o.value, coalesce(o.value, 0) AS filled FROM (SELECT DISTINCT file FROM o) f CROSS JOIN (SELECT DISTINCT feature FROM o) x
LEFT JOIN o ON o.file = f.file AND o.feature = x.feature),
m AS (SELECT corr(a.value, b.value) AS u, corr(a.filled, b.filled) AS v FROM g a JOIN g b ON a.file = b.file AND a.feature < b.feature GROUP BY a.feature, b.feature)
SELECT round(corr(u, v), 7) AS preservation FROM m""",
)
def _preservation(spark, sf):
    data = _orders(spark, sf)
    gaps, index = reshape.to_rows(data, fill=None)
    filled, _ = reshape.to_rows(data, index=index, fill=0.0)
    out = distance.correlation_preservation(distance.correlation_matrix(gaps), distance.correlation_matrix(filled))
    return rounded(out, "preservation", digits=7)


# clusters and projections ----------------------------------------------------------------------------------------

@query(
    "cluster_resolution",
    """WITH p AS (SELECT label, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings),
c AS (SELECT label, avg(x) AS cx, avg(y) AS cy FROM p GROUP BY label HAVING count(*) > 1),
s AS (SELECT label, cx, cy, avg(sqrt((x - cx) ** 2 + (y - cy) ** 2)) AS d FROM p JOIN c USING (label) GROUP BY ALL)
SELECT a.label AS label_a, b.label AS label_b, round(sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) / (a.d + b.d), 8) AS resolution FROM s a JOIN s b ON a.label < b.label""",
)
def _resolution(spark, sf):
    pts = vectors(spark, sf).select("label", F.col("x")[0].alias("pc1"), F.col("x")[1].alias("pc2"))
    return rounded(cluster.cluster_resolution(pts, "label"), "resolution")


@query(
    "cluster_markers",
    f"""WITH {VECTORS_SQL} SELECT label AS cluster, CAST(feature AS INTEGER) AS feature, round(avg(value), 8) AS mean_value FROM vec GROUP BY ALL HAVING avg(value) > 0.02""",
)
def _markers(spark, sf):
    v = vectors(spark, sf)
    long = reshape.array_to_long(v.select("file", "x"), "file", "x")
    return rounded(cluster.cluster_markers(long, v.select("file", F.col("label").alias("cluster")), 0.02), "mean_value")


_SIL_SQL = f"""WITH {VECTORS_SQL}, w AS ({_WIDE}), d AS (SELECT i, j, sqrt(sum((x - y) * (x - y))) AS value FROM w GROUP BY i, j),
both2 AS (SELECT i, j, value FROM d UNION ALL SELECT j, i, value FROM d),
cl AS (SELECT vec_id AS file, label AS cluster FROM embeddings),
m AS (SELECT b.i, cl.cluster AS other, avg(value) AS m FROM both2 b JOIN cl ON cl.file = b.j GROUP BY ALL),
ab AS (SELECT m.i AS file, cl.cluster, max(CASE WHEN other = cl.cluster THEN m END) AS a, min(CASE WHEN other <> cl.cluster THEN m END) AS b,
  arg_min(other, CASE WHEN other <> cl.cluster THEN m END) AS neighbour FROM m JOIN cl ON cl.file = m.i GROUP BY ALL)
SELECT file, cluster, neighbour, round(coalesce((b - a) / greatest(a, b), 0), 7) AS width FROM ab"""


@query("silhouette", _SIL_SQL)
def _silhouette(spark, sf):
    v = vectors(spark, sf)
    return rounded(cluster.silhouette(distance.pairwise_distance(v), v.select("file", F.col("label").alias("cluster"))), "width", digits=7)


@query("silhouette_rows", _SIL_SQL)
def _silhouette_rows(spark, sf):
    return rounded(cluster.silhouette_rows(vectors(spark, sf).withColumnRenamed("label", "cluster")), "width", digits=7)


@query(
    "threshold_clusters",
    f"""WITH RECURSIVE {VECTORS_SQL}, w AS ({_WIDE}), e AS (SELECT i, j FROM w GROUP BY i, j HAVING sqrt(sum((x - y) * (x - y))) <= 1.1),
e2 AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
reach(file, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e2.j, reach.root FROM reach JOIN e2 ON e2.i = reach.file)
SELECT file, min(root) AS cluster FROM reach GROUP BY file""",
)
def _threshold(spark, sf):
    v = vectors(spark, sf)
    return cluster.threshold_clusters(v.select("file"), distance.pairwise_distance(v, at_most=1.1, forest=True), 1.1)


@query(
    "near_clusters",
    f"""WITH RECURSIVE {VECTORS_SQL}, w AS ({_WIDE}), e AS (SELECT i, j FROM w GROUP BY i, j HAVING sqrt(sum((x - y) * (x - y))) <= 1.1),
e2 AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e),
reach(file, root) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT e2.j, reach.root FROM reach JOIN e2 ON e2.i = reach.file)
SELECT file, min(root) AS cluster FROM reach GROUP BY file""",
)
def _near_clusters(spark, sf):
    return pivots.near_clusters(vectors(spark, sf), 1.1)


# prices and quantities of the parts: rows whose distances pivots can bound
_PLACES_SQL = "places AS (SELECT p_partkey AS file, [p_retailprice / 10.0, p_size * 1.0, (p_partkey % 7) * 1.0] AS x FROM part)"


def _places(spark, sf):
    part = table(spark, sf, "part")
    return part.select(F.col("p_partkey").alias("file"), F.array(F.col("p_retailprice").cast("double") / 10.0, F.col("p_size") * F.lit(1.0), (F.col("p_partkey") % 7) * F.lit(1.0)).alias("x"))


@query(
    "near_pairs",
    f"""WITH {_PLACES_SQL} SELECT a.file AS i, b.file AS j, round(list_distance(a.x, b.x), 8) AS value FROM places a JOIN places b ON a.file < b.file AND list_distance(a.x, b.x) <= 1.5005""",
)
def _near_pairs(spark, sf):
    return rounded(pivots.near_pairs(_places(spark, sf), 1.5005).pairs, "value")


@query(
    "nearest_rows",
    f"""WITH {_PLACES_SQL}, d AS (SELECT a.file, b.file AS n_id, list_distance(a.x, b.x) AS distance FROM places a, places b),
r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY round(distance, 9), n_id) AS rank FROM d)
SELECT file, rank, round(distance, 8) AS distance FROM r WHERE rank <= 5""",
)
def _nearest_rows(spark, sf):
    v = _places(spark, sf)
    return rounded(pivots.nearest(v, v, 5).pairs.select("file", F.col("rank").cast("long").alias("rank"), "distance"), "distance")


@query("kmeans_elbow")
def _elbow(spark, sf):
    return cluster.kmeans_elbow(reshape.to_vectors(vectors(spark, sf)), [1, 2, 5, 10], starts=2)


@query("bisecting_tree")
def _bisecting(spark, sf):
    return cluster.bisecting_tree(reshape.to_vectors(vectors(spark, sf)), 10).select("file", "cluster")


@query("k_medoids")
def _medoids(spark, sf):
    return medoids.k_medoids_of(vectors(spark, sf), 6)


@query("pca")
def _pca(spark, sf):
    return project.pca(reshape.to_vectors(vectors(spark, sf)), 3)[0]


@query(
    "pca_total_variance",
    f"WITH {VECTORS_SQL}, s AS (SELECT feature, var_samp(value) AS v FROM vec GROUP BY feature) SELECT round(sum(v), 6) AS total, CAST(64 AS BIGINT) AS components, round(sum(v), 6) AS explained FROM s",
)
def _pca_total(spark, sf):
    """Variances of all components together are the variance of all columns."""
    found = project.leading_components(vectors(spark, sf), 64)
    return spark.createDataFrame([(round(found.total, 6), len(found.variances), round(float(found.variances.sum()), 6))], "total double, components long, explained double")


@query("wide_pca")
def _wide_pca(spark, sf):
    """Two components of every supplier's prices over all parts: as many columns as parts."""
    rows, _ = reshape.to_rows(cells(spark, sf), sparse=True)
    return project.wide_pca(rows, 2)[0]


@query("pca_contributions")
def _contrib(spark, sf):
    return project.pca_contributions(project.pca(reshape.to_vectors(vectors(spark, sf)), 2, scale=True)[1], 10)


@query("mds")
def _mds(spark, sf):
    return project.mds(reshape.to_vectors(vectors(spark, sf)), 2)


# statistical tests -----------------------------------------------------------------------------------------------

@query(
    "average_ranks",
    f"""WITH {CELLS_SQL} SELECT file, feature, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS avg_rank FROM cells""",
)
def _ranks(spark, sf):
    return average_ranks(cells(spark, sf), ["feature"], "value").select("file", "feature", "avg_rank")


_PAIR_SQL = f"""WITH {CELLS_SQL}, l AS (SELECT DISTINCT plastic_type AS t FROM cells), pairs AS (SELECT a.t AS label_a, b.t AS label_b FROM l a JOIN l b ON a.t < b.t),
u AS (SELECT c.feature, p.label_a, p.label_b, c.value, c.plastic_type = p.label_a AS first FROM cells c JOIN pairs p ON c.plastic_type IN (p.label_a, p.label_b))"""


@query(
    "wilcoxon_rank_sum",
    f"""{_PAIR_SQL}, k AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY feature, label_a, label_b, value) - 1) / 2 AS rk FROM u WINDOW w AS (PARTITION BY feature, label_a, label_b ORDER BY value))
SELECT feature, label_a, label_b, count(*) FILTER (first) AS n_a, count(*) FILTER (NOT first) AS n_b,
sum(rk) FILTER (first) - count(*) FILTER (first) * (count(*) FILTER (first) + 1) / 2 AS w FROM k GROUP BY ALL HAVING n_a > 0 AND n_b > 0""",
)
def _wilcoxon(spark, sf):
    out = tests.pair_distribution(cells(spark, sf), "plastic_type", _classes())
    return out.select("feature", "label_a", "label_b", "n_a", "n_b", "w")


def _classes() -> list[str]:
    return ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("wilcoxon_p")
def _wilcoxon_p(spark, sf):
    return tests.wilcoxon_rank_sum(cells(spark, sf), "plastic_type")


@query(
    "ks_two_sample",
    f"""{_PAIR_SQL}, v AS (SELECT feature, label_a, label_b, value, count(*) FILTER (first) AS ca, count(*) FILTER (NOT first) AS cb FROM u GROUP BY ALL),
f AS (SELECT *, sum(ca) OVER w / sum(ca) OVER p AS fa, sum(cb) OVER w / sum(cb) OVER p AS fb, sum(ca) OVER p AS n_a, sum(cb) OVER p AS n_b FROM v
  WINDOW w AS (PARTITION BY feature, label_a, label_b ORDER BY value), p AS (PARTITION BY feature, label_a, label_b))
SELECT feature, label_a, label_b, round(max(abs(fa - fb)), 10) AS ks_d FROM f WHERE n_a > 0 AND n_b > 0 GROUP BY ALL""",
)
def _ks(spark, sf):
    out = tests.pair_distribution(cells(spark, sf), "plastic_type", _classes())
    return rounded(out.select("feature", "label_a", "label_b", "ks_d"), "ks_d", digits=10)


@query("ks_p")
def _ks_p(spark, sf):
    return tests.ks_two_sample(cells(spark, sf), "plastic_type")


@query(
    "welch_t",
    f"""WITH {CELLS_SQL}, m AS (SELECT feature, plastic_type AS t, count(*) AS n, avg(value) AS mu, var_samp(value) AS v FROM cells GROUP BY ALL HAVING count(*) >= 2),
j AS (SELECT a.feature, a.t AS label_a, b.t AS label_b, a.n AS n_a, b.n AS n_b, a.mu - b.mu AS d, a.v / a.n AS va, b.v / b.n AS vb FROM m a JOIN m b ON a.feature = b.feature AND a.t < b.t)
SELECT feature, label_a, label_b, n_a, n_b, round(d / sqrt(va + vb), 7) AS t, round((va + vb) ** 2 / (va ** 2 / (n_a - 1) + vb ** 2 / (n_b - 1)), 7) AS df FROM j""",
)
def _welch(spark, sf):
    return rounded(tests.welch_t(cells(spark, sf), "plastic_type").drop("p_value"), "t", "df", digits=7)


@query(
    "kruskal",
    f"""WITH {CELLS_SQL}, k AS (SELECT feature, plastic_type, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM cells),
g AS (SELECT feature, plastic_type, count(*) AS n, sum(rk) AS s FROM k GROUP BY ALL),
t AS (SELECT feature, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM cells GROUP BY ALL) GROUP BY feature)
SELECT feature, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS INTEGER) AS n_groups,
round((12 * sum(s * s / n) / (sum(n) * (sum(n) + 1)) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (sum(n) ** 3 - sum(n))), 7) AS h
FROM g JOIN t USING (feature) GROUP BY feature HAVING count(*) > 1""",
)
def _kruskal(spark, sf):
    return rounded(tests.kruskal(cells(spark, sf), "plastic_type", classes=_classes()).drop("p_value"), "h", digits=7)


_ERFC = """1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 70), lambda k: CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END * exp((2 * k + 1) * ln(greatest(z, 1e-9)) - lgamma(k + 1)) / (2 * k + 1)))"""


@query(
    "kruskal_p",
    f"""WITH {CELLS_SQL}, k AS (SELECT feature, plastic_type, value, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS rk FROM cells),
g AS (SELECT feature, plastic_type, count(*) AS n, sum(rk) AS s FROM k GROUP BY ALL),
t AS (SELECT feature, sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT feature, value, count(*) AS c FROM cells GROUP BY ALL) GROUP BY feature),
h AS (SELECT feature, count(*) - 1 AS df, greatest((12 * sum(s * s / n) / (sum(n) * (sum(n) + 1)) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (sum(n) ** 3 - sum(n))), 0) AS h
  FROM g JOIN t USING (feature) GROUP BY feature HAVING count(*) > 1),
z AS (SELECT *, sqrt(h / 2) AS z FROM h)
SELECT feature, round(CASE df WHEN 1 THEN {_ERFC} WHEN 2 THEN exp(-h / 2) WHEN 3 THEN {_ERFC} + sqrt(2 * h / pi()) * exp(-h / 2) ELSE exp(-h / 2) * (1 + h / 2) END, 6) AS p_value FROM z""",
)
def _kruskal_p(spark, sf):
    return rounded(tests.kruskal(cells(spark, sf), "plastic_type").select("feature", "p_value"), "p_value", digits=6)


_ORDER_GROUPS = "g AS (SELECT o_orderstatus AS feature, o_orderpriority AS cls, round(o_totalprice * 100) AS value FROM orders)"


def _order_groups(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderstatus").alias("feature"), F.col("o_orderpriority").alias("cls"), cents("o_totalprice").alias("value"))


_F_SQL = """SELECT feature, CAST(count(*) - 1 AS BIGINT) AS df1, CAST(sum(n) - count(*) AS BIGINT) AS df2,
round((sum(n * (mu - grand) ** 2) / (count(*) - 1)) / (sum(v * (n - 1)) / (sum(n) - count(*))), 6) AS f FROM m JOIN t USING (feature) GROUP BY feature"""


@query(
    "anova_oneway",
    f"""WITH {_ORDER_GROUPS}, m AS (SELECT feature, cls, count(*) AS n, avg(value) AS mu, var_samp(value) AS v FROM g GROUP BY ALL),
t AS (SELECT feature, avg(value) AS grand FROM g GROUP BY feature) {_F_SQL}""",
)
def _anova(spark, sf):
    return rounded(tests.anova_oneway(_order_groups(spark, sf), "cls").drop("p_value"), "f", digits=6)


_DEV = f"""{_ORDER_GROUPS}, md AS (SELECT feature, cls, quantile_cont(value, 0.5) AS md FROM g GROUP BY ALL),
dv AS (SELECT feature, cls, abs(value - md) AS d FROM g JOIN md USING (feature, cls)),
m AS (SELECT feature, cls, count(*) AS n, avg(d) AS mu, var_samp(d) AS v FROM dv GROUP BY ALL)"""


@query("levene_all", f"WITH {_DEV}, t AS (SELECT feature, avg(d) AS grand FROM dv GROUP BY feature) {_F_SQL}")
def _levene_all(spark, sf):
    return rounded(tests.levene(_order_groups(spark, sf), "cls", pairwise=False).drop("p_value"), "f", digits=6)


@query(
    "levene",
    f"""WITH {_DEV} SELECT a.feature, a.cls AS label_a, b.cls AS label_b, a.n + b.n - 2 AS df2,
round((a.n * b.n / (a.n + b.n) * (a.mu - b.mu) ** 2) / ((a.v * (a.n - 1) + b.v * (b.n - 1)) / (a.n + b.n - 2)), 6) AS f
FROM m a JOIN m b ON a.feature = b.feature AND a.cls < b.cls""",
)
def _levene(spark, sf):
    return rounded(tests.levene(_order_groups(spark, sf), "cls").drop("p_value"), "f", digits=6)


@query("fligner")
def _fligner(spark, sf):
    return tests.fligner(_order_groups(spark, sf), "cls")


@query("shapiro")
def _shapiro(spark, sf):
    return tests.shapiro(cells(spark, sf), ["feature", "plastic_type"])


@query("pairwise_tests")
def _pairwise(spark, sf):
    return tests.pairwise_tests(cells(spark, sf), "plastic_type")


@query("wilcoxon_screen")
def _screen(spark, sf):
    return tests.wilcoxon_screen(cells(spark, sf), "plastic_type")


@query("combined_screen")
def _combined(spark, sf):
    return tests.combined_screen(cells(spark, sf), "plastic_type")


_P = "(CAST(round(o_totalprice * 100) AS BIGINT) % 99991 + 1) / 100000.0"


@query(
    "p_adjust",
    f"""WITH t AS (SELECT o_orderkey, o_orderpriority AS family, {_P} AS p_value FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p_value, o_orderkey) AS i, count(*) OVER (PARTITION BY family) AS n FROM t),
a AS (SELECT *, max(p_value * (n - i + 1)) OVER (PARTITION BY family ORDER BY i) AS holm,
 min(p_value * (n - i + 1)) OVER (PARTITION BY family ORDER BY i DESC) AS hoch, min(p_value * n / i) OVER (PARTITION BY family ORDER BY i DESC) AS bh FROM k),
h AS (SELECT family, sum(1.0 / i) AS hs FROM k GROUP BY family)
SELECT o_orderkey, family, round(p_value, 10) AS p_value, round(least(1, p_value * n), 9) AS p_bonferroni, round(least(1, max(holm) OVER (PARTITION BY family, p_value)), 9) AS p_holm,
round(least(1, min(hoch) OVER (PARTITION BY family, p_value)), 9) AS p_hochberg, round(least(1, min(bh) OVER (PARTITION BY family, p_value)), 9) AS "p_BH",
round(least(1, min(bh) OVER (PARTITION BY family, p_value) * hs), 9) AS "p_BY" FROM a JOIN h USING (family)""",
)
def _padjust(spark, sf):
    t = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("family"),
        ((cents("o_totalprice").cast("long") % 99991 + 1) / 100000.0).alias("p_value"),
    )
    methods = ["bonferroni", "holm", "hochberg", "BH", "BY"]
    out = padjust.p_adjust(t, ["family"], "p_value", methods)
    return rounded(rounded(out, *[f"p_{m}" for m in methods], digits=9), "p_value", digits=10)


@query("p_adjust_hommel")
def _hommel(spark, sf):
    t = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_orderpriority").alias("family"),
        ((cents("o_totalprice").cast("long") % 99991 + 1) / 100000.0).alias("p_value"),
    )
    return padjust.p_adjust(t, ["family"], "p_value", ["hommel"])


@query(
    "durbin_watson",
    """WITH e AS (SELECT o_orderpriority AS model, o_orderkey, o_totalprice - 250000 AS residual FROM orders),
s AS (SELECT *, residual - lag(residual) OVER (PARTITION BY model ORDER BY o_orderkey) AS d FROM e)
SELECT model, round(sum(d * d) / sum(residual * residual), 8) AS durbin_watson FROM s GROUP BY model""",
)
def _durbin(spark, sf):
    t = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("model"), "o_orderkey", (F.col("o_totalprice") - 250000).alias("residual"))
    return rounded(regression.durbin_watson(t, ["model"], "o_orderkey"), "durbin_watson")


@query("linear_model")
def _lm(spark, sf):
    return regression.linear_model(reshape.to_vectors(vectors(spark, sf)), "label")[0]


@query("vif")
def _vif(spark, sf):
    return regression.vif(vectors(spark, sf))


@query("breusch_pagan")
def _bp(spark, sf):
    return regression.breusch_pagan(reshape.to_vectors(vectors(spark, sf)), "label")


# imputers that learn ---------------------------------------------------------------------------------------------

@query(
    "impute_knn",
    f"""WITH {_ORDERS_SQL}, rg AS (SELECT feature, max(value) - min(value) AS w FROM o GROUP BY feature),
miss AS (SELECT f.file, x.feature FROM (SELECT DISTINCT file FROM o) f CROSS JOIN (SELECT DISTINCT feature FROM o) x ANTI JOIN o ON o.file = f.file AND o.feature = x.feature),
d AS (SELECT a.file AS i, b.file AS j, avg(abs(a.value - b.value) / w) AS d FROM o a JOIN o b ON a.feature = b.feature AND a.file <> b.file JOIN rg ON rg.feature = a.feature GROUP BY ALL),
donors AS (SELECT m.file, m.feature, b.value, row_number() OVER (PARTITION BY m.file, m.feature ORDER BY d, b.file) AS rn
  FROM miss m JOIN d ON d.i = m.file JOIN o b ON b.file = d.j AND b.feature = m.feature)
SELECT file, feature, round(quantile_cont(value, 0.5), 3) AS value FROM donors WHERE rn <= 5 GROUP BY ALL UNION ALL SELECT file, feature, round(value, 3) FROM o""",
)
def _impute_knn(spark, sf):
    rows, index = reshape.to_rows(_orders(spark, sf), fill=None)
    filled = reshape.array_to_long(impute_knn(rows).select("file", "x"), "file", "x", "idx")
    return rounded(filled.join(index, "idx").filter(F.col("value").isNotNull()).select("file", "feature", "value"), "value", digits=3)


@query("impute_forest")
def _impute_forest(spark, sf):
    return impute_forest(reshape.to_rows(_orders(spark, sf), fill=None)[0], max_iter=2, trees=10)


@query("impute_low_rank")
def _impute_low_rank(spark, sf):
    return impute_low_rank(reshape.to_rows(_orders(spark, sf), fill=None)[0], rank=2)
