"""Queries on values: summaries, rankings, imputation, normalisation, matching and alignment."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakweave.operators import align, implicit, impute, match, normalize, summary
from peakweave.operators.prevalence import feature_centroids
from peakweave.queries.registry import (
    CELLS_SQL,
    PEAKS_SQL,
    POSITIONED_SQL,
    SAMPLES_SQL,
    cells,
    cents,
    dealt,
    peaks,
    positioned,
    query,
    r,
    rounded,
    sample_cells,
    table,
)
from peakweave.session import materialize


@query(
    "group_mean_sd",
    f"""WITH {CELLS_SQL} SELECT plastic_type, feature, round(avg(value), 4) AS value_mean, round(stddev_samp(value), 4) AS value_sd, count(value) AS n
FROM cells GROUP BY ALL""",
)
def _mean_sd(spark, sf):
    return rounded(summary.mean_sd(cells(spark, sf), ["plastic_type", "feature"]), "value_mean", "value_sd", digits=4)


@query(
    "compounds_per_sample",
    f"""WITH {CELLS_SQL}, n AS (SELECT subcategory, file, count(DISTINCT feature) AS c FROM cells GROUP BY ALL)
SELECT subcategory, round(avg(c), 8) AS mean_features, round(stddev_samp(c), 8) AS sd_features FROM n GROUP BY subcategory""",
)
def _compounds(spark, sf):
    return rounded(summary.compounds_per_sample(cells(spark, sf)), "mean_features", "sd_features")


@query("feature_prevalence", f"WITH {PEAKS_SQL} SELECT feature, count(*) FILTER (value <> 0) AS n_values, avg(value) FILTER (value <> 0) AS mean_value FROM peaks GROUP BY feature")
def _prevalence(spark, sf):
    return summary.feature_prevalence(peaks(spark, sf))


@query(
    "most_prevalent",
    f"WITH {PEAKS_SQL} SELECT feature, count(*) AS n_values, avg(value) AS mean_value FROM peaks GROUP BY feature ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10",
)
def _most(spark, sf):
    return summary.most_prevalent(peaks(spark, sf))


@query(
    "describe_table",
    " UNION ALL ".join(
        f"""SELECT '{v}' AS variable, count(x) AS n, count(*) - count(x) AS missing, count(DISTINCT x) AS "distinct", avg(x) AS mean, min(x) AS lowest, max(x) AS highest,
quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95
FROM (SELECT {e} AS x FROM lineitem)"""
        for v, e in (("price", "round(l_extendedprice * 100)"), ("quantity", "l_quantity"))
    ).replace("quantile_cont(x, ", "round(quantile_cont(x, ").replace(") AS q", "), 4) AS q"),
)
def _describe(spark, sf):
    t = table(spark, sf, "lineitem").select(cents("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"))
    return rounded(summary.describe_table(t, ["price", "quantity"]), "q05", "q25", "q50", "q75", "q95", digits=4)


@query(
    "occurrence_share",
    f"""WITH {CELLS_SQL} SELECT source, feature, round(count(DISTINCT file) / (SELECT count(DISTINCT file) FROM cells) * 100, 8) AS share FROM cells
WHERE value <> 0 GROUP BY ALL""",
)
def _occurrence(spark, sf):
    return rounded(summary.occurrence_share(cells(spark, sf)), "share")


@query(
    "histogram_by_file",
    f"""WITH {PEAKS_SQL}, b AS (SELECT file, min(value) AS lo, max(value) AS hi FROM peaks GROUP BY file),
h AS (SELECT p.file, lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(29, floor((value - lo) / ((hi - lo) / 30))) END AS INTEGER) AS bin FROM peaks p JOIN b ON p.file = b.file)
SELECT file, bin, count(*) AS n, round(any_value(lo) + bin * ((any_value(hi) - any_value(lo)) / 30), 4) AS bin_start FROM h GROUP BY file, bin""",
)
def _histogram(spark, sf):
    return rounded(summary.histogram_by(peaks(spark, sf), ["file"], "value"), "bin_start", digits=4)


@query(
    "box_summary",
    f"""WITH {CELLS_SQL}, q AS (SELECT plastic_type, min(value) AS lowest, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
quantile_cont(value, 0.75) AS q3, max(value) AS highest FROM cells GROUP BY plastic_type),
w AS (SELECT c.plastic_type, min(value) FILTER (ins) AS wl, max(value) FILTER (ins) AS wh, count(*) FILTER (NOT ins) AS o FROM
 (SELECT c.plastic_type, value, value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ins FROM cells c JOIN q USING (plastic_type)) c GROUP BY 1)
SELECT plastic_type, round(lowest, 4) AS lowest, round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3, round(highest, 4) AS highest,
round(wl, 4) AS whisker_low, round(wh, 4) AS whisker_high, o AS n_outside FROM q JOIN w USING (plastic_type)""",
)
def _box(spark, sf):
    out = summary.box_summary(cells(spark, sf), ["plastic_type"])
    return rounded(out, "lowest", "q1", "median", "q3", "highest", "whisker_low", "whisker_high", digits=4)


@query(
    "bin2d_mean",
    f"""WITH {POSITIONED_SQL} SELECT CAST(floor(mz / 50000) AS BIGINT) AS x_bin, CAST(floor(rt / 250) AS BIGINT) AS y_bin, avg(value) AS mean_value, count(*) AS n FROM positioned GROUP BY 1, 2""",
)
def _bin2d(spark, sf):
    return summary.bin2d_mean(positioned(spark, sf), "mz", "rt", "value", 50_000, 250)


@query("qq_points")
def _qq(spark, sf):
    t = table(spark, sf, "orders").select("o_orderpriority", cents("o_totalprice").alias("value"))
    return summary.qq_points(t, ["o_orderpriority"])


_RANKED = "SELECT *, row_number() OVER (PARTITION BY {k} ORDER BY {v} DESC, feature) AS rank FROM {t}"


@query(
    "top_k_by_mean",
    f"""WITH {CELLS_SQL}, m AS (SELECT subcategory, feature, avg(value) AS mean_value FROM cells GROUP BY ALL), k AS ({_RANKED.format(k='subcategory', v='mean_value', t='m')})
SELECT subcategory, feature, round(mean_value, 4) AS mean_value, rank FROM k WHERE rank <= 10""",
)
def _topmean(spark, sf):
    return rounded(summary.top_k_by_mean(cells(spark, sf), "subcategory"), "mean_value", digits=4)


@query(
    "top_k_by_occurrence",
    f"""WITH {CELLS_SQL}, m AS (SELECT source, feature, count(DISTINCT file) / (SELECT count(DISTINCT file) FROM cells) * 100 AS share FROM cells WHERE value <> 0 GROUP BY ALL),
k AS ({_RANKED.format(k='source', v='share', t='m')}) SELECT source, feature, round(share, 8) AS share, rank FROM k WHERE rank <= 10""",
)
def _topocc(spark, sf):
    return rounded(summary.top_k_by_occurrence(cells(spark, sf)), "share")


@query(
    "top_k_per_sample",
    f"""WITH {CELLS_SQL}, k AS ({_RANKED.format(k='file', v='value', t='cells')}) SELECT file, feature, value, rank FROM k WHERE rank <= 10""",
)
def _topsample(spark, sf):
    return summary.top_k_per_sample(cells(spark, sf).select("file", "feature", "value"))


@query(
    "sort_head",
    f"WITH {PEAKS_SQL} SELECT scan, line, value FROM peaks ORDER BY value DESC, scan, line LIMIT 100",
)
def _head(spark, sf):
    return peaks(spark, sf).select("scan", "line", "value").orderBy(F.desc("value"), "scan", "line").limit(100)


@query(
    "rank_rows",
    f"""WITH {CELLS_SQL}, m AS (SELECT plastic_type, source, count(*) AS n, sum(value) AS total FROM cells GROUP BY ALL)
SELECT plastic_type, source, n, row_number() OVER (ORDER BY n DESC, total ASC, plastic_type, source) AS rank FROM m""",
)
def _rank(spark, sf):
    m = cells(spark, sf).groupBy("plastic_type", "source").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return summary.rank_rows(m, [F.desc("n"), F.asc("total"), F.asc("plastic_type"), F.asc("source")]).drop("total")


@query(
    "compare_sets",
    f"""WITH {PEAKS_SQL}, a AS (SELECT DISTINCT feature FROM peaks WHERE type = 'Blanks' AND value > 3000000), b AS (SELECT DISTINCT feature FROM peaks WHERE type = 'Sample' AND value > 9000000)
SELECT coalesce(a.feature, b.feature) AS feature, CASE WHEN a.feature IS NULL THEN 'right_only' WHEN b.feature IS NULL THEN 'left_only' ELSE 'both' END AS side FROM a FULL JOIN b ON a.feature = b.feature""",
)
def _sets(spark, sf):
    data = peaks(spark, sf)
    a = data.filter((F.col("type") == "Blanks") & (F.col("value") > 3_000_000))
    b = data.filter((F.col("type") == "Sample") & (F.col("value") > 9_000_000))
    return summary.compare_sets(a, b)


@query(
    "source_difference",
    f"""WITH {CELLS_SQL} SELECT subcategory, feature, CASE WHEN bool_or(source = 'Environmental') THEN 'both' ELSE 'store_only' END AS found_in
FROM cells GROUP BY ALL HAVING bool_or(source = 'Store-Bought')""",
)
def _difference(spark, sf):
    return summary.source_difference(cells(spark, sf), "subcategory")


# imputation ------------------------------------------------------------------------------------------------------

_GRID_SQL = f"""WITH {PEAKS_SQL}, c AS (SELECT file, feature, avg(value) AS value FROM peaks GROUP BY ALL),
grid AS (SELECT f.file, x.feature FROM (SELECT DISTINCT file FROM c) f, (SELECT DISTINCT feature FROM c) x),
g AS (SELECT grid.file, grid.feature, c.value FROM grid LEFT JOIN c ON c.file = grid.file AND c.feature = grid.feature)"""


def _cells(spark, sf):
    return peaks(spark, sf).groupBy("file", "feature").agg(F.avg("value").alias("value"))


def _stored(spark, sf):
    """The cells gathered once: names, fills and results are all read from them."""
    dealt_peaks = dealt(spark, sf, peaks(spark, sf), "file", "feature")
    return materialize(dealt_peaks.groupBy("file", "feature").agg(F.avg("value").alias("value")), "cells")


def _filled(imputer, *data):
    """Filled cells, rounded: a fill before it is laid out, as rounding takes longer than all else."""
    return imputer(*data, change=lambda v: r(v, 4)).select("file", "feature", "value")


for _name, _fill in (
    ("impute_zero", "SELECT feature, 0.0 AS fill FROM c GROUP BY feature"),
    ("impute_mean", "SELECT feature, avg(value) AS fill FROM c GROUP BY feature"),
    ("impute_median", "SELECT feature, quantile_cont(value, 0.5) AS fill FROM c GROUP BY feature"),
    ("impute_half_min", "SELECT feature, min(CASE WHEN value > 0 THEN value END) / 2 AS fill FROM c GROUP BY feature"),
):

    def _run(spark, sf, method=_name.removeprefix("impute_")):
        return _filled(impute.IMPUTERS[method], _stored(spark, sf))

    query(
        _name,
        f"{_GRID_SQL}, f AS ({_fill}) SELECT file, g.feature, round(coalesce(value, fill), 4) AS value FROM g JOIN f ON g.feature = f.feature",
    )(_run)


@query("impute_none", f"WITH {PEAKS_SQL} SELECT file, feature, avg(value) AS value FROM peaks GROUP BY ALL")
def _none(spark, sf):
    return impute.impute_none(_cells(spark, sf))


@query(
    "impute_half_min_technique",
    f"""WITH {SAMPLES_SQL}, grid AS (SELECT f.file, x.feature, f.technique FROM (SELECT DISTINCT file, technique FROM cells) f JOIN (SELECT DISTINCT feature, technique FROM cells) x ON f.technique = x.technique),
m AS (SELECT technique, min(value) / 2 AS fill FROM cells GROUP BY technique)
SELECT grid.file, grid.feature, grid.technique, coalesce(c.value, fill) AS value FROM grid JOIN m ON m.technique = grid.technique
LEFT JOIN cells c ON c.file = grid.file AND c.feature = grid.feature""",
)
def _halftech(spark, sf):
    out = impute.impute_half_min_technique(materialize(sample_cells(spark, sf).select("file", "feature", "technique", "value"), "cells"))
    return out.select("file", "feature", "technique", "value")


@query(
    "impute_uniform_lod",
    f"""{_GRID_SQL}, two AS (SELECT value FROM c ORDER BY value LIMIT 2)
SELECT file, count(*) AS cells, count(*) - count(value) AS missing, true AS within FROM g GROUP BY file""",
)
def _uniform(spark, sf):
    data = _stored(spark, sf)
    bounds = F.broadcast(impute.two_smallest(data))
    out = impute.impute_uniform_lod(data, seed=7).join(bounds, F.lit(True))
    ok = ~F.col("imputed") | F.col("value").between(F.col("lo"), F.col("hi"))
    return out.groupBy("file").agg(
        F.count(F.lit(1)).alias("cells"), F.count(F.when(F.col("imputed"), 1)).alias("missing"), F.min(ok).alias("within")
    )


@query(
    "impute_blank_lod",
    f"""{_GRID_SQL}, b AS (SELECT feature, avg(value) + 3 * stddev_samp(value) AS fill FROM peaks WHERE type = 'Blanks' GROUP BY feature HAVING count(value) >= 2)
SELECT file, g.feature, round(coalesce(value, fill, (SELECT min(value) FROM c)), 4) AS value FROM g LEFT JOIN b ON g.feature = b.feature""",
)
def _lod(spark, sf):
    return _filled(impute.impute_blank_lod, _stored(spark, sf), peaks(spark, sf))


# implied cells: figures of the filled matrix without laying it out

@query(
    "implied_moments",
    f"""{_GRID_SQL}, f AS (SELECT feature, min(CASE WHEN value > 0 THEN value END) / 2 AS fill FROM c GROUP BY feature), d AS (SELECT g.feature, value IS NULL AS gone, coalesce(value, fill) AS v FROM g JOIN f ON g.feature = f.feature)
SELECT feature, CAST(count(*) FILTER (gone) AS BIGINT) AS n_absent, round(avg(v), 3) AS mean, round(stddev_samp(v), 3) AS sd, round(min(v), 3) AS low, round(max(v), 3) AS high FROM d GROUP BY feature""",
)
def _implied_moments(spark, sf):
    data = _cells(spark, sf)
    found = implicit.implicit(data, impute.half_min_fills(data)).moments().drop("total")
    return rounded(found.withColumn("n_absent", F.col("n_absent").cast("long")), "mean", "sd", "low", "high", digits=3)


@query(
    "implied_file_totals",
    f"""{_GRID_SQL}, f AS (SELECT feature, avg(value) AS fill FROM c GROUP BY feature)
SELECT file, round(sum(coalesce(value, fill)), 2) AS total FROM g JOIN f ON g.feature = f.feature GROUP BY file""",
)
def _implied_totals(spark, sf):
    data = _cells(spark, sf)
    return rounded(implicit.implicit(data, impute.mean_fills(data)).file_totals(), "total", digits=2)


@query(
    "implied_zscore",
    f"""{_GRID_SQL}, d AS (SELECT file, g.feature, coalesce(value, 0) AS v FROM g), s AS (SELECT feature, avg(v) AS m, stddev_samp(v) AS sd FROM d GROUP BY feature)
SELECT file, d.feature, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END, 7) AS value FROM d JOIN s ON d.feature = s.feature""",
)
def _implied_zscore(spark, sf):
    data = _stored(spark, sf)
    scores = implicit.implicit(data, impute.zero_fills(data)).zscore()
    # rounded before fills are laid out: rounding takes longer than all else
    return scores.mapped(lambda v: r(v, 7)).long().drop("imputed")


# normalisation ---------------------------------------------------------------------------------------------------

_PLAIN = f"WITH {PEAKS_SQL}, c AS (SELECT file, feature, avg(value) AS value FROM peaks GROUP BY ALL)"

for _name, _body, _fn in (
    ("norm_tsn", "SELECT file, feature, round(value / sum(value) OVER (PARTITION BY file), 12) AS value FROM c", lambda d: rounded(normalize.norm_tsn(d), "value", digits=12)),
    (
        "norm_minmax",
        "SELECT file, feature, round(CASE WHEN hi = lo THEN 0 ELSE (value - lo) / (hi - lo) END, 8) AS value FROM (SELECT *, min(value) OVER (PARTITION BY feature) AS lo, max(value) OVER (PARTITION BY feature) AS hi FROM c)",
        lambda d: rounded(normalize.norm_minmax(d), "value"),
    ),
    (
        "norm_zscore",
        "SELECT file, feature, round(CASE WHEN coalesce(s, 0) = 0 THEN 0 ELSE (value - m) / s END, 7) AS value FROM (SELECT *, avg(value) OVER (PARTITION BY feature) AS m, stddev_samp(value) OVER (PARTITION BY feature) AS s FROM c)",
        lambda d: rounded(normalize.norm_zscore(d), "value", digits=7),
    ),
    ("norm_log10", "SELECT file, feature, round(log10(value + 1), 10) AS value FROM c", lambda d: rounded(normalize.norm_log10(d), "value", digits=10)),
    ("norm_ln", "SELECT file, feature, round(ln(value), 10) AS value FROM c", lambda d: rounded(normalize.norm_ln(d), "value", digits=10)),
    ("norm_none", "SELECT file, feature, value FROM c", normalize.norm_none),
    ("robust_clr", "SELECT file, feature, round(ln(value) - avg(ln(value)) OVER (PARTITION BY file), 6) AS value FROM c", lambda d: rounded(normalize.robust_clr(d), "value", digits=6)),
):

    def _run(spark, sf, fn=_fn):
        return fn(_cells(spark, sf))

    query(_name, f"{_PLAIN} {_body}")(_run)


# matching and alignment ------------------------------------------------------------------------------------------

_LIBRARY_SQL = """lib AS (SELECT p_partkey, p_name AS name, round(p_retailprice * 10000) + 120 AS mass FROM part),
cent AS (SELECT feature, round(avg(mz), 0) AS mean_mz FROM positioned GROUP BY feature)"""


def _library(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), (F.round(F.col("p_retailprice") * 10000) + 120).alias("mass"))


def _features(spark, sf):
    return feature_centroids(positioned(spark, sf), digits=0).select("feature", "mean_mz")


@query(
    "library_hits",
    f"""WITH {POSITIONED_SQL}, {_LIBRARY_SQL} SELECT DISTINCT mass, feature, mean_mz FROM lib JOIN cent ON mean_mz <= mass + 30 AND mean_mz >= mass - 30""",
)
def _hits(spark, sf):
    return match.library_hits(_features(spark, sf), _library(spark, sf), 30.0)


_MATCH_SQL = f"""WITH {POSITIONED_SQL}, {_LIBRARY_SQL}, h AS (SELECT DISTINCT mass, feature FROM lib JOIN cent ON mean_mz <= mass + 30 AND mean_mz >= mass - 30),
j AS (SELECT mass, string_agg(CAST(feature AS VARCHAR), ', ' ORDER BY CAST(feature AS VARCHAR)) AS features, count(*) AS n_features FROM h GROUP BY mass)"""


@query(
    "match_library_first",
    f"""{_MATCH_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY mass ORDER BY name, p_partkey) AS rn FROM lib)
SELECT mass, p_partkey, name, features, n_features FROM one JOIN j USING (mass) WHERE rn = 1""",
)
def _first(spark, sf):
    return match.match_library(_features(spark, sf), _library(spark, sf), 30.0, "first", ("name", "p_partkey"))


@query("match_library_all", f"{_MATCH_SQL} SELECT mass, p_partkey, name, features, n_features FROM lib JOIN j USING (mass)")
def _all(spark, sf):
    return match.match_library(_features(spark, sf), _library(spark, sf), 30.0, "all")


@query(
    "annotate_and_average",
    f"""WITH {POSITIONED_SQL}, {_LIBRARY_SQL}, h AS (SELECT DISTINCT feature, name FROM lib JOIN cent ON mean_mz <= mass + 30 AND mean_mz >= mass - 30)
SELECT feature, name, file % 5 AS class, avg(value) AS mean_value FROM positioned JOIN h USING (feature) GROUP BY ALL""",
)
def _annotate(spark, sf):
    hits = match.library_hits(_features(spark, sf), _library(spark, sf), 30.0).join(_library(spark, sf).select("mass", "name").distinct(), "mass")
    values = positioned(spark, sf).withColumn("class", F.col("file") % 5)
    return match.annotate_and_average(values, hits.select("feature", "name").distinct(), ["name", "class"])


@query(
    "annotate_by_joined_name",
    f"""{_MATCH_SQL}, one AS (SELECT *, row_number() OVER (PARTITION BY mass ORDER BY name, p_partkey) AS rn FROM lib),
mm AS (SELECT DISTINCT features, name FROM one JOIN j USING (mass) WHERE rn = 1)
SELECT feature, name, avg(value) AS mean_value FROM positioned JOIN mm ON CAST(feature AS VARCHAR) = features GROUP BY ALL""",
)
def _joined_name(spark, sf):
    matched = match.match_library(_features(spark, sf), _library(spark, sf), 30.0, "first", ("name", "p_partkey")).select("features", "name").distinct()
    return match.annotate_by_joined_name(positioned(spark, sf), matched, ["name"])


# The rule as SQL: a peak belongs to the first peak, in (rt, mz) order, whose box holds it.
_ALIGN_SQL = """pts AS (SELECT DISTINCT rt, mz, floor(mz / 501) AS cell FROM positioned),
claim AS (SELECT q.rt, q.mz, min(struct_pack(rt := a.rt, mz := a.mz)) AS anchor
  FROM pts q JOIN (SELECT rt, mz, unnest([cell - 1, cell, cell + 1]) AS cell FROM pts) a ON a.cell = q.cell
  WHERE q.rt <= a.rt + 5 AND q.rt >= a.rt - 5 AND q.mz <= a.mz + 500 AND q.mz >= a.mz - 500 GROUP BY ALL),
named AS (SELECT rt, mz, dense_rank() OVER (ORDER BY anchor) AS nr FROM claim)"""


@query(
    "align_features",
    f"""WITH {POSITIONED_SQL}, {_ALIGN_SQL}
SELECT scan, line, concat('Compound_', CAST(nr AS VARCHAR), '.ATDGCMS') AS aligned FROM positioned JOIN named USING (rt, mz)""",
)
def _align(spark, sf):
    return align.align_features(positioned(spark, sf), 5.0, 500.0, out="aligned").select("scan", "line", "aligned")


@query(
    "align_features_split",
    f"""WITH {POSITIONED_SQL}, pts AS (SELECT DISTINCT rt, mz, rt > 2500 AS late, floor(mz / 501) AS cell FROM positioned),
claim AS (SELECT q.rt, q.mz, q.late, min(struct_pack(rt := a.rt, mz := a.mz)) AS anchor
  FROM pts q JOIN (SELECT rt, mz, late, unnest([cell - 1, cell, cell + 1]) AS cell FROM pts) a ON a.cell = q.cell AND a.late = q.late
  WHERE abs(q.rt - a.rt) <= CASE WHEN q.late THEN 28 ELSE 40 END AND q.mz <= a.mz + 500 AND q.mz >= a.mz - 500 GROUP BY ALL),
named AS (SELECT rt, mz, late, dense_rank() OVER (PARTITION BY late ORDER BY anchor) AS nr FROM claim)
SELECT scan, line, concat('Compound_RT', CASE WHEN late THEN '2' ELSE '1' END, '_', CAST(nr AS VARCHAR), '.HPLCTOFMS') AS aligned
FROM positioned JOIN named USING (rt, mz)""",
)
def _align_split(spark, sf):
    out = align.align_features(positioned(spark, sf), 40.0, 500.0, 2500.0, 28.0, "HPLCTOFMS", out="aligned")
    return out.select("scan", "line", "aligned")


def _sweep_sql(tol: int) -> str:
    return f"""SELECT {tol}.0 AS rt_tol, CAST(NULL AS DOUBLE) AS rt_tol_late, s.scope, 'early' AS part, count(DISTINCT anchor) AS n_features FROM (
  SELECT q.rt, q.mz, min(struct_pack(rt := a.rt, mz := a.mz)) AS anchor
  FROM pts q JOIN (SELECT rt, mz, unnest([cell - 1, cell, cell + 1]) AS cell FROM pts) a ON a.cell = q.cell
  WHERE q.rt <= a.rt + {tol} AND q.rt >= a.rt - {tol} AND q.mz <= a.mz + 500 AND q.mz >= a.mz - 500 GROUP BY ALL) c
JOIN scopes s ON s.lo IS NULL OR c.mz BETWEEN s.lo AND s.hi GROUP BY s.scope"""


@query(
    "alignment_sweep",
    f"""WITH {POSITIONED_SQL}, pts AS (SELECT DISTINCT rt, mz, floor(mz / 501) AS cell FROM positioned),
scopes(scope, lo, hi) AS (VALUES ('all', NULL, NULL), ('9100000.0', 9099000, 9101000), ('9500000.0', 9499000, 9501000))
{_sweep_sql(5)} UNION ALL {_sweep_sql(20)}""",
)
def _sweep(spark, sf):
    data = positioned(spark, sf)
    return align.alignment_sweep(data.drop("feature"), [(5.0, None), (20.0, None)], 500.0, [9_100_000.0, 9_500_000.0], 1000.0)


@query(
    "alignment_sweep_split",
    f"""WITH {POSITIONED_SQL}, pts AS (SELECT DISTINCT rt, mz, CASE WHEN rt > 2500 THEN 'late' ELSE 'early' END AS part, floor(mz / 501) AS cell FROM positioned),
settings(rt_tol, rt_tol_late) AS (VALUES (10.0::DOUBLE, 5.0::DOUBLE), (40.0, 28.0), (20.0, 60.0)),
scopes(scope, lo, hi) AS (VALUES ('all', NULL, NULL), ('9100000.0', 9099000, 9101000), ('9500000.0', 9499000, 9501000)),
claim AS (SELECT rt_tol, rt_tol_late, q.part, q.rt, q.mz, min(struct_pack(rt := a.rt, mz := a.mz)) AS anchor
  FROM pts q JOIN (SELECT rt, mz, part, unnest([cell - 1, cell, cell + 1]) AS cell FROM pts) a ON a.cell = q.cell AND a.part = q.part, settings
  WHERE abs(q.rt - a.rt) <= CASE q.part WHEN 'late' THEN rt_tol_late ELSE rt_tol END AND abs(q.mz - a.mz) <= 500 GROUP BY ALL)
SELECT rt_tol, rt_tol_late, scope, part, count(DISTINCT anchor) AS n_features FROM claim JOIN scopes s ON s.lo IS NULL OR mz BETWEEN s.lo AND s.hi GROUP BY ALL""",
)
def _sweep_split(spark, sf):
    settings = [(10.0, 5.0), (40.0, 28.0), (20.0, 60.0)]
    return align.alignment_sweep(positioned(spark, sf).drop("feature"), settings, 500.0, [9_100_000.0, 9_500_000.0], 1000.0, 2500.0, "HPLCTOFMS")
