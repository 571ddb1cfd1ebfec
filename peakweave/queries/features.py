"""Queries on peaks and features: cutoffs, blanks, prevalence, missing-value rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from peakweave.operators import blanks, missing, prevalence
from peakweave.operators.match import attach_labels
from peakweave.plans.fingerprint import strongest_features
from peakweave.queries.registry import (
    CELLS_SQL,
    LABELS_SQL,
    PEAKS_SQL,
    POSITIONED_SQL,
    SAMPLES_SQL,
    cells,
    labelled_files,
    peaks,
    positioned,
    query,
    rounded,
    sample_cells,
)

BLANK_SQL = """stats AS (
  SELECT {keys}, count(*) FILTER (type = 'Blanks') AS nb, avg(value) FILTER (type = 'Blanks') AS bm,
         stddev_samp(value) FILTER (type = 'Blanks') AS bs
  FROM peaks GROUP BY ALL),
kept AS (
  SELECT p.*, p.value - s.bm AS corrected, s.nb, s.bs FROM peaks p JOIN stats s USING ({keys})
  WHERE s.nb = 0 OR (p.type <> 'Blanks' AND p.value - s.bm > 0 AND p.value - s.bm > 3 * s.bs)),
clean AS (SELECT file, feature, scan, line, CASE WHEN nb = 0 THEN value ELSE corrected END AS value FROM kept)"""


@query(
    "strongest_features",
    f"""WITH {PEAKS_SQL}, {LABELS_SQL}, {BLANK_SQL.format(keys="feature")},
shared AS (SELECT feature FROM clean GROUP BY feature HAVING count(DISTINCT file) >= 2),
pos AS (SELECT c.* FROM clean c SEMI JOIN shared s ON c.feature = s.feature WHERE value > 0),
tot AS (SELECT file, sum(value) AS t FROM pos GROUP BY file),
cells AS (SELECT p.file, p.feature, avg(p.value / t.t) AS v FROM pos p JOIN tot t ON p.file = t.file GROUP BY ALL),
means AS (SELECT l.plastic_type, c.feature, avg(v) AS m FROM cells c JOIN labelled_files l ON c.file = l.file GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY plastic_type ORDER BY m DESC, feature) AS rank FROM means)
SELECT plastic_type, feature, round(m, 10) AS mean_value, rank FROM ranked WHERE rank <= 10""",
)
def _strongest(spark, sf):
    out = strongest_features(peaks(spark, sf), labelled_files(spark, sf))
    return rounded(out, "mean_value", digits=10)


@query("select_rename_filter", f"WITH {PEAKS_SQL} SELECT file AS sample_file, feature, value AS area FROM peaks WHERE type = 'Sample'")
def _select(spark, sf):
    return peaks(spark, sf).filter(F.col("type") == "Sample").select(F.col("file").alias("sample_file"), "feature", F.col("value").alias("area"))


@query(
    "intensity_cutoff",
    f"WITH {PEAKS_SQL} SELECT scan, line, value, CASE WHEN value > 5000000 THEN 'kept' ELSE 'removed' END AS part FROM peaks",
)
def _cutoff(spark, sf):
    kept, removed = prevalence.intensity_cutoff(peaks(spark, sf), 5_000_000)
    cols = ["scan", "line", "value"]
    return kept.select(*cols, F.lit("kept").alias("part")).unionAll(removed.select(*cols, F.lit("removed").alias("part")))


@query(
    "peak_box",
    f"WITH {POSITIONED_SQL} SELECT scan, line, mz, rt FROM positioned WHERE mz BETWEEN 9200000 AND 9500000 AND rt > 1000 AND rt < 3000",
)
def _box(spark, sf):
    return positioned(spark, sf).filter(blanks.in_box((9_200_000, 9_500_000), (1000, 3000))).select("scan", "line", "mz", "rt")


@query(
    "remove_benchmarks",
    f"""WITH {POSITIONED_SQL}, b(m) AS (VALUES (9100050), (9333333), (9500100), (9750000), (9900020))
SELECT scan, line, mz FROM positioned p WHERE NOT EXISTS (SELECT 1 FROM b WHERE p.mz <= b.m + 500 AND p.mz >= b.m - 500)""",
)
def _benchmarks(spark, sf):
    masses = [9_100_050, 9_333_333, 9_500_100, 9_750_000, 9_900_020]
    return blanks.remove_benchmarks(positioned(spark, sf), masses, 500).select("scan", "line", "mz")


for _name, _keys in (("blank_subtract", ["feature"]), ("blank_subtract_batch", ["batch", "feature"])):

    def _run(spark, sf, keys=_keys):
        out = blanks.blank_subtract(peaks(spark, sf), keys)
        return rounded(out.select("file", "feature", "scan", "line", "value"), "value", digits=4)

    query(
        _name,
        f"WITH {PEAKS_SQL}, {BLANK_SQL.format(keys=', '.join(_keys))} SELECT file, feature, scan, line, round(value, 4) AS value FROM clean",
    )(_run)


@query(
    "blank_subtract_mean",
    f"""WITH {PEAKS_SQL}, stats AS (SELECT feature, avg(value) FILTER (type = 'Blanks') AS bm FROM peaks GROUP BY feature)
SELECT scan, line, round(p.value - coalesce(bm, 0), 4) AS value FROM peaks p JOIN stats s ON p.feature = s.feature
WHERE bm IS NULL OR type <> 'Blanks'""",
)
def _blank_mean(spark, sf):
    return rounded(blanks.blank_subtract_mean(peaks(spark, sf)).select("scan", "line", "value"), "value", digits=4)


@query(
    "tsn_by_file",
    f"""WITH {PEAKS_SQL}, t AS (SELECT file, sum(value) AS s FROM peaks WHERE value > 0 GROUP BY file)
SELECT scan, line, round(value / s, 12) AS value_share FROM peaks JOIN t ON peaks.file = t.file WHERE value > 0""",
)
def _tsn(spark, sf):
    return rounded(prevalence.tsn_by_file(peaks(spark, sf)).select("scan", "line", "value_share"), "value_share", digits=12)


@query(
    "shared_features",
    f"""WITH {PEAKS_SQL}, n AS (SELECT feature, count(DISTINCT file) AS c FROM peaks GROUP BY feature)
SELECT scan, line, CASE WHEN c >= 2 THEN 'shared' ELSE 'unique' END AS presence FROM peaks JOIN n ON peaks.feature = n.feature""",
)
def _shared(spark, sf):
    return prevalence.shared_features(peaks(spark, sf)).select("scan", "line", "presence")


@query(
    "presence_class",
    f"""WITH {CELLS_SQL}, n AS (SELECT feature, count(DISTINCT plastic_type) AS c FROM cells GROUP BY feature)
SELECT file, cells.feature, CASE WHEN c > 4 THEN 'similar' WHEN c < 2 THEN 'unique' ELSE 'other' END AS presence
FROM cells JOIN n ON cells.feature = n.feature""",
)
def _presence(spark, sf):
    return prevalence.presence_class(cells(spark, sf), "plastic_type", 5).select("file", "feature", "presence")


@query(
    "replicate_consistency",
    f"""WITH {PEAKS_SQL}, g AS (SELECT feature, file FROM peaks GROUP BY ALL HAVING count(DISTINCT replicate) > 1)
SELECT scan, line, p.feature, p.file FROM peaks p JOIN g ON p.feature = g.feature AND p.file = g.file""",
)
def _consistency(spark, sf):
    return prevalence.replicate_consistency(peaks(spark, sf), ["feature", "file"]).select("scan", "line", "feature", "file")


@query("collapse_duplicates", f"WITH {PEAKS_SQL} SELECT file, feature, avg(value) AS value FROM peaks GROUP BY ALL")
def _collapse(spark, sf):
    return prevalence.collapse_duplicates(peaks(spark, sf))


@query("duplicate_report", f"WITH {PEAKS_SQL} SELECT file, feature, count(*) AS n FROM peaks GROUP BY ALL HAVING count(*) > 1")
def _duplicates(spark, sf):
    return prevalence.duplicate_report(peaks(spark, sf))


@query(
    "common_features",
    f"""WITH {CELLS_SQL} SELECT feature FROM cells GROUP BY feature HAVING count(DISTINCT source) = 2""",
)
def _common(spark, sf):
    return prevalence.common_features(cells(spark, sf), "source")


@query(
    "restrict_to_common",
    f"""WITH {CELLS_SQL}, c AS (SELECT feature FROM cells GROUP BY feature HAVING count(DISTINCT plastic_type) = 5)
SELECT file, feature, value FROM cells WHERE feature IN (SELECT feature FROM c)""",
)
def _restrict(spark, sf):
    data = cells(spark, sf)
    return prevalence.restrict_to(data, prevalence.common_features(data, "plastic_type", n_groups=5)).select("file", "feature", "value")


@query(
    "combine_techniques",
    f"""WITH {SAMPLES_SQL}, m(combo, technique) AS (VALUES ('GC','GC'),('HPLC','HPLC'),('ICP','ICP'),('GC_HPLC','GC'),('GC_HPLC','HPLC'),
('GC_ICP','GC'),('GC_ICP','ICP'),('HPLC_ICP','HPLC'),('HPLC_ICP','ICP'),('GC_HPLC_ICP','GC'),('GC_HPLC_ICP','HPLC'),('GC_HPLC_ICP','ICP'))
SELECT combo, count(*) AS n, count(DISTINCT feature) AS features, round(sum(value), 2) AS total,
       count(CASE WHEN combo NOT LIKE '%ICP%' THEN value END) AS positioned
FROM cells JOIN m USING (technique) GROUP BY combo""",
)
def _combine(spark, sf):
    out = prevalence.combine_techniques(sample_cells(spark, sf).withColumn("mz", F.col("value")))
    return rounded(
        out.groupBy("combo").agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("feature").alias("features"), F.sum("value").alias("total"),
            F.count("mz").alias("positioned"),
        ), "total", digits=2,
    )


@query(
    "feature_centroids",
    f"WITH {POSITIONED_SQL} SELECT feature, round(avg(mz), 4) AS mean_mz, round(avg(rt), 4) AS mean_rt FROM positioned GROUP BY feature",
)
def _centroids(spark, sf):
    return prevalence.feature_centroids(positioned(spark, sf))


@query(
    "attach_labels",
    f"""WITH {PEAKS_SQL}, {LABELS_SQL} SELECT scan, line, plastic_type, subcategory, polymer
FROM peaks LEFT JOIN labelled_files l ON peaks.file = l.file""",
)
def _labels(spark, sf):
    out = attach_labels(peaks(spark, sf), labelled_files(spark, sf), ["plastic_type", "subcategory", "polymer"])
    return out.select("scan", "line", "plastic_type", "subcategory", "polymer")


@query(
    "full_join_features",
    f"""WITH {CELLS_SQL} SELECT l.file, c.feature, l.plastic_type FROM labelled_files l FULL JOIN (SELECT file, feature FROM cells) c
ON l.file = c.file WHERE c.feature IS NOT NULL""",
)
def _full(spark, sf):
    marks = labelled_files(spark, sf).select("file", "plastic_type")
    return marks.join(cells(spark, sf).select("file", "feature"), "file", "full").filter(F.col("feature").isNotNull()).select(
        "file", "feature", "plastic_type"
    )


@query(
    "summary_joined_back",
    f"""WITH {CELLS_SQL}, m AS (SELECT feature, avg(value) AS mean_value FROM cells GROUP BY feature)
SELECT c.file, c.feature, round(m.mean_value, 4) AS mean_value FROM cells c FULL JOIN m ON c.feature = m.feature""",
)
def _joined_back(spark, sf):
    data = cells(spark, sf).select("file", "feature", "value")
    means = data.groupBy("feature").agg(F.avg("value").alias("mean_value"))
    return rounded(data.join(means, "feature", "full").select("file", "feature", "mean_value"), "mean_value", digits=4)


@query(
    "right_join_positions",
    f"""WITH {POSITIONED_SQL}, pos AS (SELECT feature, avg(mz) AS mean_mz FROM positioned GROUP BY feature),
sig AS (SELECT feature, count(*) AS n FROM positioned WHERE value > 5000000 GROUP BY feature)
SELECT sig.feature, sig.n, round(pos.mean_mz, 4) AS mean_mz FROM pos RIGHT JOIN sig ON pos.feature = sig.feature""",
)
def _right(spark, sf):
    data = positioned(spark, sf)
    place = data.groupBy("feature").agg(F.avg("mz").alias("mean_mz"))
    listed = data.filter(F.col("value") > 5_000_000).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
    return rounded(place.join(listed, "feature", "right").select("feature", "n", "mean_mz"), "mean_mz", digits=4)


# missing-value rules ---------------------------------------------------------------------------------------------

@query(
    "rule80",
    f"""WITH {CELLS_SQL} SELECT feature FROM cells GROUP BY feature
HAVING count(DISTINCT file) >= 0.3 * (SELECT count(DISTINCT file) FROM cells)""",
)
def _rule80(spark, sf):
    return missing.rule80(cells(spark, sf), 0.3)


@query(
    "rule80_by_class",
    f"""WITH {CELLS_SQL}, sizes AS (SELECT plastic_type, count(DISTINCT file) AS n FROM cells GROUP BY ALL),
seen AS (SELECT feature, plastic_type, count(DISTINCT file) AS k FROM cells GROUP BY ALL)
SELECT feature FROM seen JOIN sizes USING (plastic_type) WHERE k / n >= 0.2 GROUP BY feature
HAVING count(*) = (SELECT count(*) FROM sizes)""",
)
def _rule80_class(spark, sf):
    return missing.rule80_by_class(cells(spark, sf), "plastic_type", 0.2)


_M3 = """sizes AS (SELECT technique, subcategory, count(DISTINCT file) AS n FROM cells GROUP BY ALL),
prevalent AS (SELECT DISTINCT feature FROM (SELECT feature, technique, subcategory, count(DISTINCT file) AS k FROM cells
  WHERE value <> 0 GROUP BY ALL) JOIN sizes USING (technique, subcategory) WHERE k / n > 0.9)"""
_M4 = """tsize AS (SELECT technique, count(DISTINCT file) AS n FROM cells GROUP BY technique),
sparse AS (SELECT feature FROM (SELECT feature, technique, count(DISTINCT file) AS k FROM cells GROUP BY ALL)
  JOIN tsize USING (technique) WHERE k / n < {thr})"""


@query("prevalent_in_any_class", f"WITH {SAMPLES_SQL}, {_M3} SELECT feature FROM prevalent")
def _prevalent(spark, sf):
    return missing.prevalent_in_any_class(sample_cells(spark, sf))


@query("drop_mostly_missing", f"WITH {SAMPLES_SQL}, {_M4.format(thr=0.22)} SELECT feature FROM sparse")
def _mostly(spark, sf):
    return missing.mostly_missing(sample_cells(spark, sf), 0.22)


@query("min_samples", f"WITH {SAMPLES_SQL} SELECT feature FROM cells WHERE value <> 0 GROUP BY feature HAVING count(DISTINCT file) > 1")
def _min_samples(spark, sf):
    return missing.min_samples(sample_cells(spark, sf))


@query("min_classes", f"WITH {SAMPLES_SQL} SELECT feature FROM cells WHERE value <> 0 GROUP BY feature HAVING count(DISTINCT subcategory) > 1")
def _min_classes(spark, sf):
    return missing.min_classes(sample_cells(spark, sf))


_M8 = """grid AS (SELECT f.feature, f.technique, c.subcategory FROM (SELECT DISTINCT feature, technique FROM {t}) f,
  (SELECT DISTINCT subcategory FROM cells) c),
allf AS (SELECT subcategory, count(DISTINCT file) AS n FROM cells GROUP BY ALL),
own AS (SELECT technique, subcategory, count(DISTINCT file) AS n FROM cells GROUP BY ALL),
points AS (SELECT feature, technique, subcategory, count(DISTINCT file) AS k FROM {t} GROUP BY ALL),
enough AS (SELECT g.feature, g.subcategory FROM grid g JOIN allf USING (subcategory)
  LEFT JOIN own o ON o.technique = g.technique AND o.subcategory = g.subcategory
  LEFT JOIN points p ON p.feature = g.feature AND p.technique = g.technique AND p.subcategory = g.subcategory
  WHERE coalesce(p.k, 0) + allf.n - coalesce(o.n, 0) >= {points}),
twoclass AS (SELECT feature FROM enough GROUP BY feature HAVING count(DISTINCT subcategory) >= 2)"""


@query("min_points_two_classes", f"WITH {SAMPLES_SQL}, {_M8.format(t='cells', points=9)} SELECT feature FROM twoclass")
def _min_points(spark, sf):
    return missing.min_points_two_classes(sample_cells(spark, sf), points=9)


@query(
    "feature_profile",
    f"""WITH {SAMPLES_SQL}, {_M3}, tsize AS (SELECT technique, count(DISTINCT file) AS n FROM cells GROUP BY technique),
{_M8.format(t='cells', points=3)},
share AS (SELECT feature, max(k / n) AS best FROM (SELECT feature, technique, subcategory, count(DISTINCT file) AS k FROM cells
  WHERE value <> 0 GROUP BY ALL) JOIN sizes USING (technique, subcategory) GROUP BY feature),
ok AS (SELECT feature, count(*) AS n FROM enough GROUP BY feature)
SELECT c.feature, count(DISTINCT file) AS files_seen, count(DISTINCT subcategory) AS classes_nonzero,
  any_value(best) AS best_share, count(DISTINCT file) / any_value(tsize.n) AS technique_share, any_value(ok.n) AS classes_enough
FROM cells c JOIN tsize USING (technique) JOIN share USING (feature) JOIN ok USING (feature) GROUP BY c.feature""",
)
def _profile(spark, sf):
    return missing.feature_profile(sample_cells(spark, sf)).drop("technique", "files_nonzero")


@query(
    "comprehensive_filter",
    f"""WITH {SAMPLES_SQL}, {_M3}, {_M4.format(thr=0.1)},
k3 AS (SELECT * FROM cells WHERE feature NOT IN (SELECT feature FROM sparse WHERE feature NOT IN (SELECT feature FROM prevalent))),
k4 AS (SELECT * FROM k3 WHERE feature IN (SELECT feature FROM k3 WHERE value <> 0 GROUP BY feature HAVING count(DISTINCT file) > 1)),
k5 AS (SELECT * FROM k4 WHERE feature IN (SELECT feature FROM k4 WHERE value <> 0 GROUP BY feature HAVING count(DISTINCT subcategory) > 1)),
{_M8.format(t='k5', points=3)}
SELECT file, feature, subcategory, value FROM k5 WHERE feature IN (SELECT feature FROM twoclass)""",
)
def _comprehensive(spark, sf):
    return missing.comprehensive_filter(sample_cells(spark, sf)).select("file", "feature", "subcategory", "value")


@query(
    "missing_share",
    f"""WITH {CELLS_SQL} SELECT count(DISTINCT file) AS n_files, count(DISTINCT feature) AS n_features,
count(DISTINCT (file, feature)) AS present_cells,
1 - count(DISTINCT (file, feature)) / (count(DISTINCT file) * count(DISTINCT feature)) AS missing_share FROM cells""",
)
def _missing_share(spark, sf):
    return missing.missing_share(cells(spark, sf))


@query(
    "missingness_correlation",
    f"""WITH {POSITIONED_SQL}, c AS (SELECT file, feature, avg(value) AS value FROM positioned GROUP BY ALL),
per AS (SELECT feature, (SELECT count(DISTINCT file) FROM positioned) - count(*) AS missing, avg(value) AS response FROM c GROUP BY feature),
pl AS (SELECT feature, avg(mz) AS mz, avg(rt) AS rt FROM positioned GROUP BY feature)
SELECT round(corr(response, missing), 8) AS r_response, round(corr(mz, missing), 8) AS r_mz, round(corr(rt, missing), 8) AS r_rt
FROM per JOIN pl USING (feature)""",
)
def _missingness(spark, sf):
    return rounded(missing.missingness_correlation(positioned(spark, sf)), "r_response", "r_mz", "r_rt")


@query(
    "sparse_in_groups",
    f"""WITH {CELLS_SQL}, k AS (SELECT feature, plastic_type, count(DISTINCT file) AS n FROM cells GROUP BY ALL)
SELECT feature FROM k GROUP BY feature HAVING count(*) FILTER (n > 4) <= 2""",
)
def _sparse(spark, sf):
    return missing.sparse_in_groups(cells(spark, sf), "plastic_type", more_than=4)


@query(
    "coverage_sweep",
    f"""WITH {PEAKS_SQL}, t AS (SELECT unnest(range(0, 10000001, 500000)) AS threshold),
tot AS (SELECT file, sum(value) AS s FROM peaks GROUP BY file),
k AS (SELECT threshold, file, sum(value) AS s, count(*) AS n FROM peaks, t WHERE value > threshold GROUP BY ALL)
SELECT CAST(threshold AS DOUBLE) AS threshold, round(avg(k.s * 100 / tot.s), 8) AS mean_coverage, round(avg(n), 8) AS mean_peaks,
count(*) AS n_files FROM k JOIN tot ON k.file = tot.file GROUP BY threshold""",
)
def _coverage(spark, sf):
    out = missing.coverage_sweep(peaks(spark, sf), [500_000.0 * i for i in range(21)])
    return rounded(out, "mean_coverage", "mean_peaks")


@query(
    "structural_zeros",
    f"""WITH {SAMPLES_SQL}, files AS (SELECT DISTINCT file, technique FROM cells),
feats AS (SELECT DISTINCT feature, technique FROM cells)
SELECT feats.technique AS feature_technique, files.technique AS file_technique, count(*) AS cells,
       feats.technique <> files.technique AS structural_zero
FROM feats, files GROUP BY ALL""",
)
def _structural(spark, sf):
    """Cells per pair of techniques are counted from the numbers of features and files, not laid out."""
    data = sample_cells(spark, sf)
    feats = data.groupBy(F.col("technique").alias("feature_technique")).agg(F.countDistinct("feature").alias("nf"))
    files = data.groupBy("technique").agg(F.countDistinct("file").alias("ns"))
    # three techniques on each side
    pairs = feats.join(F.broadcast(files), F.lit(True)).withColumnRenamed("technique", "file_technique")
    flagged = pairs.withColumn("structural_zero", F.col("feature_technique") != F.col("file_technique"))
    return flagged.select("feature_technique", "file_technique", (F.col("nf") * F.col("ns")).alias("cells"), "structural_zero")


@query(
    "filter_source",
    f"WITH {CELLS_SQL} SELECT file, feature, value FROM cells WHERE source = 'Environmental'",
)
def _source(spark, sf):
    return missing.filter_source(cells(spark, sf), "Environmental").select("file", "feature", "value")


@query(
    "drop_small_classes",
    f"""WITH {LABELS_SQL} SELECT file, subcategory FROM labelled_files WHERE subcategory IN
(SELECT subcategory FROM labelled_files GROUP BY subcategory HAVING count(DISTINCT file) >= 4)""",
)
def _small(spark, sf):
    return prevalence.drop_small_classes(labelled_files(spark, sf), "subcategory", 4).select("file", "subcategory")


@query(
    "beyond_list",
    f"""WITH {POSITIONED_SQL}, hit AS (SELECT DISTINCT feature FROM positioned WHERE value > 9500000)
SELECT feature, avg(mz) AS mean_mz, avg(rt) AS mean_rt FROM positioned WHERE feature NOT IN (SELECT feature FROM hit) GROUP BY feature""",
)
def _beyond(spark, sf):
    data = positioned(spark, sf)
    return prevalence.beyond_list(data, data.filter(F.col("value") > 9_500_000).select("feature").distinct())
