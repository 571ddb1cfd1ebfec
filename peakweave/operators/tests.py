"""Tests of group differences, for many features and class pairs in one job.

Each test is reduced to counts, sums and distribution tables per feature; tail probabilities are computed
last, on one row per test. Rank-based tests share one sorted table of distinct values and the classes that have
them (`distribution`), so no pair of classes has its rows gathered again, and classes that a feature lacks cost nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from peakweave.functions.shapiro import MAX_N, MIN_N, shapiro_wilk
from peakweave.functions.tails import (
    chi2_p_value,
    f_p_value,
    ks_p_value,
    normal_quantile,
    normal_upper,
    rank_sum_p_exact,
    t_p_value,
)
from peakweave.operators.distribution import PairSums, RankSums, class_sums
from peakweave.operators.ordering import exact_quantiles, value_positions
from peakweave.operators.padjust import p_adjust
from peakweave.session import cut_lineage, materialize

MAX_CLASSES = 200


def class_names(df: DataFrame, label: str) -> list:
    """Sorted class names; refuses labels that are not classes."""
    found = [r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().limit(MAX_CLASSES + 1).collect()]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes in {label}")
    return sorted(found)


def pair_distribution(
    df: DataFrame, label: str, classes: Sequence | None = None, feature: Sequence[str] = ("feature",), value: str = "value", own: str | None = None,
) -> DataFrame:
    """Per feature and pair of the classes present in it: sizes, pairs won by the first class (W), tie terms, KS distance.

    `own` names a key that holds the name of a class: only that class's pairs come out.
    """
    found = class_sums(df, label, feature, value, PairSums, classes, own)
    return found.withColumnsRenamed({"first": "w", "apart": "ks_d"})


def wilcoxon_p(w: Column, n_a: Column, n_b: Column, ties: Column) -> Column:
    """Two-sided p: exact for small samples without ties, else normal with tie and continuity correction."""
    n = (n_a + n_b).cast("double")
    spread = n_a * n_b / F.lit(12.0) * ((n + 1) - ties / (n * (n - 1)))
    off = w - n_a * n_b / F.lit(2.0)
    z = (off - F.signum(off) * 0.5) / F.sqrt(F.nullif(spread, F.lit(0.0)))
    approx = F.least(F.lit(1.0), 2 * normal_upper(F.abs(z)))
    small = (n_a < 50) & (n_b < 50) & (ties == 0)
    # only small samples are handed to the exact count
    exact = rank_sum_p_exact(F.when(small, w), F.when(small, n_a), F.when(small, n_b))
    return F.when(small, exact).when(spread > 0, approx)


def wilcoxon_rank_sum(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value",
                      classes: Sequence | None = None) -> DataFrame:
    """Rank-sum test of every class pair per feature."""
    stats = pair_distribution(df, label, classes, feature, value)
    return stats.select(
        *feature, "label_a", "label_b", "n_a", "n_b", "w", "ties",
        wilcoxon_p(F.col("w"), F.col("n_a"), F.col("n_b"), F.col("ties")).alias("p_value"),
    )


def ks_two_sample(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value",
                  classes: Sequence | None = None) -> DataFrame:
    """Largest distance between the distributions of every class pair, with its p-value."""
    stats = pair_distribution(df, label, classes, feature, value)
    return stats.select(
        *feature, "label_a", "label_b", "n_a", "n_b", "ks_d",
        ks_p_value(F.col("ks_d"), F.col("n_a"), F.col("n_b"), F.col("ties") > 0).alias("p_value"),
    )


def group_moments(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    return df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(*feature, label).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_samp(value).alias("var")
    )


def moment_pairs(moments: DataFrame, label: str, feature: Sequence[str]) -> DataFrame:
    """Class pairs of one row per (feature, class): classes meet, measurements do not."""
    keys = list(feature)
    a = moments.select(*keys, F.col(label).alias("label_a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "mean", "var")])
    b = moments.select(*keys, F.col(label).alias("label_b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "mean", "var")])
    return a.join(b, keys).filter(F.col("label_a") < F.col("label_b"))


def welch_from_moments(pairs: DataFrame) -> DataFrame:
    va, vb = F.col("var_a") / F.col("n_a"), F.col("var_b") / F.col("n_b")
    spread = F.nullif(va + vb, F.lit(0.0))
    return pairs.withColumn("t", (F.col("mean_a") - F.col("mean_b")) / F.sqrt(spread)).withColumn(
        "df", spread * spread / F.nullif(va * va / (F.col("n_a") - 1) + vb * vb / (F.col("n_b") - 1), F.lit(0.0))
    )


def welch_t(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """t-test without equal variances for every class pair with at least two values each."""
    moments = group_moments(df, label, feature, value).filter(F.col("n") >= 2)
    out = welch_from_moments(moment_pairs(moments, label, feature))
    p = F.when(F.col("t").isNotNull() & F.col("df").isNotNull(), t_p_value(F.col("t"), F.col("df")))
    return out.select(*feature, "label_a", "label_b", "n_a", "n_b", "t", "df", p.alias("p_value"))


def shapiro(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Normality of every group of 3 values or more that is not constant: (keys, n, w, p_value, normality).

    Up to MAX_N values the test is Shapiro-Wilk's, which is defined for no more; such a group travels to Python as one
    array. Larger groups are tested by their skewness and kurtosis (Jarque-Bera, whose asymptotic law holds at that size),
    from aggregates alone; their w is null and `normality` says 'moments'.
    """
    keys = list(keys)
    present = df.filter(F.col(value).isNotNull())
    sized = present.groupBy(*keys).agg(
        F.count(value).alias("n"), F.min(value).alias("_lo"), F.max(value).alias("_hi"),
        F.skewness(value).alias("_skew"), F.kurtosis(value).alias("_kurt"),
    ).filter((F.col("n") >= MIN_N) & (F.col("_hi") > F.col("_lo")))
    testable = sized.filter(F.col("n") <= MAX_N).select(*keys)
    arrays = present.join(testable, keys).groupBy(*keys).agg(F.collect_list(F.col(value).cast("double")).alias("_v"))
    tested = arrays.withColumn("_r", _shapiro(F.col("_v"))).select(
        *keys, F.size("_v").cast("long").alias("n"), "_r.w", "_r.p_value", F.lit("shapiro").alias("normality")
    )
    jarque_bera = F.col("n") / 6 * (F.col("_skew") * F.col("_skew") + F.col("_kurt") * F.col("_kurt") / 4)
    # the upper tail of chi-square with two degrees of freedom
    large = sized.filter(F.col("n") > MAX_N).select(
        *keys, "n", F.lit(None).cast("double").alias("w"), F.exp(-jarque_bera / 2).alias("p_value"), F.lit("moments").alias("normality")
    )
    return tested.unionByName(large)


@F.pandas_udf(StructType([StructField("w", DoubleType()), StructField("p_value", DoubleType())]))
def _shapiro(values: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([shapiro_wilk(v) or (None, None) for v in values], columns=["w", "p_value"], dtype=float)


def kruskal(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value",
            classes: Sequence | None = None) -> DataFrame:
    """Kruskal-Wallis H per feature over the classes that have values."""
    sums = class_sums(df, label, feature, value, RankSums, classes)
    pooled = sums.groupBy(*feature).agg(
        F.sum("n_a").alias("n"), F.count(F.lit(1)).cast("int").alias("n_groups"), F.sum(F.col("first") * F.col("first") / F.col("n_a")).alias("_square"), F.max("ties").alias("_ties")
    )
    n = F.col("n").cast("double")
    h = (12 * F.col("_square") / (n * (n + 1)) - 3 * (n + 1)) / F.nullif(1 - F.col("_ties") / F.nullif(n * n * n - n, F.lit(0.0)), F.lit(0.0))
    out = pooled.select(*feature, "n", "n_groups", h.alias("h")).filter((F.col("n_groups") > 1) & F.col("h").isNotNull())
    return out.withColumn("p_value", chi2_p_value(F.col("h"), F.col("n_groups") - 1))


def anova_from_moments(moments: DataFrame, feature: Sequence[str]) -> DataFrame:
    """One-way F from n, mean and variance per class."""
    total = moments.groupBy(*feature).agg(
        F.sum("n").alias("_n"),
        F.count(F.lit(1)).alias("_k"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("_grand"),
        F.sum(F.coalesce(F.col("var") * (F.col("n") - 1), F.lit(0.0))).alias("_within"),
    )
    between = (
        moments.join(total.select(*feature, "_grand"), list(feature))
        .groupBy(*feature)
        .agg(F.sum(F.col("n") * (F.col("mean") - F.col("_grand")) * (F.col("mean") - F.col("_grand"))).alias("_between"))
    )
    d1, d2 = F.col("_k") - 1, F.col("_n") - F.col("_k")
    f = (F.col("_between") / F.nullif(d1, F.lit(0))) / F.nullif(F.col("_within") / F.nullif(d2, F.lit(0)), F.lit(0.0))
    out = total.join(between, list(feature)).select(*feature, d1.alias("df1"), d2.alias("df2"), f.alias("f"))
    return out.filter(F.col("f").isNotNull()).withColumn("p_value", f_p_value(F.col("f"), F.col("df1"), F.col("df2")))


def anova_oneway(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    return anova_from_moments(group_moments(df, label, feature, value), feature)


def _median_deviations(df: DataFrame, label: str, feature: Sequence[str], value: str) -> DataFrame:
    """Every value with its absolute distance to the median of its class."""
    keys = [*feature, label]
    present = materialize(df.filter(F.col(value).isNotNull() & F.col(label).isNotNull()).select(*keys, value), "spread-rows")
    medians = exact_quantiles(present, keys, value, [0.5], ["_med"], stored=True)
    return present.join(medians, keys).withColumn("_dev", F.abs(F.col(value) - F.col("_med")))


def levene(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value", pairwise: bool = True) -> DataFrame:
    """Equality of variances from distances to the class median, per class pair or over all classes."""
    moments = group_moments(_median_deviations(df, label, feature, value), label, feature, "_dev")
    if not pairwise:
        return anova_from_moments(moments, feature)
    pairs = moment_pairs(moments, label, feature)
    n = F.col("n_a") + F.col("n_b")
    diff = F.col("mean_a") - F.col("mean_b")
    between = F.col("n_a") * F.col("n_b") / n * diff * diff
    within = F.coalesce(F.col("var_a") * (F.col("n_a") - 1), F.lit(0.0)) + F.coalesce(F.col("var_b") * (F.col("n_b") - 1), F.lit(0.0))
    f = between / F.nullif(within / F.nullif(n - 2, F.lit(0)), F.lit(0.0))
    out = pairs.select(*feature, "label_a", "label_b", (n - 2).alias("df2"), f.alias("f")).filter(F.col("f").isNotNull())
    return out.withColumn("p_value", f_p_value(F.col("f"), F.lit(1), F.col("df2")))


def fligner(df: DataFrame, label: str, feature: Sequence[str] = ("feature",), value: str = "value") -> DataFrame:
    """Fligner-Killeen test: normal scores of the ranks of distances to the class median."""
    keys = list(feature)
    deviations = _median_deviations(df, label, feature, value)
    ranks = value_positions(deviations, keys, "_dev")
    score = normal_quantile((1 + (F.col("n_before") + (F.col("n") + 1) / 2) / (F.col("n_total") + 1)) / 2)
    scores = ranks.select(*keys, "_dev", "n", score.alias("_a"))
    overall = scores.groupBy(*keys).agg(
        F.sum("n").alias("_total"),
        (F.sum(F.col("n") * F.col("_a")) / F.sum("n")).alias("_mean"),
        F.sum(F.col("n") * F.col("_a") * F.col("_a")).alias("_sq"),
    )
    per_class = (
        deviations.groupBy(*keys, label, "_dev")
        .agg(F.count(F.lit(1)).alias("_m"))
        .join(scores.drop("n"), [*keys, "_dev"])
        .groupBy(*keys, label)
        .agg(F.sum("_m").alias("_nk"), (F.sum(F.col("_m") * F.col("_a")) / F.sum("_m")).alias("_ak"))
    )
    joined = per_class.join(overall, keys).groupBy(*keys).agg(
        F.sum(F.col("_nk") * (F.col("_ak") - F.col("_mean")) * (F.col("_ak") - F.col("_mean"))).alias("_num"),
        F.max((F.col("_sq") - F.col("_total") * F.col("_mean") * F.col("_mean")) / (F.col("_total") - 1)).alias("_v"),
        (F.count(F.lit(1)) - 1).alias("df"),
    )
    stat = F.col("_num") / F.nullif(F.col("_v"), F.lit(0.0))
    out = joined.select(*keys, "df", stat.alias("x2")).filter((F.col("df") > 0) & F.col("x2").isNotNull())
    return out.withColumn("p_value", chi2_p_value(F.col("x2"), F.col("df")))


def pairwise_tests(
    df: DataFrame, label: str, min_n: int = 3, alpha: float = 0.05, method: str = "bonferroni",
    feature: Sequence[str] = ("feature",), value: str = "value", classes: Sequence | None = None,
) -> DataFrame:
    """Each feature and class pair with enough values on both sides.

    Rank-sum test when either class is not normal (see `shapiro`: by moments in classes above its limit), else Welch's t;
    a class of fewer than 3 values, or of equal ones, has no normality test and drops the pair. All p-values are adjusted together; `significant` marks the adjusted ones below alpha.
    """
    keys = list(feature)
    normal = shapiro(df, [*keys, label], value).select(*keys, label, F.col("p_value").alias("_s"))
    ranks = wilcoxon_rank_sum(df, label, feature, value, classes).filter((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    welch = welch_t(df, label, feature, value).select(*keys, "label_a", "label_b", F.col("p_value").alias("_t"))
    tested = (
        ranks.join(normal.withColumnsRenamed({label: "label_a", "_s": "_sa"}), [*keys, "label_a"])
        .join(normal.withColumnsRenamed({label: "label_b", "_s": "_sb"}), [*keys, "label_b"])
        .join(welch, [*keys, "label_a", "label_b"], "left")
    )
    skewed = (F.col("_sa") < alpha) | (F.col("_sb") < alpha)
    chosen = tested.select(
        *keys, "label_a", "label_b", "n_a", "n_b",
        F.when(skewed, "wilcoxon").otherwise("welch").alias("test"),
        F.when(skewed, F.col("p_value")).otherwise(F.col("_t")).alias("p_value"),
    ).filter(F.col("p_value").isNotNull())
    # one row per test: written once, so that ranking the p-values does not run the tests again
    return p_adjust(cut_lineage(chosen), [], "p_value", [method]).withColumn("significant", F.col(f"p_{method}") < alpha)


def wilcoxon_screen(
    df: DataFrame, label: str, methods: Sequence[str] = ("holm", "hochberg", "bonferroni", "BH", "BY"),
    min_n: int = 3, feature: Sequence[str] = ("feature",), value: str = "value", classes: Sequence | None = None,
) -> DataFrame:
    """Rank-sum p-values of pairs in which neither class is constant, under several corrections.

    "hommel" can be asked for as well; it adjusts all tests in one task, so it is not among the defaults.
    """
    keys = list(feature)
    varied = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, label)
        .agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .filter(F.col("_hi") > F.col("_lo"))
        .select(*keys, label)
    )
    tests = wilcoxon_rank_sum(df, label, feature, value, classes).filter((F.col("n_a") >= min_n) & (F.col("n_b") >= min_n))
    tests = tests.join(varied.withColumnRenamed(label, "label_a"), [*keys, "label_a"], "left_semi").join(
        varied.withColumnRenamed(label, "label_b"), [*keys, "label_b"], "left_semi"
    )
    return p_adjust(cut_lineage(tests.filter(F.col("p_value").isNotNull())), [], "p_value", methods)


def combined_screen(df: DataFrame, label: str, alpha: float = 0.05, feature: Sequence[str] = ("feature",),
                    value: str = "value", classes: Sequence | None = None) -> DataFrame:
    """Pairs in which the rank-sum and the distribution test both reject."""
    stats = pair_distribution(df, label, classes, feature, value)
    both = stats.select(
        *feature, "label_a", "label_b",
        wilcoxon_p(F.col("w"), F.col("n_a"), F.col("n_b"), F.col("ties")).alias("p_wilcoxon"),
        ks_p_value(F.col("ks_d"), F.col("n_a"), F.col("n_b"), F.col("ties") > 0).alias("p_ks"),
    )
    return both.filter((F.col("p_wilcoxon") < alpha) & (F.col("p_ks") < alpha))
