"""Group summaries, rankings, histograms, box statistics and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakweave.functions.tails import normal_quantile
from peakweave.operators.ordering import attach_group_stats, exact_quantiles, log_bucket, row_positions, value_positions
from peakweave.operators.tests import class_names
from peakweave.session import materialize


def mean_sd(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{value}_mean"), F.stddev_samp(value).alias(f"{value}_sd"), F.count(value).alias("n")
    )


def compounds_per_sample(
    df: DataFrame, label: str = "subcategory", file: str = "file", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Mean number of features measured per file of each class, with its deviation."""
    per_file = df.filter(F.col(value).isNotNull()).groupBy(label, file).agg(F.countDistinct(feature).alias("_n"))
    return per_file.groupBy(label).agg(F.avg("_n").alias("mean_features"), F.stddev_samp("_n").alias("sd_features"))


def feature_prevalence(df: DataFrame, feature: str = "feature", value: str = "value") -> DataFrame:
    """How many non-zero values each feature has, and their mean."""
    real = F.when(F.col(value) != 0, F.col(value))
    return df.groupBy(feature).agg(F.count(real).alias("n_values"), F.avg(real).alias("mean_value"))


def most_prevalent(df: DataFrame, k: int = 10, feature: str = "feature", value: str = "value") -> DataFrame:
    """The k features with most values, then the higher mean."""
    ranked = feature_prevalence(df, feature, value)
    return ranked.orderBy(F.desc("n_values"), F.desc("mean_value"), feature).limit(k)


def describe_table(df: DataFrame, columns: Sequence[str], quantiles: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """One row per numeric column: n, missing, distinct, mean, extremes and exact quantiles."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "variable", "v")
    basics = long.groupBy("variable").agg(
        F.count("v").alias("n"),
        F.count(F.when(F.col("v").isNull(), 1)).alias("missing"),
        F.countDistinct("v").alias("distinct"),
        F.avg("v").alias("mean"),
        F.min("v").alias("lowest"),
        F.max("v").alias("highest"),
    )
    names = [f"q{round(q * 100):02d}" for q in quantiles]
    return basics.join(exact_quantiles(long, ["variable"], "v", quantiles, names), "variable", "left")


def occurrence_share(
    df: DataFrame, group: str = "source", file: str = "file", feature: str = "feature", value: str = "value"
) -> DataFrame:
    """Files of a group holding a non-zero value of the feature, in percent of all files."""
    total = F.broadcast(df.agg(F.countDistinct(file).alias("_files")))
    seen = df.filter(F.col(value) != 0).groupBy(group, feature).agg(F.countDistinct(file).alias("_n"))
    return seen.join(total, F.lit(True)).select(group, feature, (F.col("_n") / F.col("_files") * 100).alias("share"))


def histogram_by(df: DataFrame, keys: Sequence[str], value: str, bins: int = 30) -> DataFrame:
    """Counts in equal bins between the group's extremes; the highest value falls in the last bin."""
    spread = attach_group_stats(df.filter(F.col(value).isNotNull()), keys, F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    number = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / F.nullif(width, F.lit(0.0))))
    )
    return (
        spread.groupBy(*keys, number.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
        .select(*keys, "bin", "n", (F.col("_lo") + F.col("bin") * ((F.col("_hi") - F.col("_lo")) / bins)).alias("bin_start"))
    )


def box_summary(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Five-number summary, whisker ends within 1.5 interquartile ranges, and the number of values outside."""
    df = materialize(df.filter(F.col(value).isNotNull()).select(*keys, value), "box-rows")
    five = exact_quantiles(df, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0], ["lowest", "q1", "median", "q3", "highest"], stored=True)
    five = materialize(five, "box-quantiles")
    low = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    high = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col(value).between(low, high)
    whiskers = (
        df.join(five.select(*keys, "q1", "q3"), list(keys))
        .groupBy(*keys)
        .agg(
            F.min(F.when(inside, F.col(value))).alias("whisker_low"),
            F.max(F.when(inside, F.col(value))).alias("whisker_high"),
            F.count(F.when(~inside, 1)).alias("n_outside"),
        )
    )
    return five.join(whiskers, list(keys))


def bin2d_mean(df: DataFrame, x: str, y: str, value: str, x_width: float, y_width: float) -> DataFrame:
    """Mean of a value in rectangular bins of two coordinates."""
    return df.groupBy(
        F.floor(F.col(x) / x_width).alias("x_bin"), F.floor(F.col(y) / y_width).alias("y_bin")
    ).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n"))


#: Copies of a value that one array lists.
COPIES = 4096


def qq_points(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Each value with its standard normal quantile, one row per copy."""
    at = value_positions(df, keys, value)
    a = F.when(F.col("n_total") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    p = (F.col("position") - a) / (F.col("n_total") + 1 - 2 * a)
    # copies come out in two steps, so that no array is as long as a value is common
    runs = at.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / COPIES))))
    here = F.least(F.lit(COPIES).cast("long"), F.col("n") - F.col("_run") * COPIES)
    begin = F.col("n_before") + F.col("_run") * COPIES
    rows = runs.withColumn("position", F.explode(F.sequence(begin + 1, begin + here)))
    return rows.select(*keys, value, "position", normal_quantile(p).alias("theoretical"))


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows of each group. Spark keeps k rows per task before the shuffle, so hot groups stay small."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def top_k_by_mean(df: DataFrame, label: str, k: int = 10, feature: str = "feature", value: str = "value") -> DataFrame:
    """The k features with the highest mean in each class."""
    means = df.groupBy(label, feature).agg(F.avg(value).alias("mean_value"))
    return top_k(means, [label], [F.desc("mean_value"), F.asc(feature)], k)


def top_k_by_occurrence(df: DataFrame, group: str = "source", k: int = 10, file: str = "file",
                        feature: str = "feature", value: str = "value") -> DataFrame:
    shares = occurrence_share(df, group, file, feature, value)
    return top_k(shares, [group], [F.desc("share"), F.asc(feature)], k)


def top_k_per_sample(df: DataFrame, k: int = 10, file: str = "file", feature: str = "feature", value: str = "value") -> DataFrame:
    """The k strongest features of each file."""
    return top_k(df, [file], [F.desc(value), F.asc(feature)], k)


def rank_rows(df: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Rank a small result table, such as one row per combination of methods."""
    return df.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def compare_sets(left: DataFrame, right: DataFrame, on: str = "feature") -> DataFrame:
    """Where each distinct name occurs: `both`, `left_only` or `right_only`."""
    tagged = left.select(on, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionAll(
        right.select(on, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    seen = tagged.groupBy(on).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when((F.col("_l") == 1) & (F.col("_r") == 1), "both").when(F.col("_l") == 1, "left_only").otherwise("right_only")
    return seen.select(on, side.alias("side"))


def source_difference(
    df: DataFrame, label: str, source: str = "source", feature: str = "feature",
    store: str = "Store-Bought", field: str = "Environmental",
) -> DataFrame:
    """Per class, features found only in store-bought items and those found in both sources."""
    seen = df.groupBy(label, feature).agg(
        F.max((F.col(source) == store).cast("int")).alias("_s"), F.max((F.col(source) == field).cast("int")).alias("_e")
    )
    return seen.filter(F.col("_s") == 1).select(
        label, feature, F.when(F.col("_e") == 1, "both").otherwise("store_only").alias("found_in")
    )


def union_names(*tables: DataFrame, on: str = "feature") -> DataFrame:
    """Distinct names of several tables."""
    names = tables[0].select(on)
    for t in tables[1:]:
        names = names.unionAll(t.select(on))
    return names.distinct()


def label_pairs(df: DataFrame, label: str) -> DataFrame:
    """All pairs of class names, the smaller name first. The number of classes is checked; rows are not paired."""
    names = class_names(df, label)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    kind = df.schema[label].dataType.simpleString()
    return df.sparkSession.createDataFrame(pairs, f"label_a {kind}, label_b {kind}")


def parameter_grid(spark, **choices: Sequence) -> DataFrame:
    """All combinations of a few parameter values, as one exploded row."""
    grid = spark.range(1).select()
    for name, values in choices.items():
        grid = grid.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return grid


def join_in_chunks(df: DataFrame, order: str, text: str, size: int = 5) -> DataFrame:
    """Names in lines of `size`, joined by commas, along a numeric order (labels of a diagram)."""
    placed = row_positions(df.select(order, text), [], [order], log_bucket(F.col(order)), "_pos")
    line = F.floor((F.col("_pos") - 1) / size).cast("int").alias("line")
    # a line never holds more than `size` names
    names = F.transform(F.array_sort(F.collect_list(F.struct("_pos", text))), lambda n: n[text])
    return placed.groupBy(line).agg(F.array_join(names, ", ").alias("names"))
