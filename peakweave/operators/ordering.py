"""Ranks, running totals and exact quantiles that never gather a whole group in one task.

A window over a group puts all of its rows in one task, which fails when a group holds a third of
the data. Here a group is first cut into value buckets by an expression that keeps the order of the
values. Totals per bucket are small and a window adds them up; rows then only meet the other rows of
their own bucket. The answer is the same as that of the plain window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakweave.session import materialize

_BUCKET = "_bucket"


def log_bucket(col: Column, resolution: int = 1024) -> Column:
    """Order-preserving bucket of a number: equal-width steps of log|x|, mirrored below zero.

    The JVM logarithm never decreases, so x <= y gives bucket(x) <= bucket(y). A bucket spans a relative
    width of about 1/resolution, and all doubles together fill at most about 3 million buckets.
    """
    x = col.cast("double")
    # log of a double lies in (-746, 710)
    shift = 750 * resolution
    return (
        F.when(x > 0, F.floor(F.log(x) * resolution) + shift)
        .when(x < 0, -(F.floor(F.log(-x) * resolution) + shift))
        .otherwise(F.lit(0))
        .cast("int")
    )


def hash_bucket(col: Column, bits: int = 12) -> Column:
    """Order-preserving bucket of a 64-bit hash: its leading bits."""
    return F.shiftright(col, 64 - bits).cast("int")


def attach_group_stats(df: DataFrame, keys: Sequence[str], *stats: Column, how: str = "inner") -> DataFrame:
    """Aggregate per group (partial sums before the shuffle) and join the result back to the rows.

    Adaptive execution broadcasts the aggregate only when its measured size allows, and otherwise splits
    hot keys of the row side.
    """
    return df.join(df.groupBy(*keys).agg(*stats), list(keys), how)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    counts: Sequence[str],
    bucket: Column | None = None,
) -> DataFrame:
    """For rows unique on (keys, order): `{c}_before`, the sum of c over smaller orders, and `{c}_total`."""
    keys = list(keys)
    base = df.withColumn(_BUCKET, log_bucket(F.col(order)) if bucket is None else bucket)
    upto = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(*keys)
    offsets = (
        base.groupBy(*keys, _BUCKET)
        .agg(*[F.sum(c).alias(f"_s_{c}") for c in counts])
        .select(
            *keys,
            _BUCKET,
            *[F.coalesce(F.sum(f"_s_{c}").over(upto), F.lit(0)).alias(f"_o_{c}") for c in counts],
            *[F.sum(f"_s_{c}").over(everything).alias(f"{c}_total") for c in counts],
        )
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    joined = base.join(offsets, [*keys, _BUCKET])
    return joined.select(
        *df.columns,
        *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_o_{c}")).alias(f"{c}_before") for c in counts],
        *[F.col(f"{c}_total") for c in counts],
    )


def running_extremes(
    df: DataFrame, keys: Sequence[str], order: str, wanted: Sequence[tuple[str, str, str, bool]]
) -> DataFrame:
    """Inclusive running extremes of several columns in one pass over each group.

    `wanted` lists (column, output, "max" or "min", ascending): the walk along `order` goes up or down.
    """
    keys = list(keys)
    pick = {"max": F.max, "min": F.min}
    merge = {"max": F.greatest, "min": F.least}
    base = df.withColumn(_BUCKET, log_bucket(F.col(order)))

    def walk(by: str, up: bool, within: Sequence[str], until: int):
        step = F.col(by).asc() if up else F.col(by).desc()
        return Window.partitionBy(*within).orderBy(step).rowsBetween(Window.unboundedPreceding, until)

    per_bucket = base.groupBy(*keys, _BUCKET).agg(*[pick[kind](c).alias(f"_e_{out}") for c, out, kind, _ in wanted])
    carried = per_bucket.select(
        *keys,
        _BUCKET,
        *[pick[kind](f"_e_{out}").over(walk(_BUCKET, up, keys, -1)).alias(f"_e_{out}") for _, out, kind, up in wanted],
    )
    # greatest() and least() skip nulls, so the first bucket needs no special case
    return base.join(carried, [*keys, _BUCKET]).select(
        *df.columns,
        *[
            merge[kind](pick[kind](c).over(walk(order, up, [*keys, _BUCKET], 0)), F.col(f"_e_{out}")).alias(out)
            for c, out, kind, up in wanted
        ],
    )


def value_positions(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per group with `n` copies, `n_before` smaller rows and `n_total` rows."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counted, keys, value, ["n"])


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "avg_rank") -> DataFrame:
    """Average rank with ties of every row within its group; rows without a value are left out."""
    ranks = value_positions(df, keys, value).select(
        *keys, value, (F.col("n_before") + (F.col("n") + 1) / 2).alias(out)
    )
    return df.join(ranks, [*keys, value])


#: Rows of a bucket that one task puts in order, and the parts that a fuller one is cut into.
RANKED, SPLIT = 1 << 17, 1 << 12


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], names: Sequence[str], stored: bool = False
) -> DataFrame:
    """Interpolating quantiles, position (n-1)p counted from zero, one row per group.

    By selection: totals of value buckets tell which bucket holds each wanted position, and only the rows of those
    buckets are put in order. A bucket of one value needs no rows at all; one with more than RANKED rows is cut between its extremes, again
    and again if need be. Rows without a value are left out. The rows are read twice: unless they are `stored` already, their keys and values are
    written first.
    """
    keys = list(keys)
    if not stored:
        df = materialize(df.filter(F.col(value).isNotNull()).select(*keys, value), "quantile-rows")
    rows = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"), log_bucket(F.col(value)).alias(_BUCKET))
    extent = (F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    upto = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.groupBy(*keys, _BUCKET).agg(*extent).withColumns(
        {"_before": F.coalesce(F.sum("_n").over(upto), F.lit(0)), "_total": F.sum("_n").over(Window.partitionBy(*keys))}
    )
    heights = [(F.col("_total") - 1) * F.lit(float(p)) for p in probs]
    wanted = F.array_distinct(F.array(*(f(h) for h in heights for f in (F.floor, F.ceil))))

    def holding(buckets: DataFrame, ranks: Column) -> DataFrame:
        inside = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
        kept = buckets.withColumn("_ranks", inside).filter(F.size("_ranks") > 0)
        return materialize(kept.select(*keys, _BUCKET, "_lo", "_hi", "_n", "_before", "_total", "_ranks"), "quantile-buckets")

    hits = holding(placed, wanted)
    crowded = (F.col("_n") > RANKED) & (F.col("_lo") < F.col("_hi"))
    while not hits.filter(crowded).isEmpty():
        bucket = [*keys, _BUCKET, "_low"]
        full = hits.filter(crowded).withColumnsRenamed({"_lo": "_low", "_hi": "_high", "_before": "_start"}).drop("_n")
        inner = rows.join(full, [*keys, _BUCKET]).filter(F.col("_v").between(F.col("_low"), F.col("_high")))
        part = F.floor((F.col("_v") - F.col("_low")) / (F.col("_high") - F.col("_low")) * SPLIT)
        parts = inner.groupBy(*bucket, "_start", "_total", "_ranks", part.alias("_part")).agg(*extent)
        before = F.sum("_n").over(Window.partitionBy(*bucket).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        finer = holding(parts.withColumn("_before", F.col("_start") + F.coalesce(before, F.lit(0))), F.col("_ranks"))
        hits = hits.filter(~crowded).unionByName(finer)
    one = hits.filter(F.col("_lo") == F.col("_hi")).select(*keys, "_total", F.explode("_ranks").alias("_rank"), F.col("_lo").alias("_v"))
    near = rows.join(hits.filter(F.col("_lo") < F.col("_hi")), [*keys, _BUCKET]).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    number = F.row_number().over(Window.partitionBy(*keys, _BUCKET, "_lo").orderBy("_v")) - 1 + F.col("_before")
    ranked = near.select(*keys, "_total", number.alias("_rank"), "_ranks", "_v").filter(F.array_contains("_ranks", F.col("_rank")))
    found = one.unionByName(ranked.select(*keys, "_total", "_rank", "_v"))
    at = lambda position: F.max(F.when(F.col("_rank") == position, F.col("_v")))
    picks = [c for k, h in enumerate(heights) for c in (at(F.floor(h)).alias(f"_lo{k}"), at(F.ceil(h)).alias(f"_hi{k}"))]
    got = found.groupBy(*keys).agg(F.max("_total").alias("_total"), *picks)
    between = [(F.col(f"_lo{k}") + (F.col(f"_hi{k}") - F.col(f"_lo{k}")) * (h - F.floor(h))).alias(name) for k, (h, name) in enumerate(zip(heights, names, strict=True))]
    return got.select(*keys, *between)


def row_positions(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column, out: str = "position"
) -> DataFrame:
    """row_number() from 1 within each group; `bucket` must not decrease along `order`."""
    keys = list(keys)
    base = df.withColumn(_BUCKET, bucket)
    upto = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, _BUCKET)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, _BUCKET, F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*keys, _BUCKET).orderBy(*order)
    return base.join(offsets, [*keys, _BUCKET]).select(
        *df.columns, (F.row_number().over(inside) + F.col("_offset")).alias(out)
    )


def seeded_positions(
    df: DataFrame, keys: Sequence[str], row_id: Sequence[str], seed: int, out: str = "position"
) -> DataFrame:
    """A reproducible random order within each group: the same under any partitioning."""
    hashed = df.withColumn("_hash", F.xxhash64(*row_id, F.lit(seed)))
    placed = row_positions(hashed, keys, ["_hash", *row_id], hash_bucket(F.col("_hash")), out)
    return placed.drop("_hash")


def index_features(df: DataFrame, feature: str = "feature") -> DataFrame:
    """Distinct features with a zero-based `idx`, in an order fixed by a hash of the name."""
    names = df.filter(F.col(feature).isNotNull()).select(feature).distinct()
    placed = seeded_positions(names, [], [feature], 0, "idx")
    return placed.withColumn("idx", (F.col("idx") - 1).cast("int"))
