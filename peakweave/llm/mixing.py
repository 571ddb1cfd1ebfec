"""Mixing sources to target weights by pivotal dependent rounding, with residuals combined in a tree."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.session import materialize

# fixed values: weights of the sources in order, share of all words that the mix takes, most copies of a source
WEIGHTS, SHARE, MOST_COPIES = (5.0, 2.0, 1.0), 1.5, 2.0
WORD = r"[^\x20\x09-\x0D]+"
#: Equal rows that one unit of work stands for at most, units of a group, groups whose residuals meet in the tree's next level.
PART, GROUP, FAN = 1024, 1000, 256
#: A fraction this near to a whole number is one.
NEAR = 1e-9


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES) -> DataFrame:
    """`target` for each row of (source, source_size).

    Sources in code-point order, null last, weigh `weights` in turn and share `share` of all sizes. A target stops at `most` times
    its source's size; what is above goes to the sources still below by weight. With level L a target is the smaller of
    weight * L and the stop; L rises until the targets add up. A round is one sum over the sources, and only that sum is read.
    """
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col("source").asc_nulls_last()]
    placed = sources.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    placed = materialize(placed.withColumn("at", F.monotonically_increasing_id()), "mixing-sources")  # the task's number, then 33 bits of row number
    task, row = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    counts = {r["task"]: r["n"] for r in placed.groupBy(task.alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a task
    shift, before = F.lit(0), 0
    for k in sorted(counts):
        shift, before = F.when(task == k, F.lit(before % len(weights))).otherwise(shift), before + counts[k]
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(shift + row, F.lit(len(weights))) + 1).cast("int"))
    stop = F.col("source_size") * most
    sized = materialize(placed.select(*sources.columns, weight.alias("weight"), stop.alias("stop")), "mixing-weights")
    total, weighed = sized.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted, level, stopped = share * (total or 0), 0.0, -1
    if wanted:
        level = wanted / weighed
        while True:
            full = F.col("weight") * level > F.col("stop")
            held, left, n = sized.agg(F.sum(F.when(full, F.col("stop"))), F.sum(F.when(~full, F.col("weight"))), F.count(F.when(full, 1))).first()
            if n == stopped or not left:
                break
            stopped, level = n, (wanted - (held or 0.0)) / left
    return sized.select(*sources.columns, F.least(F.col("weight") * level, F.col("stop")).alias("target"))


def coin(order: int, level: int, seed: int) -> float:
    """A number in [0, 1) from the row's hash: the same in every run."""
    x = (order ^ (seed * 0x9E3779B97F4A7C15 + level * 0xD1342543DE82EF95)) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return ((x ^ (x >> 31)) >> 11) / (1 << 53)


def pivot(a: float, a_size: int, b: float, b_size: int, u: float) -> tuple[float, float]:
    """Move words between two fractions until one is 0 or 1; neither expectation changes.

    Up to `to_a` words can go to the first and up to `to_b` to the second; the odds are the other way round, so the mean move is 0.
    """
    to_a = min((1 - a) * a_size, b * b_size)
    to_b = min(a * a_size, (1 - b) * b_size)
    moved = to_a if u * (to_a + to_b) < to_b else -to_b
    a, b = a + moved / a_size, b - moved / b_size
    return (round(a) if abs(a - round(a)) < NEAR else a), (round(b) if abs(b - round(b)) < NEAR else b)


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST_COPIES, whole_copies: bool = False, seed: int = 11,
) -> DataFrame:
    """How many words of each document a mix takes whose sources have target weights.

    Returns one row per document: (id_col, size, source_size, target, copies, taken). Size is the number of words; targets are those of
    `source_targets`. A document of a source wants target / source_size copies. It takes the whole part; the fractions left are
    rounded by the pivotal method: two documents of a source pass words to and fro until one fraction is 0 or 1, with odds that keep
    each document's expectation and the source's words. The last fraction of a source is taken as a part of that document's words,
    so a source's words are its target but for rounding (`whole_copies`: it is rounded by a coin, so the source misses by less than one document).

    Work: rows equal in id, source and size are counted first (a unit stands for at most PART of them, and takes its whole copies at
    once, as pairing equal rows would). A hash deals the units of a source into groups of about GROUP; a task pairs the units of a group one
    after another and keeps one fraction. The residuals of about FAN groups make a group of the tree's next level, until a source has one left. Groups
    depend on hashes and counts alone, so reruns agree however tasks are cut, and a hot source has many of them.

    Null text has size 0. Null sources are one source, the last. A document of size 0 takes nothing. Null and repeated ids are taken row by row;
    which of several equal rows takes a copy has no meaning. An empty table gives an empty result; other columns are ignored.
    """
    cols = [F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")]
    units = docs.select(*cols).groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    units = units.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / PART))))
    units = units.withColumn("rows", F.least(F.lit(PART), F.col("rows") - F.col("part") * PART))
    units = materialize(units.withColumn("order", F.xxhash64("id", "source", "size", "part")), "mixing-units")
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.ceil(F.count(F.lit(1)) / GROUP).alias("groups"))
    targets = materialize(source_targets(sources, weights, share, most).withColumnRenamed("source", "of"), "mixing-targets")
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(wanted)
    many = (wanted - whole) * F.col("rows")
    extra = F.floor(many + NEAR)
    rest = F.greatest(many - extra, F.lit(0.0))
    joined = units.join(targets, units["source"].eqNullSafe(targets["of"])).select(
        "id", "source", "size", "rows", "part", "order", "source_size", "target", whole.alias("copies"), extra.alias("extra"),
        F.when((rest > NEAR) & (F.col("size") > 0), rest).otherwise(0.0).alias("rest"), F.pmod("order", "groups").alias("tree"), "groups",
    )

    def rounds(level: int):
        def run(batches):
            held = None  # the run's source and group, and the unit whose fraction is open

            for batch in batches:
                out = []
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = list(row)
                    if held and (held[1] != row[1] or held[11] != row[11]):
                        out.append(held)
                        held = None
                    if not row[10]:
                        out.append(row)
                    elif held is None:
                        held = row
                    else:
                        held[10], row[10] = pivot(held[10], held[2], row[10], row[2], coin(row[5], level, seed))
                        still = [r for r in (held, row) if 0 < r[10] < 1]
                        for r in (held, row):
                            if not 0 < r[10] < 1:
                                r[9], r[10] = r[9] + int(r[10]), 0.0
                                out.append(r)
                        held = still[0] if still else None
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out, strict=True), batch.schema.types, strict=True)], batch.schema.names) if out else batch.slice(0, 0)
            if held:
                yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(held, batch.schema.types, strict=True)], batch.schema.names)

        return run

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in joined.schema])
    order = ["source", "tree", "order", "id", "size", "part"]
    settled, level, most_groups = [], 0, targets.agg(F.max("groups")).first()[0] or 1
    while True:
        dealt = joined.repartition("source", "tree").sortWithinPartitions(*order)
        step = materialize(dealt.mapInArrow(rounds(level), schema), "mixing-level")
        settled.append(step.where("rest = 0 OR groups = 1"))
        if most_groups == 1:
            break
        most_groups, level = math.ceil(most_groups / FAN), level + 1
        fewer = F.ceil(F.col("groups") / FAN)
        joined = step.where("rest > 0 AND groups > 1").withColumn("groups", fewer).withColumn("tree", F.pmod("tree", "groups"))
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    if whole_copies:
        words = F.when(F.pmod(F.xxhash64("order", F.lit(seed)), F.lit(1 << 30)) < F.col("rest") * (1 << 30), F.col("size")).otherwise(F.lit(0))
    else:
        words = F.round(F.col("rest") * F.col("size")).cast("long")
    done = done.withColumn("words", words).withColumn("row", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    copies = F.col("copies") + (F.col("row") < F.col("extra")).cast("long")
    taken = copies * F.col("size") + F.when(F.col("row") == F.col("extra"), F.col("words")).otherwise(F.lit(0))
    return done.select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"), taken.cast("long").alias("taken"))
