"""Named queries over the given tables, with SQL for those it can express.

The tables stand in for peak data: a line item is a peak, its supplier the file, its part the feature and its price
the value. Values are whole cents and positions whole ten-thousandths, so sums do not depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Peaks that one task gathers into cells, about.
GATHERED = 1 << 18
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def r(col: Column | str, digits: int = 8) -> Column:
    """Rounding that hides the order in which doubles were added."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def rounded(df: DataFrame, *cols: str, digits: int = 8) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in cols})


def cents(col: str) -> Column:
    return F.round(F.col(col) * 100)


TECHNIQUE = "CASE l_partkey % 3 WHEN 0 THEN 'GC' WHEN 1 THEN 'HPLC' ELSE 'ICP' END"

PEAKS_SQL = f"""peaks AS (
  SELECT l_suppkey AS file, l_partkey AS feature, round(l_extendedprice * 100) AS value,
         CASE WHEN l_suppkey % 10 = 0 THEN 'Blanks' ELSE 'Sample' END AS type,
         l_suppkey % 3 AS batch, l_linenumber % 3 AS replicate,
         round((l_quantity + l_discount) * 100) AS rt, l_orderkey AS scan, l_linenumber AS line,
         {TECHNIQUE} AS technique,
         l_suppkey * 10 + l_partkey % 3 AS sample
  FROM lineitem)"""

LABELS_SQL = """labelled_files AS (
  SELECT s_suppkey AS file, r_name AS plastic_type, n_name AS subcategory, s_suppkey % 3 AS polymer,
         CASE WHEN s_suppkey % 2 = 0 THEN 'Environmental' ELSE 'Store-Bought' END AS source
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""

CELLS_SQL = f"""{PEAKS_SQL}, {LABELS_SQL},
cells AS (
  SELECT p.file, p.feature, l.plastic_type, l.subcategory, l.source, avg(p.value) AS value
  FROM peaks p JOIN labelled_files l ON p.file = l.file GROUP BY ALL)"""

# one sample per supplier and technique, so that every other technique is structurally zero for it
SAMPLES_SQL = f"""{PEAKS_SQL}, {LABELS_SQL},
cells AS (
  SELECT p.sample AS file, p.feature, p.technique, l.plastic_type, l.subcategory, l.source, l.polymer, avg(p.value) AS value
  FROM peaks p JOIN labelled_files l ON p.file = l.file GROUP BY ALL)"""

POSITIONED_SQL = """positioned AS (
  SELECT l_suppkey AS file, l_partkey AS feature, round(l_extendedprice * 100) AS value,
         round(p_retailprice * 10000) + round(l_tax * 2500) AS mz, round((l_quantity + l_discount) * 100) AS rt,
         l_orderkey AS scan, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def peaks(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("file"),
        F.col("l_partkey").alias("feature"),
        cents("l_extendedprice").alias("value"),
        F.when(F.col("l_suppkey") % 10 == 0, "Blanks").otherwise("Sample").alias("type"),
        (F.col("l_suppkey") % 3).alias("batch"),
        (F.col("l_linenumber") % 3).alias("replicate"),
        F.round((F.col("l_quantity") + F.col("l_discount")) * 100).alias("rt"),
        F.col("l_orderkey").alias("scan"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_partkey") % 3 == 0, "GC").when(F.col("l_partkey") % 3 == 1, "HPLC").otherwise("ICP").alias("technique"),
        (F.col("l_suppkey") * 10 + F.col("l_partkey") % 3).alias("sample"),
    )


def positioned(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", F.round(F.col("p_retailprice") * 10000).alias("_m"))
    line = table(spark, folder, "lineitem")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("file"),
        F.col("l_partkey").alias("feature"),
        cents("l_extendedprice").alias("value"),
        (F.col("_m") + F.round(F.col("l_tax") * 2500)).alias("mz"),
        F.round((F.col("l_quantity") + F.col("l_discount")) * 100).alias("rt"),
        F.col("l_orderkey").alias("scan"),
        F.col("l_linenumber").alias("line"),
        F.when(F.col("l_suppkey") % 10 == 0, "Blanks").otherwise("Sample").alias("type"),
    )


def labelled_files(spark: SparkSession, folder: str) -> DataFrame:
    s, n, g = (table(spark, folder, t) for t in ("supplier", "nation", "region"))
    return (
        s.join(n, s["s_nationkey"] == n["n_nationkey"])
        .join(g, n["n_regionkey"] == g["r_regionkey"])
        .select(
            F.col("s_suppkey").alias("file"),
            F.col("r_name").alias("plastic_type"),
            F.col("n_name").alias("subcategory"),
            (F.col("s_suppkey") % 3).alias("polymer"),
            F.when(F.col("s_suppkey") % 2 == 0, "Environmental").otherwise("Store-Bought").alias("source"),
        )
    )


def dealt(spark: SparkSession, folder: str, rows: DataFrame, *keys: str) -> DataFrame:
    """Peaks dealt by the keys of their cells, about GATHERED to a task: the tables in which they are gathered stay as small however many peaks there are.

    Nearly every peak is a cell of its own, so gathering those of a file split first would hold the whole split.
    """
    parts = -(-table(spark, folder, "lineitem").count() // GATHERED)
    return rows.repartition(max(1, parts), *keys)


def cells(spark: SparkSession, folder: str) -> DataFrame:
    """One value per (file, feature) with labels."""
    joined = dealt(spark, folder, peaks(spark, folder).join(labelled_files(spark, folder), "file"), "file", "feature")
    return joined.groupBy("file", "feature", "plastic_type", "subcategory", "source").agg(F.avg("value").alias("value"))


def sample_cells(spark: SparkSession, folder: str) -> DataFrame:
    """One value per (sample, feature), samples being measured by one technique each."""
    joined = dealt(spark, folder, peaks(spark, folder).join(labelled_files(spark, folder), "file"), "sample", "feature")
    return joined.groupBy(
        F.col("sample").alias("file"), "feature", "technique", "plastic_type", "subcategory", "source", "polymer"
    ).agg(F.avg("value").alias("value"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    """Dense samples: (file, label, x)."""
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("file"), F.col("label"), F.col("embedding").cast("array<double>").alias("x")
    )


VECTORS_SQL = """vec AS (
  SELECT vec_id AS file, label, CAST(unnest(embedding) AS DOUBLE) AS value, unnest(range(len(embedding))) AS feature
  FROM embeddings)"""
