"""Reading result files and writing tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from peakweave.functions.names import ALGORITHM_DEFAULT, ALGORITHM_RULES, classify_by_name
from peakweave.schema import GC_CSV

# Files of single-replicate field samples and earlier blanks that are left out of the gas
# chromatography runs, and the texts that mark blanks and information files.
GC_EXCLUDED = (
    "2022",
    "USE_01", "USE_02", "USE_05", "USE_06", "USE_09", "USE_10", "USE_11", "USE_12", "USE_13",
    "USE_15", "USE_16", "USE_17", "USE_18", "USE_19", "USE_20",
    "USSB_01", "USSB_08",
)
GC_BLANK = "2022-"
LC_BLANK = "Blank"
OLDER_EXCLUDED = ("Blank", "Info")


def filter_files(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), file: str = "file") -> DataFrame:
    """Keep rows whose file name holds one of `include` (any, if empty) and none of `exclude`; the texts are patterns.

    On a file source Spark applies the condition to `_metadata.file_name` when it lists the files.
    """
    out = df
    if include:
        out = out.filter(F.col(file).rlike("|".join(include)))
    if exclude:
        out = out.filter(~F.col(file).rlike("|".join(exclude)))
    return out


def _named(df: DataFrame, include: Sequence[str], exclude: Sequence[str], by_folder: bool = False) -> DataFrame:
    name = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1) if by_folder else F.col("_metadata.file_name")
    if include:
        df = df.filter(name.rlike("|".join(include)))
    if exclude:
        df = df.filter(~name.rlike("|".join(exclude)))
    return df.withColumn("file", name)


def read_peaks(
    spark: SparkSession, path: str, schema: StructType = GC_CSV, include: Sequence[str] = (), exclude: Sequence[str] = (),
    glob: str = "*.csv", skip: int = 0, keep: Sequence[str] = ("Area", "m.z", "RT"),
    by_folder: bool = False,
) -> DataFrame:
    """All peak lists of a folder as (file, value, mz, rt). Excluded files are never opened.

    With `by_folder` a list is a folder of part files and its name is the folder's. `skip` banner lines above the header are dropped in each file.
    """
    if skip:
        return read_with_banner(spark, path, schema, skip, include, exclude, glob).select(
            "file", *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, ("value", "mz", "rt"), strict=True)]
        )
    raw = spark.read.schema(schema).option("header", True).option("pathGlobFilter", glob).csv(path)
    return _named(raw, include, exclude, by_folder).select(
        "file", *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, ("value", "mz", "rt"), strict=True)]
    )


def read_with_banner(
    spark: SparkSession, path: str, schema: StructType, skip: int, include: Sequence[str] = (), exclude: Sequence[str] = (),
    glob: str = "*.csv",
) -> DataFrame:
    """Files with `skip` banner lines and a header line before the data.

    Lines are dropped by their position: the first `skip` + 1 of each file, whatever they hold. Every later line is a
    row; numbers that do not parse are null. Large files are still split over tasks, as the banner lies in a file's
    first split, whose lines come in order. A quoted value may not hold a line break.
    """
    raw = spark.read.option("pathGlobFilter", glob).text(path)
    lines = _named(raw, include, exclude).select(
        "file", "value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("begin")
    )

    def after_banner(batches):
        split, seen = None, 0
        for lines in batches:
            if lines.empty:
                continue
            at = lines.groupby(["path", "begin"], sort=False).cumcount()
            first = (lines["path"].iat[0], lines["begin"].iat[0])
            if first == split:
                at[(lines["path"] == first[0]) & (lines["begin"] == first[1])] += seen
            split, seen = (lines["path"].iat[-1], lines["begin"].iat[-1]), int(at.iat[-1]) + 1
            yield lines.loc[(lines["begin"] > 0) | (at > skip), ["file", "value"]]

    data = lines.mapInPandas(after_banner, "file string, value string").filter(F.trim("value") != "")
    row = F.from_csv("value", ", ".join(f"`{f.name}` string" for f in schema.fields))
    return data.select("file", row.alias("_r")).select(
        "file", *[F.col(f"_r.`{f.name}`").try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def read_results(spark: SparkSession, path: str, schema: StructType, fmt: str = "csv", glob: str = "*.csv") -> DataFrame:
    """Every result file below a folder, tagged with its directory (the technique) and the algorithm in its name."""
    reader = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    raw = reader.option("header", True).csv(path) if fmt == "csv" else reader.format(fmt).load(path)
    where = F.col("_metadata.file_path")
    return raw.select(
        "*",
        F.regexp_extract(where, r"([^/]+)/[^/]+$", 1).alias("technique"),
        classify_by_name(F.col("_metadata.file_name"), ALGORITHM_RULES, ALGORITHM_DEFAULT).alias("algo"),
    )


def read_sheets(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Sheets stored as `sheet=<name>` folders, as one table with the sheet name as a column."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def read_feature_list(spark: SparkSession, path: str, column: str = "feature") -> DataFrame:
    """Names in a plain CSV, to be used as a filter."""
    return spark.read.schema(f"`{column}` string").option("header", True).csv(path).filter(F.col(column).isNotNull())


def drop_legacy_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop leftover rows in which all but one column is empty."""
    columns = list(columns) if columns is not None else df.columns
    filled = sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int"))
    return df.filter(filled != 1)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """One folder per result; refuses to overwrite unless asked."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
