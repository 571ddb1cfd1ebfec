"""Long and wide forms, and vectors at the border to machine learning."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from peakweave.operators.ordering import index_features

MAX_WIDE = 2000
#: A row of which only the cells other than 0 are kept.
SPARSE = StructType([StructField("size", IntegerType()), StructField("idx", ArrayType(IntegerType())), StructField("v", ArrayType(DoubleType()))])


def to_matrix(
    df: DataFrame, rows: Sequence[str], col: str, value: str, names: Sequence | None = None
) -> DataFrame:
    """Pivot to one column per name. The names are given, or read when there are at most MAX_WIDE of them."""
    if names is None:
        found = [r[0] for r in df.select(col).distinct().orderBy(col).limit(MAX_WIDE + 1).collect()]
        if len(found) > MAX_WIDE:
            raise ValueError(f"more than {MAX_WIDE} columns: keep the long form or use to_rows")
        names = found
    return df.groupBy(*rows).pivot(col, list(names)).agg(F.avg(value))


def to_long(df: DataFrame, ids: Sequence[str], name: str = "feature", value: str = "value",
            columns: Sequence[str] | None = None, drop_missing: bool = False) -> DataFrame:
    """One row per cell of a wide table."""
    columns = list(columns) if columns is not None else [c for c in df.columns if c not in ids]
    long = df.unpivot(list(ids), columns, name, value)
    return long.filter(F.col(value).isNotNull()) if drop_missing else long


def transpose(df: DataFrame, row: str = "file", col: str = "feature") -> DataFrame:
    """Swap the roles of rows and columns; in the long form only the names change."""
    return df.withColumnsRenamed({row: "_t", col: row}).withColumnRenamed("_t", col)


def array_to_long(df: DataFrame, row: str, array: str, col: str = "feature", value: str = "value") -> DataFrame:
    """One row per element of an array column."""
    keep = [c for c in df.columns if c != array]
    return df.select(*keep, F.posexplode(array).alias(col, value)).withColumn(value, F.col(value).cast("double"))


def to_rows(
    cells: DataFrame, row: str = "file", col: str = "feature", value: str = "value",
    carry: Sequence[str] = (), index: DataFrame | None = None, fill: float | None = 0.0, sparse: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """One dense array per sample, plus the feature index.

    `cells` hold one value per (row, col), so a sample's array is as long as the feature list and no longer,
    however often its file occurs in the raw data. With `sparse` a row holds its cells only, x being (size, idx, v) in the
    order of the index, and all others are 0: for lists so long that a dense row is a matter of megabytes.
    """
    if sparse and fill != 0.0:
        raise ValueError("absent cells of sparse rows are 0")
    index = index_features(cells, col) if index is None else index
    width = index.count()
    packed = (
        cells.filter(F.col(value).isNotNull())
        .join(index, col)
        .groupBy(row, *carry)
        .agg(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col(value).cast("double").alias("v"))).alias("_m"))
    )

    def lay_out(batches):
        # cells are written to their places: work is the length of the rows, whatever the order of the cells
        for batch in batches:
            cells = batch.column("_m")
            flat = cells.flatten()
            line = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cells).to_numpy(zero_copy_only=False))
            at = line * width + flat.field("idx").to_numpy(zero_copy_only=False)
            x = np.full(batch.num_rows * width, 0.0 if fill is None else float(fill))
            x[at] = flat.field("v").to_numpy(zero_copy_only=False)
            empty = None
            if fill is None:
                empty = np.ones(len(x), bool)
                empty[at] = False
            dense = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * width, pa.int32()), pa.array(x, mask=empty))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (row, *carry)), dense], [row, *carry, "x"])

    def lay_out_sparse(batches):
        # as in a dense row, one of several cells of a place counts, the last
        for batch in batches:
            flat = batch.column("_m").flatten()
            idx, v = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("idx", "v"))
            line = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column("_m")).to_numpy(zero_copy_only=False))
            order = np.lexsort((idx, line))
            idx, v, line = idx[order], v[order], line[order]
            last = np.append((idx[1:] != idx[:-1]) | (line[1:] != line[:-1]), True)[: len(idx)]
            ends = np.concatenate([[0], np.cumsum(np.bincount(line[last], minlength=batch.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(a[last])) for a in (idx.astype(np.int32), v)]
            x = pa.StructArray.from_arrays([pa.array(np.full(batch.num_rows, width, np.int32)), *lists], ["size", "idx", "v"])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (row, *carry)), x], [row, *carry, "x"])

    if sparse:
        schema = StructType([*(packed.schema[c] for c in (row, *carry)), StructField("x", SPARSE)])
        return packed.mapInArrow(lay_out_sparse, schema), index
    schema = StructType([*(packed.schema[c] for c in (row, *carry)), StructField("x", ArrayType(DoubleType()))])
    return packed.mapInArrow(_in_small_batches(lay_out, width), schema), index


def _in_small_batches(lay_out, width: int):
    """Rows of many columns go a few at a time, so that a batch of dense rows stays near 64 MB."""
    rows = max(1, (8 << 20) // max(1, width))

    def run(batches):
        for batch in batches:
            yield from lay_out(batch.slice(at, rows) for at in range(0, batch.num_rows, rows))

    return run


def to_vectors(rows: DataFrame, array: str = "x", out: str = "features") -> DataFrame:
    """Spark ML vectors from dense arrays."""
    return rows.withColumn(out, array_to_vector(F.col(array).cast("array<double>")))
