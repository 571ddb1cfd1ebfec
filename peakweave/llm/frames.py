"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.session import materialize

# fixed values: white space other than the space, as any of the tokenizer libraries may see it
OTHER_SPACE = "\t\n\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -​    　﻿"

SLICE_BYTES = 4 << 20


def field(df: DataFrame, column: str, name: str | None = None) -> T.StructField:
    """The schema entry of a column, nullable, for the result of an Arrow function."""
    return T.StructField(name or column, df.schema[column].dataType, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def row_keyed(df: DataFrame) -> tuple[DataFrame, str]:
    """The table with a key for each row, and the key's name: the row's file and number for files, else a number in a copy that is written once.

    Rows that agree in every column have keys of their own, and a row has the same key whenever it is read again.
    """
    name = unused(df, "row_key")
    try:
        keyed = df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
        if keyed.schema[name].dataType["row"].dataType == T.LongType():
            return keyed, name
    except AnalysisException:
        pass  # not a table of files with row numbers
    return materialize(df.withColumn(name, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("row"))), "row-keys"), name


def text_slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows that hold at most `limit` bytes of text, a longer text alone."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start, done = 0, 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield batch.slice(start, end - start)
        start, done = end, int(sizes[end - 1])


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """Texts without nulls: a null counts as empty."""
    return pc.fill_null(batch.column(column), "")


def chunk_codes(texts: pa.Array, any_space: bool) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Each text cut at white space (or at each single space): distinct chunks, the code of each chunk, chunks per text."""
    parts = pc.utf8_split_whitespace(texts) if any_space else pc.split_pattern(texts, " ")
    coded = pc.dictionary_encode(parts.flatten())
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False), pc.list_value_length(parts).to_numpy(zero_copy_only=False)


def ragged_take(values: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Runs of `values` (run i holds sizes[i] entries, one after another) for each pick, joined."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else np.zeros(0, np.int64)
    lengths = sizes[picks]
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return values[np.repeat(starts[picks] - (ends - lengths), lengths) + np.arange(total)]


def run_sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum over each run of the given size; empty runs give 0."""
    total = np.concatenate(([0], np.cumsum(values)))
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


class BoundedCache:
    """A worker's memory of at most `entries` results, so that a worker never grows without limit.

    It holds two halves; when the newer one is full it takes the place of the older one. What is asked for stays.
    """

    def __init__(self, entries: int):
        self.half, self.new, self.old = max(1, entries // 2), {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.half:
            self.old, self.new = self.new, {}
        self.new[key] = value
