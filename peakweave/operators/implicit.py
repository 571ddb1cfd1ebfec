"""Files-by-features matrices whose absent cells are implied: measured cells, and one fill per feature for all others.

Nothing here lays the matrix out but `missing_cells` and `dense_rows`, at the border to long tables and vectors. Moments, totals
and normalisations count absent cells in closed form: a feature with fill f and m files without a value adds m * f to
its sum and m * f * f to its sum of squares.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.operators.ordering import index_features
from peakweave.session import materialize

#: Features and files of one part of the matrix at most; cells of one batch that leaves a task; files of a run; rows held until a feature ends; cells of a row of the batch.
FEATURES, FILES, ROWS, RUN, HELD, PRODUCT = 8192, 8192, 1 << 19, 512, 1 << 17, 1 << 12
_T = "_technique"


def missing_cells(
    df: DataFrame, fills: DataFrame | None, file: str = "file", feature: str = "feature", value: str = "value", technique: str | None = None,
    made: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """(file, feature, [technique,] fill) of every cell without a value, for each technique its files against its features.

    Features and files are dealt into blocks by hash. A task gets the files of a block, then each feature of a block followed by its
    measured cells, and writes the files that are not among these, features that lack the same run of files together: Spark lays out their
    products. The matrix itself is never shuffled or joined, and a task holds a step of features at a time, however many cells are measured. Cells whose value is null are
    missing. Rows with a null file or feature name no cell. Repeated cells count once. `fill` is null for features that `fills` lacks;
    `fills` has a fill per feature, per technique or per both. `made` changes it, once a feature and not once a cell.
    """
    marked = df.select(
        F.col(file).alias("_file"), F.col(feature).alias("_feature"), (F.lit("") if technique is None else F.col(technique)).alias(_T), F.col(value).isNotNull().alias("_there")
    ).filter(F.col("_file").isNotNull() & F.col("_feature").isNotNull() & F.col(_T).isNotNull())
    names = marked.select(_T, "_feature").distinct()
    if fills is not None:
        by = {c: hidden for c, hidden in ((feature, "_feature"), (technique, _T)) if c in fills.columns}
        names = names.join(fills.select(*[F.col(c).alias(hidden) for c, hidden in by.items()], F.col("fill").cast("double").alias("_fill")), list(by.values()), "left")
    else:
        names = names.withColumn("_fill", F.lit(None).cast("double"))
    if made is not None:
        names = names.withColumn("_fill", made(F.col("_fill")).cast("double"))
    names, files = materialize(names, "implicit-features"), materialize(marked.select(_T, "_file").distinct(), "implicit-files")
    n_names, tasks = names.count(), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = max(1, -(-files.count() // FILES))
    # small matrices are cut further, so that every task has a part
    blocks = max(1, -(-n_names // FEATURES), min(-(-n_names // RUN), -(-tasks // groups)))
    block, group = F.pmod(F.xxhash64("_feature"), F.lit(blocks)), F.pmod(F.xxhash64("_file"), F.lit(groups))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    parts = files.select(_T, group.alias("_group"), every(blocks).alias("_block"), F.lit(0).alias("_what"), "_file")
    parts = parts.unionByName(names.select(_T, every(groups).alias("_group"), block.alias("_block"), F.lit(1).alias("_what"), "_feature", "_fill"), allowMissingColumns=True)
    there = marked.filter("_there").select(_T, group.alias("_group"), block.alias("_block"), F.lit(2).alias("_what"), "_file", "_feature")
    parts = parts.unionByName(there, allowMissingColumns=True).select(_T, (F.col("_block") * groups + F.col("_group")).alias("_part"), "_what", "_file", "_feature", "_fill")
    # laying out costs far more than the shuffled bytes suggest, so tiny partitions are not merged
    dealt = parts.repartition(min(blocks * groups * (1 if technique is None else 3), 4 * tasks), _T, "_part")
    # files have no feature, so they come first; a feature comes before its cells
    dealt = dealt.sortWithinPartitions(_T, "_part", F.asc_nulls_first("_feature"), "_what")

    def lay_out(batches):
        run = 1 << (min(RUN, ROWS).bit_length() - 1)
        step = max(1, ROWS // run)

        def missing(files: pa.Array, features: pa.Table):
            what = features.column("_what").to_numpy()
            names, at = features.filter(pa.array(what == 1)), np.cumsum(what == 1)[what == 2] - 1
            row = pc.index_in(features.filter(pa.array(what == 2)).column("_file"), value_set=files).to_numpy()
            for first in range(0, names.num_rows, step):
                some = names.slice(first, step)
                feature, fill = (some.column(c).combine_chunks() for c in ("_feature", "_fill"))
                lo, hi = np.searchsorted(at, [first, first + step])
                for inner, names_of, outer, files_of in _rectangles(some.num_rows, len(files), at[lo:hi] - first, row[lo:hi], run):
                    named = pa.StructArray.from_arrays([feature.take(pa.array(names_of)), fill.take(pa.array(names_of))], names=["_feature", "_fill"])
                    lists = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x) for ends, x in ((outer, files.take(pa.array(files_of))), (inner, named)))
                    yield pa.RecordBatch.from_arrays([*lists, pa.repeat(some.column(_T)[0], len(inner) - 1)], out.names)

        def pieces():
            for batch in batches:
                if batch.num_rows:
                    mark, part = (batch.column(c).to_numpy(zero_copy_only=False) for c in (_T, "_part"))
                    cuts = [0, *(np.flatnonzero((part[1:] != part[:-1]) | (mark[1:] != mark[:-1])) + 1).tolist(), batch.num_rows]
                    for a, b in zip(cuts, cuts[1:], strict=False):
                        yield (mark[a], part[a]), pa.Table.from_batches([batch.slice(a, b - a)])

        for _, same in itertools.groupby(pieces(), lambda x: x[0]):
            files, held, n, most = [], [], 0, HELD
            for _, piece in same:
                n_files = np.count_nonzero(piece.column("_what").to_numpy() == 0)
                if n_files:
                    files.append(piece.slice(0, n_files).column("_file").combine_chunks())
                    piece = piece.slice(n_files)
                held.append(piece)
                n += piece.num_rows
                if n >= most:
                    rows = pa.concat_tables(held)
                    # the last feature may go on
                    last = int(np.flatnonzero(rows.column("_what").to_numpy() == 1)[-1])
                    yield from missing(pa.concat_arrays(files), rows.slice(0, last))
                    held, n = [rows.slice(last)], n - last
                    most = max(HELD, 2 * n)
            yield from missing(pa.concat_arrays(files), pa.concat_tables(held))

    kind = lambda c: marked.schema[c].dataType
    one = T.StructType([T.StructField("_feature", kind("_feature")), T.StructField("_fill", T.DoubleType())])
    out = T.StructType([T.StructField("_files", T.ArrayType(kind("_file"))), T.StructField("_names", T.ArrayType(one)), T.StructField(_T, kind(_T))])
    found = dealt.mapInArrow(lay_out, out).select("_files", F.explode("_names").alias("_name"), _T)
    shown = [F.explode("_files").alias(file), F.col("_name._feature").alias(feature), *([] if technique is None else [F.col(_T).alias(technique)])]
    return found.select(*shown, F.col("_name._fill").alias("fill"))


def _rectangles(n_names: int, n_files: int, name: np.ndarray, file: np.ndarray, run: int):
    """All (name, file) but those given, as products of some names and some files, a batch for each run of files.

    Yields (ends of the names, names, ends of the files, files). Names that lack no file of a run share its files, those left share the
    files of a quarter, then of a quarter of that; what is left then has a list of its own. Where more than half would be left,
    names have a list a run.
    """
    sizes = [size for size in (run, run >> 2, run >> 4) if size]
    whole = {}
    for size in sizes:
        whole[size] = np.ones((-(-n_files // size), n_names), bool)
        whole[size][file // size, name] = False
    if 2 * np.count_nonzero(whole[sizes[-1]]) < whole[sizes[-1]].size:
        sizes = sizes[:1]
    leaf = sizes[-1]
    for a in range(0, n_files, run):
        b = min(a + run, n_files)
        parts = []
        for i, size in enumerate(sizes):
            new = whole[size][a // size : -(-b // size)]
            if i:
                parent = sizes[i - 1]
                new = new & ~np.repeat(whole[parent][a // parent : -(-b // parent)], parent // size, axis=0)[: len(new)]
            s, x = np.nonzero(new)
            # a row of few names: its cells are held at once where they are laid out
            starts = np.flatnonzero((np.arange(len(s)) - np.searchsorted(s, s)) % max(1, PRODUCT // size) == 0)
            begin = a + s[starts] * size
            lengths = np.minimum(begin + size, b) - begin
            shift = np.cumsum(lengths) - lengths
            parts.append((np.diff(starts, append=len(s)), x, lengths, np.repeat(begin - shift, lengths) + np.arange(lengths.sum())))
        s, x = np.nonzero(~whole[leaf][a // leaf : -(-b // leaf)])
        number = np.zeros((-(-(b - a) // leaf), n_names), np.int64)
        number[s, x] = np.arange(len(s))
        here = (file >= a) & (file < b)
        left = a + s[:, None] * leaf + np.arange(leaf) < b
        left[number[(file[here] - a) // leaf, name[here]], (file[here] - a) % leaf] = False
        r, c = np.nonzero(left)
        parts.append((np.ones(len(s), np.int64), x, np.count_nonzero(left, axis=1), a + s[r] * leaf + c))
        names, names_of, files, files_of = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(files_of):
            yield np.concatenate([[0], np.cumsum(names)]), names_of, np.concatenate([[0], np.cumsum(files)]), files_of


@dataclass
class Implicit:
    """Measured cells (file, feature, value), all distinct, what stands for the others, (feature, fill) of every feature, and every file."""

    cells: DataFrame
    fills: DataFrame
    files: DataFrame
    file: str = "file"
    feature: str = "feature"
    value: str = "value"

    def moments(self) -> DataFrame:
        """(feature, n_absent, total, mean, sd, low, high) over all files, absent cells at their fill."""
        v, f = F.col(self.value), F.col("fill")
        # sums of the distances to the fill: absent cells add nothing, and near-constant features lose no digits
        seen = self.cells.join(self.fills, self.feature).groupBy(self.feature).agg(
            F.count(v).alias("_n"), F.sum(v - f).alias("_d"), F.sum((v - f) * (v - f)).alias("_dd"), F.min(v).alias("_low"), F.max(v).alias("_high"),
        )
        files = F.broadcast(self.files.agg(F.count(F.lit(1)).alias("_files")))  # one row
        all_of = self.fills.join(seen, self.feature, "left").join(files, F.lit(True))
        n, d, dd = F.coalesce("_n", F.lit(0)), F.coalesce("_d", F.lit(0.0)), F.coalesce("_dd", F.lit(0.0))
        absent = F.col("_files") - n
        spread = F.when(F.col("_files") > 1, F.sqrt(F.greatest(dd - d * d / F.col("_files"), F.lit(0.0)) / (F.col("_files") - 1)))
        edge = F.when(absent > 0, f)
        return all_of.select(
            self.feature, absent.alias("n_absent"), (f * F.col("_files") + d).alias("total"), (f + d / F.col("_files")).alias("mean"), spread.alias("sd"),
            F.least("_low", edge).alias("low"), F.greatest("_high", edge).alias("high"),
        )

    def file_totals(self) -> DataFrame:
        """(file, total) over all features: all fills, and what the measured cells have more."""
        more = self.cells.join(self.fills, self.feature).groupBy(self.file).agg(F.sum(F.col(self.value) - F.col("fill")).alias("_more"))
        base = F.broadcast(self.fills.agg(F.sum("fill").alias("_base")))  # one row
        return self.files.join(more, self.file, "left").join(base, F.lit(True)).select(self.file, (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("total"))

    def _by_feature(self, stats: DataFrame, change) -> Implicit:
        """Every value of a feature, its fill too, changed by figures of the feature."""
        stats = materialize(stats, "implicit-figures")
        cells = self.cells.join(stats, self.feature).withColumn(self.value, change(F.col(self.value))).select(*self.cells.columns)
        fills = self.fills.join(stats, self.feature).select(self.feature, change(F.col("fill")).alias("fill"))
        return replace(self, cells=cells, fills=fills)

    def zscore(self, constant: str = "zero") -> Implicit:
        flat = F.lit(0.0 if constant == "zero" else float("nan"))
        change = lambda v: F.when(F.col("sd") > 0, (v - F.col("mean")) / F.nullif(F.col("sd"), F.lit(0.0))).otherwise(flat)
        return self._by_feature(self.moments().select(self.feature, "mean", "sd"), change)

    def minmax(self, constant: str = "zero") -> Implicit:
        flat, width = F.lit(0.0 if constant == "zero" else float("nan")), F.col("high") - F.col("low")
        change = lambda v: F.when(width == 0, flat).otherwise((v - F.col("low")) / F.nullif(width, F.lit(0.0)))
        return self._by_feature(self.moments().select(self.feature, "low", "high"), change)

    def mapped(self, change) -> Implicit:
        """Every value changed alike, as by a logarithm."""
        cells = self.cells.withColumn(self.value, change(F.col(self.value)))
        return replace(self, cells=cells, fills=self.fills.withColumn("fill", change(F.col("fill"))))

    def long(self) -> DataFrame:
        """Every cell (file, feature, value, imputed), laid out."""
        stored = materialize(self.cells, "implicit-cells")
        cells = stored.select(self.file, self.feature, F.col(self.value).cast("double").alias(self.value), F.lit(False).alias("imputed"))
        absent = missing_cells(stored, self.fills, self.file, self.feature, self.value)
        return cells.unionByName(absent.select(self.file, self.feature, F.col("fill").alias(self.value), F.lit(True).alias("imputed")))

    def dense_rows(self, totals: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """One dense array `x` per file, in the order of the feature index that is returned beside it; absent cells at their fill.

        With `totals(file, total)` a row is divided by its file's total (by one if that is zero). The fills, as long as one row, go to
        every task; a task holds a few rows at once.
        """
        index = index_features(self.fills, self.feature)
        filled = materialize(index.join(self.fills, self.feature).select(self.feature, "idx", "fill"), "implicit-index")
        width = filled.count()
        fill = np.zeros(width)
        for i, f in filled.select("idx", "fill").toLocalIterator():
            fill[i] = np.nan if f is None else f
        shared = self.cells.sparkSession.sparkContext.broadcast(fill)
        packed = self.cells.filter(F.col(self.value).isNotNull()).join(filled.select(self.feature, "idx"), self.feature).groupBy(self.file).agg(
            F.collect_list(F.struct("idx", F.col(self.value).cast("double").alias("v"))).alias("_m")
        )
        packed = self.files.join(packed, self.file, "left")
        packed = packed.join(totals, self.file) if totals is not None else packed.withColumn("total", F.lit(1.0))

        file = self.file

        def rows(batches):
            few = max(1, (8 << 20) // max(1, width))
            for batch in batches:
                for at in range(0, batch.num_rows, few):
                    part = batch.slice(at, few)
                    cells = part.column("_m")
                    flat = cells.flatten()
                    x = np.tile(shared.value, part.num_rows)
                    sizes = pc.fill_null(pc.list_value_length(cells), 0).to_numpy(zero_copy_only=False)
                    x[np.repeat(np.arange(part.num_rows), sizes) * width + flat.field("idx").to_numpy(zero_copy_only=False)] = flat.field("v").to_numpy(zero_copy_only=False)
                    total = part.column("total").to_numpy(zero_copy_only=False)
                    x /= np.repeat(np.where(total == 0, 1.0, total), width)
                    dense = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * width, pa.int32()), pa.array(x))
                    yield pa.RecordBatch.from_arrays([part.column(file), dense], [file, "x"])

        schema = T.StructType([T.StructField(file, packed.schema[file].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
        return packed.select(file, "_m", "total").mapInArrow(rows, schema), filled.select(self.feature, "idx")


def implicit(cells: DataFrame, fills: DataFrame, default: float = 0.0, file: str = "file", feature: str = "feature", value: str = "value") -> Implicit:
    """The matrix of measured cells (one per file and feature; null values are absent) with `fills(feature, fill)`, and a default where those have none."""
    named = cells.filter(F.col(file).isNotNull() & F.col(feature).isNotNull())
    fills = named.select(feature).distinct().join(fills.select(feature, "fill"), feature, "left")
    fills = materialize(fills.select(feature, F.coalesce(F.col("fill").cast("double"), F.lit(float(default))).alias("fill")), "implicit-fills")
    files = materialize(named.select(file).distinct(), "implicit-files")
    return Implicit(named.filter(F.col(value).isNotNull()).select(file, feature, F.col(value).cast("double").alias(value)), fills, files, file, feature, value)
