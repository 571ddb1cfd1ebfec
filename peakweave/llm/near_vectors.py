"""Near duplicates of vectors: spherical k-means cells, blocked cosine products within cells, one vector of a group kept."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.components import connected_components
from peakweave.session import materialize

#: Rows of one side of a block product, about.
BLOCK = 512


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def spherical_kmeans(sample: np.ndarray, cells: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Unit centres of at most `cells` cells: assign by the largest cosine, move to the mean direction, repeat."""
    centres = sample[np.random.default_rng(seed).permutation(len(sample))[:cells]].copy()
    for _ in range(rounds):
        home = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1)
        centres[size > 1e-9] = sums[size > 1e-9] / size[size > 1e-9, None]
    return centres


def fitted_centres(reps: DataFrame, rows: int, sample_rows: int) -> np.ndarray:
    """Centres fitted to at most `sample_rows` vectors; their number grows with the root of the rows.

    They decide which vectors are compared in which task, never which are compared.
    """
    cells = max(1, math.isqrt(rows) // 16)
    share = max(1, rows // sample_rows)
    picked = reps.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(share)) == 0).select("x").limit(sample_rows)
    by_size: dict[int, list] = {}
    for r in picked.toLocalIterator():
        by_size.setdefault(len(r["x"]), []).append(r["x"])
    if not by_size:
        return np.zeros((0, 0))
    most = max(by_size.values(), key=len)
    return spherical_kmeans(unit(np.array(most, np.float64)), cells)


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which rows of a and b have a cosine of `least` or more. Blocks whose bounding caps decide need no product."""
    angle, caps = math.acos(least), []
    for x in (a, b):
        middle = x.sum(axis=0)
        size = np.linalg.norm(middle)
        if size < 1e-9:
            return a @ b.T >= least
        caps.append((middle / size, math.acos(min(1.0, max(-1.0, float((x @ (middle / size)).min()))))))
    apart = math.acos(min(1.0, max(-1.0, float(caps[0][0] @ caps[1][0]))))
    spread = caps[0][1] + caps[1][1]
    if apart + spread < angle - 1e-6:
        return np.ones((len(a), len(b)), bool)
    if apart - spread > angle + 1e-6:
        return np.zeros((len(a), len(b)), bool)
    return a @ b.T >= least


def forest(mask: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column) that connect what the mask connects, at most one less than its rows and columns."""
    rows, columns = mask.shape
    open_row, open_column, out = mask.any(axis=1), mask.any(axis=0), []
    while open_row.any():
        front = [int(np.argmax(open_row))]
        open_row[front[0]] = False
        while front:
            r = front.pop()
            fresh = np.flatnonzero(mask[r] & open_column)
            open_column[fresh] = False
            for c in fresh.tolist():
                out.append((r, c))
                near = np.flatnonzero(mask[:, c] & open_row)
                open_row[near] = False
                out += [(n, c) for n in near.tolist()]
                front += near.tolist()
    return out


def cells_met(x: np.ndarray, centres: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's cell, and (row, cell) of the cells of a higher number whose border is within reach of it.

    The distance to the border of cells n and c, as a sine, is (x.n - x.c) / |n - c|, so the centres are all a task needs; the distances of one
    centre to the others are made when vectors of its cell come up.
    """
    near, rows, cells = np.zeros(len(x), np.int64), [], []
    step = max(1, (1 << 22) // len(centres))
    for at in range(0, len(x), step):
        dots = x[at : at + step] @ centres.T
        home = np.argmax(dots, axis=1)
        near[at : at + step] = home
        for c in np.unique(home):
            mine = np.flatnonzero(home == c)
            apart = np.linalg.norm(centres[c] - centres, axis=1)
            gap = dots[mine, c][:, None] - dots[mine]
            margin = np.divide(gap, apart, out=np.zeros_like(gap), where=apart > 0)
            margin[:, : c + 1] = np.inf
            row, cell = np.nonzero(margin <= reach)
            rows.append(mine[row] + at)
            cells.append(cell)
    empty = [np.zeros(0, np.int64)]
    return near, np.concatenate(rows or empty), np.concatenate(cells or empty)


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *,
    least: float = 0.93, sample_rows: int = 20_000,
) -> DataFrame:
    """Links of vectors with equal labels and a cosine of `least` or more, one row per input row.

    Returns (id_col, n_links, component_id, kept): the number of other rows linked directly, the smallest id reachable by
    links, and whether the row has it. Vectors that are null, empty, zero, or hold null or non-finite components, and rows
    with a null label, are linked with nothing; vectors of different lengths are never linked.

    Equal vectors of a label are one vector that counts for all its rows. Spherical k-means, fitted to at most
    `sample_rows` vectors, gives cells; a vector is at home in the cell of its nearest centre, and visits each cell
    of a higher number whose border is within the angle of `least`: no partner can lie beyond, so no link is lost. Cells of a label
    are cut into blocks of about BLOCK vectors, and each pair of blocks is one cosine product in double precision; the
    task returns counts and a spanning forest of its links, never its pairs.

    Rows with a null id take part but name no component. Rows that share an id count one by one. An empty table gives an
    empty result; other columns are ignored.
    """
    array = F.col(vector_col).cast("array<double>")
    usable = F.col(label_col).isNotNull() & (F.size(array) > 0) & ~F.exists(array, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists(array, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), array.alias("x"), F.coalesce(usable, F.lit(False)).alias("usable"))
    # 0.0 and -0.0 are the same number
    rows = rows.withColumn("x", F.transform("x", lambda v: v + F.lit(0.0))).withColumn("rep", F.when(F.col("usable"), F.xxhash64("label", "x")))
    reps = rows.where("usable").groupBy("label", "x").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"), F.first("rep").alias("rep"))
    reps = materialize(reps, "near-vectors-reps")
    count = reps.count()
    centres = fitted_centres(reps, count, sample_rows)

    reach = math.sin(math.acos(least)) + 1e-9

    def place(batches):
        for pdf in batches:
            out = []
            for size, part in pdf.groupby(pdf["x"].map(len)):
                x = unit(np.stack(part["x"].to_list()))
                if not len(centres) or size != centres.shape[1]:
                    cell, row, home = np.zeros(len(x), np.int64), np.arange(len(x)), np.ones(len(x), bool)
                else:
                    near, row, cell = cells_met(x, centres, reach)
                    row, cell = np.concatenate((np.arange(len(x)), row)), np.concatenate((near, cell))
                    home = np.arange(len(row)) < len(x)
                found = part.iloc[row][["label", "rep", "copies"]].assign(cell=cell, home=home, size=size)
                out.append(found.assign(x=list(x[row])))
            if out:
                yield pd.concat(out)[["label", "size", "cell", "home", "rep", "copies", "x"]]

    label = T.StructField("label", vectors.schema[label_col].dataType)
    schema = T.StructType([label, *(T.StructField(n, k) for n, k in (("size", T.IntegerType()), ("cell", T.LongType()), ("home", T.BooleanType()), ("rep", T.LongType()), ("copies", T.LongType()), ("x", T.ArrayType(T.DoubleType()))))])
    placed = materialize(reps.select("label", "rep", "copies", "x").mapInPandas(place, schema), "near-vectors-placed")
    cell = ["label", "size", "cell"]
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    sizes = placed.groupBy(*cell).agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count(F.when(~F.col("home"), 1)).alias("guests"))
    sizes = materialize(sizes.where("homes > 0"), "near-vectors-sizes")
    dealt = placed.join(sizes, cell).withColumn("n", F.when(F.col("home"), F.col("homes")).otherwise(F.col("guests")))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), blocks).cast("int"))
    homes = F.ceil(F.col("homes") / BLOCK).cast("int")
    guests = F.ceil(F.col("guests") / BLOCK).cast("int")
    # a home block meets itself, the home blocks after it, and all guest blocks (numbered after the home blocks)
    first = F.when(F.col("home"), F.col("own")).otherwise(homes + F.col("own"))
    others = F.when(F.col("home"), F.sequence(F.lit(0), homes + guests - 1)).otherwise(F.sequence(F.lit(0), homes - 1))
    dealt = dealt.withColumn("first", first).withColumn("other", F.explode(others))
    dealt = dealt.select(*cell, F.least("first", "other").alias("low"), F.greatest("first", "other").alias("high"), "first", "rep", "copies", "x")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        low, high = pdf["low"].iat[0], pdf["high"].iat[0]
        a = pdf[pdf["first"] == low]
        b = pdf[pdf["first"] == high]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        mask = linked(np.stack(a["x"].to_list()), np.stack(b["x"].to_list()), least)
        ids_a, ids_b = a["rep"].to_numpy(), b["rep"].to_numpy()
        if low == high:
            mask = mask & ~np.eye(len(a), dtype=bool)
        tallies = [pd.DataFrame({"a": ids_a, "b": ids_a, "links": mask @ b["copies"].to_numpy()})]
        if low != high:
            tallies.append(pd.DataFrame({"a": ids_b, "b": ids_b, "links": mask.T @ a["copies"].to_numpy()}))
        edges = [(ids_a[r], ids_b[c], 0) for r, c in forest(mask)]
        tallies.append(pd.DataFrame(edges, columns=["a", "b", "links"]))
        out = pd.concat(tallies).astype("int64")
        return out[(out["links"] > 0) | (out["a"] != out["b"])]

    found = dealt.groupBy(*cell, "low", "high").applyInPandas(compare, "a long, b long, links long")
    found = materialize(found, "near-vectors-found")
    tally = materialize(found.where("a = b").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links")), "near-vectors-tally")
    part = materialize(connected_components(found.where("a != b")), "near-vectors-components").withColumnRenamed("id", "rep")
    named = reps.select("rep", "first_id", "copies").join(part, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    smallest = materialize(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "near-vectors-smallest")
    named = named.join(smallest, "component").join(tally, "rep", "left")
    named = materialize(named.select("rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-vectors-named")
    single = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    found = rows.where("usable").select("id", "rep").join(named, "rep").select("id", "n_links", "component_id").unionByName(single)
    return found.select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
