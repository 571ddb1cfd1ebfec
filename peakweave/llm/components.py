"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peakweave.session import materialize

JUMPS = 3


def connected_components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(id, component) for every id in a link; component is one id of its members, the same for all of them.

    Every vertex points at its smallest neighbour if that is smaller than itself; pointers are followed a few steps;
    vertices that reach the same one become one vertex. What links are left between different vertices go into the
    next round, until none is left. Each round at least halves the vertices that still have links, and its tables are
    written to the shared folder, so a lost executor costs a re-read. No vertex's neighbours are gathered: a
    vertex of very many links is reduced to a minimum before the shuffle. Null ends and links to itself are left out;
    repeated links change nothing; without links the result is empty.
    """
    edges = links.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a != b").distinct()
    edges = materialize(edges, "components-links")
    labels = None
    while True:
        ends = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = ends.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("to"))
        point = materialize(point, "components-pointers")  # as a table, a side of a join that can be split where it is hot
        onward = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
        for _ in range(JUMPS):
            point = point.join(onward, "to").select("id", F.col("next").alias("to"))
        point = materialize(point, "components-round")
        if labels is None:
            labels = point
        else:
            step = point.select(F.col("id").alias("to"), F.col("to").alias("next"))
            labels = labels.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        first, second = (point.select(F.col("id").alias(c), F.col("to").alias(f"{c}_to")) for c in ("a", "b"))
        edges = edges.join(first, "a").join(second, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = materialize(edges.where("a != b").distinct(), "components-links")
        if edges.isEmpty():
            return labels.select("id", F.col("to").alias("component"))
        labels = materialize(labels, "components-labels")
