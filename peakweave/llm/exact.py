"""Exact duplicates by progressive refinement: length, then a hash of the beginning, then a hash of the whole text."""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import field, texts_of
from peakweave.session import materialize

PREFIX_BYTES = 256


def lower_bytes(text: str) -> bytes:
    """UTF-8 with A-Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").lower()


def digests(docs: DataFrame, id_col: str, text_col: str, *, prefix: bool) -> DataFrame:
    """(id, length, digest) of each normalised text: of its first PREFIX_BYTES as a number, or SHA-256 of all as hex."""

    def run(batches):
        for batch in batches:
            raw = [lower_bytes(t) for t in texts_of(batch, text_col).to_pylist()]
            length = pa.array([len(r) for r in raw], pa.int64())
            if prefix:
                short = (hashlib.blake2b(r[:PREFIX_BYTES], digest_size=8).digest() for r in raw)
                out = pa.array([int.from_bytes(h, "little", signed=True) for h in short], pa.int64())
            else:
                out = pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(id_col), length, out], ["id", "length", "digest"])

    kind = T.LongType() if prefix else T.StringType()
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("length", T.LongType()), T.StructField("digest", kind)])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def repeated(rows: DataFrame, *keys: str) -> DataFrame:
    """Key values of more than one row; partial counts meet, not the rows of a hot key."""
    found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return materialize(found, "exact-repeated")  # as a table, a side of a join that can be split where it is hot


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, with_digest: bool = False) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; the row with the largest id of each group stays.

    Returns (id_col, keep_id, group_size, kept, and with `with_digest` text_sha256), one row per input row. A first pass gives each row its length and
    the hash of its beginning. Lengths that occur once are settled; of the rest, those whose beginning occurs once
    at that length. Only texts that survive both are read whole and hashed by SHA-256. Rows meet their group's figures
    in a join that Spark splits when a group is large; groups themselves are only counted. `with_digest` also hashes the settled texts, each in
the row it stands in, so no digest is looked up by an id.

    Null text counts as empty. A null id stands for itself: its row joins the group, never stays before an id that
    is not null, and a group of only null ids keeps null. Rows with the same id and text count one by one and
    are kept or dropped together. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    first = materialize(digests(docs, id_col, text_col, prefix=True), "exact-first")
    by_length = first.join(repeated(first, "length"), "length", "left_semi")
    open_rows = by_length.join(repeated(by_length, "length", "digest"), ["length", "digest"], "left_semi").select("id").distinct()
    open_rows = materialize(open_rows, "exact-open")
    reading = docs.join(open_rows, docs[id_col].eqNullSafe(open_rows["id"]), "left_semi")
    full = materialize(digests(reading, id_col, text_col, prefix=False), "exact-full")
    groups = full.groupBy("length", "digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    groups = materialize(groups, "exact-groups")
    grouped = full.join(groups, ["length", "digest"]).select("id", "keep_id", "group_size", "digest")
    in_group = full.join(groups, ["length", "digest"], "left_anti").select("id", "digest")
    # rows that any step found alone: their id was never open, or its whole text turned out to be unlike all others
    if with_digest:
        settled = digests(docs.join(open_rows, docs[id_col].eqNullSafe(open_rows["id"]), "left_anti"), id_col, text_col, prefix=False).select("id", "digest")
    else:
        settled = first.join(open_rows, first["id"].eqNullSafe(open_rows["id"]), "left_anti").select("id", F.lit(None).cast("string").alias("digest"))
    alone = settled.unionByName(in_group)
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    found = grouped.unionByName(alone)
    shown = [F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")]
    return found.select(*shown, *([F.col("digest").alias("text_sha256")] if with_digest else []))
