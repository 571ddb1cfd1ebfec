"""Packing along a space-filling curve: documents that are alike stand next to each other and share sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import field, ragged_take, run_sums, text_slices, texts_of
from peakweave.llm.word_bpe import word_codec
from peakweave.session import materialize

DIMS, BITS, BUCKETS = 3, 10, 256
#: Bytes of text, and of ids, that a task works on at once; a longer text alone.
SLICE_BYTES, PIECE_BYTES = 3 << 20, 1 << 20
TIE_BITS = 62 - DIMS * BITS


def projection(seed: int = 7) -> np.ndarray:
    """Fixed directions of the hashed buckets in a few dimensions."""
    return np.random.default_rng(seed).standard_normal((BUCKETS, DIMS))


def hilbert_key(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position of each cell (rows of whole numbers below 2 ** bits) along the Hilbert curve.

    The curve visits the corners of a cube in Gray-code order, and each sub-cube turned so that ends meet. Undoing the
    turns from the coarsest bit down, then the Gray code, and interleaving the bits gives the position.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for bit in range(bits - 1, 0, -1):
        mask = (1 << bit) - 1
        for i in range(n):
            high = (x[i] >> bit) & 1 == 1
            swap = np.where(high, 0, (x[0] ^ x[i]) & mask)
            x[0] = np.where(high, x[0] ^ mask, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> bit) & 1 == 1, turn ^ ((1 << bit) - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def curve_positions(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray, counts: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """Hilbert key of each document's mean direction; documents without tokens sit in the middle.

    Directions are added up once per distinct piece (ids end to end, `sizes` each), then over the pieces of each document.
    """
    hashed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)
    total = np.stack([run_sums(run_sums(directions[hashed, d], sizes)[codes], counts) for d in range(DIMS)], 1)
    mean = total / np.maximum(run_sums(sizes[codes], counts), 1)[:, None]
    cells = np.clip((np.tanh(mean * 2) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_key(cells)


def binary_runs(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Runs of numbers as binary values, cut by offsets without a copy."""
    offsets = np.concatenate(([0], np.cumsum(sizes) * values.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(values))])


def tokenized(docs: DataFrame, path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """(id, place, n, ids): place orders the documents along the curve, then by a hash of id and text."""

    def run(batches):
        codec, directions = word_codec(path), projection()
        for batch in batches:
            for part in text_slices(batch, text_col, SLICE_BYTES):
                ids, per_piece, codes, counts = codec.coded(texts_of(part, text_col))
                key = curve_positions(ids, per_piece, codes, counts, directions)
                tie = part.column("tie").to_numpy(zero_copy_only=False) & ((1 << TIE_BITS) - 1)
                sizes = run_sums(per_piece[codes], counts)
                kind = "<u2" if codec.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
                packed = np.insert(ragged_take(ids.astype(kind), per_piece, codes), np.cumsum(sizes), end_id)
                data = binary_runs(packed, sizes + 1)
                yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array((key << TIE_BITS) | tie, pa.int64()), pa.array(sizes + 1, pa.int64()), data], ["id", "place", "n", "ids"])
            pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col), F.col(text_col), F.xxhash64(F.col(id_col), F.col(text_col)).alias("tie"))
    schema = T.StructType([field(docs, id_col, "id"), T.StructField("place", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType())])
    return rows.mapInArrow(run, schema)


def stretch_bounds(docs: DataFrame, stretches: int, sample_rows: int, **kw) -> np.ndarray:
    """Cuts of the curve into stretches of about equal size, from a sample. They balance the work and change no result."""
    sample = tokenized(docs.where("text_sample < 1").drop("text_sample").limit(sample_rows), **kw).select("place")
    places = np.sort(np.array([r[0] for r in sample.toLocalIterator()], np.int64))
    return places[np.linspace(0, len(places) - 1, stretches + 1)[1:-1].astype(int)] if len(places) else places


def pack_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = 4096, end_id: int = 2, sample_rows: int = 2000, with_ids: bool = True,
) -> DataFrame:
    """Documents, each followed by `end_id`, laid end to end along the curve and cut into sequences of `length` ids.

    Returns one row per piece: (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with `with_ids` the ids). A document's
    vector is its hashed bag of ids, projected to three dimensions; its Hilbert key, then a hash, give its place. The
    curve is cut into stretches by a sample of at most `sample_rows` places; documents are dealt by stretch, sorted within
    it, and written once with their running sum. Only the total of each stretch goes to the driver. Sequences are full
    but for the last, so the padding is below one sequence for the whole table. Equal documents have the same key; the hash of
    id and text spreads them over stretches, so no group of copies meets in one task.

    Null text counts as empty: its document is `end_id` alone. Null and repeated ids are packed row by row (equal rows
    have no order between them, and need none). An empty table gives no pieces; other columns are ignored.
    """
    spark = docs.sparkSession
    kw = {"path": path, "id_col": id_col, "text_col": text_col, "end_id": end_id}
    docs = docs.select(F.col(id_col), F.col(text_col))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.count()
    share = max(1, total // sample_rows)
    sampled = docs.withColumn("text_sample", F.pmod(F.xxhash64(F.col(id_col)), F.lit(share)))
    bounds = stretch_bounds(sampled, 8 * tasks, sample_rows, **kw)

    def deal(batches):
        for batch in batches:
            stretch = np.searchsorted(bounds, batch.column("place").to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stretch, pa.int32())], [*batch.schema.names, "stretch"])

    def running(batches):
        current, done = None, 0
        for batch in batches:
            stretch, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("stretch", "n"))
            before = np.cumsum(n) - n
            first = np.flatnonzero(np.concatenate(([len(n) > 0 and stretch[0] != current], stretch[1:] != stretch[:-1])))
            runs = np.diff(np.concatenate((first, [len(n)])))
            shift = np.full(len(n), done, np.int64)
            shift[len(n) - runs.sum() :] = -np.repeat(before[first], runs)
            before = before + shift
            if len(n):
                current, done = stretch[-1], int(before[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64())], [*batch.schema.names, "before"])

    rows = tokenized(docs, **kw)
    dealt = rows.mapInArrow(deal, T.StructType([*rows.schema.fields, T.StructField("stretch", T.IntegerType())]))
    laid = dealt.repartition(tasks, "stretch").sortWithinPartitions("stretch", "place", "id")
    laid = materialize(laid.mapInArrow(running, T.StructType([*laid.schema.fields, T.StructField("before", T.LongType())])), "packing")
    totals = {r["stretch"]: r["n"] for r in laid.groupBy("stretch").agg(F.sum("n").alias("n")).toLocalIterator()}  # at most 8 a task
    begins, at = {}, 0
    for stretch in sorted(totals):
        begins[stretch], at = at, at + totals[stretch]

    def pieces(batches):
        for batch in batches:
            for part in text_slices(batch, "ids", PIECE_BYTES):
                rows, picks = [], []
                columns = [part.column(c).to_pylist() for c in ("stretch", "before", "n", "ids")]
                for row, (stretch, before, n, data) in enumerate(zip(*columns, strict=True)):
                    ids = np.frombuffer(data, "<u2" if len(data) == 2 * n else "<u4").astype("<u4")
                    place, start = begins[stretch] + before, 0
                    while start < n:
                        sequence, offset = divmod(place + start, length)
                        size = min(n - start, length - offset)
                        raw = ids[start : start + size].tobytes()
                        rows.append((start, size, zlib.crc32(raw), n, sequence, offset, *([raw] if with_ids else ())))
                        picks.append(row)
                        start += size
                columns = list(zip(*rows, strict=True)) or [()] * (7 if with_ids else 6)
                arrays = [pa.array(list(c), pa.binary() if i == 6 else pa.int64()) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(picks, pa.int64())), *arrays], [f.name for f in out])

    names = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    out = T.StructType([field(docs, id_col), *(T.StructField(c, T.LongType()) for c in names), *([T.StructField("ids", T.BinaryType())] if with_ids else [])])
    return laid.select("id", "stretch", "before", "n", "ids").mapInArrow(pieces, out)
