"""Near duplicates of texts: MinHash signatures joined by a multi-index over their chunks, links confirmed on whole sets.

A signature has POSITIONS symbols of 16 bits, cut into chunks of CHUNK symbols. Two signatures that differ in at most
GUARANTEED symbols have a chunk that differs in one symbol or none. So a row is filed, for each chunk, once under each
way of erasing one symbol, and such pairs meet under equal keys. Two texts at similarity 0.75 meet with probability
above 0.999998; the share grows with the similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.components import connected_components
from peakweave.llm.exact import lower_bytes
from peakweave.llm.frames import field, text_slices, texts_of
from peakweave.llm.shingles import mixed, shingle_sets, similar
from peakweave.session import materialize

POSITIONS, CHUNK, GUARANTEED = 40, 4, 19
CHUNKS = POSITIONS // CHUNK
#: Pairs that differ in more symbols than this are not compared in full; at similarity 0.75 one in a million does.
FARTHEST = 24
#: Rows of one key that one task compares with each other or with as many others.
BLOCK = 1024
#: Pairs of one key that differ in at most GUARANTEED symbols are compared in full. Of those that differ in more, a second, longer signature of
#: four-bit symbols decides: those whose estimated similarity is not more than SLACK standard deviations below the threshold.
WIDE, SLACK = 1024, 4.3
#: A bit for each of so many buckets of shingles: whether a set has an odd number of shingles there. Sets differ in at least as many shingles as
#: bits, so pairs with too many differing bits can't be links; nothing that could be one is lost.
ODD = 2048

_RANDOM = np.random.default_rng(40)
_FLIP = _RANDOM.integers(0, 1 << 63, POSITIONS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_WIDE_FLIP = _RANDOM.integers(0, 1 << 63, WIDE, dtype=np.uint64)
_WIDE_TIMES = _RANDOM.integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: How many of the two symbols of a byte agree, by the bits in which two bytes differ.
_AGREE = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint16)


def least_hashes(sets: list[np.ndarray], flip: np.ndarray, times: np.ndarray) -> np.ndarray:
    """One row for each set, none of them empty, with the spread least hash under each of the functions."""
    members = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    out = np.empty((len(sets), len(flip)), np.uint64)
    for i in range(len(flip)):
        out[:, i] = mixed(np.minimum.reduceat((members ^ flip[i]) * times[i], starts))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of POSITIONS symbols for each set."""
    return (least_hashes(sets, _FLIP, _TIMES) & np.uint64(0xFFFF)).astype(np.uint16)


def wide_signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of WIDE four-bit symbols, two a byte, for each set."""
    low = (least_hashes(sets, _WIDE_FLIP, _WIDE_TIMES) & np.uint64(15)).astype(np.uint8)
    return low[:, 0::2] | (low[:, 1::2] << 4)


def odd_buckets(members: np.ndarray) -> bytes:
    """The bits of ODD buckets of one set."""
    bucket = (mixed(members) >> np.uint64(20)).astype(np.int64) % ODD
    return np.packbits((np.bincount(bucket, minlength=ODD) & 1).astype(np.uint8)).tobytes()


def chunk_keys(symbols: np.ndarray) -> np.ndarray:
    """Per row, CHUNKS * CHUNK keys: chunk number, erased symbol, and the three symbols left, as one number each."""
    parts = symbols.reshape(len(symbols), CHUNKS, CHUNK).astype(np.int64)
    keys = np.empty((len(symbols), CHUNKS, CHUNK), np.int64)
    for erased in range(CHUNK):
        left = [parts[:, :, i] for i in range(CHUNK) if i != erased]
        keys[:, :, erased] = (((np.arange(CHUNKS) * CHUNK + erased) << 48) | (left[0] << 32) | (left[1] << 16) | left[2])
    return keys.reshape(len(symbols), CHUNKS * CHUNK)


def folded(symbols: np.ndarray) -> np.ndarray:
    """Four bits of each symbol, 16 symbols a number: differing quarter-bytes never outnumber differing symbols."""
    low = np.zeros((len(symbols), 48), np.int64)
    low[:, :POSITIONS] = symbols & 15
    out = np.zeros((len(symbols), 3), np.int64)
    for i in range(48):
        out[:, i // 16] |= low[:, i] << (4 * (i % 16))
    return out


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, node, symbols, s0, s1, s2): set size, a number that stands for the set, its signature and its folds."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, text_col):
                sets = shingle_sets([lower_bytes(t) for t in texts_of(part, text_col).to_pylist()])
                n = np.array([len(s) for s in sets], np.int64)
                node = np.array([mixed(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                full = [s for s in sets if len(s)]
                symbols = np.zeros((len(sets), POSITIONS), np.uint16)
                if full:
                    symbols[n > 0] = signatures(full)
                fold = folded(symbols)
                yield pa.RecordBatch.from_arrays(
                    [part.column(id_col), pa.array(n), pa.array(node), pa.array([r.tobytes() for r in symbols], pa.binary()), *(pa.array(fold[:, i]) for i in range(3))],
                    ["id", "n", "node", "symbols", "s0", "s1", "s2"],
                )

    longs = [T.StructField(c, T.LongType()) for c in ("n", "node")]
    schema = T.StructType([field(docs, id_col, "id"), *longs, T.StructField("symbols", T.BinaryType()), *(T.StructField(f"s{i}", T.LongType()) for i in range(3))])
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def rows_of(column: pa.Array, kind: type) -> np.ndarray:
    """A column of equally long binary values as rows of numbers."""
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1 if values else 0)


def filed(nodes: DataFrame) -> DataFrame:
    """(key, node): each node under all keys of its signature."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                keys = chunk_keys(rows_of(part.column("symbols"), np.uint16))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("node").to_numpy(), keys.shape[1]))], ["key", "node"])

    return nodes.select("node", "symbols").mapInArrow(run, "key long, node long")


def may_link(left: str, right: str, percent: int) -> Column:
    """Whether sizes and folded signatures leave room for a link."""
    sizes = F.greatest(f"{left}n", f"{right}n") * percent <= F.least(f"{left}n", f"{right}n") * 100
    apart = F.lit(0)
    for i in range(3):
        x = F.col(f"{left}s{i}").bitwiseXOR(F.col(f"{right}s{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(x)
    return sizes & (apart <= FARTHEST)


def node_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, members, wide, odd) of the wanted nodes, each made once from the text of one row that has its set."""
    wanted = nodes.join(wanted, "node", "left_semi").select("node", "first_id")
    texts = docs.join(wanted, docs[id_col].eqNullSafe(wanted["first_id"])).select("node", F.col(text_col).alias("text"))

    def make(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                nodes = part.column("node").to_pylist()
                sets = shingle_sets([lower_bytes(t) for t in texts_of(part, "text").to_pylist()])
                # an id that is not unique brings other texts too
                own = [(node, s) for s, node in zip(sets, nodes, strict=True) if len(s) and mixed(s).sum(dtype=np.uint64) == np.uint64(node % (1 << 64))]
                wide = wide_signatures([s for _, s in own]) if own else ()
                columns = [pa.array([n for n, _ in own], pa.int64()), pa.array([s.tobytes() for _, s in own], pa.binary()), pa.array([w.tobytes() for w in wide], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([odd_buckets(s) for _, s in own], pa.binary())], ["node", "members", "wide", "odd"])

    sets = texts.mapInArrow(make, "node long, members binary, wide binary, odd binary").dropDuplicates(["node"])
    return materialize(sets, "near-text-sets")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""

    def check(batches):
        for batch in batches:
            a, b = batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist()
            keep = pa.array([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"{c}_set"))
    return materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(check, "a long, b long"), "near-text-links")


def run_ends(group: np.ndarray) -> np.ndarray:
    """Where the run of equal numbers ends that each position lies in."""
    ends = np.append(np.flatnonzero(np.diff(group)) + 1, len(group))
    return np.repeat(ends, np.diff(np.concatenate(([0], ends))))


def pairs_of_runs(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of positions i < j of the same run."""
    partners = ends - np.arange(len(ends)) - 1
    first = np.repeat(np.arange(len(ends)), partners)
    return first, first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(partners) - partners, partners)


def slices_by_pairs(rows: pa.RecordBatch, most: int = 1 << 20) -> list[pa.RecordBatch]:
    """The rows cut between groups, so that a slice has no more pairs than `most`, or one group."""
    ends = run_ends(rows.column("group").to_numpy())
    bounds = np.unique(ends)
    totals = np.cumsum(ends - np.arange(len(ends)) - 1)[bounds - 1]
    out, run, start, done = [], 0, 0, 0
    while run < len(bounds):
        run = max(run + 1, int(np.searchsorted(totals, done + most, side="right")))
        out.append(rows.slice(start, int(bounds[run - 1]) - start))
        start, done = int(bounds[run - 1]), int(totals[run - 1])
    return out


def close_pairs(rows: pa.RecordBatch, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the pairs of one key, and how many wide symbols they share, that are to be compared in full: not yet in one component, of sizes and wide
    signatures that leave room for a link; wide signatures have no say where the signatures differ in at most GUARANTEED symbols, only the sizes and
    odd buckets, which rule out no link. A pair that shares several keys is left to the first of them."""
    number = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
    key, n, component, block, crossed = (number(c) for c in ("key", "n", "component", "block", "crossed"))
    symbols, wide, odd = rows_of(rows.column("symbols"), np.uint16), rows_of(rows.column("wide"), np.uint8), rows_of(rows.column("odd"), np.uint64)
    i, j = pairs_of_runs(run_ends(number("group")))
    good = (component[i] != component[j]) & (np.maximum(n[i], n[j]) * percent <= np.minimum(n[i], n[j]) * 100) & (~crossed[i] | (block[i] != block[j])) & (key[i] == key[j])
    i, j = i[good], j[good]
    # a symbol of four bits agrees by chance, too
    level = percent / 100 + (1 - percent / 100) / 16
    least = WIDE * level - SLACK * np.sqrt(WIDE * level * (1 - level))
    out = []
    for at in range(0, len(i), 1 << 15):
        a, b = i[at : at + (1 << 15)], j[at : at + (1 << 15)]
        same = (symbols[a] == symbols[b]).reshape(len(a), CHUNKS, CHUNK)
        chunk = (key[a] >> 50)[:, None]
        erased = (key[a] >> 48) & 3
        agree = same.sum(axis=2)
        earlier = ((agree >= CHUNK - 1) & (np.arange(CHUNKS) < chunk)).any(axis=1)
        # of the ways of erasing a symbol of a chunk that agrees throughout, the first counts
        own = np.take_along_axis(agree, chunk, axis=1)[:, 0]
        keep = np.flatnonzero(~earlier & ((own < CHUNK) | (erased == 0)))
        both = n[a[keep]] + n[b[keep]]
        differ = np.bitwise_count(odd[a[keep]] ^ odd[b[keep]]).sum(axis=1, dtype=np.int64)
        keep = keep[(both - differ) * (100 + percent) >= 2 * percent * both]
        near = _AGREE[wide[a[keep]] ^ wide[b[keep]]].sum(axis=1, dtype=np.int64)
        compared = (near >= least) | (agree[keep].sum(axis=1) >= POSITIONS - GUARANTEED)
        keep, near = keep[compared], near[compared]
        out.append((a[keep], b[keep], near))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*out, strict=True)) or [(), (), ()]))


def pairs_within_keys(open_rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, near, ca, cb), with the shared wide symbols and both components, from rows (key, node, component, n, symbols, wide, odd, rows): keys are cut into blocks, and each task compares the
    rows of one block, or of two, in bulk. Only pairs that need a full comparison come out."""
    blocks = F.ceil(F.col("rows") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(9)), blocks).cast("int")
    dealt = open_rows.withColumn("block", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    # in a group of two blocks, only rows of different blocks meet
    dealt = dealt.withColumns({"group": F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")), "crossed": F.col("block") != F.col("other")})
    dealt = dealt.select("group", "key", "node", "component", "n", "symbols", "wide", "odd", "block", "crossed")
    tasks = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def compare(batches):
        rest = None
        for batch in batches:
            whole = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            group = whole.column("group").to_numpy()
            # the last group may go on in the next batch
            cut = int(np.flatnonzero(group != group[-1])[-1]) + 1 if len(group) and (group != group[-1]).any() else 0
            rest = whole.slice(cut)
            if cut:
                yield from emit(whole.slice(0, cut))
        if rest is not None and rest.num_rows:
            yield from emit(rest)

    def emit(rows):
        for part in slices_by_pairs(rows):
            i, j, near = close_pairs(part, percent)
            node, component = part.column("node").to_numpy(), part.column("component").to_numpy()
            ends = [f(x[i], x[j]) for x in (node, component) for f in (np.minimum, np.maximum)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*ends[:2], near, *ends[2:])], ["a", "b", "near", "ca", "cb"])

    return dealt.repartition(tasks, "group").sortWithinPartitions("group").mapInArrow(compare, "a long, b long, near long, ca long, cb long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, percent: int = 75) -> DataFrame:
    """Components of texts whose sets of 5-word shingles have similarity percent / 100 or more, one row per input row.

    Returns (id_col, n_shingles, component_id, kept): component_id is the smallest id reachable by links, and kept
    marks the row that has it. Words are runs of anything but space, tab, line feed, vertical tab, form feed and
    carriage return, after lower-casing A-Z; fewer than five words make one shingle.

    Equal sets are one node. Nodes are filed under the keys of their signature. First, each key's nodes are paired with one
    of them, its centre, and confirmed links are contracted, which settles groups of copies in linear work. Then nodes of
    one key that are not yet in the same component are compared in blocks: parities of buckets rule out most pairs that are no links
    inside the task, and a longer signature others beyond the guaranteed distance; only what is left comes out, each pair once. Of these, the closest of each two components are confirmed first,
    then those whose components are still apart. Every link is confirmed on the whole sets.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows with a null id take part,
    but name no component (component_id is null, and kept true, if all ids there are null). Rows that share an id count one by
    one. An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select(F.col(id_col), F.col(text_col))
    rows = materialize(sketches(docs, id_col, text_col), "near-text-rows")
    alike = ("n", "symbols", "s0", "s1", "s2")
    nodes = rows.where("n > 0").groupBy("node").agg(F.min("id").alias("first_id"), *(F.first(c).alias(c) for c in alike))
    nodes = materialize(nodes, "near-text-nodes")
    brief = nodes.select("node", "n", "s0", "s1", "s2")
    keys = filed(nodes)
    # one of four centres of a key's nodes, by the number of its chunk
    order = F.struct(F.xxhash64("node", F.shiftright("key", 50) % 4).alias("by"), "node")
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(order)["node"].alias("centre")).where("rows > 1")
    keys = materialize(keys.join(materialize(shared, "near-text-shared"), "key"), "near-text-filed")
    side = lambda df, c: df.select(*(F.col(x).alias(c if x == "node" else f"{c}_{x}") for x in df.columns))
    ends = lambda df: df.select(F.col("a").alias("node")).union(df.select(F.col("b").alias("node"))).distinct()
    pairs = keys.where("node != centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    pairs = pairs.join(side(brief, "a"), "a").join(side(brief, "b"), "b").where(may_link("a_", "b_", percent)).select("a", "b")
    pairs = materialize(pairs, "near-text-pairs")
    links = confirmed(pairs, node_sets(ends(pairs), nodes, docs, id_col, text_col), percent)
    part = materialize(connected_components(links), "near-text-components")

    # nodes that share a key and are not in one component yet
    placed = keys.select("key", "node", "rows").join(part.withColumnRenamed("id", "node"), "node", "left")
    placed = materialize(placed.withColumn("component", F.coalesce("component", "node")), "near-text-placed")
    apart = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high").select("key")
    open_rows = materialize(placed.join(materialize(apart, "near-text-apart"), "key", "left_semi"), "near-text-open")
    sets = node_sets(open_rows.select("node").distinct(), nodes, docs, id_col, text_col)
    described = nodes.select("node", "n", "symbols").join(sets.select("node", "wide", "odd"), "node")
    more = pairs_within_keys(open_rows.join(materialize(described, "near-text-described"), "node"), percent)
    more = materialize(more.join(pairs, ["a", "b"], "left_anti"), "near-text-more")
    if not more.isEmpty():
        # of two components, first the pair that looks closest: if it is a link, the others need no comparison
        best = more.groupBy("ca", "cb").agg(F.max(F.struct("near", "a", "b")).alias("pair")).select("ca", "cb", "pair.a", "pair.b")
        best = materialize(best, "near-text-best")
        further = confirmed(best.select("a", "b"), sets, percent)
        joined = connected_components(best.join(further, ["a", "b"], "left_semi").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        joined = materialize(joined, "near-text-joined")
        now = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"{c}_now"))
        rest = more.join(now("ca"), "ca", "left").join(now("cb"), "cb", "left")
        rest = rest.where(F.coalesce("ca_now", "ca") != F.coalesce("cb_now", "cb")).select("a", "b")
        links = links.unionByName(further).unionByName(confirmed(materialize(rest, "near-text-rest"), sets, percent))
        part = materialize(connected_components(links), "near-text-components")

    named = rows.select("id", "n", "node").join(part.withColumnRenamed("id", "node"), "node", "left")
    named = named.withColumn("component", F.coalesce("component", "node"))
    smallest = nodes.join(part.withColumnRenamed("id", "node"), "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first_id").alias("smallest"))
    smallest = materialize(smallest, "near-text-smallest")
    found = named.where("n > 0").join(smallest, "component").select("id", "n", "smallest").unionByName(named.where("n = 0").select("id", "n", F.col("id").alias("smallest")))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("smallest").alias("component_id"), F.col("id").eqNullSafe(F.col("smallest")).alias("kept"))
