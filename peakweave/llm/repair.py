"""Repair of a conversation's structure: the cheapest edits to a legal order of roles, found by iterative-deepening A*."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakweave.llm.frames import field
from peakweave.session import materialize

# fixed values: costs of the edits, what a truncated row adds when it stays, white space, ends of a sentence, legal neighbours
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
SPACE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", ("su", "ua", "au")
#: What a repaired beginning ends with: nothing yet, system, user, assistant; and what may follow, by initial.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
AFTER = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (EMPTY, ASSISTANT)
#: No fault, truncated, blank or duplicate.
FINE, CUT_OFF, GONE = range(3)
#: A block holds 2 ** BLOCK_BITS rows; blocks are searched apart.
BLOCK_BITS = 7
FAR = 1 << 60

Row = tuple[str, int, int]  # initial of the role, kind, how many such rows in a row (more than one only if GONE)
Way = tuple[int, int, int, str]  # state before, state after, cost, edits


def next_role(state: int) -> int:
    """The one state that a new or renamed row can lead to."""
    return ASSISTANT if state == USER else USER


class Search:
    """Cheapest edits of a list of rows to an accepted state: depth first, edits in ASCII order, under a growing bound.

    `known[row][state]` is the transposition table: a lower bound of the cost from there, at first an estimate (2 for each row that must go or is
    truncated, 1 for each pair of neighbours of which one must change), raised each time the search fails there, and valid
    for all later bounds and beginnings. Without `closing` nothing is inserted after the last row.
    """

    def __init__(self, rows: Sequence[Row], accepted: Sequence[int], closing: bool):
        self.rows, self.accepted, self.closing = rows, accepted, closing
        n = len(rows)
        self.known = [[0] * 4 for _ in range(n + 1)]
        self.known[n] = [0 if state in accepted else INSERT if closing else FAR for state in range(4)]
        due, pairs, pairs_after, following, system = 0, 0, 0, None, False
        for i in range(n - 1, -1, -1):
            initial, kind, times = rows[i]
            due += DELETE * times if kind else 0
            if kind != GONE:
                pair = following is not None and kind == following[1] == FINE and initial + following[0] not in LEGAL
                pairs, pairs_after = max(pairs, 1 + pairs_after) if pair else pairs, pairs
                following = rows[i]
                system = system or initial == "s"
            self.known[i] = [due + pairs] * 4
            # nothing leads back to the states of the beginning
            if accepted == [EMPTY]:
                self.known[i][SYSTEM:] = [FAR] * 3
            elif accepted == [SYSTEM]:
                self.known[i][USER:] = [FAR] * 2
                if not system:
                    self.known[i][EMPTY] = FAR

    def edges(self, i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(edits, cost, next row, next state), in ASCII order."""
        out, role = [], next_role(state)
        if i == len(self.rows):
            return [("I", INSERT, i, role)] if self.closing else []
        initial, kind, times = self.rows[i]
        out = [("D" * times, DELETE * times, i + 1, state), ("I", INSERT, i, role)]
        if kind != GONE:
            more = TRUNCATED if kind == CUT_OFF else 0
            if initial in AFTER[state]:
                out.append(("K", more, i + 1, AFTER[state][initial]))
            out.append(("R", REROLE + more, i + 1, role))
        return out

    def visit(self, i: int, state: int, budget: int) -> str | None:
        """Edits of the first accepted path within the budget."""
        if i == len(self.rows) and state in self.accepted:
            return ""
        least = FAR
        for letters, cost, j, after in self.edges(i, state):
            if cost + self.known[j][after] <= budget and (rest := self.visit(j, after, budget - cost)) is not None:
                return letters + rest
            least = min(least, cost + self.known[j][after])
        self.known[i][state] = max(self.known[i][state], least)
        return None

    def path(self, start: int) -> tuple[int, str] | None:
        """Cost and edits of the cheapest path from a state, of equal ones the ASCII-least; None if there is none."""
        while (bound := self.known[0][start]) < FAR:
            if (letters := self.visit(0, start, bound)) is not None:
                return bound, letters
        return None


def ways_through(rows: Sequence[Row], begins: bool, ends: bool) -> list[Way]:
    """All ways through the rows of a block, or of a conversation's beginning or end only those that count."""
    starts = [EMPTY] if begins else range(4)
    goals = [(ASSISTANT, Search(rows, ACCEPTED, True))] if ends else [(state, Search(rows, [state], False)) for state in range(4)]
    return [(s, state, *found) for state, search in goals for s in starts if (found := search.path(s))]


#: Inserted after the last row of a conversation.
CLOSING: list[Way] = [(EMPTY, ASSISTANT, 0, ""), (SYSTEM, ASSISTANT, 2 * INSERT, "II"), (USER, ASSISTANT, INSERT, "I"), (ASSISTANT, ASSISTANT, 0, "")]


def chain(blocks: Sequence[list[Way]]) -> tuple[int, list[tuple[int, str]]]:
    """Cost of the cheapest way through all blocks (of equal ones the ASCII-least), and the state before and edits of each block.

    Costs to go are added up from the end. Then, from the front, a block takes the least edits that keep the cost: they end with a
    row's edit, so none is the beginning of another and the first difference decides.
    """
    to_go = [dict.fromkeys(range(4), 0)]
    for ways in reversed([*blocks, CLOSING]):
        costs: dict[int, int] = {}
        for before, after, cost, _ in ways:
            if after in to_go[-1]:
                costs[before] = min(costs.get(before, FAR), cost + to_go[-1][after])
        to_go.append(costs)
    to_go.reverse()
    state, out = EMPTY, []
    for k, ways in enumerate([*blocks, CLOSING]):
        left = to_go[k + 1]
        letters, after = min((edits, e) for s, e, cost, edits in ways if s == state and e in left and cost + left[e] == to_go[k][s])
        out.append((state, letters))
        state = after
    _, closing = out.pop()
    if out:
        out[-1] = (out[-1][0], out[-1][1] + closing)
    return to_go[0][EMPTY], out


def damaged(conversations: DataFrame) -> DataFrame:
    """Test damage by crc32 of `conv_id:turn` modulo 20 (null: one space): 0 drops, 1 empties, 2 takes ends of sentences, 3 repeats, 4 makes a user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.pmod(F.crc32(key.cast("binary")), F.lit(20))
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, f"[{ENDS}]", "")).otherwise(text).alias("text"),
        F.when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def repair_conversations(conversations: DataFrame, *, damage: bool = False, block_bits: int = BLOCK_BITS, with_text: bool = False) -> DataFrame:
    """Faults of each conversation, the cheapest edits that repair it, and the repaired text.

    Takes (conv_id, turn, role, text); returns one row per conv_id: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, and
    with `with_text` `repaired`, which holds a whole conversation). Rows stand by turn (nulls first), then role, then text.

    Rows equal in all four columns are counted first: all but one are duplicates. The rows are sorted by ranges of all four columns, so a hot
    conversation spans many tasks, and numbered. The first row of each (conversation, role, text) comes from a minimum, with partial sums. A block of
    2 ** block_bits neighbours is searched in one task: a conversation that lies inside of it at once, the parts of others for every state before and after. A
    conversation then picks one way through each of its blocks, from their costs and edits; no text is gathered. The digest takes the texts
    of a conversation one after another, as SHA-256 must: they pass through one task sorted, a batch at a time.

    Null conv_ids are one conversation. Null role and text are one space: such a text is blank, such a role no legal one. Null turns come first and do
    not count for gaps. Empty texts are blank. Conversations without a row left (`damage` can drop all) give zeros and digests of nothing. An
    empty table gives an empty result; other columns are ignored.
    """
    spark = conversations.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if damage:
        rows = damaged(conversations)
    else:
        rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(1).cast("long").alias("copies"))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    laid = rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id())
    laid = laid.withColumns({
        "initial": F.substring("role", 1, 1),
        "kind": F.when(shown == "", GONE).when(F.substring(shown, -1, 1).isin(list(ENDS)), FINE).otherwise(CUT_OFF),
        "digest": F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256),
    })
    laid = materialize(laid, "repair-rows")
    first = laid.groupBy("conv_id", "digest").agg(F.min("position").alias("first")).select("first")
    marked = laid.select("conv_id", "turn", "copies", "position", "initial", "kind").join(first, F.col("position") == F.col("first"), "left")
    marked = marked.select("conv_id", "turn", "copies", "position", "initial", "kind", F.col("first").isNotNull().alias("fresh"))
    # a number of tasks by hand: the rows are small, but searching them is not
    marked = marked.withColumn("block", F.shiftright("position", block_bits)).repartition(tasks, "block").sortWithinPartitions("position")

    long = T.LongType()
    counts = ("blank", "duplicate", "truncated", "illegal")
    conv = field(conversations, "conv_id")
    way = T.StructType([T.StructField("before", T.IntegerType()), T.StructField("after", T.IntegerType()), T.StructField("cost", long), T.StructField("edits", T.StringType())])
    arrow_way = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())])
    segment = T.StructType([
        conv, T.StructField("position", long), *(T.StructField(c, long) for c in counts), T.StructField("left", T.StringType()), T.StructField("right", T.StringType()),
        T.StructField("low", long), T.StructField("high", long), T.StructField("turns", long), T.StructField("ways", T.ArrayType(way)),
    ])

    def table_of(out: list[tuple], kinds: Sequence[pa.DataType], names: Sequence[str]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)], list(names))

    def summed(part: list[tuple], begins: bool, ends: bool) -> tuple:
        """One row for the neighbouring rows of a conversation in a block."""
        found, steps = dict.fromkeys(counts, 0), []
        before = None
        for _, _, copies, _, initial, kind, fresh, _ in part:
            if kind == GONE:
                found["blank"] += copies
            else:
                found["duplicate"] += copies - fresh
                found["truncated"] += fresh and kind == CUT_OFF
            found["illegal"] += copies - 1 + (before is not None and before + initial not in LEGAL)
            before = initial
            if fresh and kind != GONE:
                steps.append((initial, kind, 1))
            if spare := copies - (fresh and kind != GONE):
                if steps and steps[-1][1] == GONE:
                    steps[-1] = ("", GONE, steps[-1][2] + spare)
                else:
                    steps.append(("", GONE, spare))
        turns = [r[1] for r in part if r[1] is not None]
        ways = [dict(zip(("before", "after", "cost", "edits"), w, strict=True)) for w in ways_through(steps, begins, ends)]
        span = (min(turns), max(turns), len(set(turns))) if turns else (None, None, 0)
        return part[0][0], part[0][3], *found.values(), part[0][4], part[-1][4], *span, ways

    def search(batches):
        kind_of = None

        def parts(block: list[tuple]) -> list[tuple]:
            cuts = [0, *(i for i in range(1, len(block)) if block[i][0] != block[i - 1][0]), len(block)]
            return [summed(block[a:b], a > 0, b < len(block)) for a, b in zip(cuts, cuts[1:], strict=False) if a < b]

        block: list[tuple] = []
        for batch in batches:
            kind_of, out = batch.schema.field("conv_id").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block and block[-1][-1] != row[-1]:
                    out += parts(block)
                    block = []
                block.append(row)
            yield table_of(out, kinds(kind_of), segment.names)
        if block:
            yield table_of(parts(block), kinds(kind_of), segment.names)

    def kinds(kind_of: pa.DataType) -> list[pa.DataType]:
        return [kind_of, *[pa.int64()] * 5, pa.string(), pa.string(), *[pa.int64()] * 3, pa.list_(arrow_way)]

    segments = materialize(marked.mapInArrow(search, segment), "repair-blocks")

    results = ("gaps", *counts, "cost")
    piece = T.StructType([T.StructField("position", long), T.StructField("state", T.IntegerType()), T.StructField("edits", T.StringType())])
    arrow_piece = pa.struct([("position", pa.int64()), ("state", pa.int32()), ("edits", pa.string())])
    judged = T.StructType([conv, *(T.StructField(c, long) for c in results), T.StructField("audit", T.StringType()), T.StructField("pieces", T.ArrayType(piece))])

    def join_blocks(batches):
        def one(parts: list[tuple]) -> tuple:
            total = [sum(p[2 + i] for p in parts) for i in range(len(counts))]
            total[3] += sum(a[7] + b[6] not in LEGAL for a, b in zip(parts, parts[1:], strict=False))
            dated = [p for p in parts if p[8] is not None]
            distinct = sum(p[10] for p in dated) - sum(a[9] == b[8] for a, b in zip(dated, dated[1:], strict=False))
            gaps = dated[-1][9] - dated[0][8] + 1 - distinct if dated else 0
            cost, found = chain([[tuple(w.values()) for w in p[11]] for p in parts])
            pieces = [{"position": p[1], "state": state, "edits": edits} for p, (state, edits) in zip(parts, found, strict=True)]
            return parts[0][0], min(gaps, (1 << 63) - 1), *total, cost, "".join(edits for _, edits in found), pieces

        def batch_of(out):
            return table_of(out, [kind_of, *[pa.int64()] * 6, pa.string(), pa.list_(arrow_piece)], judged.names)

        kind_of, parts = None, []
        for batch in batches:
            kind_of, out = batch.schema.field("conv_id").type, []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and parts[-1][0] != row[0]:
                    out.append(one(parts))
                    parts = []
                parts.append(row)
            yield batch_of(out)
        if parts:
            yield batch_of([one(parts)])

    dealt = segments.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "position")
    decided = materialize(dealt.mapInArrow(join_blocks, judged), "repair-edits")

    # of each conversation: its id, its figures, then by position the edits of a block before the block's rows
    first_of_all = F.lit(-1).cast("long").alias("position")
    stream = conversations.select("conv_id").distinct().select("conv_id", first_of_all, F.lit(0).alias("what"))
    stream = stream.unionByName(decided.select("conv_id", first_of_all, F.lit(1).alias("what"), *results, "audit"), allowMissingColumns=True)
    edits = decided.select("conv_id", F.explode("pieces").alias("p")).select("conv_id", F.lit(2).alias("what"), "p.*")
    stream = stream.unionByName(edits, allowMissingColumns=True)
    stream = stream.unionByName(laid.select("conv_id", "position", F.lit(3).alias("what"), "role", "text", "copies"), allowMissingColumns=True)
    stream = stream.select("conv_id", "position", "what", *results, "audit", "state", "edits", "role", "text", "copies")
    stream = stream.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "position", "what")
    final = T.StructType([
        conv, *(T.StructField(c, long) for c in results), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType()),
        *([T.StructField("repaired", T.StringType())] if with_text else []),
    ])

    class Repaired:
        """A conversation as its rows come: its figures and the digest of what its edits leave."""

        def __init__(self, key):
            self.key, self.figures, self.hash, self.lines = key, (0,) * len(results) + ("",), hashlib.sha256(), []
            self.edits, self.at, self.state, self.any = "", 0, EMPTY, False

        def put(self, role: str, text: str) -> None:
            raw = ("\n" * self.any + role + ":" + text).encode("utf-8", "surrogatepass")
            self.hash.update(raw)
            if with_text:
                self.lines.append(f"{role}:{text}")
            self.any = True

        def insert(self) -> None:
            while self.at < len(self.edits) and self.edits[self.at] == "I":
                self.state = next_role(self.state)
                self.put(NAMES[self.state], "")
                self.at += 1

        def row(self, role: str, text: str, copies: int) -> None:
            self.insert()
            edit = self.edits[self.at]
            if edit == "K":
                self.state = AFTER[self.state][role[:1]]
                self.put(role, text)
            elif edit == "R":
                self.state = next_role(self.state)
                self.put(NAMES[self.state], text)
            self.at += copies

        def close(self) -> tuple:
            self.insert()
            return self.key, *self.figures, self.hash.hexdigest(), *(["\n".join(self.lines)] if with_text else [])

    def hashed(batches):
        kind_of, now = None, None

        def batch_of(out):
            return table_of(out, [kind_of, *[pa.int64()] * len(results), *[pa.string()] * (len(final) - len(results) - 1)], final.names)

        for batch in batches:
            kind_of, out = batch.schema.field("conv_id").type, []
            for key, _, what, *rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or now.key != key:
                    if now is not None:
                        out.append(now.close())
                    now = Repaired(key)
                figures, (state, letters, role, text, copies) = rest[: len(results) + 1], rest[len(results) + 1 :]
                if what == 1:
                    now.figures = tuple(figures)
                elif what == 2:
                    now.edits, now.at, now.state = letters, 0, state
                elif what == 3:
                    now.row(role, text, copies)
            yield batch_of(out)
        if now is not None:
            yield batch_of([now.close()])

    return stream.mapInArrow(hashed, final)
