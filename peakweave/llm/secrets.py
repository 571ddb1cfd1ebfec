"""Secrets in text: fixed patterns, and further candidates; both judged by how many owners in the corpus have them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from peakweave.llm.frames import unused
from peakweave.session import materialize

# fixed values: kinds in their order, the pattern of each, and the length that the secret itself must have
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "live"]
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Whole runs of a key alphabet that look like a generated secret: at least 16 characters with a digit and letters of both cases,
#: or of one case with two digits and nothing but letters and digits.
KEY = "A-Za-z0-9+/_-"
MIXED = r"(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[%s]{16,}" % KEY
ONE_CASE = r"(?=[%s]*[0-9][%s]*[0-9])(?=[0-9]*[%s])[%s0-9]{16,}"
CANDIDATE = rf"(?<![{KEY}])(?:{MIXED}|{ONE_CASE % (('a-z',) * 4)}|{ONE_CASE % (('A-Z',) * 4)})(?![{KEY}])"


def placed(text: Column, pattern: str, holds: Column) -> Column:
    """(start, end, value) of all matches, in code points: what lies between matches, and the matches, by their lengths.

    `holds` tells cheaply which texts can have a match at all.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start_values = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value")))).alias("out"))

    # one gap more than matches: the last has no value and is left out
    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("value")), lambda p: p["value"].isNotNull())
    return F.when(holds, F.aggregate(pairs, start_values, step, lambda state: state["out"])).otherwise(start_values["out"])


def long_runs(pattern: str, least: int) -> str:
    """A greedy pattern `...[set]+` that only matches from `least` characters of the set on: the same matches, less the short ones."""
    return pattern.removesuffix("+") + "{%d,}" % least


def joined(spans: Column) -> Column:
    """kind:start:end, by start and then kind as listed, joined by commas."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def tagged(spans: Column, rank: int) -> Column:
    """With their kind, and the hash of the secret itself, which owners are counted by."""
    secret = lambda s: F.regexp_extract(s["value"], ASSIGN, 1) if KINDS[rank] == "assign" else s["value"]
    fields = lambda s: F.struct(
        F.lit(KINDS[rank]).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.xxhash64(secret(s)).alias("key")
    )
    return F.transform(spans, fields)


def base_spans(text: Column) -> Column:
    """(kind, rank, start, end, value, key) of all matches of the fixed patterns, kind by kind."""
    word = text.rlike("(?i)pass(?:word|wd)|secret|token|api_?key")
    # a value too short drops its match, which has used up its text all the same
    assign = F.filter(placed(text, ASSIGN, word), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1)) >= LEAST["assign"])
    access = placed(text, long_runs(ACCESS, LEAST["access"] - 4), text.contains("AKIA"))
    runs = long_runs(HEX, LEAST["hex"])
    return F.concat(tagged(assign, 0), tagged(access, 1), tagged(placed(text, runs, text.rlike(runs)), 2))


def candidate_spans(text: Column, base: Column) -> Column:
    """Candidates that no base span touches, as kind `live`."""
    found = placed(text, CANDIDATE, text.rlike(CANDIDATE))
    free = F.filter(found, lambda c: ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])))
    return tagged(free, 3)


def mark(id_col: str, text: Column) -> Column:
    """Stands for a row: rows with the same id and text have the same spans."""
    return F.xxhash64(F.col(id_col), text)


def owner_specific(rows: DataFrame, most_owners: int, most_repos: int, most_texts: int) -> DataFrame:
    """(mark, live): the keys that look live, of rows (mark, owner, repo, copy, keys).

    A value counts once for each distinct text (`copy`) that holds it, with one of the text's owners, so copies of a text
    are no spread. It is an example if its texts have more than `most_owners` owners, or if it is in more than `most_texts`
    texts that have more than `most_repos` repositories or are of unknown owners. Else it is live. Values travel as hashes,
    are made distinct before the shuffle and counted from partial counts, so a value that a third of all rows hold
    meets nowhere as rows; rows then meet their hash's verdict in a join.
    """
    each = rows.select("mark", "owner", "repo", "copy", F.explode(F.array_distinct("keys")).alias("hash"))
    each = materialize(each, "secrets-candidates")
    first = F.min(F.struct(F.col("owner").isNull().alias("unknown"), "owner", F.coalesce("repo", F.lit("")).alias("repo"))).alias("who")
    who = each.groupBy("hash", "copy").agg(first).groupBy("hash", "who.owner", "who.repo").agg(F.count(F.lit(1)).alias("texts"))
    spread = who.groupBy("hash").agg(
        F.countDistinct("owner").alias("owners"), F.countDistinct(F.struct(F.coalesce("owner", F.lit("")), "repo")).alias("repos"),
        F.sum("texts").alias("texts"), F.sum(F.when(F.col("owner").isNull(), F.col("texts")).otherwise(0)).alias("unknown"),
    )
    example = (F.col("owners") > most_owners) | ((F.col("texts") > most_texts) & ((F.col("repos") > most_repos) | (F.col("unknown") > most_texts)))
    live = materialize(spread.where(~example).select("hash"), "secrets-live")
    return each.join(live, "hash", "left_semi").groupBy("mark").agg(F.collect_set("hash").alias("live"))


def judged(spans: Column, live: Column) -> Column:
    """Spans with `live`: whether ownership says that their secret is one."""
    known = F.coalesce(live, F.array().cast("array<bigint>"))
    return F.transform(spans, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "rank", "start", "end", "value")), F.array_contains(known, s["key"]).alias("live")))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang",
    *, most_owners: int = 1, most_repos: int = 1, most_texts: int = 8,
) -> DataFrame:
    """(id_col, base, more): the spans of each text by the fixed patterns, and those that ownership adds.

    base and more are arrays of (kind, rank, start, end, value, live), in code points, end exclusive; spans of different kinds
    may overlap. Further candidates are long runs that look generated (CANDIDATE) and that no base span touches. Secrets of base spans
    and candidates are counted over the corpus by distinct texts, owners and repositories (`owner_specific`): base has all
    matches and tells which are live, more has the live candidates as kind `live`; the others are copied examples.

    Null text counts as empty and has no spans. A null owner is unknown and is no further owner; a null repository counts as the empty name.
    Null and repeated ids and repeated rows stay row by row; an empty table gives an empty result; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), mark(id_col, text).alias("mark"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"),
        F.xxhash64(text).alias("copy"), base_spans(text).alias("base"), text.alias("text"),
    )
    rows = rows.withColumn("candidates", candidate_spans(F.col("text"), F.col("base"))).drop("text")
    rows = materialize(rows, "secrets-rows")
    asking = rows.withColumn("keys", F.concat("base.key", "candidates.key")).where(F.size("keys") > 0)
    live = materialize(owner_specific(asking, most_owners, most_repos, most_texts), "secrets-owned")
    more = F.filter(judged(F.col("candidates"), F.col("live")), lambda s: s["live"])
    return rows.join(live, "mark", "left").select(F.col("id").alias(id_col), judged(F.col("base"), F.col("live")).alias("base"), more.alias("more"))


def redact_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "lang",
    *, most_owners: int = 1, most_repos: int = 1, most_texts: int = 8, keep_examples: bool = False, tag: str = "[secret]",
) -> DataFrame:
    """docs with each span of `find_secrets` in its text replaced by `tag`; all rows and columns stay, null text stays null.

    With `keep_examples`, base spans that are not live stay as they are. Only rows with a base span or a candidate meet the
    ownership table; the others are passed on as they were read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own, asks, owned, based, further = (unused(docs, name) for name in ("mark", "asks", "live", "base_spans", "candidate_spans"))
    rows = docs.withColumns({own: mark(id_col, text), based: base_spans(text)}).withColumn(further, candidate_spans(text, F.col(based)))
    # texts with their spans are written once: patterns run once, and what follows reads only the columns it needs
    rows = materialize(rows.withColumn(asks, F.size(based) + F.size(further) > 0), "secrets-rows")
    asking = rows.where(F.col(asks)).select(
        F.col(own).alias("mark"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), F.xxhash64(text).alias("copy"),
        F.concat(F.col(based)["key"], F.col(further)["key"]).alias("keys"),
    )
    live = materialize(owner_specific(asking, most_owners, most_repos, most_texts), "secrets-owned").select(F.col("mark").alias(own), F.col("live").alias(owned))
    with_live = rows.where(F.col(asks)).join(live, own, "left")

    def cut(state: Column, span: Column) -> Column:
        before = F.substring(text, state["at"] + 1, span["start"] - state["at"])
        fresh = F.struct(span["end"].alias("at"), F.concat(state["out"], before, F.lit(tag)).alias("out"))
        return F.when(span["start"] >= state["at"], fresh).otherwise(F.struct(F.greatest(state["at"], span["end"]).alias("at"), state["out"].alias("out")))

    base = judged(F.col(based), F.col(owned))
    base = F.filter(base, lambda s: s["live"]) if keep_examples else base
    spans = F.concat(base, F.filter(judged(F.col(further), F.col(owned)), lambda s: s["live"]))
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    clean = F.aggregate(order, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text) - s["at"])))
    rewritten = F.when(F.col(text_col).isNull(), F.col(text_col)).otherwise(clean)
    return with_live.withColumn(text_col, rewritten).select(*docs.columns).unionByName(rows.where(~F.col(asks)).select(*docs.columns))
