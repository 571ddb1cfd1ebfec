"""Queries over the documents, embeddings and pages tables, and the SQL that can check them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm import check_sql
from peakweave.llm.byte_bpe import round_trip_digests
from peakweave.llm.exact import exact_duplicates
from peakweave.llm.html_extract import extract_text
from peakweave.llm.mixing import mix_sources
from peakweave.llm.near_text import near_duplicates
from peakweave.llm.near_vectors import near_vectors
from peakweave.llm.packing import pack_documents
from peakweave.llm.periodic import periodic_runs
from peakweave.llm.quality import fit_quality, held_out, score_quality
from peakweave.llm.repair import repair_conversations
from peakweave.llm.secrets import find_secrets, joined
from peakweave.llm.token_counts import token_counts
from peakweave.llm.url_filter import judged_urls

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query(
    "op1_embedding_dedup",
    """WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(l.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON e.vec_id = c.a
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON e.vec_id = l.a""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


GOOD_ENOUGH = 0.7


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    scored = score_quality(docs, fit_quality(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD_ENOUGH).cast("int").alias("predicted"))


ASCII_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op4_exact_dedup",
    f"""WITH t AS (SELECT doc_id, {ASCII_LOWER_SQL} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM t""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return exact_duplicates(table(spark, folder, "documents"), with_digest=True)


@query(
    "op2_minhash_dedup",
    f"""WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array({ASCII_LOWER_SQL}, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, unnest(s) AS x, len(s) AS n FROM sets),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (any_value(a.n) + any_value(b.n) - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT sets.doc_id, len(s)::BIGINT AS n_shingles, c.component_id, sets.doc_id = c.component_id AS kept
FROM sets JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON sets.doc_id = c.a""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op5_token_counts")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)


# fixed values: verdict, host and beginning of the path
URL_RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def _rule_sql(column: int) -> str:
    """The longest rule that fits, as text (0) or verdict (1)."""
    longest_first = sorted(URL_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = "(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    cases = " ".join(f"WHEN {fits.format(h=h, p=p)} THEN '{(h + p, said)[column]}'" for said, h, p in longest_first)
    return f"CASE {cases} END"


def _weight_sql(level: str) -> str:
    return f"""(SELECT least(greatest(coalesce(CASE WHEN g > 1 AND v > 0 THEN m * (1 - m) / v - 1 WHEN g > 1 THEN 1000.0 END, 1.0), 1.0), 1000.0) FROM (
  SELECT g, m, (sq - n * m * m - (g - 1) * m * (1 - m)) / nullif(n - nn / n, 0) AS v FROM (
    SELECT count(*) AS g, sum(bad)::DOUBLE / sum(labelled) AS m, sum(labelled)::DOUBLE AS n, sum(bad * bad / labelled::DOUBLE) AS sq,
           sum(labelled * labelled)::DOUBLE AS nn FROM {level} WHERE labelled > 0)))"""


@query(
    "op6_url_filter",
    f"""WITH p AS (
  SELECT page_id, translate(CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://([^/?#]*)', 1, 's') ELSE '' END,
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN contains(url, '://') THEN regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') ELSE '' END AS path FROM pages),
j AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS said FROM p),
h AS (SELECT host, count(said) AS labelled, count(*) FILTER (said = 'block') AS bad,
        array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM j GROUP BY host),
d AS (SELECT domain, suffix, sum(labelled) AS labelled, sum(bad) AS bad FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(labelled) AS labelled, sum(bad) AS bad FROM d GROUP BY ALL),
w AS (SELECT (SELECT CASE WHEN sum(labelled) > 0 THEN sum(bad)::DOUBLE / sum(labelled) ELSE 0.5 END FROM s) AS base,
        {_weight_sql('s')} AS ws, {_weight_sql('d')} AS wd, {_weight_sql('h')} AS wh),
ps AS (SELECT suffix, (bad + ws * base) / (labelled + ws) AS m FROM s, w),
pd AS (SELECT d.domain, (d.bad + wd * ps.m) / (d.labelled + wd) AS m FROM d JOIN ps USING (suffix), w),
ph AS (SELECT h.host, (h.bad + wh * pd.m) / (h.labelled + wh) AS m, h.labelled + wh AS n FROM h JOIN pd USING (domain), w)
SELECT page_id, j.host, path, rule, coalesce(said, CASE WHEN m - sqrt(m * (1 - m) / (n + 1)) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM j JOIN ph ON j.host = ph.host""",
)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return judged_urls(table(spark, folder, "pages"), URL_RULES).drop("bad_share")


@query("op7_secret_scan")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    found = find_secrets(table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "more")).alias("spans"),
    )


@query("op8_byte_bpe")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op9_packing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


@query("op10_html_extract")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return extract_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op11_conversation_repair", check_sql.CONVERSATIONS)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repair_conversations(table(spark, folder, "conversations"), damage=True)


@query("op12_source_mix")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return mix_sources(table(spark, folder, "documents"))


@query("op13_periodic_runs", check_sql.PERIODIC)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs(table(spark, folder, "documents"), plant=True).drop("n_words")
