"""From raw documents to packed training text: the stages in order.

Each stage takes the documents that the one before it kept, and all but the last give documents of the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakweave.llm.exact import exact_duplicates
from peakweave.llm.frames import row_keyed, unused
from peakweave.llm.near_text import near_duplicates
from peakweave.llm.packing import pack_documents
from peakweave.llm.quality import fit_quality, score_quality
from peakweave.llm.secrets import redact_secrets
from peakweave.session import materialize

#: Documents below this score are left out.
GOOD_ENOUGH = 0.7


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field scores as good, each row by its own text. It is fitted on labelled documents of the input."""
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = unused(docs, "score")
    scored = score_quality(docs, model, carry=docs.columns, score_col=score)
    return scored.where(F.col(score) >= GOOD_ENOUGH).select(*docs.columns)


def chosen_rows(docs: DataFrame, nulls_last: bool, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows that `find` keeps of (row, text). A row is its document's id, by which it is chosen, and the row's own key, which settles
    ties: of rows that share an id, or have none, each is judged for itself and one of equal ones stays."""
    keyed, key = row_keyed(docs)
    named = F.col("doc_id").isNull() if nulls_last else F.col("doc_id").isNotNull()
    rows = keyed.select(F.struct(named.alias("named"), F.col("doc_id").alias("id"), F.col(key).alias("key")).alias("row"), "text")
    kept = find(rows).where("kept").select(F.col("row.key").alias(key))
    return keyed.join(kept, key, "left_semi").select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal but for the case of A-Z: one with the largest id (null ids last)."""
    return chosen_rows(docs, False, lambda rows: exact_duplicates(rows, "row"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near duplicates: one with the smallest id (null ids last)."""
    return chosen_rows(docs, True, lambda rows: near_duplicates(rows, "row"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with its secrets replaced but for values that ownership takes for copied examples; n_chars follows the new text."""
    clean = redact_secrets(docs, keep_examples=True)
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document, with its place in its sequence and its ids."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("secret scans", redact),
    ("packing", pack),
]
#: SQL can express neither the classifier nor the tokenizer; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
