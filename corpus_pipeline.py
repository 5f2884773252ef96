"""Corpus pipeline over the documents table: five filtering and weighting stages.

Every stage is called as (spark, docs, sf_dir) and works on all documents that its
predecessor kept; its result is written as Parquet and read again as the next one's
documents. All but the last return the columns of documents, whatever their names; the last adds how
often the mix takes each document (its own columns of those names are replaced).

In every stage an empty table gives an empty one, very long texts are processed whole, and rows that agree in
doc_id and text share one fate. Null and empty texts go with language ID (they have no language); given to
a later stage, they stay. A null doc_id, lang or source stays null: such rows are judged by their text, a null
source is a source of its own in the mix. Ties: see each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from confluo.llm import decontam, langid, linededup, mixing, neardup
from confluo.llm.names import set_aside
from confluo.plans.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents outside the held-out fifth; documents that are rejected go.

    Of equally likely languages the first by code point decides.
    """
    model = langid.train(docs.where(F.col("doc_id").isNotNull() & ~langid.held_out(F.col("doc_id"))))
    docs, back = set_aside(docs, langid.RESULT)
    return langid.identify(docs, model).where(~F.col("rejected")).select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat earlier windows; a document of which only white space is left by that goes.

    Earlier is the smaller doc_id, then the smaller row hash. n_chars follows the text.
    """
    docs, back = set_aside(docs, linededup.RESULT)
    out = linededup.dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & ~F.coalesce(F.col("kept_text"), F.lit("")).rlike(r"\S")
    changed = out.where(~emptied).withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed = changed.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return changed.select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the smallest doc_id: five-word shingles, similarity 0.8 or more.

    Of rows that agree in doc_id and text one stays.
    """
    return neardup.drop_near_duplicates(docs, shingle=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go, by the rule of op2; it has no ties."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size and how many words the mix takes of each; sources that cap at the same level share it."""
    return mixing.mix_sources(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
]

#: Language models are beyond SQL; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
