"""The corpus pipeline: five of the operators, each stage over all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import free_name, materialise, quoted, table
from parlance.llm.decontaminate import decontaminate
from parlance.llm.line_dedup import line_dedup
from parlance.llm.mixing import mix_sources
from parlance.llm.ngram_join import ngram_join
from parlance.llm.toxicity import score_toxicity

#: A document with this score or more is rejected as toxic.
TOXIC = 0.7
#: Words of a shingle, and percent of shared shingles from which documents are near duplicates.
SHINGLE, SIMILAR = 5, 80


def _without(docs: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``docs`` without the rows whose doc_id is one of ``ids`` (id), null being an id like any other."""
    gone = free_name("__gone", docs.columns)
    ids = materialise(ids.select(F.col("id").alias(gone)).distinct(), name)
    return docs.join(ids, docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under TOXIC; the classifier learns from the labels of documents given.

    All rows of an id go if one of them is toxic; a null id is an id. Null and empty texts have the score of no window. Without
    labels of both kinds every score is the share of label 1. No rows, or nothing to learn from: nothing goes.
    """
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"))
    return _without(docs, score_toxicity(docs, labels).where(F.col("score") >= TOXIC), "toxic")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of later occurrences; one that has nothing left goes, and n_chars follows where there is one.

    Null and empty texts, and texts of fewer lines than a window, stay. Rows of one id are versions of a document: equal ones
    come out equal. Extra columns stay, whatever their names. No rows give no rows.
    """
    out = line_dedup(docs)
    removed = F.col(free_name("__removed", docs.columns))
    gone = (removed > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    out = out.where(~gone)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(removed > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*[quoted(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Rows that repeat an id are one document and all stay or go; a null id counts as the smallest. Null and empty texts are near
    nothing and stay. No rows give no rows.
    """
    return _without(docs, ngram_join(docs, SHINGLE, SIMILAR).where("NOT (id <=> component)"), "later")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark; nulls, empties and repeats are as in ``decontaminate``, and without
    a benchmark all stay."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, as words and as passes; null and empty texts have no words and are not taken."""
    return mix_sources(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("mixing", mix),
]
#: The toxicity classifier cannot be written in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
