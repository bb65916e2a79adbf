"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), applies one operator of ``loggrove.llm``
to all rows of ``docs`` and returns a DataFrame; all but the last return the
columns of ``documents``. ``run`` writes each result as Parquet to the folder
that the cluster shares and reads it again for the next stage.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the
operators' docstrings say: a document with a null text passes all filters and is
packed as its end token, one with a null id is never taken for a duplicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loggrove.llm.common import written
from loggrove.llm.decontamination import decontaminate
from loggrove.llm.line_dedup import without_repeated_lines
from loggrove.llm.near_duplicates import drop_near_duplicates
from loggrove.llm.packing import pack
from loggrove.llm.queries import table, vocabulary
from loggrove.llm.toxicity import drop_toxic, fit_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fits on the labelled documents and drops those that score 0.5 or more."""
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts out passages that a document with a smaller id has."""
    return without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays: five-word shingles,
    similarity of 0.8 or more."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"), end_id=1)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", packing)]

#: SQL cannot express the classifier, the forest or the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
