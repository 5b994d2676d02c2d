"""A corpus pipeline over ``documents``: language, quality, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs.  All but the last return the
columns of ``documents``; the last returns the pieces of the packed sequences.
A stage begins by having executors return the heap that the one before has filled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm._util import materialize, return_heap
from scriptorium.llm.language_id import keep_identified, train
from scriptorium.llm.near_copies import keep_one
from scriptorium.llm.packing import pack_documents
from scriptorium.llm.quality import keep_good


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; undetermined ones (null and empty texts among
    them) and ambiguous ones go.  Repeated rows stay; texts are read whole."""
    return_heap(spark)
    return keep_identified(docs, train(docs))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and every rule of the cascade; null and empty texts
    fail the base.  Repeated rows are judged alike; texts are read whole."""
    return_heap(spark)
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id: five-word
    shingle sets of Jaccard similarity 0.8 or more, found by the SimHash operator's
    groups and, beyond its reach, by bands.  Rows without a doc_id stay; repeated rows
    become one; of several texts under one doc_id only copies go."""
    return_heap(spark)
    return keep_one(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of at most 1024 tokens; repeated rows are
    packed apart, a null doc_id stays null, an empty text has its end id."""
    return_heap(spark)
    return pack_documents(docs)


STAGES = [("language", language), ("quality", quality), ("near_dedup", near_dedup), ("packing", packing)]

#: Language identification is learned, so SQL can't express the result.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
