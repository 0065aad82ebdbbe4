"""The corpus pipeline: language ID, exact and near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``documents``. ``run`` applies them in order to
the table, writing each result to the shared scratch folder and reading it
back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabfold.llm import decontaminate, exact_dedup, language, packing, simhash
from tabfold.llm.common import anti_rows, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised."""
    return language.accepted(docs, language.train(docs))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints, the smallest doc_id."""
    found = simhash.near_duplicates(docs)
    return anti_rows(docs, found.filter("not kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return anti_rows(docs, found.filter("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 4096 tokens."""
    return packing.pack(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_duplicates),
          ("near_dedup", near_duplicates), ("decontamination", decontamination), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None   # learned language filters, 64-bit hashes and a tokenizer are beyond SQL
