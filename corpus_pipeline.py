"""A corpus pipeline: known languages only, one of each group of near-duplicates, personal data masked, then packed.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``; the last returns the
placed pieces. Results are written as Parquet and read again between stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakelog.llm import language, packing, pii, simhash
from lakelog.llm.queries import TOKENIZER
from lakelog.llm.rows import table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; without letters or in no modelled language they go."""
    return language.accepted_only(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates."""
    return simhash.one_of_each(docs)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind."""
    return pii.mask_personal_data(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("language_id", language_id), ("simhash_dedup", simhash_dedup), ("mask_pii", mask_pii), ("pack", pack)]

#: A trained model decides the first stage and the tokenizer the last, so SQL cannot express the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
