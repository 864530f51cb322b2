"""Corpus pipeline: from raw documents to packed training sequences.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; ``run``
writes each stage's result as Parquet under the shared folder and reads it
back as the next stage's documents, so a lost executor never reaches past one
stage; a stage's files are deleted when the next is written. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import exact_dedup, langid, mixing, packing, simhash
from tessera.llm.common import discard, stage, table

#: A document goes if no language can be told (no letter), or if its words' own
#: best languages have a lower mean posterior; with four languages chance is 0.25.
MIN_LANGUAGE_SCORE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.accepted(docs, MIN_LANGUAGE_SCORE)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.unique_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix_to_weights(docs, mixing.PRODUCTION_TARGETS, mixing.PRODUCTION_REST, with_draws=False)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mixing", mixed),
    ("packing", packed),
]

#: The learned language stage has no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        before, docs = docs, stage(apply(spark, docs, sf_dir), name)
        discard(before)                                      # its files go once the next stage is written
    return STAGES[-1][1](spark, docs, sf_dir)
