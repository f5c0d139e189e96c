"""Corpus pipeline: language filter, line dedup, near dedup, source mix and packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Each stage's result is written to the shared folder and read back as
the next one's documents, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tapeloom.llm import langid, lines, mixing, packing, queries, simhash
from tapeloom.session import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the models don't reject, as they are."""
    return langid.keep_identified(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later ones of repeated runs of lines."""
    return lines.without_repeated_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints, by op9's definition: three-word shingles, 3 of 64 bits.

    It is the definition that the registered query has.  Near copies of a lower similarity,
    mostly short ones, can stay.
    """
    return simhash.drop_near_duplicates(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, whole, each as often as it is taken."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per packed piece; a repeated document's pieces are rows of their own."""
    return packing.pack(docs, queries.tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

# Language models, fingerprints and tokens have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
