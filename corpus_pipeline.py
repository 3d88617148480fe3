"""A training corpus from documents: toxicity, line dedup, near duplicates, decontamination, packing.

A null or empty text is kept as an empty document until near duplicates, where it is linked with nothing, and is packed
as its end id alone. Of rows equal in doc_id and text one stays. Without labels of both classes nothing is toxic, without
benchmark items nothing is contaminated, and an empty table gives no rows. Columns beside doc_id and text go through the
stages as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvanite.llm import decontam, jaccard, line_dedup, packing, toxicity
from sylvanite.llm._run import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network scores under 0.5; it learns from the labels of the stage's own documents."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents hold stay in the largest doc_id only."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 over five-word shingles the least doc_id stays."""
    return jaccard.keep_one(docs, k=5, num=4, den=5)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of each document in sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("ngram_jaccard", drop_near_copies), ("decontamination", drop_benchmark), ("packing", pack)]

#: Classifier, components and packing are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
