"""From documents to packed training sequences: five stages, each an operator applied to all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from sparkloom.llm.common import documents, durable, release, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels, doesn't reject."""
    return toxicity.kept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal up to white space, the one with the smallest id."""
    return exact_dedup.apply(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 or more on shingles of five words, the document with the smallest id."""
    return ngram_join.apply(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in the target weights of domain, language and source; one row for each epoch."""
    return mixing.apply(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 4096 ids."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard", without_near_copies),
    ("mixing", mixed),
    ("packing", packed),
]

#: Training, components and tokenizing can't be said in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents, each result written before the next stage reads it and what led to it deleted."""
    docs, others = documents(spark, sf_dir), written()
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
        # the last path is that of docs
        release(spark, [p for p in written()[:-1] if p not in others])
    return STAGES[-1][1](spark, docs, sf_dir)
