"""A training-data pipeline of five stages; each takes (spark, docs, sf_dir) and works on all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from meterlake.llm.common import id_crc, table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects; it learns from the labels that op6 learns from."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), id_crc() % 4 != 2)
    return toxicity.score(docs, model, docs.columns).filter(F.col("score") < toxicity.THRESHOLD).select("row.*")


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.exact_dedup(docs, carry=docs.columns).filter("kept").select("row.*")


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_first(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by the probabilities that meet the tempered marginals."""
    return mixing.mix(docs, carry=docs.columns).filter("kept").select("row.*")


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, and the digests of what is encoded and decoded."""
    coded = bpe.encode(docs)
    return coded.select("doc_id", "ids", *bpe.digest_columns())


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Neither the classifier, nor similarity of shingles, nor BPE can be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
