"""Stages that make packed training sequences of raw documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marketlab.llm import containment, jaccard, packing, resampling, secretscan
from marketlab.llm.common import read, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents drawn by importance resampling towards the good labelled ones."""
    return resampling.keep(docs, read(spark, sf_dir, "labels"))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near-duplicates."""
    return jaccard.first_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that contain a benchmark item."""
    return containment.clean(docs, read(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets, also encoded ones, in the texts."""
    return secretscan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents that are left, as pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", classify),
    ("n-gram jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written and reread."""
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs


#: The stages are hashed models, searches and tokens, which SQL doesn't express; tests hold each against brute force.
ORACLE_SQL = None
