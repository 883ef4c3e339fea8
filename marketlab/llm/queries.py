"""The corpus queries, one for each operator, over whole tables."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession

from . import containment, jaccard, kneser, outliers, packing, passages, resampling, secretscan, surrogates, template
from .common import read

SURROGATE_KEY = "spark.marketlab.surrogateKey"


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kneser.train_and_score(read(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each passage of a document, with its class; ``passages.find`` has the pairs."""
    return passages.classes(read(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surrogates by the key in the session's setting ``SURROGATE_KEY``, or else by one that is drawn for this run."""
    key = spark.conf.get(SURROGATE_KEY, None)
    key = key.encode() if key else secrets.token_bytes(32)
    return surrogates.replace(read(spark, sf_dir, "documents"), key).select("doc_id", "text", "n_entities")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(read(spark, sf_dir, "documents"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(read(spark, sf_dir, "documents"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.digest(secretscan.scan(read(spark, sf_dir, "documents")))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template.extract(read(spark, sf_dir, "pages"))


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {}
