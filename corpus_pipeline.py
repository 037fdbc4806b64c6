"""A corpus from raw documents to packed sequences, in five stages of the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarrymill.llm.common import materialize, table
from quarrymill.llm.decontaminate import drop_contaminated
from quarrymill.llm.near_dedup import drop_near_duplicates
from quarrymill.llm.packing import pack
from quarrymill.llm.pii import redact
from quarrymill.llm.quality_classifier import Classifier


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the quality classifier rejects."""
    return Classifier(docs, table(spark, sf_dir, "labels")).keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts."""
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokenized documents into sequences."""
    return pack(docs)


STAGES = [
    ("quality_classifier", quality),
    ("near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii_redaction", personal_data),
    ("packing", packing),
]

#: Trained models, suffix arrays and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
