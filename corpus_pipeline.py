"""Training-data pipeline over `documents`; every stage calls one operator of chronoweave.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import minhash, mixing, pieces, pii, quality
from chronoweave.llm.common import read
from chronoweave.llm.queries import MODEL_FILE
from chronoweave.session import scratch_path


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rejected documents and the failing lines of the others."""
    return quality.clean_documents(docs)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five-word shingles, 0.8)."""
    return minhash.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    return pii.redact_documents(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents inside the mix, in the order of its schedule."""
    return mixing.mixed_documents(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sampled segmentations of every document."""
    return pieces.encode_documents(docs, MODEL_FILE)


STAGES = [
    ("quality rules", quality_stage),
    ("near-duplicates", dedup_stage),
    ("personal data", pii_stage),
    ("source mixing", mixing_stage),
    ("sentencepiece", encoding_stage),
]

# MinHash groups, learnt patterns and sampled segmentations have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1], 1):
        path = scratch_path(spark, f"pipeline-{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
