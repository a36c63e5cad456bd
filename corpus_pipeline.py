"""The corpus pipeline: each stage works on all rows that the one before has kept.

Stages take and return documents (doc_id, text, lang, source, n_chars); the last one
adds size, source_size, target and taken. Every stage's result is written as Parquet
to the shared folder and read again, so a lost executor never costs an earlier stage.

In every stage a null text counts as empty, texts are read whole, other columns are
carried along whatever their names, and a table without rows gives one without rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontam import decontaminate
from tidemark.llm.minhash import one_of_each
from tidemark.llm.mixing import mixed
from tidemark.llm.secrets import redact
from tidemark.llm.toxicity import without_toxic
from tidemark.session import shared_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the passage search rejects go. It learns from the labelled rows of ``docs``; without such rows of both classes none go. Null ids, and null and empty texts, are scored like others; repeated rows alike."""
    return without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, similarity 0.80 or more. It is the one with the smallest id; null ids, and texts without words, stay; of rows that repeat an id one stays."""
    return one_of_each(docs, similar=80, symbols=40, chunks=10)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, with all rows of their id; null ids stay. An empty benchmark takes none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays, n_chars is counted anew (null for a null text)."""
    found = redact(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in found.columns else found


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix of sources takes words of, with the words taken. Documents without words go; null sources are one source, null ids one document's."""
    return mixed(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("mixing", mixing),
]

#: SQL cannot express the stages; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
