"""Corpus preparation: quality classifier, line dedup, SimHash near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; its result is written
as Parquet and read again as the next one's documents. All stages but the last return the columns of
documents. A quality verdict removes a document, line dedup removes lines (and documents of which nothing is
left), near-dedup keeps the first document of each group, decontamination cuts benchmark passages (and
removes documents of which no word is left), packing lays every token left into training windows.

Null, empty and blank texts go at the first stage; documents with a null doc_id pass through all
others but lose benchmark passages. Rows of one doc_id are one document to the dedup stages.
Columns beside doc_id and text are carried along; n_chars, if there, follows the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from recordmill.llm import decontaminate, lines, packing, quality, simhash
from recordmill.llm import textkit as tk


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.train(docs, labels), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return lines.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("quality", quality_filter),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", pack),
]

# Trained trees, MinHash and SimHash can't be written in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the cluster's shared folder and read again."""
    folder = f"{tk.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
