"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gaugeline.llm import byte_bpe, mixing, quality_rules, secret_scan, signature_tree
from gaugeline.llm.common import configure, drop_tables, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    configure(spark)
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents."""
    configure(spark)
    return signature_tree.keep_one(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    configure(spark)
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    configure(spark)
    return mixing.sample(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, with digests of ids and decoded bytes."""
    configure(spark)
    return byte_bpe.encode_documents(
        docs, ["doc_id", "source"], "doc_id long, source string",
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=True,
    )


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("secret_scans", secrets),
    ("mixing", mix),
    ("byte_bpe", token_ids),
]

#: SQL can't express byte-level merges; the chain is tested stage by stage against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes once the next one is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_tables(spark, *written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
