"""Registered queries of the training-data operators, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    byte_bpe, divergence, lsh_forest, minhash, mixing, ordinal, phrases, quality_rules, secret_scan, signature_tree, suffix_dedup,
    token_binary, token_counts,
)
from .common import configure, materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    judged = quality_rules.judge(docs, ["doc_id"], "doc_id long", report=quality_rules.MEASURES)
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op2_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"), ["doc_id"], "doc_id long")


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return token_binary.stored(spark, docs, public_tokenizers.path("word_bpe_49k.json"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    path = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.count_tokens(docs, ["doc_id"], "doc_id long", path)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    mixed = mixing.mix(materialize(sizes, "mix-sizes"), F.col("size"))
    taken = (F.col("copies") * F.col("mix_size")).alias("taken")
    return mixed.select("doc.doc_id", "doc.size", "source_size", "target", taken)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_documents(
        _table(spark, sf_dir, "documents"), ["doc_id"], "doc_id long",
        public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return lsh_forest.nearest(rows, rows.where(F.col("vec_id") % 20 == 0))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    made = materialize(ordinal.described(docs, ["doc_id"], "doc_id long"), "ordinal-features")
    model, least = ordinal.train(docs, _table(spark, sf_dir, "labels"), made=made)
    return ordinal.score_described(made, ["doc_id"], "doc_id long", model, least)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.join_documents(_table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_secret_scans, op3_token_binary, op4_token_counts, op5_mixing,
        op6_byte_bpe, op7_nearest, op8_suffix_dedup, op9_quality_classifier, op10_jaccard_join,
        op11_minhash_dedup, op12_source_divergence, op13_phrase_mining,
    )
}

ORACLE_SQL = {
    "op5_mixing": mixing.ORACLE_SQL,
    "op12_source_divergence": divergence.ORACLE_SQL,
    "op13_phrase_mining": phrases.ORACLE_SQL,
}
