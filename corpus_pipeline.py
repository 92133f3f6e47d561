"""From raw documents to packed sequences: the stages, each an operator of glasspool.llm."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from glasspool.llm import exact, minhash, packing, pii, quality
from glasspool.llm.text import prepared
from glasspool.workspace import Workspace


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the fences of their language and source."""
    return quality.keep_good(docs, Workspace.of(prepared(spark)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact.drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more of five-word shingles."""
    return minhash.drop_near_copies(docs, Workspace.of(prepared(spark)))


def remove_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data generalised and disclosing terms removed."""
    return pii.redact(docs, Workspace.of(prepared(spark)), length_column="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their place in a sequence."""
    return packing.pack(docs, Workspace.of(prepared(spark)), public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("remove_pii", remove_pii),
    ("pack", pack),
]

#: quantile fences, min-max hashing and packing have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    workspace = Workspace.of(prepared(spark))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = workspace.store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
