"""From raw documents to packed sequences: each stage works on all that the one before it kept.

Every stage but the last returns the columns of its input. Where a stage changes texts, ``n_chars`` is counted anew.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from voxloom.llm import exact_dedup, ngram_join, packing, quality, suffix_dedup
from voxloom.session import ship_package, stage


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines above the limit of their host are removed from the others."""
    ship_package(spark)
    return _counted(quality.clean(docs))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    ship_package(spark)
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar texts stays: five words to a shingle, a similarity of 0.8 or more."""
    ship_package(spark)
    return ngram_join.deduplicate(docs, size=5, part=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that begin anywhere else as well are removed, and so are passages of over 50 words, however short."""
    ship_package(spark)
    return _counted(suffix_dedup.deduplicate(docs, words=51))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their place in a sequence."""
    ship_package(spark)
    return packing.packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_copies),
    ("ngram_jaccard", near_copies),
    ("suffix_dedup", repeated_passages),
    ("best_fit_packing", packed),
]

ORACLE_SQL = None  # repeated byte strings, tokenizers and packing have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        rows = stage(function(spark, rows, sf_dir), f"pipeline-{name}")
    return rows
