"""The corpus pipeline: from raw documents to packed token sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.llm import near_sets, packing, quality_rules, store, suffix_dedup, weak_quality
from gristmill.llm.queries import vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled scorer accepts."""
    return weak_quality.judge(docs).where("good").select(*docs.columns)


def quality_rule_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the rules' posterior."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, with the smallest doc_id, of each component of near copies: found by SimHash, checked by
    5-word Jaccard of 0.8 or more; copies of that Jaccard beyond the fingerprints' radius are found exactly."""
    return near_sets.keep_first(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 100 bytes that start earlier in the corpus."""
    cut = suffix_dedup.remove_repeats(docs)
    return cut.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rule_filter),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", exact_dedup),
    ("best_fit_packing", pack),
]

#: Learned models, components and packing have no SQL form; the tests hold the
#: stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs = store.stash(stage(spark, docs, sf_dir), name)
    return docs
