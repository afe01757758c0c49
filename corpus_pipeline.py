"""Corpus pipeline: five stages over documents, each written as Parquet before the next one reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.llm import bpe, decontam, langid, quality, simhash
from locusframe.llm.common import delete, materialize, scratch, table
from locusframe.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are inside their perplexity bands. Null and empty texts go."""
    return quality.keep_good(docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Null, empty and letterless texts go."""
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates; one of those without words stays too."""
    return simhash.near_dedup(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with every benchmark passage cut out; n_chars follows the text. Null and empty texts stay as they are."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, packed, with digests of them and of the text decoded from them; none for null or empty."""
    coded = bpe.round_trip(docs, bpe.Vocabulary.load(tokenizer_path()))
    return coded.select(
        "doc_id", F.expr("cast(length(ids) div 4 as bigint)").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("encoding", encoding),
]

#: Perplexity bands, language profiles, fingerprints and the encoder are not SQL; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; the last one's table as read back.

    What a stage wrote for itself goes when its table is written, and that table when the next one is: only the last
    stays, which is the result. Null, empty, very long and repeated rows: see each stage's operator.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as keep:
            docs, path = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.add(path)
        if before is not None:
            delete(spark, before)
        before = path
    return docs
