"""A corpus from quality filter to tokens: five stages, each a training-data operator.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet and read again.
Identifiers are taken to be those of documents: rows that share one (other than equal rows, of which one stays) go
and stay together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, exact_dedup, quality, simhash
from .common import scratch, table, without, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest identifier stays."""
    return exact_dedup.keep_one(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by four fifths of their five-word shingles that with the smallest identifier stays."""
    groups = simhash.similar_groups(docs)
    return without(docs, written(groups.where("NOT doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct(), "near"), "doc_id")


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words within occurrences of benchmark windows are cut out of the texts."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens, digests of the ids and of what they decode to."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("decontaminate", decontaminate_stage), ("encode", encode_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
