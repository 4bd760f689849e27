"""Cleaning of a training corpus: stages that each take and give rows of documents, the last one with token ids.

Each stage is written as Parquet and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import bpe, decontamination, neardup, quality, substrings
from skein.llm._shared import written

#: Words of the shortest passage that the substring stage removes where a document with a smaller id has it.
PASSAGE = 50


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, doesn't reject."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8."""
    return neardup.keep_one(docs)


def without_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that documents with smaller ids have; n_chars follows. Documents that lose all their words go."""
    cut = substrings.remove(docs.withColumn("__had", F.col("text").rlike(r"[^\x20\x09-\x0D]")), PASSAGE)
    cut = cut.where(F.col("text").rlike(r"[^\x20\x09-\x0D]") | ~F.coalesce("__had", F.lit(False)))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length("text"), "n_chars").cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark's passages."""
    return decontamination.remove_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their byte-level BPE ids and the text that these decode to."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each),
    ("substring_dedup", without_passages),
    ("decontamination", without_benchmarks),
    ("bpe", as_tokens),
]
#: A trained network decides, which SQL can't express; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
