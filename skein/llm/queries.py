"""The queries of this subpackage, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import audit, bpe, curriculum, decontamination, licenses, lm, neardup, quality, sharding, substrings, topk, warc, whitening


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(_table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(_table(spark, sf_dir, "pages"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"))


def op6_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"), order=lm.ORDER)


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(_table(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(_table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op11_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.digest(_table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.digest(_table(spark, sf_dir, "embeddings"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_licenses": op2_licenses,
        "op3_warc": op3_warc,
        "op4_quality": op4_quality,
        "op5_topk": op5_topk,
        "op6_ppm": op6_ppm,
        "op7_substrings": op7_substrings,
        "op8_minhash": op8_minhash,
        "op9_bpe": op9_bpe,
        "op10_sharding": op10_sharding,
        "op11_curriculum": op11_curriculum,
        "op12_whitening": op12_whitening,
        "op13_audit": op13_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontamination": decontamination.ORACLE_SQL,
        "op3_warc": warc.ORACLE_SQL,
        "op5_topk": topk.ORACLE_SQL,
        "op7_substrings": substrings.ORACLE_SQL,
        "op8_minhash": neardup.ORACLE_SQL,
        "op11_curriculum": curriculum.ORACLE_SQL,
        "op13_audit": audit.ORACLE_SQL,
    }
