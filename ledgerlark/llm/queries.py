"""The queries of this subpackage, by name, and their SQL where SQL expresses them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, divergence, exact_dedup, licenses, lm, mixing, pii, quality, sharding, simhash, warc, whitening
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op1(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.op5(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op7(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.op8(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op3(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op4(table(spark, sf_dir, "documents"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op6(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op9(table(spark, sf_dir, "conversations"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op10(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.op11(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op12(table(spark, sf_dir, "pages"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.op13(table(spark, sf_dir, "documents"))


#: What the operators offer beside the queries' columns is tested in tests/llm.
QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_mixing, op2_quality, op3_licenses, op4_sharding, op5_exact_dedup, op6_lm_scoring, op7_simhash, op8_decontamination, op9_chat, op10_pii, op11_whitening, op12_warc, op13_divergence)
}

SQL: dict[str, str] = {
    "op1_mixing": mixing.SQL, "op3_licenses": licenses.SQL, "op5_exact_dedup": exact_dedup.SQL, "op6_lm_scoring": lm.SQL,
    "op8_decontamination": decontam.SQL, "op9_chat": chat.SQL, "op12_warc": warc.SQL, "op13_divergence": divergence.SQL,
}
