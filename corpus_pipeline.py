"""The corpus pipeline: stages that each take the documents their predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ledgerlark.llm import decontam, mixing, quality, sharding, simhash, similar
from ledgerlark.llm._shared import drop, noting, stored, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Working tables of the stage that ran last. Its result has been written when the next stage begins, which deletes them.
_working: list[str] = []


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        drop(spark, _working)
        with noting(_working):
            return f(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.near_dedup(docs, similar.group_both)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources), ("sharding", sharded),
]

#: The first stage trains a classifier, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is kept until the next one's result is written."""
    docs, held = table(spark, sf_dir, "documents"), []
    for i, (_, stage) in enumerate(STAGES):
        docs, before, held = stage(spark, docs, sf_dir), held, []
        if i < len(STAGES) - 1:
            with noting(held):
                docs = stored(docs)
            drop(spark, before)
    return docs
