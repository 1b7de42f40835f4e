"""The corpus pipeline: five stages over ``documents``, each reading what its predecessor wrote.

A document is rejected if it is scored toxic, loses the lines that repeat earlier ones,
stays only as the smallest id of its near-duplicate class (six of 64 bits over five-word shingles), is dropped if it holds a
benchmark item, and is then mixed to the target weights of its source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import decontaminate, linedup, mixing, shared, simhash, toxicity


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return linedup.dedup_lines(docs)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.by_source(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("decontamination", benchmark_stage),
    ("mixing", mixing_stage),
]

#: The first stage scores with a trained model and the last solves a flow; neither is SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, which keeps what it needs; the tables between the stages are deleted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with shared.scratch(spark) as store:
        for _, stage in STAGES[:-1]:
            docs = store(stage(spark, docs, sf_dir))
        return STAGES[-1][1](spark, docs, sf_dir)
