"""A sink that writes what each micro-batch leaves in several tables once, however often the batch is replayed.

Each table has a folder for each batch, which a replay overwrites, and a ledger names the batches that were written to the end. Readers
take only batches of the ledger, so rows of a batch that broke off are never seen, and a batch that is in the ledger is not written again.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from ..plans import turns as plan
from ..sources import shared

Tables = Callable[[DataFrame], dict[str, DataFrame]]


def batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch): the batches that were written to the end."""
    try:
        return spark.read.schema("n_tables int, batch long").parquet(f"{path}/ledger").select("batch")
    except AnalysisException:
        return spark.createDataFrame([], "batch long")


def once(tables: Tables, path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: writes each table's rows of the batch, then the batch into the ledger."""

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not batches(spark, path).where(F.col("batch") == batch_id).isEmpty():
            return
        found = tables(shared.cut(batch))
        for name, rows in found.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        spark.createDataFrame([(len(found),)], "n_tables int").write.mode("overwrite").parquet(f"{path}/ledger/batch={batch_id}")

    return write


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """The rows of a table, each batch's once. The ledger has a row for each batch and is read by its folders."""
    rows = spark.read.option("basePath", f"{path}/{name}").parquet(f"{path}/{name}")
    return rows.join(batches(spark, path), "batch", "left_semi").drop("batch")


def turn_tables(responses: DataFrame, as_of: datetime) -> Tables:
    """What replayed turns with their texts leave: interactions, decisions, and the reviews of sessions that complete, against stored responses."""

    def tables(states: DataFrame) -> dict[str, DataFrame]:
        results = shared.cut(plan.results_of(states))
        interactions, decisions = plan.audit_rows(results, states.select("session_id", "turn", "text"), as_of)
        reviews = quality.review_rows(plan.quality_reports(results, responses), responses, as_of)
        return {"interactions": interactions, "decisions": decisions, "reviews": reviews}

    return tables
