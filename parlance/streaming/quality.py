"""Session quality kept up to date over a stream of responses, with a feed of the changes of its status.

The stream keeps exact sums for each session and gives, in update mode, the sessions that a batch changed. Each batch writes their new
figures once (``sink``), and where a session's status differs from that of its latest batch before, a row of the feed. Since both only
hang on earlier batches of the ledger, a batch that is replayed writes the same rows again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality
from . import sink

FIGURES = ("total_responses", "flagged_count", "quality_score", "status", "escalation_reason")
KIND = "session_id long, total_responses long, flagged_count long, quality_score double, status string, escalation_reason string, batch long"


def figures(responses: DataFrame, low: float = quality.LOW_CONFIDENCE) -> DataFrame:
    """A stream of responses (session_id, isco_code, confidence_score) to the judged figures of each session that changed; write it in update mode."""
    return quality.judged(quality.metrics(responses, low, exact=True)).select("session_id", *FIGURES)


def _written(spark: SparkSession, path: str) -> DataFrame:
    try:
        rows = spark.read.schema(KIND).parquet(f"{path}/figures")
    except AnalysisException:
        return spark.createDataFrame([], KIND)
    return rows.join(sink.batches(spark, path), "batch", "left_semi").select(*[c.split()[0] for c in KIND.split(", ")])


def latest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """(session_id, figures..., batch): of each session the figures that the latest batch gave it, of batches before one if that is named."""
    rows = _written(spark, path)
    rows = rows if before is None else rows.where(F.col("batch") < before)
    return rows.groupBy("session_id").agg(F.max_by(F.struct(*FIGURES, "batch"), "batch").alias("f")).select("session_id", "f.*")


def writer(path: str) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` over :func:`figures`: writes the figures and the changes of status of a batch once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        def tables(rows: DataFrame) -> dict[str, DataFrame]:
            old = latest(rows.sparkSession, path, batch_id).select(F.col("session_id").alias("_s"), F.col("status").alias("old_status"))
            both = rows.join(old, F.col("session_id").eqNullSafe(F.col("_s")), "left").where(~F.col("status").eqNullSafe(F.col("old_status")))
            return {"figures": rows, "changes": both.select("session_id", "old_status", F.col("status").alias("new_status"), "quality_score", "escalation_reason")}

        sink.once(tables, path)(batch, batch_id)

    return write


def queue(spark: SparkSession, path: str) -> DataFrame:
    """The sessions that stand escalated now, those first that have been so longest."""
    return latest(spark, path).where("status = 'escalated'").orderBy("batch", "session_id")
