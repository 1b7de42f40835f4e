"""A store of provider replies: a request is asked once, by the hash of its content, and failures are kept and asked again.

The store only grows: a folder for each kind of request, a row for each attempt, with a null reply where it failed. What was
answered, or failed as often as it may, is not asked again, so a stage that is run anew costs no further calls. Kinds don't touch each
other: where one provider fails, its rows get its neutral default and the others theirs as ever.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import providers, shared

ATTEMPT = "key string, reply string, attempt int, kind string"


class Enrichment(NamedTuple):
    """What a stage asks of a provider: the prompt of a row, which rows ask, and what a row has without a reply."""

    prompt: Column
    gate: Column
    provider: providers.Provider | None
    default: str | None = None


def stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, reply, attempts): of each request of a kind its reply, null if all attempts failed, and their number."""
    try:
        rows = spark.read.schema(ATTEMPT).parquet(path).where(F.col("kind") == kind)
    except AnalysisException:
        rows = spark.createDataFrame([], ATTEMPT)
    return rows.groupBy("key").agg(F.max("reply").alias("reply"), F.max("attempt").alias("attempts"))


def ask(df: DataFrame, path: str, kind: str, what: Enrichment, most: int = 3) -> int:
    """Ask what isn't answered yet and append the replies to the store; gives the number of requests asked. Equal prompts are one request."""
    if what.provider is None:
        return 0
    wanted = df.where(F.coalesce(what.gate, F.lit(False))).select(what.prompt.alias("prompt")).where("prompt is not null").distinct()
    known = stored(df.sparkSession, path, kind)
    due = wanted.withColumn("key", F.sha2("prompt", 256)).join(known, "key", "left").where(F.col("reply").isNull() & (F.coalesce("attempts", F.lit(0)) < most))
    due = due.select("key", "prompt", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempt"))
    got = shared.cut(providers.complete(due, F.col("prompt"), F.lit(True), what.provider))
    n = got.count()
    if n:
        got.select("key", "reply", F.col("attempt").cast("int").alias("attempt"), F.lit(kind).alias("kind")).write.mode("append").partitionBy("kind").parquet(path)
    return n


def enriched(df: DataFrame, path: str, stages: dict[str, Enrichment], most: int = 3) -> DataFrame:
    """df with a column for each stage: the stored reply, asked now where it is due, or the stage's default.

    A row whose gate is false or null has the default too. A provider that raises, or none, leaves the other stages as they are.
    """
    for name, what in stages.items():
        ask(df, path, name, what, most)
        found = stored(df.sparkSession, path, name).select(F.col("key").alias("_key"), F.col("reply").alias("_reply"))
        key = F.when(F.coalesce(what.gate, F.lit(False)), F.sha2(what.prompt, 256))
        df = df.join(found, key == F.col("_key"), "left").withColumn(name, F.coalesce("_reply", F.lit(what.default))).drop("_key", "_reply")
    return df
