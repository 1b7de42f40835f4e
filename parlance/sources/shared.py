"""The folder that the driver and all executors share, for tables that outlive a job."""

from __future__ import annotations

import re
import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@cache
def _local(app: str) -> str:
    return tempfile.mkdtemp(prefix=f"parlance-{app}-")


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. A local session without one gets a temporary folder; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return _local(spark.sparkContext.applicationId)


def fingerprint(df: DataFrame) -> str:
    """What a table read from files is: a hash over its files' paths, sizes and times."""
    files = df.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    got = files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("*").cast("decimal(38,0)")).alias("h")).first()
    return f"{got['n']}-{got['h']}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and cut the lineage there, so that no executor's loss repeats the work before it."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
    return df.checkpoint(eager=True)
