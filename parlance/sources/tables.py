"""Readers and writers of tables, and the occupation dimension."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

OCCUPATIONS = Path(__file__).parent.parent / "resources" / "occupations.csv"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, per_core: int = 64 << 20) -> DataFrame:
    """The rows dealt over all cores where the table is so small that its files have fewer row groups than there are cores; large tables stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    small = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < per_core * cores
    return df.repartition(cores) if small else df


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Append rows to a table; the schema is that of the rows."""
    (df.write.mode("append").partitionBy(*partition_by) if partition_by else df.write.mode("append")).parquet(path)


def with_ids(rows: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """rows with a stable id that a retry repeats: a hash of their key columns."""
    return rows.withColumn(name, F.xxhash64(*keys))


def occupations(spark: SparkSession) -> DataFrame:
    """(code, level, title_en, title_ar, description): the fixed dimension of 124 rows; codes are text and keep leading zeros."""
    import csv

    with OCCUPATIONS.open(encoding="utf-8") as f:
        rows = [(r["code"], int(r["level"]), r["title_en"], r["title_ar"], r["description"]) for r in csv.DictReader(f)]
    return spark.createDataFrame(rows, "code string, level int, title_en string, title_ar string, description string")


def size(df: DataFrame) -> DataFrame:
    """One row: the exact number of rows n."""
    return df.agg(F.count("*").alias("n"))


def documents_as_json(df: DataFrame, key: str, column: str = "doc") -> DataFrame:
    """One JSON document for each key, as a key-value store keeps it."""
    return df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias(column))


def from_documents(df: DataFrame, key: str, schema: str, column: str = "doc") -> DataFrame:
    """The documents' fields; a document that is not JSON gives null."""
    return df.select(key, F.from_json(column, schema).alias("r")).select(key, "r.*")


def rebuild(df: DataFrame, path: str) -> None:
    """Replace a table as a whole, as an index is rebuilt."""
    df.write.mode("overwrite").parquet(path)


def ensure(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write the table only if there is none or it is empty, then read it."""
    from pyspark.errors import AnalysisException

    try:
        found = spark.read.parquet(path)
        if not found.isEmpty():
            return found
    except AnalysisException:
        pass
    rebuild(df, path)
    return spark.read.parquet(path)
