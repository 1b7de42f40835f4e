"""Logs laid out by day: retention drops whole days, periods are answered from kept counts of days.

A log is a folder for each day of a time column; beside it lie its counts by day and by a few columns. A purge deletes the folders of days
before the limit and rewrites only the day that the limit falls in. The counts of a period are those of its whole days, added up, and
of the rows of its first and last day, the only ones that are read. Rows that come late recompute the counts of their own day.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows without a time lie in a folder of their own: they are of no period and never expire.
NEVER = "none"


def _day(column: str) -> Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(NEVER))


def append(log: DataFrame, path: str, column: str = "timestamp", by: tuple[str, ...] = ()) -> None:
    """Add rows to a log, making it if need be, and bring the counts of the days they fall in up to date.

    by are the columns that counts are kept by; they hold few values. Only the folders of the days touched are read again.
    """
    spark = log.sparkSession
    days = [r[0] for r in log.select(_day(column).alias("day")).distinct().collect()]  # a row for each day
    if not days:
        return
    log.withColumn("day", _day(column)).repartition("day").write.mode("append").partitionBy("day").parquet(f"{path}/rows")
    _counted(spark.read.parquet(f"{path}/rows").where(F.col("day").isin(days)), by).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/counts")
    spark.createDataFrame([(column, list(by))], "column string, by array<string>").write.mode("overwrite").parquet(f"{path}/layout")


def _counted(rows: DataFrame, by) -> DataFrame:
    return rows.groupBy("day", *by).agg(F.count("*").alias("n"))


def _layout(spark: SparkSession, path: str) -> tuple[str, list[str]]:
    return tuple(spark.read.parquet(f"{path}/layout").first())


def read(spark: SparkSession, path: str, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """The log's rows, or those of a period, both ends included, from the folders of its days."""
    column, _ = _layout(spark, path)
    rows = _rows(spark, path)
    if start is not None:
        rows = rows.where((F.col("day") >= f"{start:%Y-%m-%d}") & (F.col("day") != NEVER) & (F.col(column) >= F.lit(start).cast("timestamp_ntz")))
    if end is not None:
        rows = rows.where((F.col("day") <= f"{end:%Y-%m-%d}") & (F.col(column) <= F.lit(end).cast("timestamp_ntz")))
    return rows.drop("day")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "false").parquet(f"{path}/rows").withColumn("day", F.col("day").cast("string"))


def counts(spark: SparkSession, path: str, start: datetime, end: datetime) -> DataFrame:
    """(by..., n) of a period, both ends included: counts of the days between added to those of the rows of its first and last day."""
    column, by = _layout(spark, path)
    first, last = f"{start:%Y-%m-%d}", f"{end:%Y-%m-%d}"
    kept = spark.read.parquet(f"{path}/counts").withColumn("day", F.col("day").cast("string"))
    whole = kept.where((F.col("day") > first) & (F.col("day") < last)).select(*by, "n")
    border = _rows(spark, path).where(F.col("day").isin(sorted({first, last})))
    border = border.where(F.col(column).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))).groupBy(*by).agg(F.count("*").alias("n"))
    both = whole.unionByName(border)
    return both.groupBy(*by).agg(F.sum("n").alias("n")) if by else both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def purge(spark: SparkSession, path: str, limit: datetime, dry_run: bool = False) -> int:
    """Remove the rows before ``limit`` and give their number. Whole days go with their folders, unread: their kept counts tell their rows."""
    column, by = _layout(spark, path)
    day = f"{limit:%Y-%m-%d}"
    kept = spark.read.parquet(f"{path}/counts").withColumn("day", F.col("day").cast("string"))
    old = kept.where(F.col("day") < day).groupBy("day").agg(F.sum("n").alias("n")).collect()  # a row for each expired day
    border = _rows(spark, path).where(F.col("day") == day)
    keeps = F.col(column) >= F.lit(limit).cast("timestamp_ntz")
    gone, stay = border.agg(F.count_if(~keeps), F.count_if(keeps)).first()
    total = sum(r["n"] for r in old) + gone
    if dry_run or not total:
        return total
    if gone and stay:
        # The rows go last, so that a purge which breaks off is made whole by the next one.
        for table, rows in (("counts", _counted(border.where(keeps), by)), ("rows", border.where(keeps))):
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(f"{path}/{table}")
    for r in [*old, *([{"day": day}] if gone and not stay else [])]:
        for table in ("rows", "counts"):
            _remove(spark, f"{path}/{table}/day={r['day']}")
    return total


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(f"{path}/layout").isEmpty()
    except AnalysisException:
        return False


def purge_logs(spark: SparkSession, audit: str, access: str, decision: str, as_of: datetime, retention_days: int = 90, dry_run: bool = False) -> dict[str, int]:
    """Purge the three logs, the access log (laid out by ``retained_until``) by its own limits; rows removed are told by one event in the audit log."""
    limit = as_of - timedelta(days=retention_days)
    told = {
        "audit_purged": purge(spark, audit, limit, dry_run), "access_purged": purge(spark, access, as_of, dry_run), "decision_purged": purge(spark, decision, limit, dry_run),
    }
    if sum(told.values()) and not dry_run:
        pairs = F.to_json(F.struct(*[F.lit(n).alias(c) for c, n in told.items()]))
        event = spark.range(1).select(F.lit("purge_executed").alias("event_type"), F.lit(as_of).cast("timestamp_ntz").alias("timestamp"), pairs.alias("metadata_json"))
        append(event, audit, by=tuple(_layout(spark, audit)[1]))
    return told
