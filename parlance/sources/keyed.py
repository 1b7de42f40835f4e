"""Tables bucketed by key: a set of changes reads and rewrites only the buckets that hold its keys.

A table is a folder of bucket folders. Each row has a version; a change may name the version it was made for, and one that is
stale changes nothing and is reported. Deleted rows stay as versions without data, so a late change to one is found out too;
:func:`read` leaves them out. A set of changes is applied by one overwrite of the touched partitions, which is committed as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared

#: What became of a change.
OUTCOMES = ("applied", "stale", "missing", "superseded")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create(rows: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Write rows with unique keys as a keyed table, all at version 1. The number of buckets is part of the table."""
    rows = rows.withColumns({"version": F.lit(1).cast("long"), "deleted": F.lit(False), "bucket": _bucket(key, buckets)})
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    rows.sparkSession.createDataFrame([(key, buckets)], "key string, buckets int").write.mode("overwrite").parquet(f"{path}/layout")


def read(spark: SparkSession, path: str, keys: DataFrame | None = None) -> DataFrame:
    """The rows of a keyed table with their versions; with ``keys`` only those of its keys, from their buckets."""
    key, buckets = spark.read.parquet(f"{path}/layout").first()
    found = spark.read.parquet(f"{path}/rows").where("not deleted")
    if keys is not None:
        wanted = keys.select(F.col(key).alias("_key")).distinct()
        found = found.where(F.col("bucket").isin(_touched(wanted, "_key", buckets))).join(wanted, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
    return found.drop("bucket", "deleted")


def _touched(changes: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of some keys, of at most the table's number."""
    return sorted(r[0] for r in changes.select(_bucket(key, buckets)).distinct().collect())


def apply(changes: DataFrame, path: str) -> DataFrame:
    """Apply changes (key, seq, op, made_for, columns to set...) and give (key, seq, outcome, version) of each.

    op is ``set`` (null columns keep what is stored, a new key begins a row), ``update`` (the same, for a key that must be there) or ``delete``. Where made_for isn't null it must be
    the row's version (0 for none), else the change is stale. Of several changes to a key the last by seq counts, the others are superseded. Each applied change adds
    one to the version. Only touched buckets are read and written.
    """
    spark = changes.sparkSession
    key, buckets = spark.read.parquet(f"{path}/layout").first()
    columns = [c for c in changes.columns if c not in (key, "seq", "op", "made_for")]
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    ranked = shared.cut(changes.withColumn("_nth", last))
    touched = _touched(ranked, key, buckets)
    new = ranked.where("_nth = 1").select(F.col(key).alias("_key"), "seq", "op", "made_for", *[F.col(c).alias(f"_{c}") for c in columns])
    old = spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(touched))
    both = old.join(new, F.col(key).eqNullSafe(F.col("_key")), "full")
    there = F.col("version").isNotNull() & ~F.col("deleted")
    now = F.when(there, F.col("version")).otherwise(0)
    outcome = (
        F.when(F.col("op").isNull(), None).when(F.col("made_for").isNotNull() & (F.col("made_for") != now), "stale")
        .when(~there & (F.col("op") != "set"), "missing").otherwise("applied")
    )
    both = shared.cut(both.withColumns({"outcome": outcome, "_key": F.when(F.col("op").isNotNull(), F.col("_key"))}))
    done = F.coalesce(F.col("outcome") == "applied", F.lit(False))
    gone = done & (F.col("op") == "delete")
    fresh = done & ~F.coalesce(there, F.lit(False))
    values = {}
    for c in old.columns:
        if c in columns:
            values[c] = F.when(gone, None).when(fresh, F.col(f"_{c}")).when(done, F.coalesce(f"_{c}", c)).otherwise(F.col(c))
        elif c not in (key, "version", "deleted", "bucket"):
            values[c] = F.when(gone | fresh, None).otherwise(F.col(c))
    values |= {
        key: F.when(F.col("version").isNull(), F.col("_key")).otherwise(F.col(key)), "version": F.when(done, F.coalesce("version", F.lit(0)) + 1).otherwise(F.col("version")),
        "deleted": F.when(done, gone).otherwise(F.col("deleted")), "bucket": F.coalesce("bucket", _bucket("_key", buckets)),
    }
    after = both.where(F.col("version").isNotNull() | done).select(*[values[c].alias(c) for c in old.columns])
    after.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{path}/rows")
    told = both.where("op is not null").select(
        F.col("_key").alias(key), "seq", "outcome", F.when(done, F.coalesce("version", F.lit(0)) + 1).otherwise(now).alias("version"))
    return told.unionByName(ranked.where("_nth > 1").select(key, "seq", F.lit("superseded").alias("outcome"), F.lit(None).cast("long").alias("version")))
