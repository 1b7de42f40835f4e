"""What several operators of this subpackage need: words, checkpoints, size-checked broadcasts, components.

Nothing here collects rows of the input. Checkpoints go to the folder named by
``spark.checkpoint.dir``, which all executors share; only where a local session has no
such setting (tests) a temporary folder is set.
"""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and the controls 09 to 0D.
WHITE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session without one gets a temporary one; a cluster must name its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="parlance-"))
    return sc.getCheckpointDir()


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate results, in whatever store it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within, a job's shuffle files go when it ends: its result is written, so nothing reads them again."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives the loss of executors."""
    shared_dir(df.sparkSession)
    with freeing_shuffles(df.sparkSession):
        return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession, codec: str = "zstd", dictionary: bool = True) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that writes a frame as Parquet to the shared folder and reads it back; the folder goes at the end.

    For columns of hashes dictionaries cost more than they save, and so does a dear codec if they are soon read.
    """
    folder = f"{shared_dir(spark)}/scratch-{uuid4().hex}"

    def store(df: DataFrame) -> DataFrame:
        path = f"{folder}/{uuid4().hex}"
        with freeing_shuffles(spark):
            df.write.option("compression", codec).option("parquet.enable.dictionary", str(dictionary).lower()).parquet(path)
        return spark.read.parquet(path)

    try:
        yield store
    finally:
        remove(spark, folder)


def small(df: DataFrame, max_bytes: int = 32 << 20, width: int | Column = 64) -> DataFrame:
    """Mark a materialised table for broadcast if its rows, of ``width`` bytes each, take at most max_bytes; else a shuffle joins it."""
    size = df.agg(F.sum(F.lit(width) if isinstance(width, int) else width).alias("n")).first()["n"]
    return F.broadcast(df) if (size or 0) <= max_bytes else df


def pieces(text: Column) -> Column:
    """Text cut at each white space character: its words and some empty strings. A one-character split needs no regex."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.split(text, " ")


def words(text: Column) -> Column:
    """Words between white space of any text, null as none; no empty strings."""
    return F.array_remove(pieces(F.coalesce(text, F.lit(""))), "")


def connected_components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(node, root) for every node of an edge table (a, b): root is the smallest node reachable.

    Alternating large-star and small-star rounds. Each round only takes minima by
    key and joins them back, so no neighbour list is held in one task; a hub's rows
    may be split by the skew join. Rounds grow with the logarithm of the longest path.
    """
    e = cut(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    seen = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = cut(
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        sign = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def fit_rows(docs: DataFrame, labels: DataFrame, label: str, mod: int, left_out: int, bound: int, seed: int = 11) -> DataFrame:
    """(text, y, u): at most about ``bound`` labelled documents outside the held-out remainder, chosen by a hash of their id.

    u in [0, 1) splits them further. The labels are cut to the bound before the texts are joined, so the broadcast is bounded.
    """
    use = labels.where(F.col(label).isNotNull() & (fold("doc_id", mod) != left_out)).groupBy("doc_id").agg(
        F.max(label).cast("int").alias("y")
    )
    share = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    kept = use.where(share < bound / max(1, use.count())).withColumn("u", F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(1000)) / 1000)
    return docs.select("doc_id", "text").join(F.broadcast(kept), "doc_id").select("text", "y", "u")


def fold(doc_id: str, mod: int) -> Column:
    """Remainder of the CRC-32 of the id as text; null ids fall in 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod, F.lit(0))
