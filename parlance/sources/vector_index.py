"""A stored vector index: inverted lists as files partitioned by list, filled once, probed list by list.

``vectors`` holds unit vectors in a folder for each list and ``centres``, written last, one row for
each list: its centre, its radius and its size. An index is filled if it has centres, so a fill that was
broken off is done anew. A search reads only the folders of lists that it probes. The exact search first probes the
nearest lists of each query, whose k-th best similarity then shows which other lists may still hold a better
item: no item of a list is nearer than the distance to its centre less its radius.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import providers

#: Most lists of one vector length, vectors that the centres are fitted on, vectors of a part of a list and queries that meet it at a time.
LISTS, SAMPLE, PART = 4096, 50_000, 4096
#: Bytes of query vectors that a task hands on at a time, each query once for each list it may probe.
ROOM = 16 << 20
CENTRES = "list int, centre array<double>, radius double, n long, parts int"
#: Confidences have four places, so items within half of the last place may tie.
PLACES = 4


def unit(x: Column) -> Column:
    """The vector as doubles of length one; null for one that is null, empty or zero, or has null or non-finite parts."""
    x = x.cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)

    def scaled(top: Column) -> Column:
        near = F.transform(x, lambda v: v / top)  # no square over- or underflows
        norm = F.sqrt(F.aggregate(near, F.lit(0.0), lambda s, v: s + v * v))
        return F.transform(F.array(norm), lambda n: F.transform(near, lambda v: v / n))[0]

    return F.when(sound, F.transform(F.array(F.array_max(F.transform(x, F.abs))), scaled)[0])


def filled(spark: SparkSession, path: str) -> bool:
    """Whether an index stands at the path."""
    try:
        return not spark.read.parquet(f"{path}/centres").isEmpty()
    except AnalysisException:
        return False


def size(spark: SparkSession, path: str) -> int:
    """Exact number of items in the index, from its list sizes."""
    return spark.read.parquet(f"{path}/centres").agg(F.sum("n")).first()[0] or 0


def rebuild(items: DataFrame, path: str, lists: int | None = None, seed: int = 5) -> None:
    """Write the index anew from items (item_id, code, embedding). Items without a direction are left out; each vector length has lists of its own."""
    spark = items.sparkSession
    raw = f"{path}/items"
    items.select("item_id", "code", unit(F.col("embedding")).alias("x")).where("x is not null").write.mode("overwrite").parquet(raw)
    rows = spark.read.parquet(raw)
    placed, first = None, 0
    for dim, total in sorted(rows.groupBy(F.size("x")).count().collect()):
        some = rows.where(F.size("x") == dim)
        wanted = lists or int(np.clip(np.sqrt(total) / 2, 1, LISTS))
        if wanted > 1:
            vectors = some.withColumn("v", array_to_vector("x"))
            model = KMeans(k=wanted, initMode="random", maxIter=4, seed=seed, featuresCol="v", predictionCol="list").fit(
                vectors.where(F.pmod(F.xxhash64("x", F.lit(seed)), F.lit(total)) < SAMPLE).select("v"))
            some, found = model.transform(vectors).drop("v"), len(model.clusterCenters())
        else:
            some, found = some.withColumn("list", F.lit(0)), 1
        some = some.withColumn("list", (F.col("list") + first).cast("int"))
        placed, first = some if placed is None else placed.unionByName(some), first + found
    if placed is None:
        spark.createDataFrame([], CENTRES).write.mode("overwrite").parquet(f"{path}/centres")
        return
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / PART).alias("parts"))
    placed = placed.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("x", "item_id"), F.col("parts")).cast("int")).drop("parts")
    placed.repartition("list", "part").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    stored = spark.read.parquet(f"{path}/vectors")
    centre = stored.groupBy("list").agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("centre"))
    gap = F.zip_with("x", "centre", lambda a, b: (a - b) * (a - b))
    far = F.sqrt(F.aggregate(gap, F.lit(0.0), lambda s, v: s + v))
    about = stored.join(centre, "list").groupBy("list").agg(
        F.first("centre").alias("centre"), F.max(far).alias("radius"), F.count("*").alias("n"), (F.max("part") + 1).alias("parts"))
    about.write.mode("overwrite").parquet(f"{path}/centres")


def ensure(items: DataFrame, path: str, **options) -> str:
    """Fill the index only if there is none, and give its path."""
    if not filled(items.sparkSession, path):
        rebuild(items, path, **options)
    return path


def populate(entries: DataFrame, path: str, embedder: providers.Embedder) -> str:
    """Fill an empty index from entries (code, title_en, title_ar, description): their texts are embedded in batches and ids are stable hashes of codes.

    Where the index is filled the embedder isn't called.
    """
    from ..functions.script import stable_id

    if filled(entries.sparkSession, path):
        return path
    text = providers.embedding_text(F.col("title_en"), F.col("title_ar"), F.col("description"))
    rebuild(providers.embed(entries.select(stable_id(F.col("code")).alias("item_id"), "code", text.alias("text")), F.col("text"), embedder), path)
    return path


def _ranked(k: int, at: np.ndarray, near: np.ndarray, code: np.ndarray, item: np.ndarray) -> np.ndarray:
    """Places of the k rows of each ``at`` with the largest rounded similarity, ties by code and item."""
    order = np.lexsort((item, code, -np.floor(near * 10**PLACES + 0.5), at))
    start = np.r_[0, np.flatnonzero(np.diff(at[order])) + 1]
    nth = np.arange(len(order)) - np.repeat(start, np.diff(np.r_[start, len(order)]))
    return order[nth < k]


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _met(k: int):
    """Queries and one part of a list to the k best items of each query."""

    def run(queries: pa.Table, items: pa.Table) -> pa.Table:
        out = {"query_id": [], "item_id": [], "code": [], "near": []}
        if len(queries) and len(items):
            q, x = _matrix(queries.column("x")), _matrix(items.column("x"))
            codes = items.column("code").to_pandas().fillna("").to_numpy(dtype=object)
            names, rank = np.unique(codes, return_inverse=True)
            ids = items.column("item_id").to_numpy()
            for s in range(0, len(q), 256):
                near = np.clip(q[s : s + 256] @ x.T, 0, 1)
                least = np.partition(near, -k, axis=1)[:, -k] if len(x) > k else np.zeros(len(near))
                i, j = np.nonzero(near >= least[:, None] - 10.0**-PLACES)
                best = _ranked(k, i, near[i, j], rank[j], ids[j])
                i, j = i[best], j[best]
                out["query_id"].append(queries.column("query_id").to_numpy()[i + s])
                out["item_id"].append(ids[j])
                out["code"].append(codes[j])
                out["near"].append(near[i, j])
        kinds = {"query_id": pa.int64(), "item_id": pa.int64(), "code": pa.string(), "near": pa.float64()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], kinds[c]) for c, v in out.items()})

    return run


def _probes(about: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], first: int | None):
    """Queries to the lists that they probe: the ``first`` nearest, or those beyond them that may hold an item as near as ``least``."""

    squares = {dim: (centres**2).sum(1) for dim, (_, centres, _) in about.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.list_value_length(b.column("x")).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes).tolist():
                if dim not in about:
                    continue
                lists, centres, radius = about[dim]
                every = np.flatnonzero(sizes == dim)
                step = max(1, ROOM // centres.nbytes)  # a query may go out once for each list
                for s in range(0, len(every), step):
                    rows = every[s : s + step]
                    q = _matrix(b.column("x").take(pa.array(rows)))
                    far = np.sqrt(np.maximum(0, (q**2).sum(1)[:, None] + squares[dim] - 2 * q @ centres.T))
                    turn = np.argsort(np.argsort(far, axis=1, kind="stable"), axis=1)
                    if first is not None:
                        i, j = np.nonzero(turn < first)
                    else:
                        least = b.column("least").to_numpy(zero_copy_only=False)[rows]
                        top = 1 - np.maximum(0, far - radius) ** 2 / 2
                        may = (top >= least[:, None] - 10.0**-PLACES - 1e-9) | (least[:, None] <= 0)  # what points away has confidence 0 too
                        i, j = np.nonzero((turn >= 1) & may)
                    at = pa.array(rows[i])
                    yield pa.RecordBatch.from_arrays(
                        [b.column("query_id").take(at), b.column("x").take(at), pa.array(lists[j].astype("int32"))], names=["query_id", "x", "list"])

    return run


def _scan(asked: DataFrame, path: str, k: int) -> DataFrame:
    """Each query with the parts of the lists it probes; only their folders are read."""
    spark = asked.sparkSession
    per = [(r["list"], -(-r["count"] // PART)) for r in asked.groupBy("list").count().collect()]  # at most the number of lists
    items = spark.read.parquet(f"{path}/vectors").where(F.col("list").isin([r[0] for r in per]) if per else F.lit(False))
    about = F.broadcast(spark.read.parquet(f"{path}/centres").select("list", "parts"))  # a row for each list
    per = spark.createDataFrame(per, "list int, blocks long")
    asked = asked.join(F.broadcast(per), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks")
    asked = asked.join(about, "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1))).drop("parts")
    items = items.join(F.broadcast(per), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    by = ["list", "part", "block"]
    return asked.groupBy(*by).cogroup(items.groupBy(*by)).applyInArrow(_met(k), "query_id long, item_id long, code string, near double")


def search(queries: DataFrame, path: str, k: int = 5, probes: int | None = None) -> DataFrame:
    """(query_id, code, item_id, confidence, rank): the k items of the index at ``path`` most similar to each of queries (query_id, embedding).

    Confidence is the cosine cut to 0..1, to four places; ties go by code and item. Without ``probes`` the result is exact; with
    it only so many nearest lists of each query are read. Queries without a direction, or of a length the index lacks, find nothing.
    """
    spark = queries.sparkSession
    about: dict[int, tuple] = {}
    for r in spark.read.parquet(f"{path}/centres").collect():  # at most LISTS rows for each vector length
        about.setdefault(len(r["centre"]), []).append((r["list"], r["centre"], r["radius"], r["n"]))
    if not about:
        return spark.createDataFrame([], "query_id long, code string, item_id long, confidence double, rank int")
    about = {dim: tuple(np.array(v) for v in zip(*sorted(rows), strict=True)) for dim, rows in about.items()}
    maps = {dim: a[:3] for dim, a in about.items()}
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), unit(F.col("embedding")).alias("x")).where("x is not null")
    kind = "query_id long, x array<double>, list int"
    best = Window.partitionBy("query_id").orderBy(F.desc("confidence"), "code", "item_id")

    def top(found: DataFrame) -> DataFrame:
        return found.withColumn("confidence", F.round("near", PLACES)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    near = top(_scan(rows.mapInArrow(_probes(maps, probes or 1), kind), path, k))
    if not probes:
        least = near.where(F.col("rank") == k).select("query_id", F.col("confidence").alias("least"))
        more = rows.join(least, "query_id", "left").select("query_id", "x", F.coalesce("least", F.lit(-1.0)).alias("least"))
        rest = _scan(more.mapInArrow(_probes(maps, None), kind), path, k)
        near = top(near.drop("confidence", "rank").unionByName(rest))
    return near.select("query_id", "code", "item_id", "confidence", "rank")
