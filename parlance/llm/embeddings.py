"""Embedding near-duplicates by product quantisation.

A coarse quantiser (k-means, fitted on a bounded sample) puts every unit vector in an
inverted list; its residual is coded by the nearest of 16 centroids in each subspace. A
vector probes each list whose border with its own list lies within ``margin`` of it. Within
a probed list distances to the codes come from look-up tables (asymmetric: the query is not
coded); since each vector keeps its distance to its own code, the triangle inequality tells
which codes may stand for a vector within reach, and those are reranked by exact cosine in
double precision. Lists are kept apart by label and cut into chunks, so a task compares two
bounded chunks. Equal vectors collapse to one first. Vectors of each length have quantisers of their own;
those of rare lengths lie in one list for each label and are compared by cosine directly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

CHUNK = 2048
#: Up to so many vectors of one length are compared without quantisers, unless no length has more.
RARE = 4096


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = x[near == c].mean(axis=0)
    return centres


def fit(sample: np.ndarray, n_lists: int, parts: int = 8, codes: int = 16, seed: int = 5) -> dict:
    """Coarse centroids and one codebook of residuals for each subspace."""
    rng = np.random.default_rng(seed)
    coarse = _kmeans(sample, n_lists, 8, rng)
    rest = sample - coarse[np.argmin((coarse**2).sum(1) - 2 * sample @ coarse.T, axis=1)]
    cuts = np.array_split(np.arange(sample.shape[1]), min(parts, sample.shape[1]))
    return {"coarse": coarse, "cuts": cuts, "books": [_kmeans(rest[:, c], codes, 8, rng) for c in cuts]}


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long lists as one matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(model: dict, margin: float):
    """Rows of unit vectors to rows (vector, list, role): its own list, and as a query each list that it probes."""
    coarse = model["coarse"]
    gap = 2 * np.sqrt(np.maximum(((coarse[:, None] - coarse[None]) ** 2).sum(-1), 1e-12))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("unit"))
            d2 = (coarse**2).sum(1)[None] - 2 * x @ coarse.T
            own = d2.argmin(axis=1)
            border = (d2 - d2[np.arange(len(x)), own][:, None]) / gap[own]
            border[np.arange(len(x)), own] = 0
            q, lists = np.nonzero(border <= margin)
            at = pa.array(np.concatenate([np.arange(len(x)), q]))
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(at), b.column("label").take(at), b.column("unit").take(at),
                 pa.array(np.concatenate([own, lists]).astype("int32")), pa.array(np.repeat([False, True], [len(x), len(q)]))],
                names=["key", "label", "unit", "list", "query"],
            )

    return run


def _search(models: dict[int, dict], cosine: float):
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-9
    none = np.empty(0, np.int64)

    def direct(x: np.ndarray, q: np.ndarray, ka: np.ndarray, kb: np.ndarray) -> pa.Table:
        a, b = [none], [none]
        for s in range(0, len(q), 256):
            i, j = np.nonzero(q[s : s + 256] @ x.T >= cosine - 1e-9)
            near = (ka[i + s] != kb[j]) & ((q[i + s] * x[j]).sum(1) >= cosine)
            a.append(ka[i[near] + s])
            b.append(kb[j[near]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    def link(table: pa.Table) -> pa.Table:
        query = table.column("query").combine_chunks().to_numpy(zero_copy_only=False)
        keys, vectors = table.column("key").to_numpy(), _matrix(table.column("unit"))
        x, q, ka, kb = vectors[~query], vectors[query], keys[query], keys[~query]
        model = models.get(vectors.shape[1])
        if model is None or not len(x) or not len(q):
            return direct(x, q, ka, kb)
        coarse, cuts, books = model["coarse"], model["cuts"], model["books"]
        centre = coarse[table.column("list")[0].as_py()]
        rest, own = x - centre, q - centre
        codes = np.zeros((len(books), len(x)), np.int64)
        spare = np.zeros(len(x))
        for m, (c, book) in enumerate(zip(cuts, books, strict=True)):
            codes[m] = np.argmin((book**2).sum(1) - 2 * rest[:, c] @ book.T, axis=1)
            spare += ((rest[:, c] - book[codes[m]]) ** 2).sum(1)
        most = (reach + np.sqrt(spare)) ** 2 + 1e-12
        a, b = [], []
        for s in range(0, len(q), 256):  # look-up tables of 256 queries at a time
            far = np.zeros((len(q[s : s + 256]), len(x)))
            for m, (c, book) in enumerate(zip(cuts, books, strict=True)):
                part = own[s : s + 256, c]
                far += ((part**2).sum(1)[:, None] + (book**2).sum(1) - 2 * part @ book.T)[:, codes[m]]
            i, j = np.nonzero(far <= most)
            keep = ka[i + s] != kb[j]
            i, j = i[keep] + s, j[keep]
            for t in range(0, len(i), 100_000):
                near = (q[i[t : t + 100_000]] * x[j[t : t + 100_000]]).sum(1) >= cosine
                a.append(ka[i[t : t + 100_000]][near])
                b.append(kb[j[t : t + 100_000]][near])
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return link


def _unit(v) -> np.ndarray | None:
    x = np.array([] if v is None else v, dtype=float)  # None becomes NaN
    top = np.abs(x).max(initial=0.0)
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top  # no overflow or underflow of squares
    return x / np.sqrt((x * x).sum())


def _units(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, unit): vectors as doubles of length one; unit is null for those that link with nothing."""

    @F.pandas_udf("array<double>")
    def unit(values: pd.Series) -> pd.Series:
        return pd.Series([_unit(v) for v in values], dtype=object)

    return vectors.select("vec_id", "label", F.when(F.col("label").isNotNull(), unit("embedding")).alias("unit"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, sample: int = 20_000, margin: float | None = None, chunk: int = CHUNK, seed: int = 5) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: vectors of one label linked by a cosine of at least ``cosine``.

    The quantisers are fitted on at most about ``sample`` vectors; all are indexed and all are queries. A list is
    probed if its border is within ``margin`` of the vector, by default half the reach: of two vectors within reach one is as near
    to the border of their lists, and each pair is met from both sides, so none is lost. Each length has its own lists. Vectors that
    are null, zero, or with null or non-finite parts, or without a label, link with nothing. Equal rows of one label link with each other. A null vec_id has no class of its
    own and takes the smallest id of its class that is not null. Labels may be of any type that can be hashed, vectors are told apart
    by two hashes. Extra columns are ignored, whatever their names. An empty table gives no row.
    """
    rows = shared.cut(_units(vectors).withColumns({"k1": F.xxhash64("label", "unit"), "k2": F.xxhash64(F.lit(1), "unit", "label")}))
    good = rows.where("unit is not null")
    dims = {r["dim"]: r["count"] for r in good.groupBy(F.size("unit").alias("dim")).count().collect()}
    if not dims:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    common = max(dims, key=lambda dim: (dims[dim], -dim))
    distinct = shared.cut(
        good.groupBy("k1", "k2").agg(
            F.xxhash64(F.first("label")).alias("label"), F.first("unit").alias("unit"), F.count("*").alias("n"), F.min("vec_id").alias("low")
        ).withColumn("key", F.monotonically_increasing_id())
    )
    share = F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    reach = float(np.sqrt(max(0.0, 2 - 2 * cosine)))
    margin = reach / 2 + 1e-9 if margin is None else margin
    models, size = {}, F.size("unit")
    own = distinct.select("key", "label", "unit")
    rare = own.where(~size.isin([dim for dim, n in dims.items() if dim == common or n > RARE]))
    roles = F.explode(F.array(F.lit(False), F.lit(True))).alias("query")
    placed = rare.select("key", "label", "unit", F.lit(0).alias("list"), roles)
    for dim, total in dims.items():
        if dim == common or total > RARE:
            some = distinct.where(size == dim)
            got = np.array(some.where(share < sample / total).orderBy("k1", "k2").select("unit").toPandas()["unit"].tolist() or
                           some.limit(1).select("unit").toPandas()["unit"].tolist())
            models[dim] = fit(got, int(np.clip(np.sqrt(total) / 8, 1, sample // 10)))
            placed = placed.unionByName(own.where(size == dim).mapInArrow(
                _assign(models[dim], margin), "key long, label long, unit array<double>, list int, query boolean"
            ))
    placed = placed.withColumn("dim", size)
    placed = shared.cut(placed)
    counts = placed.groupBy("dim", "label", "list").agg(F.count_if(~F.col("query")).alias("bn"), F.count_if("query").alias("qn"))
    cells = placed.join(shared.small(shared.cut(counts.where("bn > 0 and qn > 0"))), ["dim", "label", "list"])
    cells = (
        cells.withColumn("bc", F.ceil(F.col("bn") / chunk)).withColumn("qc", F.ceil(F.col("qn") / chunk))
        .withColumn("own", F.pmod(F.xxhash64("key"), F.when(F.col("query"), F.col("qc")).otherwise(F.col("bc"))))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.when(F.col("query"), F.col("bc")).otherwise(F.col("qc")) - 1)))
        .select("key", "unit", "list", "dim", "label", "query", F.when(F.col("query"), F.col("other")).otherwise(F.col("own")).alias("i"),
                F.when(F.col("query"), F.col("own")).otherwise(F.col("other")).alias("j"))
    )
    found = cells.groupBy("dim", "label", "list", "i", "j").applyInArrow(_search(models, cosine), "a long, b long")
    links = shared.cut(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mass = distinct.select(F.col("key").alias("b"), F.col("n").alias("m"))
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.join(mass, "b").groupBy(F.col("a").alias("key")).agg(F.sum("m").alias("linked"))
    roots = shared.connected_components(links).withColumnRenamed("node", "key")
    classes = distinct.join(degree, "key", "left").join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    classes = shared.cut(classes.select("k1", "k2", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "root", "low"))
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lows, "root").select("k1", "k2", "n_links", "component_id")
    out = rows.select("vec_id", *[F.when(F.col("unit").isNotNull(), F.col(k)).alias(k) for k in ("k1", "k2")]).join(classes, ["k1", "k2"], "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
