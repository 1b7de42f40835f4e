"""Approximate nearest neighbours by an adaptive dimension scan.

Vectors lie in inverted lists of a coarse quantiser (k-means, fitted on a bounded sample).
A query probes the lists whose centroids have the largest inner products with it. Vectors
are turned by a random rotation, after which any few dimensions are a fair sample of all.
Within a list a block of columns is read for all candidates at a time: the squared distance
over d of D dimensions, times D / d, estimates the whole one, and a candidate is abandoned
once that exceeds ``(1 + eps / sqrt(d))^2`` times the largest squared distance at which it
would still enter the result. For an inner product of tau that distance is |q|^2 + |x|^2 - 2 tau,
so the test serves inner products of vectors of any norm. The first list of a query is read whole
and gives its tau; the others are scanned against it. What survives all columns is scored on
the original vectors in double precision.

Lists are cut into chunks, and each chunk of candidates meets each chunk of queries in a task of its own.
Equal vectors are one candidate with their smallest ids and one query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .embeddings import _kmeans, _matrix

CHUNK = 2048
#: Most lists of one vector length; the sample holds twenty vectors for each, half to fit the lists and half to find how many to probe.
LISTS = 4096


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def surviving(q: np.ndarray, x: np.ndarray, tau: np.ndarray, eps: float, block: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Pairs (i, j) of rotated rows that no test abandons, and how many pairs were left after each block of columns."""
    dim = q.shape[1]
    qq, xx = (q * q).sum(1), (x * x).sum(1)
    room = qq[:, None] + xx[None] - 2 * tau[:, None]
    slack = 1e-9 * (qq.max() + xx.max())
    d = min(block, dim)

    def within(part: np.ndarray, room: np.ndarray) -> np.ndarray:
        return part * (dim / d) <= (1 if d == dim else (1 + eps / np.sqrt(d)) ** 2) * room + slack

    part = (q[:, :d] ** 2).sum(1)[:, None] + (x[:, :d] ** 2).sum(1)[None] - 2 * q[:, :d] @ x[:, :d].T
    i, j = np.nonzero(within(part, room))
    part, room, left = part[i, j], room[i, j], [len(i)]
    while d < dim:
        last, d = d, min(d + block, dim)
        part = part + ((q[i, last:d] - x[j, last:d]) ** 2).sum(1)
        keep = within(part, room)
        i, j, part, room = i[keep], j[keep], part[keep], room[keep]
        left.append(len(i))
    return i, j, left


def _scores(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of pairs, summed in the order of the dimensions."""
    total = np.zeros(len(i))
    for a, b in zip(q.T, x.T, strict=True):
        total += a[i] * b[j]
    return total


def _best(k: int, at: np.ndarray, score: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Positions of the k rows of each ``at`` that have the largest score, ties to the smallest ``low``."""
    order = np.lexsort((low, -score, at))
    at = at[order]
    start = np.r_[0, np.flatnonzero(at[1:] != at[:-1]) + 1] if len(at) else np.empty(0, int)
    place = np.arange(len(at)) - np.repeat(start, np.diff(np.r_[start, len(at)]))
    return order[place < k]


def _scan(k: int, eps: float, block: int, seed: int):
    """For a chunk of queries and one of candidates: rows (q, vec_id, score, own), the k best of each query."""

    def run(queries: pa.Table, found: pa.Table) -> pa.Table:
        out = {"q": [np.empty(0, np.int64)], "vec_id": [np.empty(0, np.int64)], "score": [np.empty(0)], "own": [np.empty(0, bool)]}
        if len(queries) and len(found):
            q, x = _matrix(queries.column("x")), _matrix(found.column("x"))
            keys, mine = queries.column("key").to_numpy(), found.column("key").to_numpy()
            ids = found.column("ids").combine_chunks()
            sizes, flat = np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()
            first = np.cumsum(sizes) - sizes
            tau = np.array(queries.column("tau").to_pandas(), dtype=float)
            turn = rotation(q.shape[1], seed)
            qt, xt = q @ turn, x @ turn
            for s in range(0, len(q), 256):
                part = slice(s, s + 256)
                if np.isnan(tau[part]).all():  # the first list: all pairs, those that may be among the k best exactly
                    ip = q[part] @ x.T
                    least = np.partition(ip, -k, axis=1)[:, -k] if len(x) > k else np.full(len(ip), -np.inf)
                    i, j = np.nonzero(ip >= (least - 1e-9 * (1 + np.abs(ip).max(axis=1)))[:, None])
                else:
                    i, j, _ = surviving(qt[part], xt, np.where(np.isnan(tau[part]), -np.inf, tau[part]), eps, block)
                score = _scores(q[part], x, i, j)
                top = _best(k, i, score, flat[first[j]])
                i, j, score = i[top] + s, j[top], score[top]
                n = sizes[j]
                which = np.repeat(np.arange(len(j)), n)
                vec = flat[np.repeat(first[j] - np.cumsum(n) + n, n) + np.arange(n.sum())]
                top = _best(k, i[which], score[which], vec)
                which, vec = which[top], vec[top]
                for name, values in (("q", keys[i[which]]), ("vec_id", vec), ("score", score[which]), ("own", keys[i[which]] == mine[j[which]])):
                    out[name].append(values)
        return pa.table({name: np.concatenate(values) for name, values in out.items()})

    return run


def _placed(centres: np.ndarray, probes: int):
    """Rows (key, x, ids, asks) to rows with list and turn: turn -1 in the list they lie in, and 0, 1, ... in those that a query probes."""

    def run(batches):
        half = (centres**2).sum(1) / 2
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("x"))
            ip = x @ centres.T
            own = np.argmax(ip - half, axis=1)
            asks = np.flatnonzero(b.column("asks").to_numpy(zero_copy_only=False))
            near = np.argsort(-ip[asks], axis=1, kind="stable")[:, :probes]
            at = pa.array(np.concatenate([np.arange(len(x)), np.repeat(asks, near.shape[1])]))
            turn = np.concatenate([np.full(len(x), -1), np.tile(np.arange(near.shape[1]), len(asks))])
            yield pa.RecordBatch.from_arrays(
                [b.column("key").take(at), b.column("x").take(at), b.column("ids").take(at),
                 pa.array(np.concatenate([own, near.ravel()]).astype("int32")), pa.array(turn.astype("int32"))],
                names=["key", "x", "ids", "list", "turn"],
            )

    return run


def probes_for(sample: np.ndarray, centres: np.ndarray, k: int, recall: float, seed: int) -> int:
    """Lists to probe so that a share of ``recall`` of the nearest k of the sample, over some 500 queries of it, lie in them."""
    rng = np.random.default_rng(seed)
    asks = rng.choice(len(sample), min(500, len(sample)), replace=False)
    own = np.argmax(sample @ centres.T - (centres**2).sum(1) / 2, axis=1)
    ip = sample[asks] @ sample.T
    ip[np.arange(len(asks)), asks] = -np.inf
    near = np.argsort(-ip, axis=1)[:, : max(1, min(k, len(sample) - 1))]
    turn = np.argsort(np.argsort(-(sample[asks] @ centres.T), axis=1, kind="stable"), axis=1)
    return int(np.quantile(np.take_along_axis(turn, own[near], axis=1), recall, method="higher")) + 1


def _cells(queries: DataFrame, found: DataFrame, sizes: DataFrame, chunk: int, scan) -> DataFrame:
    """Each chunk of a list's queries with each chunk of its candidates."""
    counts = queries.groupBy("dim", "list").agg(F.count("*").alias("qn")).join(sizes, ["dim", "list"])
    counts = shared.small(shared.cut(counts.select("dim", "list", F.ceil(F.col("qn") / chunk).alias("qc"), F.ceil(F.col("bn") / chunk).alias("bc"))))
    salt = F.xxhash64("key", F.lit(3))

    def spread(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(counts, ["dim", "list"]).withColumn(own, F.pmod(salt, F.col(own))).withColumn(
            other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))
        )

    by = ["dim", "list", "qc", "bc"]
    left, right = spread(queries, "qc", "bc"), spread(found.toDF(*found.columns), "bc", "qc")
    right = right.toDF(*right.columns)  # columns of its own: both sides come from one table
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(scan, "q long, vec_id long, score double, own boolean")


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, recall: float = 0.95, probes: int | None = None, eps: float = 2.1, block: int = 16, chunk: int = CHUNK, seed: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the k others with the largest inner product.

    All rows are candidates. Quantisers are fitted on a sample of at most about twenty vectors for each of at most ``LISTS`` lists, for each
    vector length; vectors of different lengths have no inner product and never meet. Each query probes ``probes`` lists, by default as many
    as hold a share ``recall`` of the neighbours within the sample, whose neighbours are farther than those among all rows; neighbours in
    other lists are missed (README: recall against brute force). ``eps`` sets how surely a candidate must be too far before it is abandoned.
    Scores are exact, in double precision on the vectors as given; ties go to the smaller vec_id. Vectors that are null, empty, zero or
    hold null or non-finite parts take no part, nor do rows without a vec_id. Rows that repeat both id and vector count once; rows that
    share an id but not a vector are rows of their own, and a query may then find its own id. A query whose lists hold too few
    candidates reads the other lists too, so it gets k or all there are. Extra columns are ignored, whatever their names. An empty table gives no row.
    """
    x = F.col("embedding").cast("array<double>")
    sound = F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.where(F.col("vec_id").isNotNull() & sound).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    rows = shared.cut(rows.withColumns({"k1": F.xxhash64("x"), "k2": F.xxhash64(F.lit(1), "x")}))
    asking = rows.where(F.col("vec_id") % every == 0).select("k1", "k2", "vec_id").distinct()
    first = F.dense_rank().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))
    distinct = rows.withColumn("nth", first).where(F.col("nth") <= k + 1).groupBy("k1", "k2").agg(
        F.first("x").alias("x"), F.array_sort(F.collect_set("vec_id")).alias("ids")
    )
    asks = asking.select("k1", "k2").distinct().withColumn("asks", F.lit(True))
    distinct = distinct.join(asks, ["k1", "k2"], "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    distinct = shared.cut(distinct.withColumn("key", F.monotonically_increasing_id()))
    placed = None
    for dim, total in distinct.groupBy(F.size("x").alias("dim")).count().collect():
        some = distinct.where(F.size("x") == dim)
        lists = int(np.clip(np.sqrt(total), 1, LISTS))
        share = F.pmod(F.xxhash64("k1", F.lit(seed)), F.lit(1_000_000)) / 1_000_000
        fitted = some.where(share < 20 * lists / total).orderBy("k1", "k2").select("x").toArrow().column("x")
        centres, asked = np.zeros((1, dim)), 1
        if len(fitted):
            sample = _matrix(fitted)
            centres = _kmeans(sample[::2], lists, 8, np.random.default_rng(seed))
            asked = probes or probes_for(sample[1::2] if len(sample) > 1 else sample, centres, round(k * len(sample) / 2 / total), recall, seed)
        part = some.select("key", "x", "ids", "asks").mapInArrow(_placed(centres, asked), "key long, x array<double>, ids array<long>, list int, turn int")
        part = part.withColumn("dim", F.lit(dim))
        placed = part if placed is None else placed.unionByName(part)
    kind = "query_id long, rank int, vec_id long, score double"
    if placed is None:
        return vectors.sparkSession.createDataFrame([], kind)
    placed = shared.cut(placed)
    found = placed.where("turn = -1").drop("turn")
    sizes = found.groupBy("dim", "list").agg(F.count("*").alias("bn"))
    scan = _scan(k + 1, eps, block, seed)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")

    def kept(df: DataFrame) -> DataFrame:
        return df.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)

    queries = placed.where("turn >= 0").select("key", "x", "dim", "list", "turn")
    near = shared.cut(kept(_cells(queries.where("turn = 0").withColumn("tau", F.lit(None).cast("double")), found, sizes, chunk, scan)))
    tau = near.where(F.col("nth") == k + 1).select(F.col("q").alias("key"), F.col("score").alias("tau"))
    rest = _cells(queries.where("turn > 0").join(tau, "key", "left"), found, sizes, chunk, scan)
    top = shared.cut(kept(near.drop("nth").unionByName(rest)).drop("nth"))
    # Where the probed lists held too few rows, the other lists are read as well.
    held = top.groupBy(F.col("q").alias("key")).agg(F.count("*").alias("n"))
    short = queries.where("turn = 0").join(held, "key", "left").where(F.coalesce("n", F.lit(0)) < k + 1).select("key", "x", "dim")
    short = short.join(shared.small(shared.cut(sizes.select("dim", "list"))), "dim").join(queries.select("key", "list"), ["key", "list"], "left_anti")
    short = shared.cut(short)
    if not short.isEmpty():
        top = top.unionByName(_cells(short.withColumn("tau", F.lit(None).cast("double")), found, sizes, chunk, scan))
    top = kept(top).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id", "own", "score"))).alias("top")
    )
    other = F.slice(F.filter("top", lambda c: ~(c["own"] & (c["vec_id"] == F.col("query_id")))), 1, k)
    keys = distinct.where("asks").select("k1", "k2", F.col("key").alias("q"))
    each = asking.withColumnRenamed("vec_id", "query_id").join(keys, ["k1", "k2"]).join(top, "q")
    out = each.select("query_id", F.posexplode(other).alias("at", "c"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.vec_id").alias("vec_id"), F.col("c.score").alias("score"))
