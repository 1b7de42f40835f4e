"""SimHash near-duplicates by pivot distance tables.

A fingerprint is 64 majority bits over the XXH64 hashes of four-word shingles.
Every fingerprint gets a table of Hamming distances to fixed reference
fingerprints (the pivots), one row of distances for each block of bits. Distances
to a pivot never differ by more than the fingerprints themselves do, so

* two fingerprints that differ in at most ``d`` of 64 bits agree on all but ``d`` of
  ``m`` blocks; on those blocks their distances to every pivot are equal. The vector
  of these distances, for each choice of ``m - d`` blocks, is the key that candidates share;
* a candidate whose distances over all bits to some pivot differ by more than ``d``
  is discarded by that largest coordinate difference;
* survivors are verified by the exact Hamming distance.

No pair is lost. The number of blocks grows with the number of distinct
fingerprints, so that keys stay selective. Keys with many members are cut into
chunks and compared by pairs of chunks: a task never holds more than two chunks, and
hands on a star of each linked set instead of all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

CHUNK = 2048


def pivots(n: int = 12, seed: int = 20240229) -> list[int]:
    """Reference fingerprints as signed 64-bit integers, fixed by the seed."""
    return [int(x) for x in np.random.default_rng(seed).integers(-(2**63), 2**63 - 1, n, dtype=np.int64)]


def _bits(text: str | None, width: int) -> int:
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    width = min(width, len(found))
    line = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(found) - width + 1], ends[width - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 65_536):
        spans = zip(starts[at : at + 65_536].tolist(), ends[at : at + 65_536].tolist(), strict=True)
        h = np.array([xxh64_intdigest(line[s:e], 42) for s, e in spans], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, width: int = 4) -> Column:
    """64-bit SimHash of whole texts as a signed long; no words (or null): 0."""

    @F.pandas_udf(T.LongType())
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([_bits(t, width) for t in texts], dtype="int64")

    return simhash(text)


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _blocks(n: int) -> list[int]:
    """Masks of n runs of bits that cover all 64."""
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _keys(fp: Column, n_blocks: int, d: int, refs: list[int]) -> Column:
    """One key for each choice of n_blocks - d blocks: the distances to all pivots on these blocks. Written over arrays, as one term for each would make a huge plan."""
    masks = F.array(*[F.lit(_signed(sum(chosen))) for chosen in combinations(_blocks(n_blocks), n_blocks - d)])
    far = F.array(*[F.lit(p) for p in refs])

    def key(mask: Column, k: Column) -> Column:
        return F.xxhash64(k, F.transform(far, lambda p: F.bit_count(fp.bitwiseXOR(p).bitwiseAND(mask))))

    return F.transform(masks, key)


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n items with links a-b: each item's smallest linked item, by repeated minima."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _linker(d: int, refs: list[int]):
    far = np.array(refs, np.int64)

    def link(unit: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        table = np.bitwise_count((fp[:, None] ^ far[None, :]).view(np.uint64)).astype(np.int8)
        left, right, at, k = [], [], np.arange(len(fp)), 1
        while True:
            at = at[at + k < len(fp)]
            at = at[unit[at] == unit[at + k]]
            if not len(at):
                break
            near = at[np.abs(table[at] - table[at + k]).max(axis=1) <= d]
            near = near[np.bitwise_count((fp[near] ^ fp[near + k]).view(np.uint64)) <= d]
            left.append(near)
            right.append(near + k)
            k += 1
        a = np.concatenate([*left, np.empty(0, np.int64)]).astype(np.int64)
        b = np.concatenate([*right, np.empty(0, np.int64)]).astype(np.int64)
        root = _stars(len(fp), a, b)
        own = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[own], "b": fp[root[own]]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            unit = rest["unit"].to_numpy()
            if not len(unit):
                continue
            last = int(np.flatnonzero(unit != unit[-1])[-1]) + 1 if (unit != unit[-1]).any() else 0
            if last:
                yield link(unit[:last], rest["fp"].to_numpy()[:last])
                rest = rest.iloc[last:]
        if rest is not None and len(rest):
            yield link(rest["unit"].to_numpy(), rest["fp"].to_numpy())

    return run


def links(fps: DataFrame, d: int = 4, chunk: int = CHUNK, n_pivots: int = 12) -> DataFrame:
    """(a, b) edges over a table of distinct fingerprints ``fp`` whose components are those of all pairs within d bits."""
    refs = pivots(n_pivots)
    n = fps.count()
    blocks = d + 2 if n <= 2**22 else d + 3 if n <= 2**28 else d + 4
    rows = fps.select("fp", F.explode(_keys(F.col("fp"), blocks, d, refs)).alias("key"))
    many = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    units = (
        rows.join(many, "key")
        .withColumn("chunks", F.ceil(F.col("n") / chunk))
        .withColumn("i", F.pmod(F.xxhash64("fp", F.lit(7)), "chunks"))
        .select("fp", "key", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("j"))
        .select("fp", F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("unit"))
    )
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        units.repartition(parts, "unit").sortWithinPartitions("unit")
        .mapInPandas(_linker(d, refs), "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", d: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs, at most d differing bits linking two documents.

    Null or wordless texts have fingerprint zero and link like any other. Equal rows
    share a fingerprint and a class. Rows with a null id stay; the class id is the
    smallest id that is not null, or null if there is none. An empty table gives none.
    """
    got = shared.cut(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), width).alias("fp")))
    fps = got.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = shared.connected_components(links(fps.select("fp"), d))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = rooted.join(lows, "root").select("fp", "component_id")
    return got.join(classes, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", d: int = 6, width: int = 5) -> DataFrame:
    """docs with one row of each near-duplicate class, by default at most 6 bits apart over five-word shingles: that with the smallest id, nulls last.

    Of several rows of a class with that id the one with the smallest hash of the text, then of the row, stays; rows that are equal
    as a whole are one. A row is found again by id and hashes, so rows that share an id but not a class do not touch each other.
    """
    cols = docs.columns
    whole = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    marks = {"_i": F.col(doc_id), "_t": F.xxhash64(text), "_r": F.xxhash64(*whole)}
    own = docs.select("*", *[v.alias(k) for k, v in marks.items()])
    got = shared.cut(own.select(*marks, fingerprint(F.col(text), width).alias("fp")))
    rows = got.groupBy("fp", *marks).agg(F.count("*").alias("_n"))
    best = F.min(F.struct(F.col("_i").isNull().alias("none"), *marks, "_n"))
    fps = shared.cut(rows.groupBy("fp").agg(best.alias("x")))
    found = shared.connected_components(links(fps.select("fp"), d))
    rooted = fps.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = shared.cut(rooted.groupBy("root").agg(F.min("x").alias("x")).select(*[F.col(f"x.{c}").alias(f"_{c}") for c in (*marks, "_n")]))
    same = F.col("_i").eqNullSafe(F.col("__i")) & (F.col("_t") == F.col("__t")) & (F.col("_r") == F.col("__r"))
    out = own.join(kept.where("__n = 1"), same, "left_semi")
    again = kept.where("__n > 1")
    if again.limit(1).count():
        out = out.unionByName(own.join(again, same, "left_semi").dropDuplicates(list(marks)))
    return out.select(*cols)
