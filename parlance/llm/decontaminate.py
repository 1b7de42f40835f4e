"""Benchmark decontamination by size-partitioned MinHash containment search; DataFrame functions only.

An item is its set of five-word shingles (an item of fewer words is one shingle of its own
length). Items are partitioned by the logarithm of their number of shingles. A partition asks for
``r`` sketch hits, more for larger items, and an item's sketch is its ``n - ceil(t n) + r``
smallest hashes: a document that holds a share ``t`` of the item's shingles lacks at most
``n - ceil(t n)``, so it holds ``r`` of the sketch and no match can be missed. Each partition has a bound,
its largest sketch hash; a document shingle probes only the partitions whose bound it does not exceed,
under a key of partition and hash. Candidates with their partition's number of hits are verified by
exact containment on the shingles' words. A long document is never compared as one set, so its
length does not dilute a match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared


def _at(words: Column, i: Column, k: int) -> list[Column]:
    return [F.get(words, i + j) for j in range(k)]


def _shingles(df: DataFrame, k: int, *keep: str) -> DataFrame:
    """A row for each run of k words of column ``w``: the kept columns, its hash h and its words s."""
    rows = df.where(F.size("w") >= k).select(*keep, "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("i"))
    words = _at(F.col("w"), F.col("i"), k)
    return rows.select(*keep, F.xxhash64(F.lit(k), *words).alias("h"), F.concat_ws(" ", *words).alias("s"))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def item_shingles(items: DataFrame, k: int = 5) -> DataFrame:
    """(item_id, k, n, h, s): the distinct shingles of each item, its shingle length and their number; wordless items have none."""
    w = items.select("item_id", shared.words(F.lower("text")).alias("w")).where("size(w) > 0")
    rows = _union([
        _shingles(w.where(F.least(F.size("w"), F.lit(k)) == j), j, "item_id").withColumn("k", F.lit(j)) for j in range(1, k + 1)
    ]).distinct()
    sizes = rows.groupBy(F.col("item_id").alias("_item")).agg(F.count("*").alias("n"))
    return rows.join(sizes, F.col("item_id").eqNullSafe(F.col("_item"))).select("item_id", "k", "n", "h", "s")


def part(n: Column) -> Column:
    """The size partition of an item of n shingles."""
    return F.floor(F.log2(n)).cast("int")


def hits_of(part: Column) -> Column:
    """Sketch hits that a partition asks for: an eighth of its smallest size, one at least."""
    return F.greatest(F.lit(1), F.floor(F.pow(F.lit(2.0), part) / 8))


def sketches(shingles: DataFrame, t: float) -> DataFrame:
    """(item_id, k, part, h): of each item the smallest hashes of which a match holds as many as its partition asks for."""
    p = part(F.col("n"))
    size = F.least(F.col("n"), F.col("n") - F.ceil(t * F.col("n") - 1e-9) + hits_of(p))
    return (
        shingles.groupBy("item_id", "k", "n").agg(F.sort_array(F.collect_set("h")).alias("all"))
        .select("item_id", "k", p.alias("part"), F.explode(F.slice("all", F.lit(1), size.cast("int"))).alias("h"))
    )


def probes(worded: DataFrame, sketch: DataFrame) -> DataFrame:
    """(doc_id, th, part, h): document shingles with each size partition whose bound they do not exceed; worded has the words in w."""
    bounds = sketch.groupBy("k", "part").agg(F.max("h").alias("top")).collect()  # at most k times the logarithm of the largest item
    out = []
    for j in sorted({b.k for b in bounds}):
        tops = sorted(((b.top, b.part) for b in bounds if b.k == j), reverse=True)
        near = _shingles(worded, j, "doc_id", "th").where(F.col("h") <= tops[0][0]).select("doc_id", "th", "h")
        within = F.array_compact(F.array(*[F.when(F.col("h") <= top, F.lit(p)) for top, p in tops]))
        out.append(near.select("doc_id", "th", F.explode(within).alias("part"), "h") if len(tops) > 1 else near.select("doc_id", "th", F.lit(tops[0][1]).alias("part"), "h"))
    return _union(out or [worded.where("false").select("doc_id", "th", F.lit(0).alias("part"), F.col("th").alias("h"))])


def contained(docs: DataFrame, items: DataFrame, t: float = 0.8, k: int = 5) -> DataFrame:
    """(doc_id, th, item_id, n_shingles, n_shared, containment) for each item of which a document holds a share t or more.

    Words are compared in lower case. th is a hash of the text, so that rows with equal ids
    but other texts stay apart; equal rows count once. Null and wordless texts match nothing.
    Items that share an id are one item with all their shingles. Extra columns are ignored. Empty tables give no row.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th"))
    whole = shared.cut(item_shingles(items.select("item_id", "text"), k))
    sketch = shared.cut(sketches(whole, t))
    ks = [r.k for r in whole.select("k").distinct().orderBy("k").collect()] or [k]
    worded = docs.select("doc_id", "th", shared.words(F.lower("text")).alias("w"))
    pairs = (
        probes(worded, sketch).join(shared.small(sketch.select("part", "h", "item_id")), ["part", "h"])
        .groupBy("doc_id", "th", "item_id", "part").agg(F.count_distinct("h").alias("hits")).where(F.col("hits") >= hits_of(F.col("part")))
    )
    pairs = shared.cut(pairs.select("doc_id", "th", "item_id").distinct())
    at = shared.small(shared.cut(pairs.select(F.col("doc_id").alias("d"), F.col("th").alias("t")).distinct()))
    some = docs.join(at, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")), "left_semi")
    worded = some.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", shared.words(F.lower("text")).alias("w"))
    exact = _union([_shingles(worded, j, "doc_id", "th").select("doc_id", "th", "s").withColumn("k", F.lit(j)) for j in ks])
    table = whole.select("item_id", "k", "n", "s")
    hits = exact.join(shared.small(table, width=F.octet_length("s") + 64), ["k", "s"]).groupBy("doc_id", "th", "item_id", "n").agg(F.count_distinct("s").alias("n_shared"))
    hits = hits.where(F.col("n_shared") >= t * F.col("n") - 1e-9)
    pairs = pairs.toDF("_d", "_t", "_i")
    same = F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("th") == F.col("_t")) & F.col("item_id").eqNullSafe(F.col("_i"))
    hits = hits.join(pairs, same, "left_semi")
    return hits.select(
        "doc_id", "th", "item_id", F.col("n").alias("n_shingles"), "n_shared", (F.col("n_shared") / F.col("n")).alias("containment")
    )


def decontaminate(docs: DataFrame, items: DataFrame, t: float = 0.8, k: int = 5) -> DataFrame:
    """docs without the rows that contain a benchmark item; all columns and other rows stay, null texts too."""
    bad = shared.cut(contained(docs, items, t, k).select(F.col("doc_id").alias("_d"), F.col("th").alias("_t")).distinct())
    own = docs.withColumn("_th", F.xxhash64("text"))
    bad = shared.small(bad)
    return own.join(bad, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t")), "left_anti").select(*docs.columns)
