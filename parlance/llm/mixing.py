"""Mixing overlapping sources to target weights by min-cost flow.

Documents are aggregated by membership pattern (the set of sources that hold them), and
only the patterns' word totals reach the driver. A flow routes words from each pattern to
the sources of its set: a pattern gives its own size once for nothing and again at a rising
cost for each repetition, and a source takes its target. The flow's total for a pattern
tells how often its documents are taken; what is left of a whole repetition is a seeded
choice of documents: hash buckets are summed, and only the bucket in which the quota ends
is ordered, so no task orders a whole source. What is then missing or too much is lessened by
moving the document in or out whose size is nearest to it, up to three times.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

BUCKETS = 1 << 14
#: Rounds in which a document may still be moved in or out of the choice.
FILLS = 3
#: Cost of a word's first, second and third copy.
COSTS = (0, 1, 3)


def ranked_weights(sources: list[str | None]) -> dict[str | None, float]:
    """5, 2, 1, repeating, over sources in code point order with null last."""
    ordered = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    return {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(ordered)}


def capped_targets(sizes: dict, weights: dict, total: float, cap: float = 3) -> dict:
    """Shares of total by weight; none above cap times its size, the excess shared again by weight."""
    fixed, free = {}, list(weights)
    while free:
        left, sum_w = total - math.fsum(fixed.values()), math.fsum(weights[s] for s in free)
        over = [s for s in free if left * weights[s] / sum_w > cap * sizes[s]]
        if not over:
            return fixed | {s: left * weights[s] / sum_w for s in free}
        fixed |= {s: float(cap * sizes[s]) for s in over}
        free = [s for s in free if s not in fixed]
    return fixed


def min_cost_flow(supply: dict[str, int], members: dict[str, list], demand: dict, costs: tuple[int, ...] = COSTS) -> dict[tuple, int]:
    """Words from each pattern to each of its sources, (pattern, source) -> words, by successive cheapest paths."""
    arcs: list[list] = []  # to, capacity, cost; the reverse arc is at the index xor 1
    out: dict = {}

    def add(a, b, cap: int, cost: int) -> int:
        for x, y, c, w in ((a, b, cap, cost), (b, a, 0, -cost)):
            out.setdefault(x, []).append(len(arcs))
            arcs.append([y, c, w])
        return len(arcs) - 2

    for p, size in supply.items():
        for cost in costs:
            add("from", ("p", p), size, cost)
    route = {(p, s): add(("p", p), ("s", s), sum(demand.values()) + 1, 0) for p in supply for s in members[p]}
    for s, need in demand.items():
        add(("s", s), "to", need, 0)
    while True:
        best, via, queue = {"from": 0}, {}, deque(["from"])
        while queue:
            a = queue.popleft()
            for k in out.get(a, ()):
                b, cap, cost = arcs[k]
                if cap > 0 and best[a] + cost < best.get(b, math.inf):
                    best[b], via[b] = best[a] + cost, k
                    queue.append(b)
        if "to" not in best:
            return {r: arcs[k ^ 1][1] for r, k in route.items() if arcs[k ^ 1][1]}
        path, at = [], "to"
        while at != "from":
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        push = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= push
            arcs[k ^ 1][1] += push


def word_count(text: Column) -> Column:
    return F.size(shared.words(text)).cast("long")


def mix(
    docs: DataFrame,
    sources: Column,
    weights: Callable[[list], dict] = ranked_weights,
    share: float = 1.0,
    max_copies: int = 3,
    seed: int = 17,
    max_patterns: int = 200_000,
) -> tuple[DataFrame, dict, dict, dict]:
    """Words to take of each document so that each source comes near its target.

    sources is an array column, the sources that hold the document; null entries are a
    source of their own. Returns a row for each row of docs (doc_id, size, pattern, copies, taken),
    the sources' sizes and targets, and the flow. Null and wordless texts have size 0 and are
    taken 0 words. Equal rows count one by one, so some of them may be taken once more than others. Extra columns are
    ignored, whatever their names. An empty table gives no row. There may be at most
    ``max_patterns`` sets of sources; more raise an error, none is dropped.
    """
    spark = docs.sparkSession
    pattern = F.to_json(F.struct(F.array_sort(F.array_distinct(sources)).alias("s")), {"ignoreNullFields": "false"})
    rows = shared.cut(
        docs.select("doc_id", word_count(F.col("text")).alias("size"), pattern.alias("pattern"), sources.alias("sources"),
                    F.xxhash64(F.lit(seed), "doc_id", "text").alias("u"))
    )
    found = rows.groupBy("pattern").agg(F.sum("size").alias("size"), F.first("sources").alias("sources")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} sets of sources")
    supply = {r.pattern: int(r["size"]) for r in sorted(found, key=lambda r: r.pattern)}
    members = {r.pattern: list(dict.fromkeys(r.sources)) for r in found}
    sizes: dict = {}
    for p, n in supply.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    w = weights(list(sizes))
    targets = capped_targets(sizes, w, share * sum(supply.values()), max_copies)
    flow = min_cost_flow(supply, members, {s: round(t) for s, t in targets.items()}, COSTS[:max_copies])
    totals = {p: sum(flow.get((p, s), 0) for s in members[p]) for p in supply}
    quota = spark.createDataFrame(
        [(p, totals[p] // n if n else 0, totals[p] % n if n else 0) for p, n in supply.items()],
        T.StructType([T.StructField("pattern", T.StringType()), T.StructField("whole", T.LongType()), T.StructField("part", T.LongType())]),
    )
    # Equal rows are one with their number m, so a move can take some of them and a hot one is one row.
    rows = rows.groupBy("pattern", "u", "doc_id", "size").agg(F.count("*").alias("m"))
    rows = rows.join(F.broadcast(quota), "pattern").withColumn("bucket", F.pmod("u", F.lit(BUCKETS)))
    chosen = _choose(rows).withColumn("nth", F.explode(F.sequence(F.lit(1).cast("long"), "m")))
    chosen = chosen.withColumn("extra", F.when(F.col("nth") <= F.col("extra"), 1).otherwise(0))
    copies = F.least(F.col("whole") + F.col("extra"), F.lit(max_copies))  # a row without words may be chosen beyond
    return (
        chosen.select("doc_id", "size", "pattern", copies.alias("copies"), (copies * F.col("size")).alias("taken")),
        sizes, targets, flow,
    )


def _choose(rows: DataFrame) -> DataFrame:
    """rows with extra, 0 to m: a seeded choice of documents whose sizes add up to about ``part`` in each pattern."""
    from pyspark.sql import Window

    rows = rows.withColumn("all", F.col("size") * F.col("m"))
    sums = rows.groupBy("pattern", "bucket", "part").agg(F.sum("all").alias("n"))
    before = F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")
    edge = (
        sums.withColumn("before", before).where("before <= part").groupBy("pattern")
        .agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("e"))
        .select("pattern", F.col("e.bucket").alias("last"), F.col("e.before").alias("before"))
    )
    rows = rows.join(F.broadcast(edge), "pattern")  # a row for each pattern, whose number mix() has bounded
    inside = rows.where("bucket < last").withColumn("extra", F.col("m"))
    outside = rows.where("bucket > last").withColumn("extra", F.lit(0).cast("long"))
    cum = F.sum("all").over(Window.partitionBy("pattern").orderBy("u", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0))
    room = F.col("part") - F.col("before") - F.col("cum") + F.col("all")
    fit = F.when(F.col("size") > 0, F.floor(room / F.col("size"))).when(room >= 0, F.col("m")).otherwise(0)
    at = rows.where("bucket = last").withColumn("cum", cum).withColumn("extra", F.greatest(F.lit(0), F.least("m", fit)).cast("long")).drop("cum")
    out = shared.cut(inside.unionByName(at).unionByName(outside).drop("last", "before", "bucket", "all"))
    # Each round moves rows of one document of each pattern in or out, those that leave the least gap, if that is less than now.
    same = (F.col("u") == F.col("fill_u")) & F.col("doc_id").eqNullSafe(F.col("fill_id")) & (F.col("size") == F.col("fill_size"))
    for _ in range(FILLS):
        took = out.groupBy("pattern", "part").agg(F.sum(F.col("size") * F.col("extra")).alias("took"))
        gap = took.select("pattern", (F.col("part") - F.col("took")).alias("gap"))
        wanted = F.round(F.col("gap") / F.col("size")).cast("long")
        moves = out.where("size > 0").join(F.broadcast(gap), "pattern").withColumn("move", F.greatest(-F.col("extra"), F.least(F.col("m") - F.col("extra"), wanted)))
        fits = moves.withColumn("left", F.abs(F.col("gap") - F.col("move") * F.col("size"))).where(F.col("left") < F.abs("gap"))
        fill = fits.groupBy("pattern").agg(F.min(F.struct("left", "u", "doc_id", "size", "move")).alias("f"))
        fill = fill.select("pattern", F.col("f.u").alias("fill_u"), F.col("f.doc_id").alias("fill_id"), F.col("f.size").alias("fill_size"), F.col("f.move").alias("move"))
        moved = F.col("extra") + F.when(same, F.col("move")).otherwise(0)
        out = shared.cut(out.join(F.broadcast(fill), "pattern", "left").withColumn("extra", moved).drop("fill_u", "fill_id", "fill_size", "move"))
    return out


def by_source(docs: DataFrame, seed: int = 17) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies): documents of one source each, mixed to weights 5, 2, 1, repeating."""
    taken, sizes, targets, _ = mix(docs.select("doc_id", "text", "source"), F.array("source"), seed=seed)
    return _with_targets(taken, sizes, targets)


def _with_targets(taken: DataFrame, sizes: dict, targets: dict) -> DataFrame:
    spark = taken.sparkSession
    table = spark.createDataFrame(
        [(s, int(sizes[s]), float(targets[s])) for s in sizes], "source string, source_size long, target double"
    )
    key = F.to_json(F.struct(F.array("source").alias("s")), {"ignoreNullFields": "false"})
    table = table.select(key.alias("pattern"), "source_size", "target")
    return taken.join(F.broadcast(table), "pattern").select("doc_id", "size", "source_size", "target", "taken", "copies")
