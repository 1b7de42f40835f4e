"""The stored index: filled once, rebuilt, exact by list bounds, read list by list, recall when few lists are probed."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.operators import occupation
from parlance.sources import tables, vector_index


def cosine(a, b):
    a, b = ([x / max(map(abs, v)) for x in v] for v in (a, b))
    return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5


def best(rows, q, k):
    """Places to four digits, ties by code and item."""
    sound = [r for r in rows if r[2] and len(r[2]) == len(q) and None not in r[2] and any(r[2]) and all(abs(x) < 1e300 for x in r[2])]
    order = sorted(sound, key=lambda r: (-round(min(1.0, max(0.0, cosine(q, r[2]))), 4), r[1] or "", r[0]))
    return [r[0] for r in order[:k]]


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    rng = random.Random(9)
    heads = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(30)]
    rows = [(i, str(i % 7), [x + rng.gauss(0, 0.15) for x in heads[i % 30]]) for i in range(3000)]
    rows += [(4000 + i, "9", list(rows[5][2])) for i in range(40)]  # ties
    rows += [(5000, "x", None), (5001, "x", []), (5002, "x", [0.0] * 12), (5003, "x", [None] + [1.0] * 11), (5004, "x", [float("inf")] + [1.0] * 11), (5005, None, [1e200] * 12)]
    rows += [(6000, "two", [1.0, 0.0]), (6001, "two", [0.6, 0.8])]
    df = spark.createDataFrame(rows, "item_id long, code string, embedding array<double>")
    path = str(tmp_path_factory.mktemp("index") / "i")
    assert vector_index.ensure(df, path, lists=25) == path
    return rows, path


def test_exact_search_equals_brute_force(spark, clustered):
    rows, path = clustered
    asked = [(1, rows[5][2]), (2, rows[100][2]), (3, [-x for x in rows[0][2]]), (4, [0.5] * 12), (5, None), (6, [0.0] * 12), (7, [1.0, 0.1]), (8, [1.0, 2.0, 3.0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = {}
    for r in vector_index.search(queries, path, 6).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.item_id)
    assert got == {q: best(rows, x, 6) for q, x in asked if q in (1, 2, 3, 4, 7)}
    assert vector_index.size(spark, path) == 3043
    assert vector_index.search(queries.where("query_id in (5, 6, 8)"), path, 6).count() == 0


def test_plan_reads_only_probed_lists(spark, clustered):
    rows, path = clustered
    queries = spark.createDataFrame([(1, rows[5][2])], "query_id long, embedding array<double>")
    plan = vector_index.search(queries, path, 5, probes=1)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert re.search(r"PartitionFilters: \[list#\d+ IN \(\d+\)\]|PartitionFilters: \[.*list#\d+ = \d+", plan)
    both = vector_index.search(queries, path, 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in both and "NestedLoop" not in both


def test_recall_of_few_lists(spark, clustered):
    rows, path = clustered
    queries = spark.createDataFrame([(r[0], r[2]) for r in rows[:3000:50]], "query_id long, embedding array<double>")
    got = vector_index.search(queries, path, 10, probes=3).groupBy("query_id").agg(F.collect_set("item_id").alias("ids")).collect()
    hits = sum(len(set(r.ids) & set(best(rows, rows[r.query_id][2], 10))) for r in got)
    assert hits >= 0.9 * 10 * 60


def test_filled_once_and_rebuilt(spark, tmp_path):
    path = str(tmp_path / "i")
    kind = "item_id long, code string, embedding array<double>"
    one, two = spark.createDataFrame([(1, "a", [1.0, 0.0])], kind), spark.createDataFrame([(2, "b", [1.0, 0.0]), (3, "c", [0.0, 1.0])], kind)
    assert not vector_index.filled(spark, path)
    vector_index.ensure(one, path)
    vector_index.ensure(two, path)
    assert vector_index.size(spark, path) == 1
    vector_index.rebuild(two, path)
    assert vector_index.size(spark, path) == 2
    asked = spark.createDataFrame([(9, [1.0, 0.1])], "query_id long, embedding array<double>")
    assert [r.item_id for r in occupation.top_k(asked, path, 5).orderBy("rank").collect()] == [2, 3]
    # a fill that broke off before the centres were written counts as none
    spark.createDataFrame([], "list int, centre array<double>, radius double, n long, parts long").write.mode("overwrite").parquet(f"{path}/centres")
    vector_index.ensure(one, path)
    assert vector_index.size(spark, path) == 1
    vector_index.rebuild(spark.createDataFrame([], kind), path)
    assert not vector_index.filled(spark, path) and occupation.top_k(asked, path, 5).count() == 0


def test_population_embeds_in_batches_once(spark, tmp_path):
    path, log = str(tmp_path / "i"), tmp_path / "calls"
    log.mkdir()

    def embedder(texts):
        import uuid

        assert len(texts) <= 64 and all(t.startswith("passage: ") for t in texts)
        (log / uuid.uuid4().hex).write_text(str(len(texts)))
        return [[float(len(t)), float(sum(map(ord, t)) % 97), 1.0] for t in texts]

    entries = tables.occupations(spark).coalesce(1)
    vector_index.populate(entries, path, embedder)
    calls = sorted(int(p.read_text()) for p in log.iterdir())
    assert sum(calls) == 124 and calls == [60, 64] and vector_index.size(spark, path) == 124
    vector_index.populate(entries, path, lambda texts: 1 / 0)
    ids = {r.item_id for r in spark.read.parquet(f"{path}/vectors").where("code = '2512'").collect()}
    assert ids == {171025987359200099}


def test_probing_hands_on_bounded_batches():
    rng = np.random.default_rng(3)
    q, centres = rng.normal(size=(1500, 32)), rng.normal(size=(500, 32))
    x = pa.FixedSizeListArray.from_arrays(pa.array(q.ravel()), 32).cast(pa.list_(pa.float64()))
    asked = pa.RecordBatch.from_arrays([pa.array(range(1500)), x, pa.array(np.full(1500, -1.0))], names=["query_id", "x", "least"])
    about = {32: (np.arange(500), centres, np.full(500, 1.0))}
    met = [0, 0]
    for b in vector_index._probes(about, None)(iter([asked])):
        assert b.nbytes <= 18 << 20  # ROOM and the ids
        met[0] += b.num_rows
        assert (b.column("x").flatten().to_numpy().reshape(-1, 32) == q[b.column("query_id").to_numpy()]).all()
    near = [b for b in vector_index._probes(about, 3)(iter([asked]))]
    met[1] = sum(b.num_rows for b in near)
    assert met == [1500 * 499, 1500 * 3]
    far = ((q[:, None] - centres) ** 2).sum(2)
    wanted = {(i, int(j)) for i in range(1500) for j in np.argsort(far[i])[:3]}
    assert {(i, j) for b in near for i, j in zip(b.column("query_id").to_pylist(), b.column("list").to_pylist())} == wanted
