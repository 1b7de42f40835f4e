"""Changes to keyed tables: the same rows as applying them one by one, and only touched buckets are read and written."""

import os
import random
import re

from parlance.sources import keyed

ROW = "id long, status string, n long"
CHANGE = "id long, seq long, op string, made_for long, status string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def one_by_one(state, changes):
    """The state and the outcomes after changes applied one by one."""
    state = {i: list(r) for i, r in state.items()}
    told, last = [], {}
    for i, seq, *_ in changes:
        last[i] = max(last.get(i, -1), seq)
    for change in changes:
        i, seq = change[:2]
        if seq != last[i]:
            told.append((i, seq, "superseded", None))
            continue
        _, seq, op, made_for, status = change
        row = state.get(i)
        there = row is not None and not row[3]
        version = row[2] if there else 0
        if made_for is not None and made_for != version:
            told.append((i, seq, "stale", version))
        elif not there and op != "set":
            told.append((i, seq, "missing", 0))
        else:
            old = row[2] if row else 0
            state[i] = [None, None, old + 1, True] if op == "delete" else [
                status if status is not None or not there else row[0], row[1] if there else None, old + 1, False]
            told.append((i, seq, "applied", old + 1))
    return state, told


def test_changes_equal_one_by_one(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["open", "done"]), i * 10) for i in range(500)] + [(None, "open", 1)]
    path = str(tmp_path / "t")
    keyed.create(spark.createDataFrame(rows, ROW), path, "id", buckets=16)
    state = {i: [s, n, 1, False] for i, s, n in rows}
    for _ in range(3):
        changes = [
            (rng.choice([*range(520), None, 3, 3, 4]), seq, rng.choice(["set", "set", "update", "delete"]), rng.choice([None, None, 0, 1, 2]), rng.choice([None, "new", f"s{seq}"]))
            for seq in range(60)
        ]
        want_state, want_told = one_by_one(state, changes)
        told = keyed.apply(spark.createDataFrame(changes, CHANGE), path).collect()
        assert sorted(map(str, map(tuple, told))) == sorted(map(str, want_told))
        got = {r.id: (r.status, r.n, r.version) for r in keyed.read(spark, path).collect()}
        assert got == {i: tuple(r[:3]) for i, r in want_state.items() if not r[3]}
        state = want_state
    some = spark.createDataFrame([(3,), (7,), (None,), (10_000,)], "id long")
    assert {r.id for r in keyed.read(spark, path, some).collect()} == {i for i in (3, 7, None) if i in state and not state[i][3]}


def test_only_touched_buckets_are_read_and_written(spark, tmp_path):
    path = str(tmp_path / "t")
    keyed.create(spark.range(2000).selectExpr("id", "'open' status", "id n"), path, "id", buckets=40)
    before = files(f"{path}/rows")
    changes = spark.range(0, 2000, 1000).selectExpr("id", "id seq", "'update' op", "1L made_for", "'done' status")
    plan = keyed.read(spark, path, changes)._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ IN \(\d+,\d+\)", plan)
    assert keyed.apply(changes, path).where("outcome = 'applied'").count() == 2
    after = files(f"{path}/rows")
    changed = {os.path.dirname(p) for p in set(before) ^ set(after)}
    assert len(changed) == 2 and all(after[p] == t for p, t in before.items() if os.path.dirname(p) not in changed)
    assert keyed.read(spark, path).where("status = 'done' and version = 2").count() == 2 and keyed.read(spark, path).count() == 2000
    assert [r.outcome for r in keyed.apply(changes, path).collect()] == ["stale", "stale"]
