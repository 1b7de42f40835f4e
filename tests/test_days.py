"""Logs by day: counts of random periods equal a scan, late rows count, purges drop folders and rewrite only the border day."""

import os
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from parlance.operators import audit
from parlance.sources import days

KIND = "id long, event_type string, timestamp timestamp_ntz"


def log(rng, n, at=datetime(2024, 1, 1)):
    rows = [(i, rng.choice(["a", "b", None]), at + timedelta(seconds=rng.randint(0, 20 * 86_400))) for i in range(n)]
    return [*rows, (n, "a", None), (n + 1, "b", datetime(2024, 1, 9)), (n + 2, "b", datetime(2024, 1, 9, 23, 59, 59, 999_999))]


def folders(path):
    return {d: sorted((f, os.stat(os.path.join(path, d, f)).st_mtime_ns) for f in os.listdir(os.path.join(path, d))) for d in os.listdir(path) if d.startswith("day=")}


def test_periods_equal_a_scan(spark, tmp_path):
    rng, path = random.Random(2), str(tmp_path / "log")
    rows = log(rng, 800)
    days.append(spark.createDataFrame(rows[:600], KIND), path, by=("event_type",))
    before = folders(f"{path}/counts")
    late = [(5000 + i, "late", datetime(2024, 1, 5, 3)) for i in range(7)]
    days.append(spark.createDataFrame(rows[600:], KIND), path, by=("event_type",))
    days.append(spark.createDataFrame(late, KIND), path, by=("event_type",))
    assert sum(before[d] != f for d, f in folders(f"{path}/counts").items() if d in before) >= 1
    df = spark.createDataFrame(rows + late, KIND)
    assert days.read(spark, path).count() == len(rows) + 7
    for _ in range(6):
        start = datetime(2024, 1, 1) + timedelta(seconds=rng.randint(-90_000, 20 * 86_400))
        end = start + timedelta(seconds=rng.choice([0, 100, 50_000, 400_000, 2_000_000]))
        want = audit.counts(audit.within(df, start, end), "event_type")
        assert sorted(map(str, days.counts(spark, path, start, end).collect())) == sorted(map(str, want.collect()))
        assert days.read(spark, path, start, end).count() == audit.within(df, start, end).count()
    plan = days.counts(spark, path, datetime(2024, 1, 3, 5), datetime(2024, 1, 9, 5))._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[.*day#\d+.* IN \(2024-01-03,2024-01-09\)", plan)


def test_purge_drops_days(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "log")
    rows = log(rng, 500)
    df = spark.createDataFrame(rows, KIND)
    days.append(df, path, by=("event_type",))
    limit = datetime(2024, 1, 9, 12)
    before = folders(f"{path}/rows")
    want = df.where(F.col("timestamp") < F.lit(limit).cast("timestamp_ntz")).count()
    assert days.purge(spark, path, limit, dry_run=True) == want and folders(f"{path}/rows") == before
    assert days.purge(spark, path, limit) == want
    after = folders(f"{path}/rows")
    assert min(d for d in after if d != "day=none") == "day=2024-01-09" and after["day=2024-01-09"] != before["day=2024-01-09"]
    assert all(after[d] == before[d] for d in after if d > "day=2024-01-09") and after["day=none"] == before["day=none"]
    assert sorted(r.id for r in days.read(spark, path).collect()) == sorted(r[0] for r in rows if r[2] is None or r[2] >= limit)
    assert days.purge(spark, path, limit) == 0
    end = datetime(2024, 2, 1)
    assert sum(r.n for r in days.counts(spark, path, datetime(2023, 1, 1), end).collect()) == sum(1 for r in rows if r[2] and r[2] >= limit)


def test_purge_of_three_logs_tells_once(spark, tmp_path):
    rows = log(random.Random(4), 200)
    df = spark.createDataFrame(rows, KIND)
    access = df.withColumn("retained_until", F.col("timestamp") + F.expr("interval 5 days"))
    paths = [str(tmp_path / x) for x in ("audit", "access", "decision")]
    for frame, path, column in ((df, paths[0], "timestamp"), (access, paths[1], "retained_until"), (df, paths[2], "timestamp")):
        days.append(frame, path, column, by=("event_type",))
    as_of = datetime(2024, 1, 21)
    want = audit.purge_counts(df, access, df, as_of, 8).first().asDict()
    assert days.purge_logs(spark, *paths, as_of, 8, dry_run=True) == want and days.purge_logs(spark, *paths, as_of, 8) == want
    assert days.purge_logs(spark, *paths, as_of, 8) == dict.fromkeys(want, 0)
    told = days.read(spark, paths[0]).where("event_type = 'purge_executed'").collect()
    assert len(told) == 1 and told[0].timestamp == as_of
    kept = audit.survivors(access, as_of, 8)
    assert sorted(r.id for r in days.read(spark, paths[1]).collect()) == sorted(r.id for r in kept.collect())
