"""Streams with keyed state equal the batches: the interview's machine and the session store; long sessions are replayed in blocks."""

import json
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from parlance.operators import memory
from parlance.plans import machine

from parlance.plans import turns as plan
from parlance.sources import adapters
from parlance.streaming import memory as store
from parlance.streaming import turns as stream


@pytest.fixture
def no_empty_batches(spark):
    """Else a query with timers goes on to look for expired keys and never ends."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    yield
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def run(stream_, name, checkpoint):
    q = stream_.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    assert q.awaitTermination(180)


def test_stream_equals_batch(spark, tmp_path, no_empty_batches):
    rows = adapters.turns(spark, "/root/testdata/sf0.001")
    for part in (0, 1):  # two files, in the order of turns
        keep = rows.where(f"turn {'<=' if part == 0 else '>'} 2")
        keep.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    run(stream.replay(source), "replayed", tmp_path / "cp")
    cols = ["session_id", "turn", "state", "language", "employment_status", "job_title", "industry", "hours_per_week", "employment_type"]
    got = sorted(map(str, spark.table("replayed").select(*cols).collect()))
    want = sorted(map(str, plan.replay(plan.features(rows), restart=True).select(*cols).collect()))
    assert got == want and len(got) > 20


def test_stream_goes_on_from_a_batch(spark, tmp_path, no_empty_batches):
    rows = adapters.turns(spark, "/root/testdata/sf0.001")
    old = plan.final(plan.features(rows.where("turn <= 2")))
    rows.where("turn > 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    run(stream.replay(source, initial=stream.places(old)), "went_on", tmp_path / "cp")
    want = plan.replay(plan.features(rows), restart=True).where("turn > 2")
    assert sorted(map(str, spark.table("went_on").drop("text").collect())) == sorted(map(str, want.collect()))


def folded(turns, language="en", restart=False):
    """The machine written out, turn by turn."""
    state, lang, fields, out = "greeting", language, {}, []
    for t in turns:
        if restart and state == "completing":
            state, lang, fields = "greeting", "en", {}
        lang = t["detected"] if t["detected"] in ("en", "ar") else lang
        if state in ("collecting_info", "clarifying"):
            fields = {f: fields.get(f) or t[f] for f in machine.FIELDS}
        full = all(fields.get(f) for f in machine.FIELDS)
        if state in ("greeting", "clarifying"):
            state = "collecting_info"
        elif state == "collecting_info":
            state = "clarifying" if t["ambiguous"] else "validating" if full else state
        elif state == "validating":
            state = "completing" if t["confirmed_" + ("ar" if lang == "ar" else "en")] else "collecting_info"
        out.append((state, lang, *[fields.get(f) for f in machine.FIELDS]))
    return out


def test_long_sessions_are_replayed_in_blocks(spark):
    rng = random.Random(1)
    turns = {}
    for session, n in ((1, 100_000), (2, 300), (3, 5), (None, 40)):
        turns[session] = [
            {"turn": i, **{f: rng.choice([None] * 6 + [f"{f}{i}"]) for f in machine.FIELDS}, "ambiguous": rng.random() < 0.2,
             "confirmed_en": rng.random() < 0.3, "confirmed_ar": rng.random() < 0.3, "detected": rng.choice(["en", "ar", "other", "other"])}
            for i in range(n)
        ]
    kind = "session_id long, turn long, " + ", ".join(f"{f} string" for f in machine.FIELDS) + ", ambiguous boolean, confirmed_en boolean, confirmed_ar boolean, detected string"
    feats = spark.createDataFrame([(s, *t.values()) for s, ts in turns.items() for t in ts], kind)
    for language, restart, size in (("en", True, 1024), ("ar", False, 8), ("en", True, 8)):
        some = feats if size > 8 else feats.where("session_id <> 1 or session_id is null")
        got = {}
        for r in plan.replay(some, language=language, restart=restart, size=size).collect():
            got.setdefault(r.session_id, {})[r.turn] = tuple(r)[2:]
        assert got == {s: dict(enumerate(folded(ts, language, restart))) for s, ts in turns.items() if size > 8 or s != 1}
    ends = {r.session_id: tuple(r)[1:] for r in plan.final(feats).collect()}
    assert ends == {s: (len(ts), *folded(ts)[-1]) for s, ts in turns.items()}


CHANGE = "session_id long, seq long, at timestamp_ntz, op string, language string, state string, fields string, role string, content string"


def changes(rng, n):
    at, out = datetime(2024, 1, 1), []
    for seq in range(n):
        session, op = rng.randint(1, 8), rng.choice(["save", "append", "append", "append", "update", "update", "delete"])
        fields = json.dumps({rng.choice("abc"): rng.choice(["", "x", "é y", str(seq)]) for _ in range(2)}) if op in ("save", "update") else None
        out.append((session, seq, at + timedelta(seconds=seq), op, rng.choice(["en", "ar"]), rng.choice(machine.STATES) if op == "save" else None, fields,
                    rng.choice(["user", "assistant"]) if op == "append" else None, f"said {seq}" if op == "append" else None))
    return out


def last_of(rows):
    """The last row of each session that is present."""
    ends = {}
    for r in sorted(rows, key=lambda r: r.seq):
        ends[r.session_id] = r
    return {s: r for s, r in ends.items() if r.present}


def test_streamed_store_equals_the_batch(spark, tmp_path, no_empty_batches):
    rows = changes(random.Random(5), 300)
    df = spark.createDataFrame(rows, CHANGE)
    for part in range(3):
        df.where(f"seq div 100 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    early = memory.applied(df.where("seq < 100"))
    for name, begun, since in (("store_all", None, 0), ("store_on", early, 100)):
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).where(f"seq >= {since}")
        run(store.store(source, initial=begun), name, tmp_path / name)
        got = last_of(r for r in spark.table(name).collect() if r.seq is not None)
        want = {r.session_id: r for r in memory.applied(df).collect()}
        touched = {r[0] for r in rows if r[1] >= since}
        assert set(got) == set(want) & touched and len(got) > 3
        for s, r in got.items():
            w = want[s]
            assert (r.language, r.state, r.fields, r.turn_count, r.created_at, r.last_updated) == (w.language, w.state, w.fields, w.turn_count, w.created_at, w.last_updated)
            assert r.n_history == len(json.loads(w.history))
    found = store.stored(spark, str(tmp_path / "store_all"))
    assert found.select("key.session_id").distinct().count() == len(memory.applied(df).collect())


def test_sessions_expire(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, datetime(2024, 1, 1), "append", "en", None, None, "user", "hello")], CHANGE)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = store.store(source, ttl_seconds=2).writeStream.outputMode("update").format("memory").queryName("expiring").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("expiring").where("op = 'expired'").isEmpty():
            time.sleep(0.5)
        rows = {r.op: r for r in spark.table("expiring").collect()}
        assert rows["append"].present and rows["append"].turn_count == 1 and rows["append"].state == "greeting" and not rows["expired"].present
    finally:
        q.stop()


def test_appending_makes_a_stub(spark):
    now, then = datetime(2024, 1, 5), datetime(2024, 1, 1)
    sessions = spark.createDataFrame([(1, "validating", then, then)], "session_id long, state string, created_at timestamp_ntz, last_updated timestamp_ntz")
    turns = spark.createDataFrame([(1, 0, "hi")], "session_id long, turn long, text string")
    new = spark.createDataFrame([(1, 1, "more"), (2, 0, "who?")], "session_id long, turn long, text string")
    after, log = memory.append_turn(sessions, turns, new, now)
    assert sorted(map(tuple, after.collect())) == [(1, "validating", then, now), (2, "greeting", now, now)] and log.count() == 3
