"""Replies are asked for once, failures again, and no stage's failure touches another."""

from pyspark.sql import functions as F

from parlance.sources import requests
from parlance.sources.requests import Enrichment


def provider(log, fails=()):
    def reply(texts):
        import uuid

        (log / uuid.uuid4().hex).write_text("\n".join(texts))
        if any(t in fails for t in texts):
            raise RuntimeError("down")
        return [t.upper() for t in texts]

    return reply


def asked(log):
    return sorted(t for p in log.iterdir() for t in p.read_text().split("\n"))


def test_repeated_texts_ask_once_and_failures_again(spark, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "store")
    log.mkdir()
    rows = [(i, ["a", "b", "c", None, ""][i % 5], i % 7 != 0) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, text string, open boolean").repartition(3)
    stage = {"reply": Enrichment(F.col("text"), F.col("open"), provider(log), "none")}
    for _ in range(2):
        got = {r.id: r.reply for r in requests.enriched(df, path, stage).collect()}
        assert got == {i: t.upper() if t is not None and o else "none" for i, t, o in rows}
    assert asked(log) == ["", "a", "b", "c"]
    new = spark.createDataFrame([(1, "d", True), (2, "a", True)], df.schema).coalesce(1)
    for attempt in range(5):  # three attempts, then no more
        out = requests.enriched(new, path, {"reply": Enrichment(F.col("text"), F.col("open"), provider(log, {"d"}), "none")})
        assert {r.id: r.reply for r in out.collect()} == {1: "none", 2: "A"}
    assert asked(log).count("d") == 3 and asked(log).count("a") == 1
    assert {tuple(r) for r in requests.stored(spark, path, "reply").select("reply", "attempts").collect()} >= {(None, 3), ("A", 1)}
    more = requests.enriched(new, path, {"reply": Enrichment(F.col("text"), F.col("open"), provider(log), "none")}, most=4)
    assert {r.id: r.reply for r in more.collect()} == {1: "D", 2: "A"}


def test_stages_fail_alone(spark, tmp_path):
    log = tmp_path / "calls"
    log.mkdir()
    df = spark.createDataFrame([(1, "x"), (2, "y")], "id long, text string")
    on = F.lit(True)
    stages = {
        "entities": Enrichment(F.col("text"), on, provider(log, {"x", "y"}), "[]"), "emotion": Enrichment(F.col("text"), on, provider(log), "neutral"),
        "verdict": Enrichment(F.col("text"), on, None, '{"ok": true}'), "code": Enrichment(F.col("text"), F.lit(None).cast("boolean"), provider(log), ""),
    }
    got = {r.id: tuple(r)[2:] for r in requests.enriched(df, str(tmp_path / "store"), stages).collect()}
    assert got == {1: ("[]", "X", '{"ok": true}', ""), 2: ("[]", "Y", '{"ok": true}', "")}
    empty = requests.enriched(df.limit(0), str(tmp_path / "other"), stages)
    assert empty.count() == 0 and empty.columns == ["id", "text", *stages]
