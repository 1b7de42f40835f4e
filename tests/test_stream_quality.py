"""Figures kept over a stream equal those of the batch, however the rows are split; each change of status is told once."""

import random

from parlance.operators import quality
from parlance.streaming import quality as stream
from parlance.streaming import sink

KIND = "id long, session_id long, question_id string, isco_code string, confidence_score double"


def test_stream_equals_batch_for_random_splits(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.choice([1, 2, 3, 4, 5, None]), "q", rng.choice(["2512", "2512", "2512", "", None]), rng.choice([None, 0.1, 0.3, 0.59, 0.7, 0.9, 1 / 3, 0.6])) for i in range(60)]
    for name, cuts in (("a", [12, 30, 31]), ("b", [50])):
        rng.shuffle(rows)
        folder = tmp_path / name
        for part, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(rows)])):
            spark.createDataFrame(rows[lo:hi], KIND).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
        out = str(folder / "out")

        def start(write):
            return stream.figures(source).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start()

        def killed(batch, batch_id):
            stream.writer(out)(batch, batch_id) if batch_id == 0 else 1 / 0

        try:
            start(killed).awaitTermination(120)
        except Exception as died:
            assert "ZeroDivisionError" in str(died)
        assert start(stream.writer(out)).awaitTermination(180)
        assert sink.batches(spark, out).count() == len(cuts) + 1
        df = spark.createDataFrame(rows, KIND)
        want = quality.judged(quality.metrics(df)).select("session_id", *stream.FIGURES)
        got = stream.latest(spark, out).drop("batch")
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
        changes = {}
        for r in sink.read(spark, out, "changes").collect():
            changes.setdefault(r.session_id, []).append((r.old_status, r.new_status))
        for session, status in ((r.session_id, r.status) for r in want.collect()):
            steps = changes[session]
            olds, news = [a for a, _ in steps], [b for _, b in steps]
            assert sorted(map(str, [*olds, status])) == sorted(map(str, [None, *news]))  # each status that was left was entered, the last is the batch's
        escalated = {r.session_id for r in want.where("status = 'escalated'").collect()}
        assert {r.session_id for r in stream.queue(spark, out).collect()} == escalated
