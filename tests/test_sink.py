"""The sink writes each batch's rows once, also where a query is killed between its writes and the ledger."""

from pyspark.sql import functions as F

from parlance.operators import quality
from parlance.plans import turns as plan
from parlance.sources import adapters
from parlance.streaming import sink
from parlance.streaming import turns as stream

SF = "/root/testdata/sf0.001"


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def test_killed_query_writes_once(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    rows = adapters.turns(spark, SF).where("session_id < 48").cache()
    for part in range(2):
        rows.where(f"(turn <= 2) = ({part} = 0)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    responses = adapters.responses(spark, SF).cache()
    out, plain = str(tmp_path / "out"), sink.turn_tables(responses, adapters.AS_OF)
    killed = []

    def breaking(batch):
        found = plain(batch)
        if len(killed) < 2:  # the first table is written, then the query dies, twice
            killed.append(1)
            return {"interactions": found["interactions"], "decisions": found["decisions"].withColumn("x", F.raise_error(F.lit("killed")))}
        return found

    def start(tables):
        source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        return stream.replay(source).writeStream.outputMode("update").foreachBatch(sink.once(tables, out)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()

    for _ in range(2):
        try:
            start(breaking).awaitTermination(120)
            raise AssertionError("it should have died")
        except Exception as died:
            assert "killed" in str(died)
        assert sink.batches(spark, out).isEmpty() and sink.read(spark, out, "interactions").isEmpty()  # what it left is not seen
    assert start(breaking).awaitTermination(180)
    assert start(plain).awaitTermination(60)  # nothing new
    assert sink.batches(spark, out).count() == 2
    results = plan.results(rows)
    interactions, decisions = plan.audit_rows(results, rows, adapters.AS_OF)
    reviews = quality.review_rows(plan.quality_reports(results, responses), responses, adapters.AS_OF)
    assert rows_of(sink.read(spark, out, "interactions")) == rows_of(interactions)
    assert rows_of(sink.read(spark, out, "decisions")) == rows_of(decisions)
    assert rows_of(sink.read(spark, out, "reviews")) == rows_of(reviews) and not reviews.isEmpty()
    write = sink.once(plain, out)
    write(rows.limit(0).withColumns({c: F.lit(None).cast("string") for c in ("state", "language", *plan.extract.FIELDS)}), 0)  # a batch of the ledger is not written again
    assert rows_of(sink.read(spark, out, "interactions")) == rows_of(interactions)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
