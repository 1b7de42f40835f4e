"""Driver tables in the shapes of the engine's inputs; each rule is also stated in SQL in the catalogue."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read, spread

AS_OF = datetime(2024, 1, 31)
WINDOW = (datetime(2024, 1, 10), datetime(2024, 1, 20))
RETENTION_DAYS = 15
ACCESS = {"view": "read", "click": "write", "purchase": "export", "signup": "anonymize", "error": "delete"}

#: Text seeds by id % 16, appended to the stored text.
SEEDS: dict[int, str] = {
    0: "", 1: " I am stressed and overwhelmed", 2: " لا أفهم ???", 3: " enough!!! THIS SURVEY WRONG", 4: " of course, happy to help",
    5: " أنا software engineer في البنك", 6: " I am employed full time 40 hours as a nurse in a hospital", 7: " yes",
    8: "أنا مهندس", 9: "12345 !!", 10: "أنا software engineer في البنك", 11: "I am anxious", 12: "I don't understand, I am confused",
    13: "this is annoying", 14: "40 hours", 15: "ok!!!",
}
#: Interview scripts by conversation % 4 and position of the user's turn; later turns say the last line.
SCRIPTS: dict[int, list[str]] = {
    0: ["hello there", "I am employed full time 40 hours as a nurse in a hospital", "yes that is right", "thanks again"],
    1: ["good morning", "ok", "I am a software engineer", "I am working part-time 20 hrs", "let us continue"],
    2: ["hi and welcome", "I am a self-employed teacher at a school for 30 hours", "no, I want to change that", "it is 50 hours now"],
    3: ["مرحبا بكم", "أنا موظف دوام كامل 40 ساعة مهندس في البنك", "نعم صحيح", "شكرا لكم جميعا"],
}


def logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Audit, access and decision logs from events."""
    e = read(spark, sf_dir, "events")
    session = F.get_json_object("props", "$.k").cast("bigint")
    audit = e.select(F.col("event_id").alias("id"), session.alias("session_id"), "user_id", "event_type", F.col("ts").alias("timestamp"))
    kind = F.create_map(*[F.lit(x) for kv in ACCESS.items() for x in kv])
    access = e.select(F.col("event_id").alias("id"), "user_id", F.try_element_at(kind, F.col("event_type")).alias("access_type"), F.col("ts").alias("timestamp"),
                      (F.col("ts") + F.expr("interval 15 days")).alias("retained_until"))
    decision = e.select(F.col("event_id").alias("id"), session.alias("session_id"), F.concat(F.lit("agent_"), (F.col("user_id") % 5).cast("string")).alias("agent_name"), F.col("ts").alias("timestamp"))
    return audit, access, decision


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey records from orders."""
    o = spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"))
    k = F.col("o_orderkey")
    status = F.when(k % 13 == 0, "").when(F.col("o_orderstatus") == "O", "employed").when(F.col("o_orderstatus") == "F", "unemployed").otherwise("not_in_labour_force")
    hours = F.when(k % 17 == 0, "n/a").when(k % 19 == 0, "").when(k % 23 == 0, "0").otherwise((k % 200).cast("string"))
    kinds = F.array(*map(F.lit, ("full_time", "part_time", "self_employed", "")))
    return o.select(
        k.alias("record_id"), status.alias("employment_status"), F.when(k % 4 == 0, "").otherwise("clerk").alias("job_title"),
        F.when(k % 11 == 0, "").otherwise("finance").alias("industry"), hours.alias("hours_per_week"),
        F.get(kinds, (F.floor(k / 4) % 4).cast("int")).alias("employment_type"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Survey responses from labelled documents."""
    d, lab = read(spark, sf_dir, "documents").select("doc_id", "n_chars"), read(spark, sf_dir, "labels")
    return d.join(lab, "doc_id").select(
        F.col("doc_id").alias("id"), (F.col("doc_id") % 50).alias("session_id"), F.lit("job_title").alias("question_id"),
        F.when(F.col("quality") == 1, "2512").alias("isco_code"), F.when(F.col("toxic") != 1, (F.col("n_chars") % 101) / 100.0).alias("confidence_score"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents, their whole stored texts with the seed of doc_id % 16 appended."""
    seeds = F.array(*[F.lit(SEEDS[n]) for n in range(16)])
    at = (F.col("doc_id") % 16).cast("int")
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.coalesce(F.get(seeds, at), F.lit(""))).alias("text"))


def line_of(conv: Column, position: Column) -> Column:
    """What the script of a conversation says at a position."""
    out = F.lit(None).cast("string")
    for c, lines in SCRIPTS.items():
        said = F.array(*map(F.lit, lines))
        out = F.when(conv % 4 == c, F.get(said, F.least(position, F.lit(len(lines) - 1)).cast("int"))).otherwise(out)
    return out


def scripted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, stored, text): the user's turns of conversations, whole, and what the script says at each."""
    from pyspark.sql import Window

    c = read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("stored"))
    p = F.row_number().over(Window.partitionBy("session_id").orderBy("turn")) - 1
    return c.withColumn("p", p).select("session_id", "turn", "stored", line_of(F.col("session_id"), F.col("p")).alias("text"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, text): of each conversation a session of the user's whole stored texts (even ids) and one in which the script is said instead (odd ids)."""
    own = F.struct((2 * F.col("session_id")).alias("session_id"), "turn", F.col("stored").alias("text"))
    said = F.struct((2 * F.col("session_id") + 1).alias("session_id"), "turn", "text")
    return spread(scripted(spark, sf_dir)).select(F.explode(F.array(own, said)).alias("t")).select("t.*")


def whole_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, turn, text): the user's turns, what the script says appended to their whole stored texts."""
    return spread(scripted(spark, sf_dir)).select("session_id", "turn", F.concat("stored", F.lit(" "), "text").alias("text"))


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Occupation queries (each vec_id divisible by 100) and index (all rows) from embeddings; codes are the labels."""
    e = read(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return q, e.select(F.col("vec_id").alias("item_id"), F.col("label").cast("string").alias("code"), "embedding")
