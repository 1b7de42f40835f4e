"""Sessions, responses, users and one-time codes: lookups and changes as new snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OTP_MINUTES = 10


def _ts(t: datetime) -> Column:
    return F.lit(t).cast("timestamp_ntz")


def of_user(sessions: DataFrame, user_id: int) -> DataFrame:
    """A user's sessions, newest first."""
    return sessions.where(F.col("user_id") == user_id).orderBy(F.desc("started_at"), F.desc("id"))


def owned(sessions: DataFrame, session_id: int, user_id: int) -> DataFrame:
    """At most one row; none if the session is another's."""
    return sessions.where((F.col("id") == session_id) & (F.col("user_id") == user_id)).limit(1)


def responses_of(responses: DataFrame, session_id: int) -> DataFrame:
    return responses.where(F.col("session_id") == session_id)


def responses_for_review(responses: DataFrame, session_id: int) -> DataFrame:
    return responses_of(responses, session_id).orderBy("id")


def response(responses: DataFrame, response_id: int, session_id: int) -> DataFrame:
    return responses.where((F.col("id") == response_id) & (F.col("session_id") == session_id)).limit(1)


def active_user(users: DataFrame, user_id: int | None = None, email: str | None = None) -> DataFrame:
    by = F.col("id") == user_id if user_id is not None else F.col("email") == email
    return users.where(by & F.col("is_active")).limit(1)


def open_sessions(sessions: DataFrame) -> DataFrame:
    """Sessions that may still change."""
    return sessions.where(F.col("status") != "completed")


def gated(sessions: DataFrame) -> DataFrame:
    """sessions with the outcome of a change to each: conflict where it is completed, else accepted."""
    return sessions.withColumn("outcome", F.when(F.col("status") == "completed", "conflict").otherwise("accepted"))


def create(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def complete(sessions: DataFrame, done: DataFrame, now: datetime) -> DataFrame:
    """sessions with those named in done(id) completed at now; completed ones keep their time."""
    hit = done.select(F.col("id").alias("_id")).distinct()
    out = sessions.join(hit, F.col("id") == F.col("_id"), "left")
    close = F.col("_id").isNotNull() & (F.col("status") != "completed")
    return out.withColumns({
        "completed_at": F.when(close, _ts(now)).otherwise(F.col("completed_at")), "status": F.when(close, "completed").otherwise(F.col("status")),
    }).drop("_id")


def delete(sessions: DataFrame, responses: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the sessions in gone(id) and their responses."""
    ids = gone.select(F.col("id").alias("_id")).distinct()
    return (sessions.join(ids, F.col("id") == F.col("_id"), "left_anti"), responses.join(ids, F.col("session_id") == F.col("_id"), "left_anti"))


def update_responses(responses: DataFrame, changes: DataFrame) -> DataFrame:
    """responses with question_id, answer, isco_code and confidence_score overwritten, nulls too, where changes has the id and session."""
    four = ["question_id", "answer", "isco_code", "confidence_score"]
    new = changes.select(F.col("id").alias("_id"), F.col("session_id").alias("_s"), *[F.col(c).alias(f"_{c}") for c in four])
    out = responses.join(new, (F.col("id") == F.col("_id")) & (F.col("session_id") == F.col("_s")), "left")
    return out.withColumns({c: F.when(F.col("_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)) for c in four}).select(*responses.columns)


def store_code(codes: DataFrame, user_id: int, code: str, now: datetime, new_id: int) -> DataFrame:
    """Earlier unused codes of the user are spent, the new one is appended."""
    spent = codes.withColumn("is_used", F.when(F.col("user_id") == user_id, True).otherwise(F.col("is_used")))
    row = codes.sparkSession.createDataFrame([(new_id, user_id, code, now + timedelta(minutes=OTP_MINUTES), False)], codes.schema)
    return spent.unionByName(row)


def valid_code(codes: DataFrame, user_id: int, code: str, now: datetime) -> DataFrame:
    return codes.where((F.col("user_id") == user_id) & (F.col("code") == code) & ~F.col("is_used") & (F.col("expires_at") > _ts(now)))


def use_code(codes: DataFrame, user_id: int, code: str, now: datetime) -> DataFrame:
    hit = (F.col("user_id") == user_id) & (F.col("code") == code) & ~F.col("is_used") & (F.col("expires_at") > _ts(now))
    return codes.withColumn("is_used", F.when(hit, True).otherwise(F.col("is_used")))


def persist_fields(collected: DataFrame) -> DataFrame:
    """A response row for each non-empty field of (session_id, data map): uncoded, question named as the field."""
    pairs = F.explode(F.map_filter("data", lambda _, v: v.isNotNull() & (v != "")))
    rows = collected.select("session_id", pairs.alias("question_id", "answer"))
    return rows.withColumns({"isco_code": F.lit(None).cast("string"), "confidence_score": F.lit(None).cast("double")})


def persist_titles(turns: DataFrame, classified: DataFrame) -> DataFrame:
    """A coded response for each job title among a turn's entities (session_id, entities); classified is (text, code, confidence)."""
    titles = turns.select("session_id", F.explode(F.filter("entities", lambda e: e["label"] == "JOB_TITLE")).alias("e"))
    titles = titles.select("session_id", F.col("e.text").alias("answer"))
    return titles.join(classified, F.col("answer") == F.col("text")).select(
        "session_id", F.lit("job_title").alias("question_id"), "answer", F.col("code").alias("isco_code"), F.col("confidence").alias("confidence_score"))
