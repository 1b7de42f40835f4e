"""Audit reports, retention and subject access over three logs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Tokens of the logs.
EVENT_TYPES = [
    "session_started", "session_completed", "session_deleted", "message_sent", "response_submitted", "auth_otp_requested",
    "auth_otp_verified", "auth_token_issued", "data_export_requested", "data_deletion_requested", "purge_executed",
]
ACCESS_TYPES = ["read", "write", "delete", "export", "anonymize"]
DECISION_TYPES = ["isco_classification", "language_detection", "validation", "context_summary", "rag_retrieval", "ner_extraction"]
RETENTION_DAYS = 90


def period(as_of: datetime, start: datetime | None = None, end: datetime | None = None) -> tuple[datetime, datetime]:
    """The last 30 days where no bounds are given."""
    return start or as_of - timedelta(days=30), end or as_of


def within(log: DataFrame, start: datetime, end: datetime, session_id: int | None = None, user_id: int | None = None) -> DataFrame:
    """Rows of the period, both ends included, of a session or user where the log has such a column."""
    out = log.where(F.col("timestamp").between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))
    if session_id is not None and "session_id" in log.columns:
        out = out.where(F.col("session_id") == session_id)
    if user_id is not None and "user_id" in log.columns:
        out = out.where(F.col("user_id") == user_id)
    return out


def counts(log: DataFrame, by: str) -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("n"))


def top_events(log: DataFrame, n: int = 3) -> DataFrame:
    return counts(log, "event_type").orderBy(F.desc("n"), "event_type").limit(n)


def totals(audit: DataFrame, access: DataFrame, decision: DataFrame) -> DataFrame:
    logs = {"total_audit_events": audit, "total_data_accesses": access, "total_agent_decisions": decision}
    out = None
    for name, log in logs.items():
        row = log.agg(F.count("*").alias(name))
        out = row if out is None else out.join(row)  # single rows
    return out


def report(audit: DataFrame, access: DataFrame, decision: DataFrame) -> DataFrame:
    """One row: totals, counters as maps and the text of the report in both languages, from logs already cut to the period."""
    def counter(log: DataFrame, by: str, name: str) -> DataFrame:
        pairs = F.array_sort(F.collect_list(F.struct(by, "n")))  # a pair for each token
        return counts(log, by).agg(F.map_from_entries(pairs).alias(name))

    top = top_events(audit).select(F.col("event_type").alias("e"), "n").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "e"))).alias("top"))
    row = totals(audit, access, decision).join(counter(audit, "event_type", "event_counts")).join(
        counter(access, "access_type", "access_counts")).join(counter(decision, "agent_name", "agent_counts")).join(top)
    a, d, g = "total_audit_events", "total_data_accesses", "total_agent_decisions"
    said = F.array_join(F.transform("top", lambda x: F.format_string("%s (%d)", x["e"], -x["m"])), ", ")
    idle = (F.col(a) == 0) & (F.col(d) == 0) & (F.col(g) == 0)
    en = F.format_string(
        "Audit summary: %d survey interaction(s), %d data-access event(s), and %d agent decision(s) recorded. Most frequent event types: %s. "
        "All logged activities appear consistent with declared LFS survey purposes under GDPR Article 6(1)(e).",
        a, d, g, F.when(said == "", "none").otherwise(said),
    )
    ar = F.format_string(
        "ملخص التدقيق: تم تسجيل %d تفاعل مسح، و%d حدث وصول إلى البيانات، و%d قرار وكيل. "
        "تبدو جميع الأنشطة المسجلة متوافقة مع أغراض مسح القوى العاملة المُعلنة بموجب المادة 6(1)(ه) من اللائحة العامة لحماية البيانات.",
        a, d, g,
    )
    return row.withColumns({
        "report_en": F.when(idle, "Audit period: No survey activity recorded. No data-access events or agent decisions were logged. "
                                  "System was idle or audit logging was not active during this period.").otherwise(en),
        "report_ar": F.when(idle, "فترة التدقيق: لم يُسجَّل أي نشاط لمسح القوى العاملة. لم تُسجَّل أي أحداث وصول إلى البيانات أو قرارات الوكلاء. "
                                  "كان النظام في وضع الخمول أو أن تسجيل التدقيق لم يكن نشطًا خلال هذه الفترة.").otherwise(ar),
    }).drop("top")


def expired(log: DataFrame, as_of: datetime, retention_days: int = RETENTION_DAYS) -> Column:
    """True for rows past their own limit (access log) or older than the retention; null limits never expire."""
    now = F.lit(as_of).cast("timestamp_ntz")
    if "retained_until" in log.columns:
        return F.coalesce(F.col("retained_until") < now, F.lit(False))
    return F.coalesce(F.col("timestamp") < F.lit(as_of - timedelta(days=retention_days)).cast("timestamp_ntz"), F.lit(False))


def survivors(log: DataFrame, as_of: datetime, retention_days: int = RETENTION_DAYS) -> DataFrame:
    return log.where(~expired(log, as_of, retention_days))


def purge_counts(audit: DataFrame, access: DataFrame, decision: DataFrame, as_of: datetime, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """One row: how many rows of each log a purge removes; one pass over each."""
    out = None
    for name, log in (("audit_purged", audit), ("access_purged", access), ("decision_purged", decision)):
        row = log.agg(F.count_if(expired(log, as_of, retention_days)).alias(name))
        out = row if out is None else out.join(row)
    return out


def purge(audit: DataFrame, access: DataFrame, decision: DataFrame, as_of: datetime, retention_days: int = RETENTION_DAYS, dry_run: bool = False) -> tuple[tuple[DataFrame, DataFrame, DataFrame], DataFrame]:
    """The three logs after a purge, and its counts; a purge that removes rows appends an event of its own to the audit log."""
    n = purge_counts(audit, access, decision, as_of, retention_days)
    if dry_run:
        return (audit, access, decision), n
    kept = [survivors(x, as_of, retention_days) for x in (audit, access, decision)]
    total = F.col("audit_purged") + F.col("access_purged") + F.col("decision_purged")
    event = n.where(total > 0).select(F.lit("purge_executed").alias("event_type"), F.lit(as_of).cast("timestamp_ntz").alias("timestamp"),
                                      F.to_json(F.struct("*")).alias("metadata_json"))
    return (kept[0].unionByName(event, allowMissingColumns=True), kept[1], kept[2]), n


def subject_access(access: DataFrame, user_id: int) -> DataFrame:
    """A user's accesses, newest first."""
    return access.where(F.col("user_id") == user_id).orderBy(F.desc("timestamp"))


def data_access(rows: DataFrame, now: datetime, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Access rows stamped with the time and with the day until which they are kept."""
    return rows.withColumns({"timestamp": F.lit(now).cast("timestamp_ntz"), "retained_until": F.lit(now + timedelta(days=retention_days)).cast("timestamp_ntz")})


def shortened(text: Column, most: int = 200) -> Column:
    """What the decision log keeps of a message: its first ``most`` characters, none of a null."""
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def with_iso_time(log: DataFrame, column: str = "timestamp") -> DataFrame:
    return log.withColumn(column, F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss"))
