"""Quality review of sessions: flags, metrics, score, status, escalation and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOW_CONFIDENCE, PASS, ESCALATE, MAX_FLAGS = 0.60, 0.70, 0.50, 3
WEIGHTS = (0.5, 0.3, 0.2)

# Report templates by status and language; s score, n responses, f flags, c coverage, a average confidence, each in per cent but n and f.
REPORTS: dict[str, tuple[str, str]] = {
    "pass": (
        "Session {id} passed quality review with a score of {s}%. {n} response(s) assessed; ISCO coverage {c}%, average confidence {a}%. No human review is required.",
        "اجتازت الجلسة {id} مراجعة الجودة بدرجة {s}%. تم تقييم {n} إجابة؛ تغطية التصنيف المهني {c}%، متوسط الثقة {a}%. لا تلزم مراجعة بشرية.",
    ),
    "fail": (
        "Session {id} failed quality review with a score of {s}%. {n} response(s) assessed; {f} flagged (ISCO coverage {c}%, avg confidence {a}%). Flagged responses must be reviewed before session data is accepted.",
        "فشلت الجلسة {id} في مراجعة الجودة بدرجة {s}%. تم تقييم {n} إجابة؛ تم وضع علامة على {f} منها (تغطية التصنيف المهني {c}%، متوسط الثقة {a}%). يجب مراجعة الإجابات المُعلَّمة قبل قبول بيانات الجلسة.",
    ),
    "escalated": (
        "Session {id} has been escalated for supervisor review (quality score: {s}%). {n} response(s) assessed; {f} flagged (ISCO coverage {c}%, avg confidence {a}%). Immediate human review is required.",
        "تم تصعيد الجلسة {id} لمراجعة المشرف (درجة الجودة: {s}%). تم تقييم {n} إجابة؛ تم وضع علامة على {f} منها (تغطية التصنيف المهني {c}%، متوسط الثقة {a}%). تلزم المراجعة البشرية الفورية.",
    ),
}


def _coded() -> Column:
    return F.trim(F.coalesce("isco_code", F.lit(""))) != ""


def flag(low: float = LOW_CONFIDENCE) -> Column:
    """Why a response is flagged, or null: a missing code whatever its score, else a score below the limit."""
    return F.when(~_coded(), "missing_isco").when(F.col("confidence_score") < low, "low_confidence_isco")


def flags(responses: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    return responses.withColumn("reason", flag(low)).where("reason is not null")


def metrics(responses: DataFrame, low: float = LOW_CONFIDENCE, exact: bool = False) -> DataFrame:
    """A row for each session; means and shares are cut to 0..1 and rounded to four places, 0 without rows to count.

    With ``exact`` scores are summed as decimals, so the mean doesn't hang on the order in which they come.
    """
    n = F.count("*")
    coded, scored = F.count_if(_coded()), F.count("confidence_score")
    total = F.sum(F.col("confidence_score").cast("decimal(28,18)")).cast("double")
    mean = total / scored if exact else F.avg("confidence_score")

    def share(x: Column) -> Column:
        return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)), 4)

    return responses.groupBy("session_id").agg(
        n.alias("total_responses"), coded.alias("with_isco"), scored.alias("with_score"),
        share(F.coalesce(F.when(scored > 0, mean), F.lit(0.0))).alias("avg_confidence"), share(coded / n).alias("isco_coverage"),
        F.count_if(F.col("confidence_score") < low).alias("low_confidence_count"), (n - coded).alias("missing_isco_count"),
        F.count_if(flag(low).isNotNull()).alias("flagged_count"),
    )


def review(sessions: DataFrame, responses: DataFrame, low: float = LOW_CONFIDENCE) -> DataFrame:
    """metrics of every session with quality_score, status, escalation_reason and both reports; a session without responses is escalated."""
    m = metrics(responses, low).withColumnRenamed("session_id", "_s")
    zero = {c: 0 for c in m.columns if c != "_s"}
    m = sessions.select("session_id").distinct().join(m, F.col("session_id") == F.col("_s"), "left").drop("_s").fillna(zero)
    return judged(m)


def judged(m: DataFrame) -> DataFrame:
    low_share = F.col("low_confidence_count") / F.greatest("with_score", F.lit(1))
    raw = WEIGHTS[0] * F.col("avg_confidence") + WEIGHTS[1] * F.col("isco_coverage") + WEIGHTS[2] * (1 - low_share)
    score = F.when(F.col("total_responses") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4))
    m = m.withColumn("quality_score", score)
    low, many = F.col("quality_score") < ESCALATE, F.col("flagged_count") >= MAX_FLAGS
    m = m.withColumn("status", F.when(low | many, "escalated").when(F.col("quality_score") < PASS, "fail").otherwise("pass"))
    two = F.format_string("%.2f", "quality_score")
    reason = (
        F.when(low & many, F.format_string("Quality score %s is below the escalation threshold (0.5) and %d flagged item(s) meet or exceed the limit (3).", two, "flagged_count"))
        .when(low, F.format_string("Quality score %s is below the escalation threshold of 0.5.", two))
        .when(many, F.format_string("%d flagged item(s) meet or exceed the escalation limit of 3.", "flagged_count"))
    )
    return m.withColumns({"escalation_reason": reason, "report_en": _report(0), "report_ar": _report(1)})


def _report(lang: int) -> Column:
    def per_cent(c: str) -> Column:
        return F.rint(F.col(c) * 100).cast("bigint").cast("string")  # halves to even

    values = {"id": F.col("session_id").cast("string"), "n": F.col("total_responses").cast("string"), "f": F.col("flagged_count").cast("string"),
              "s": per_cent("quality_score"), "c": per_cent("isco_coverage"), "a": per_cent("avg_confidence")}

    def filled(template: str) -> Column:
        out = F.lit(template)
        for k, x in values.items():
            out = F.replace(out, F.lit("{" + k + "}"), x)
        return out

    return F.when(F.col("status") == "pass", filled(REPORTS["pass"][lang])).when(
        F.col("status") == "fail", filled(REPORTS["fail"][lang])).otherwise(filled(REPORTS["escalated"][lang]))


def review_rows(reviewed: DataFrame, responses: DataFrame, as_of) -> DataFrame:
    """Rows for the table of reviews, flagged items as JSON."""
    items = flags(responses).groupBy(F.col("session_id").alias("_s")).agg(
        F.to_json(F.array_sort(F.collect_list(F.struct("id", "question_id", "reason", "isco_code", "confidence_score")))).alias("flagged_items_json"))
    out = reviewed.join(items, F.col("session_id") == F.col("_s"), "left").drop("_s")
    return out.select(
        "session_id", "quality_score", (F.col("status") == "pass").alias("passed"), "flagged_count", "flagged_items_json",
        (F.col("status") == "escalated").alias("escalated"), "escalation_reason", F.lit(None).cast("string").alias("reviewer_notes"),
        F.lit(None).cast("bigint").alias("reviewed_by"), F.lit(as_of).cast("timestamp_ntz").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("reviewed_at"),
    )


def queue(reviews: DataFrame) -> DataFrame:
    """Escalated and not yet reviewed, oldest first."""
    return reviews.where("escalated and reviewed_at is null").orderBy("created_at", "session_id")


def resolve(reviews: DataFrame, review_id: int, notes: str, as_of, reviewed_by: int | None = None) -> DataFrame:
    """reviews with one of them resolved; ValueError if there is no such id."""
    if reviews.where(F.col("id") == review_id).isEmpty():
        raise ValueError(f"no review {review_id}")
    hit = F.col("id") == review_id
    return reviews.withColumns({
        "reviewer_notes": F.when(hit, notes).otherwise(F.col("reviewer_notes")), "reviewed_by": F.when(hit, F.lit(reviewed_by)).otherwise(F.col("reviewed_by")).cast("bigint"),
        "reviewed_at": F.when(hit, F.lit(as_of).cast("timestamp_ntz")).otherwise(F.col("reviewed_at")),
    })
