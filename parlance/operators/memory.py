"""Session memory: merged fields, missing fields, recent turns, counts and summaries."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.extract import FIELDS

TTL_SECONDS = 86_400

# Display labels of fields and states.
FIELD_LABELS: dict[str, tuple[str, str]] = {
    "employment_status": ("Employment status", "حالة التوظيف"),
    "job_title": ("Job title", "المسمى الوظيفي"),
    "industry": ("Industry / sector", "الصناعة / القطاع"),
    "hours_per_week": ("Hours per week", "ساعات العمل الأسبوعية"),
    "employment_type": ("Employment type", "نوع التوظيف"),
}
STATE_LABELS: dict[str, tuple[str, str]] = {
    "greeting": ("greeting", "الترحيب"),
    "collecting_info": ("collecting data", "جمع البيانات"),
    "clarifying": ("clarifying answers", "توضيح الإجابات"),
    "validating": ("validating answers", "التحقق من الإجابات"),
    "completing": ("completing survey", "إتمام المسح"),
}


def merged(old: Column, new: Column) -> Column:
    """The stored map with the non-empty new values, as text, over it."""
    fresh = F.map_filter(F.transform_values(new, lambda _, v: v.cast("string")), lambda _, v: v.isNotNull() & (v != ""))
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)


def missing(data: Column) -> Column:
    """Required fields that are not in the map, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, FIELDS)), F.map_keys(data)))


def complete(data: Column) -> Column:
    return F.size(missing(data)) == 0


def recent(turns: DataFrame, n: int | None, key: str = "conv_id") -> DataFrame:
    """The last n turns of each session (all if n is None, none if 0)."""
    if n is None:
        return turns
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))
    return turns.withColumn("_r", last).where(F.col("_r") <= n).drop("_r")


def user_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.groupBy(key).agg(F.count_if(F.col("role") == "user").alias("n_user_turns"))


def live(sessions: DataFrame, as_of: datetime, ttl: int = TTL_SECONDS) -> DataFrame:
    """Sessions written within the time to live."""
    return sessions.where(F.col("last_updated") > F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(float(ttl))))


def saved(sessions: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """sessions (session_id, state, created_at, last_updated) with changes (session_id, state) over them: the time of creation stays, new ones begin now."""
    at = F.lit(now).cast("timestamp_ntz")
    new = changes.select(F.col("session_id").alias("_s"), F.col("state").alias("_state"))
    out = sessions.join(new, F.col("session_id") == F.col("_s"), "full")
    return out.select(
        F.coalesce("session_id", "_s").alias("session_id"), F.coalesce("_state", "state").alias("state"), F.coalesce("created_at", at).alias("created_at"),
        F.when(F.col("_s").isNotNull(), at).otherwise(F.col("last_updated")).alias("last_updated"),
    )


def append_turn(sessions: DataFrame, turns: DataFrame, rows: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(sessions, turns) with rows (session_id, turn, role, text...) appended: the log grows only, and a session that is not there begins as a stub."""
    fresh = rows.select("session_id").distinct().withColumn("state", F.lit("greeting"))
    known = sessions.select(F.col("session_id").alias("session_id"), F.col("state").alias("_old"))
    changes = fresh.join(known, "session_id", "left").select("session_id", F.coalesce("_old", "state").alias("state"))
    return saved(sessions, changes, now), turns.unionByName(rows, allowMissingColumns=True)


def applied(changes: DataFrame) -> DataFrame:
    """The sessions that a log of changes leaves: (session_id, language, state, fields, turn_count, history, created_at, last_updated).

    changes (session_id, seq, at, op, language, state, fields, role, content), as the streamed store takes them. Only those after a session's last delete
    count; its last save gives state, language, fields and an empty history; later updates merge their non-empty fields and later appends add turns. The time of
    creation is that of the first change after the delete. One aggregation finds the delete, one the save and one folds the rest, so a session's changes meet only as small maps of fields and its turns.
    """
    by = Window.partitionBy("session_id")
    gone = F.coalesce(F.max(F.when(F.col("op") == "delete", F.col("seq"))).over(by), F.lit(-1))
    live = changes.withColumn("_gone", gone).where(F.col("seq") > F.col("_gone"))
    save = F.coalesce(F.max(F.when(F.col("op") == "save", F.col("seq"))).over(by), F.lit(-1))
    live = live.withColumn("_save", save)
    first = F.col("seq") == F.col("_save")
    after = F.col("seq") >= F.col("_save")
    pairs = F.from_json(F.coalesce("fields", F.lit("{}")), "map<string,string>")
    sessions = live.groupBy("session_id").agg(
        F.coalesce(F.max(F.when(first, F.col("language"))), F.lit("en")).alias("language"), F.coalesce(F.max(F.when(first, F.col("state"))), F.lit("greeting")).alias("state"),
        F.count_if(after & (F.col("op") == "append") & (F.col("role") == "user")).alias("turn_count"), F.min_by("at", "seq").alias("created_at"), F.max_by("at", "seq").alias("last_updated"),
    )
    set_ = live.where(after & F.col("op").isin("save", "update")).select("session_id", "seq", "op", F.explode(pairs).alias("name", "value"))
    set_ = set_.where((F.col("op") == "save") | (F.coalesce("value", F.lit("")) != "")).groupBy("session_id", "name").agg(F.max_by("value", "seq").alias("value"))
    fields = set_.groupBy("session_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value"))))).alias("fields"))
    said = live.where(after & (F.col("op") == "append")).groupBy("session_id").agg(
        F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("seq", "role", "content", F.col("language").alias("detected_language")))), lambda t: t.dropFields("seq"))).alias("history"))
    out = sessions.join(fields, "session_id", "left").join(said, "session_id", "left")
    return out.withColumns({"fields": F.coalesce("fields", F.lit("{}")), "history": F.coalesce("history", F.lit("[]"))})


def delete(sessions: DataFrame, session_id: int) -> DataFrame:
    return sessions.where(F.col("session_id") != session_id)


def _label(table: dict[str, tuple[str, str]], key: Column, lang: int) -> Column:
    labels = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, v[lang])])
    return F.coalesce(F.try_element_at(labels, key), key)


def summary(data: Column, state: Column, n_turns: Column) -> Column:
    """struct(en, ar): what is collected, what is missing and the state."""
    gaps = missing(data)

    def text(lang: int) -> Column:
        none, head, need, done, now, sep, comma = (
            ("No employment data collected yet.", "Collected so far — ", "Still needed: ", "All required fields collected. ",
             "Current state: %s (%d turn(s)).", "; ", ", "),
            ("لم يتم جمع أي بيانات توظيف حتى الآن.", "تم جمعه حتى الآن — ", "لا يزال مطلوبًا: ", "تم جمع جميع الحقول المطلوبة. ",
             "الحالة الحالية: %s (%d دورة).", "؛ ", "، "),
        )[lang]
        pairs = F.transform(F.array_sort(F.map_entries(data)), lambda e: F.concat(_label(FIELD_LABELS, e["key"], lang), F.lit(": "), e["value"]))
        got = F.when(F.size(data) > 0, F.concat(F.lit(head), F.array_join(pairs, sep), F.lit("."))).otherwise(none)
        names = F.array_join(F.transform(gaps, lambda f: _label(FIELD_LABELS, f, lang)), comma)
        rest = F.when(F.size(gaps) > 0, F.concat(F.lit(need), names, F.lit(". "))).otherwise(done)
        return F.concat(got, F.lit(" "), rest, F.format_string(now, _label(STATE_LABELS, state, lang), n_turns))

    return F.struct(text(0).alias("en"), text(1).alias("ar"))
