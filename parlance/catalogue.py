"""All queries over the driver's tables, with the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import emotion, extract, replies, rules, script
from .operators import audit, memory, occupation, quality, sessions
from .plans import turns as plan
from .sources import adapters, shared, tables, vector_index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "turn_results"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


# --- audit -----------------------------------------------------------------------------------------------------

_ACCESS = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in adapters.ACCESS.items()) + " END"
_IN = "ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20'"
_CUT = "TIMESTAMP '2024-01-16'"


def _logs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return tuple(audit.within(x, *adapters.WINDOW) for x in adapters.logs(spark, sf_dir))


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {_IN} GROUP BY event_type")
def audit_event_counts(spark, sf_dir):
    return audit.counts(_logs(spark, sf_dir)[0], "event_type")


@query(f"SELECT {_ACCESS} AS access_type, count(*) AS n FROM events WHERE {_IN} GROUP BY 1")
def audit_access_counts(spark, sf_dir):
    return audit.counts(_logs(spark, sf_dir)[1], "access_type")


@query(f"SELECT 'agent_' || (user_id % 5) AS agent_name, count(*) AS n FROM events WHERE {_IN} GROUP BY 1")
def audit_agent_counts(spark, sf_dir):
    return audit.counts(_logs(spark, sf_dir)[2], "agent_name")


@query(f"SELECT count(*) AS total_audit_events, count(*) AS total_data_accesses, count(*) AS total_agent_decisions FROM events WHERE {_IN}")
def audit_totals(spark, sf_dir):
    return audit.totals(*_logs(spark, sf_dir))


@query(f"SELECT event_type, count(*) AS n FROM events WHERE {_IN} GROUP BY event_type ORDER BY n DESC, event_type LIMIT 3")
def audit_top3_events(spark, sf_dir):
    return audit.top_events(_logs(spark, sf_dir)[0])


@query(f"""
WITH e AS (SELECT event_type, count(*) AS n FROM events WHERE {_IN} GROUP BY 1 ORDER BY n DESC, event_type LIMIT 3),
t AS (SELECT string_agg(event_type || ' (' || n || ')', ', ' ORDER BY n DESC, event_type) AS s FROM e),
c AS (SELECT count(*) AS n FROM events WHERE {_IN})
SELECT 'Audit summary: ' || n || ' survey interaction(s), ' || n || ' data-access event(s), and ' || n || ' agent decision(s) recorded. Most frequent event types: '
 || s || '. All logged activities appear consistent with declared LFS survey purposes under GDPR Article 6(1)(e).' AS report_en,
 'ملخص التدقيق: تم تسجيل ' || n || ' تفاعل مسح، و' || n || ' حدث وصول إلى البيانات، و' || n || ' قرار وكيل. '
 || 'تبدو جميع الأنشطة المسجلة متوافقة مع أغراض مسح القوى العاملة المُعلنة بموجب المادة 6(1)(ه) من اللائحة العامة لحماية البيانات.' AS report_ar
FROM c, t""")
def audit_report_text(spark, sf_dir):
    return audit.report(*_logs(spark, sf_dir)).select("report_en", "report_ar")


@query(f"""SELECT count(*) FILTER (WHERE ts < {_CUT}) AS audit_purged, count(*) FILTER (WHERE ts + INTERVAL 15 DAY < TIMESTAMP '2024-01-31') AS access_purged,
count(*) FILTER (WHERE ts < {_CUT}) AS decision_purged FROM events""")
def retention_purge_counts(spark, sf_dir):
    return audit.purge_counts(*adapters.logs(spark, sf_dir), adapters.AS_OF, adapters.RETENTION_DAYS)


@query(f"SELECT event_id AS id, user_id, event_type FROM events WHERE NOT ts < {_CUT}")
def retention_survivors(spark, sf_dir):
    return audit.survivors(adapters.logs(spark, sf_dir)[0], adapters.AS_OF, adapters.RETENTION_DAYS).select("id", "user_id", "event_type")


@query(f"""SELECT id, access_type, row_number() OVER (ORDER BY ts DESC, id) AS place FROM
(SELECT event_id AS id, {_ACCESS} AS access_type, ts FROM events WHERE user_id = 7)""")
def subject_access(spark, sf_dir):
    from pyspark.sql import Window

    own = audit.subject_access(adapters.logs(spark, sf_dir)[1], 7)  # one person's rows, so one task is enough
    return own.select("id", "access_type", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("timestamp"), "id")).cast("bigint").alias("place"))


# --- sessions --------------------------------------------------------------------------------------------------

_STATUS = "CASE o_orderstatus WHEN 'O' THEN 'in_progress' WHEN 'F' THEN 'completed' ELSE 'in_progress' END"


def _sessions(spark, sf_dir):
    o = tables.read(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("in_progress").alias("status"),
                    F.col("o_orderdate").cast("timestamp_ntz").alias("started_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"))


@query(f"""SELECT o_orderkey AS id, {_STATUS} AS status, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place
FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)""")
def sessions_by_user(spark, sf_dir):
    from pyspark.sql import Window

    s = _sessions(spark, sf_dir)
    user = s.agg(F.min("user_id")).first()[0]
    w = Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("id"))
    return sessions.of_user(s, user).select("id", "status", F.row_number().over(w).cast("bigint").alias("place"))


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 7 = 0 THEN 'completed' ELSE {_STATUS} END AS status,
o_orderkey % 7 = 0 AND o_orderstatus <> 'F' AS stamped FROM orders""")
def session_complete(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    out = sessions.complete(s, s.where("id % 7 = 0"), adapters.AS_OF)
    return out.select("id", "status", F.col("completed_at").isNotNull().alias("stamped"))


@query("""SELECT (SELECT count(*) FROM orders WHERE o_orderkey % 5 <> 0) AS n_sessions,
(SELECT count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) AND l_orderkey % 5 <> 0)
+ (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS n_responses""")
def session_delete_cascade(spark, sf_dir):
    s, r = _sessions(spark, sf_dir), tables.read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"))
    a, b = sessions.delete(s, r, s.where("id % 5 = 0"))
    return a.agg(F.count("*").alias("n_sessions")).join(b.agg(F.count("*").alias("n_responses")))


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN '9999' WHEN quality = 1 THEN '2512' END AS isco_code,
CASE WHEN doc_id % 3 = 0 THEN NULL WHEN toxic <> 1 THEN (n_chars % 101) / 100.0 END AS confidence_score
FROM labels JOIN documents USING (doc_id)""")
def response_update(spark, sf_dir):
    r = adapters.responses(spark, sf_dir).withColumn("answer", F.lit("x"))
    new = r.where("id % 3 = 0").withColumns({"isco_code": F.lit("9999"), "confidence_score": F.lit(None).cast("double")})
    return sessions.update_responses(r, new).select("id", "isco_code", "confidence_score")


# --- validation ------------------------------------------------------------------------------------------------

_RECORDS = """
r0 AS (SELECT o_orderkey AS record_id,
  CASE WHEN o_orderkey % 13 = 0 THEN '' WHEN o_orderstatus = 'O' THEN 'employed' WHEN o_orderstatus = 'F' THEN 'unemployed' ELSE 'not_in_labour_force' END AS s,
  CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'clerk' END AS j, CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'finance' END AS i,
  CASE WHEN o_orderkey % 17 = 0 THEN 'n/a' WHEN o_orderkey % 19 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN '0' ELSE (o_orderkey % 200)::VARCHAR END AS hs,
  ['full_time', 'part_time', 'self_employed', ''][1 + (o_orderkey // 4) % 4] AS t FROM orders),
r AS (SELECT *, try_cast(hs AS DOUBLE) AS h FROM r0),
v AS (
  SELECT record_id, 'R01' AS rule_id, 'employment_status' AS field, 'error' AS severity FROM r WHERE s = ''
  UNION ALL SELECT record_id, 'R01', 'industry', 'error' FROM r WHERE i = ''
  UNION ALL SELECT record_id, 'R01', 'employment_type', 'error' FROM r WHERE s = 'employed' AND t = ''
  UNION ALL SELECT record_id, 'R01', 'hours_per_week', 'error' FROM r WHERE s = 'employed' AND hs = ''
  UNION ALL SELECT record_id, 'R01', 'job_title', 'error' FROM r WHERE s = 'employed' AND j = ''
  UNION ALL SELECT record_id, 'R02', 'hours_per_week', 'error' FROM r WHERE hs <> '' AND h IS NULL
  UNION ALL SELECT record_id, 'R03', 'hours_per_week', 'error' FROM r WHERE h < 1 OR h > 168
  UNION ALL SELECT record_id, 'R04', 'hours_per_week', 'warning' FROM r WHERE h > 80
  UNION ALL SELECT record_id, 'R05', 'job_title', 'error' FROM r WHERE s = 'unemployed' AND j <> ''
  UNION ALL SELECT record_id, 'R06', 'hours_per_week', 'error' FROM r WHERE s = 'unemployed' AND h > 0
  UNION ALL SELECT record_id, 'R07', 'job_title', 'error' FROM r WHERE s = 'not_in_labour_force' AND j <> ''
  UNION ALL SELECT record_id, 'R10', 'hours_per_week', 'error' FROM r WHERE s = 'employed' AND h = 0 AND t <> ''
  UNION ALL SELECT record_id, 'R08', 'hours_per_week', 'warning' FROM r WHERE h BETWEEN 1 AND 168 AND t = 'full_time' AND h < 20
  UNION ALL SELECT record_id, 'R09', 'hours_per_week', 'warning' FROM r WHERE h BETWEEN 1 AND 168 AND t = 'part_time' AND h >= 35)"""


def _violations(spark, sf_dir):
    r = rules.normalised(adapters.records(spark, sf_dir))
    return r.select("record_id", F.inline(rules.violations(r)))


@query(f"WITH {_RECORDS} SELECT * FROM v")
def validation_violations(spark, sf_dir):
    return _violations(spark, sf_dir).select("record_id", "rule_id", "field", "severity")


@query(f"WITH {_RECORDS} SELECT rule_id, severity, count(*) AS n FROM v GROUP BY ALL")
def validation_rule_counts(spark, sf_dir):
    return _violations(spark, sf_dir).groupBy("rule_id", "severity").agg(F.count("*").alias("n"))


@query(f"""WITH {_RECORDS}, c AS (SELECT record_id, count(*) FILTER (WHERE severity = 'error')::INTEGER AS n_errors, count(*) FILTER (WHERE severity = 'warning')::INTEGER AS n_warnings
FROM r LEFT JOIN v USING (record_id) GROUP BY record_id)
SELECT record_id, n_errors, n_warnings, n_errors = 0 AS is_valid,
round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - 0.25::DOUBLE * n_errors - 0.10::DOUBLE * n_warnings)), 4) AS confidence FROM c""")
def validation_verdict(spark, sf_dir):
    return rules.verdict(adapters.records(spark, sf_dir)).select("record_id", "n_errors", "n_warnings", "is_valid", "confidence")


# --- quality ---------------------------------------------------------------------------------------------------

_RESPONSES = """
q AS (SELECT doc_id AS id, doc_id % 50 AS session_id, CASE WHEN quality = 1 THEN '2512' END AS isco_code,
  CASE WHEN toxic <> 1 THEN (n_chars % 101) / 100.0 END AS score FROM labels JOIN documents USING (doc_id)),
f AS (SELECT *, CASE WHEN isco_code IS NULL THEN 'missing_isco' WHEN score < 0.6 THEN 'low_confidence_isco' END AS reason FROM q),
m AS (SELECT session_id, count(*) AS total_responses, count(isco_code) AS with_isco, count(score) AS with_score,
  round(coalesce(avg(score), 0.0), 4) AS avg_confidence, round(count(isco_code) / count(*), 4) AS isco_coverage,
  count(*) FILTER (WHERE score < 0.6) AS low_confidence_count, count(*) - count(isco_code) AS missing_isco_count, count(reason) AS flagged_count FROM f GROUP BY session_id),
s AS (SELECT *, round(greatest(0.0, least(1.0, 0.5::DOUBLE * avg_confidence + 0.3::DOUBLE * isco_coverage + 0.2::DOUBLE * (1 - low_confidence_count / greatest(with_score, 1)))), 4) AS quality_score FROM m),
j AS (SELECT *, CASE WHEN quality_score < 0.5 OR flagged_count >= 3 THEN 'escalated' WHEN quality_score < 0.7 THEN 'fail' ELSE 'pass' END AS status FROM s)"""


@query(f"WITH {_RESPONSES} SELECT * FROM m")
def quality_metrics(spark, sf_dir):
    return quality.metrics(adapters.responses(spark, sf_dir))


@query(f"WITH {_RESPONSES} SELECT session_id, quality_score, status FROM j")
def quality_status(spark, sf_dir):
    return quality.judged(quality.metrics(adapters.responses(spark, sf_dir))).select("session_id", "quality_score", "status")


@query(f"WITH {_RESPONSES} SELECT id, session_id, reason FROM f WHERE reason IS NOT NULL")
def quality_flags(spark, sf_dir):
    return quality.flags(adapters.responses(spark, sf_dir)).select("id", "session_id", "reason")


@query(f"WITH {_RESPONSES} SELECT session_id, quality_score, flagged_count FROM j WHERE status = 'escalated' AND session_id % 3 <> 0")
def review_queue(spark, sf_dir):
    r = adapters.responses(spark, sf_dir)
    rows = quality.review_rows(quality.judged(quality.metrics(r)), r, adapters.AS_OF)
    done = F.when(F.col("session_id") % 3 == 0, F.col("created_at"))
    return quality.queue(rows.withColumn("reviewed_at", done)).select("session_id", "quality_score", "flagged_count")


def _report_sql(lang: int) -> str:
    def filled(t: str) -> str:
        e = lit(t)
        for k, x in (("id", "session_id::VARCHAR"), ("n", "total_responses::VARCHAR"), ("f", "flagged_count::VARCHAR"),
                     ("s", "printf('%.0f', quality_score * 100)"), ("c", "printf('%.0f', isco_coverage * 100)"), ("a", "printf('%.0f', avg_confidence * 100)")):
            e = f"replace({e}, '{{{k}}}', {x})"
        return e

    return "CASE status " + " ".join(f"WHEN '{s}' THEN {filled(t[lang])}" for s, t in quality.REPORTS.items()) + " END"


@query(f"WITH {_RESPONSES} SELECT session_id, {_report_sql(0)} AS report_en, {_report_sql(1)} AS report_ar FROM j")
def quality_report_text(spark, sf_dir):
    return quality.judged(quality.metrics(adapters.responses(spark, sf_dir))).select("session_id", "report_en", "report_ar")


# --- scripts ---------------------------------------------------------------------------------------------------

_AR = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
_SEED = "CASE " + " ".join(
    f"WHEN doc_id % 16 = {n} THEN text || {lit(s)}" for n, s in adapters.SEEDS.items()
) + " ELSE text END"
_DOCS = f"""
d AS (SELECT doc_id, {_SEED} AS text FROM documents),
k AS (SELECT doc_id, text, length(regexp_replace(text, '[^{_AR}]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM d),
x AS (SELECT *, a / greatest(a + l, 1) AS ra, l / greatest(a + l, 1) AS rl FROM k)"""


@query(f"WITH {_DOCS} SELECT doc_id, round(ra, 4) AS arabic_ratio, round(rl, 4) AS latin_ratio FROM x")
def script_ratios(spark, sf_dir):
    a, b = script.ratios(F.col("text"))
    return adapters.documents(spark, sf_dir).select("doc_id", F.round(a, 4).alias("arabic_ratio"), F.round(b, 4).alias("latin_ratio"))


@query(f"WITH {_DOCS} SELECT doc_id, ra >= 0.1 AND rl >= 0.1 AS code_switched FROM x")
def code_switch(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("doc_id", script.code_switched(F.col("text")).alias("code_switched"))


@query(f"""WITH {_DOCS} SELECT doc_id, CASE WHEN a + l = 0 THEN 'other' WHEN ra >= 0.9 THEN 'ar' WHEN ra <= 0.1 THEN 'en' ELSE 'mixed' END AS class FROM x""")
def script_class4(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("doc_id", script.class4(F.col("text")).alias("class"))


@query(f"""WITH {_DOCS} SELECT doc_id, CASE WHEN a + l = 0 THEN 'en' WHEN ra >= 0.9 THEN 'ar' WHEN ra >= 0.1 THEN 'mixed' ELSE 'en' END AS class FROM x""")
def script_class3(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("doc_id", script.class3(F.col("text")).alias("class"))


@query(f"""WITH {_DOCS} SELECT doc_id, CASE WHEN a + l > 0 AND ra >= 0.5 THEN 'ar' WHEN l > 0 THEN 'en' ELSE 'other' END AS language,
round(CASE WHEN trim(text) = '' THEN 0.0 WHEN a + l > 0 AND ra >= 0.5 THEN ra WHEN l > 0 THEN 1 - ra ELSE 0.5 END, 4) AS confidence FROM x""")
def script_language(spark, sf_dir):
    return adapters.documents(spark, sf_dir).select("doc_id", F.inline(F.array(script.language(F.col("text")))))


_WHOLE_SEED = "CASE doc_id % 16 " + " ".join(f"WHEN {n} THEN {lit(s)}" for n, s in adapters.SEEDS.items()) + " ELSE '' END"


@query(f"""WITH d AS (SELECT doc_id, text || {_WHOLE_SEED} AS text FROM documents),
g AS (SELECT doc_id, regexp_extract_all(text, '[^\\p{{L}}{_AR}]+|[{_AR}][{_AR}\\P{{L}}]*|\\p{{L}}[^{_AR}]*') AS s FROM d)
SELECT doc_id, list_transform(list_filter(s, lambda r: regexp_matches(r, '[^\\p{{Z}}\\x09-\\x0D\\x{{85}}]')), lambda r: r || '|' || CASE WHEN regexp_matches(r, '^[{_AR}]') THEN 'arabic' WHEN regexp_matches(r, '^\\p{{L}}') THEN 'latin' ELSE 'other' END) AS segments FROM g""")
def script_segments(spark, sf_dir):
    """Of all documents: the whole stored texts with their seeds appended."""
    d = adapters.documents(spark, sf_dir)
    return d.select("doc_id", F.transform(script.segments(F.col("text")), lambda x: F.concat(x["text"], F.lit("|"), x["script"])).alias("segments"))


@query("SELECT p_partkey AS part, ('0x' || substr(sha256(p_partkey::VARCHAR), 1, 15))::BIGINT AS id FROM part")
def stable_ids(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), script.stable_id(F.col("p_partkey").cast("string")).alias("id"))


# --- emotion ---------------------------------------------------------------------------------------------------


def _emotion_sql(source: str, key: str) -> str:
    hits = {s: " + ".join(f"regexp_matches(text, {lit(p)}, 'i')::INTEGER" for p in ps) for s, ps in emotion.PATTERNS.items()}
    caps = (
        "(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^\\p{L}{3,}$') AND upper(w) = w AND lower(w) <> w)) >= 2)::INTEGER"
    )
    bang, ask = "regexp_matches(text, '!{3,}')::INTEGER", r"regexp_matches(text, '\?{3,}')::INTEGER"
    return f"""
e0 AS (SELECT {key}, text, {", ".join(f"{h} AS h_{s}" for s, h in hits.items())}, {bang} AS bang, {ask} AS ask, {caps} AS caps FROM {source}),
e AS (SELECT {key}, text, round(least(1.0::DOUBLE, h_stressed * 0.3::DOUBLE + bang * 0.2::DOUBLE), 4) AS stressed,
  round(least(1.0::DOUBLE, h_confused * 0.3::DOUBLE + ask * 0.2::DOUBLE), 4) AS confused,
  round(least(1.0::DOUBLE, h_frustrated * 0.3::DOUBLE + bang * 0.2::DOUBLE + caps * 0.25::DOUBLE), 4) AS frustrated,
  round(least(1.0::DOUBLE, h_engaged * 0.3::DOUBLE), 4) AS engaged FROM e0),
b AS (SELECT *, greatest(stressed, confused, frustrated, engaged) AS best FROM e),
st AS (SELECT *, CASE WHEN best < 0.2 THEN 'neutral' WHEN stressed = best THEN 'stressed' WHEN confused = best THEN 'confused' WHEN frustrated = best THEN 'frustrated' ELSE 'engaged' END AS state,
  CASE WHEN best < 0.2 THEN 1.0 ELSE least(best, 0.95) END AS confidence, CASE WHEN best < 0.2 THEN 0.0 ELSE best END AS intensity FROM b),
act AS (SELECT *, CASE WHEN state IN ('neutral', 'engaged') THEN 'continue' WHEN intensity < 0.6 THEN 'slow_down' WHEN state = 'frustrated' THEN 'end' ELSE 'pause' END AS action FROM st)"""


_EMO = f"WITH d AS (SELECT doc_id, {_SEED} AS text FROM documents), {_emotion_sql('d', 'doc_id')}"


def _emotions(spark, sf_dir):
    d = adapters.documents(spark, sf_dir)
    return d.withColumn("s", emotion.scores(F.col("text")))


@query(f"{_EMO} SELECT doc_id, stressed, confused, frustrated, engaged FROM e")
def emotion_scores(spark, sf_dir):
    return _emotions(spark, sf_dir).select("doc_id", "s.*")


@query(f"{_EMO} SELECT doc_id, state, confidence, intensity FROM st")
def emotion_state(spark, sf_dir):
    return _emotions(spark, sf_dir).select("doc_id", F.inline(F.array(emotion.verdict(F.col("s")))))


@query(f"{_EMO} SELECT doc_id, state, action FROM act")
def survey_action(spark, sf_dir):
    v = _emotions(spark, sf_dir).select("doc_id", emotion.verdict(F.col("s")).alias("v"))
    return v.select("doc_id", "v.state", emotion.action(F.col("v.state"), F.col("v.intensity"))["action"].alias("action"))


def _signals_sql() -> str:
    one = [f"CASE WHEN regexp_matches(text, {lit(p)}, 'i') THEN 'keyword|' || regexp_extract(text, {lit(p)}, 0, 'i') END" for ps in emotion.PATTERNS.values() for p in ps]
    words = "list_filter(regexp_split_to_array(text, '\\s+'), lambda w: regexp_matches(w, '^\\p{L}{3,}$') AND upper(w) = w AND lower(w) <> w)"
    one += ["CASE WHEN regexp_matches(text, '!{3,}') THEN 'punctuation|!!!' END", r"CASE WHEN regexp_matches(text, '\?{3,}') THEN 'punctuation|???' END",
            f"CASE WHEN len({words}) >= 2 THEN 'caps|' || array_to_string(({words})[1:3], ' ') END"]
    return f"""WITH d AS (SELECT doc_id, {_SEED} AS text FROM documents)
SELECT doc_id, list_filter([{", ".join(one)}], lambda x: x IS NOT NULL) AS signals FROM d"""


@query(_signals_sql())
def emotion_signals(spark, sf_dir):
    d = adapters.documents(spark, sf_dir)
    return d.select("doc_id", F.transform(emotion.signals(F.col("text")), lambda x: F.concat(x["type"], F.lit("|"), x["text"])).alias("signals"))


# --- turns -----------------------------------------------------------------------------------------------------


def _script_sql() -> str:
    by = " ".join(f"WHEN {c} THEN [{', '.join(map(lit, lines))}][1 + least(p, {len(lines) - 1})]" for c, lines in adapters.SCRIPTS.items())
    return f"""
p AS (SELECT conv_id AS session_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM conversations WHERE role = 'user'),
scr AS (SELECT session_id, turn, p, CASE session_id % 4 {by} END AS text FROM p),
bo AS (SELECT 2 * session_id + 1 AS session_id, turn, text FROM scr UNION ALL SELECT 2 * conv_id, turn, coalesce(text, '') FROM conversations WHERE role = 'user'),
t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn) - 1 AS p FROM bo)"""


_WHOLE_TURNS = """
t0 AS (SELECT session_id, scr.turn, scr.p, coalesce(c.text, '') || ' ' || scr.text AS text FROM scr JOIN conversations c ON c.conv_id = scr.session_id AND c.turn = scr.turn AND c.role = 'user')"""


def _any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(low, {lit(w)})" for w in words) + ")"


_READ = f"""
low AS (SELECT *, lower(text) AS low FROM t),
c AS (SELECT session_id, turn, p, text,
  CASE {" ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in extract.STATUS.items())} END AS employment_status,
  CASE WHEN {_any(extract.PROFESSIONS)} THEN trim(text) END AS job_title,
  CASE {" ".join(f"WHEN {_any(w)} THEN '{n}'" for n, w in extract.SECTORS.items())} END AS industry,
  nullif(regexp_extract(low, {lit(extract.HOURS)}, 1), '') AS hours_per_week,
  CASE {" ".join(f"WHEN regexp_matches(low, {lit(p)}) THEN '{n}'" for n, p in extract.TYPES.items())} END AS employment_type,
  length(trim(text)) < 5 OR trim(low) IN ({", ".join(map(lit, extract.VAGUE))}) AS ambiguous,
  regexp_matches(trim(low), '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(w.replace("'", "''") for w in extract.CONFIRMATIONS["en"])})($|[^\\p{{L}}\\p{{N}}_])') AS confirmed_en,
  regexp_matches(trim(low), '(^|[^\\p{{L}}\\p{{N}}_])({"|".join(extract.CONFIRMATIONS["ar"])})($|[^\\p{{L}}\\p{{N}}_])') AS confirmed_ar,
  length(regexp_replace(text, '[^{_AR}]', '', 'g')) AS a, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS l FROM low),
cd AS (SELECT *, CASE WHEN a + l > 0 AND a / (a + l) >= 0.5 THEN 'ar' WHEN l > 0 THEN 'en' ELSE 'other' END AS detected FROM c)"""

_TURNS = f"{_script_sql()},{_READ}"
_WHOLE = f"{_script_sql()},{_WHOLE_TURNS},{_READ.replace('FROM t)', 'FROM t0)')}"
_FIELDS = extract.FIELDS


def _fsm_sql(restart: bool = False) -> str:
    keep = ", ".join(f"CASE WHEN f.{x} IS NULL AND f.state IN ('collecting_info', 'clarifying') THEN n.{x} ELSE f.{x} END AS {x}" for x in _FIELDS)
    full = " AND ".join(f"g.{x} IS NOT NULL" for x in _FIELDS)
    over = "state = 'completing'"
    anew = f"""(SELECT session_id, p, CASE WHEN {over} THEN 'greeting' ELSE state END AS state, CASE WHEN {over} THEN 'en' ELSE language END AS language,
      {", ".join(f"CASE WHEN {over} THEN NULL ELSE {x} END AS {x}" for x in _FIELDS)} FROM f) f"""
    return f"""{_TURNS},
f AS (
  SELECT session_id, -1::BIGINT AS p, NULL::BIGINT AS turn, 'greeting' AS state, 'en' AS language, {", ".join(f"NULL::VARCHAR AS {x}" for x in _FIELDS)}
  FROM (SELECT DISTINCT session_id FROM cd)
  UNION ALL
  SELECT session_id, p, turn, CASE WHEN state = 'greeting' THEN 'collecting_info' WHEN state = 'collecting_info' AND ambiguous THEN 'clarifying'
    WHEN state = 'collecting_info' AND {full} THEN 'validating' WHEN state = 'clarifying' THEN 'collecting_info'
    WHEN state = 'validating' THEN CASE WHEN CASE WHEN language = 'ar' THEN confirmed_ar ELSE confirmed_en END THEN 'completing' ELSE 'collecting_info' END
    ELSE state END, language, {", ".join(_FIELDS)}
  FROM (SELECT f.session_id, n.p, n.turn, f.state, n.ambiguous, n.confirmed_ar, n.confirmed_en,
      CASE WHEN n.detected IN ('en', 'ar') THEN n.detected ELSE f.language END AS language, {keep}
    FROM {anew if restart else "f"} JOIN cd n ON n.session_id = f.session_id AND n.p = f.p + 1) g)"""


@query(f"WITH {_TURNS} SELECT session_id, turn, {', '.join(_FIELDS)} FROM cd")
def turn_fields(spark, sf_dir):
    return plan.features(adapters.turns(spark, sf_dir)).select("session_id", "turn", *_FIELDS)


@query(f"WITH {_TURNS} SELECT session_id, turn, ambiguous, confirmed_en, confirmed_ar, detected FROM cd")
def turn_flags(spark, sf_dir):
    return plan.features(adapters.turns(spark, sf_dir)).select("session_id", "turn", "ambiguous", "confirmed_en", "confirmed_ar", "detected")


@query(f"WITH {_WHOLE} SELECT session_id, turn, {', '.join(_FIELDS)} FROM cd")
def turn_fields_whole(spark, sf_dir):
    """Of the whole stored texts with the scripts appended."""
    return plan.features(adapters.whole_turns(spark, sf_dir)).select("session_id", "turn", *_FIELDS)


@query(f"WITH {_WHOLE} SELECT session_id, turn, ambiguous, confirmed_en, confirmed_ar, detected FROM cd")
def turn_flags_whole(spark, sf_dir):
    return plan.features(adapters.whole_turns(spark, sf_dir)).select("session_id", "turn", "ambiguous", "confirmed_en", "confirmed_ar", "detected")


@query(f"WITH RECURSIVE {_fsm_sql()} SELECT session_id, turn, state, language, {', '.join(_FIELDS)} FROM f WHERE p >= 0")
def fsm_replay(spark, sf_dir):
    return plan.replay(plan.features(adapters.turns(spark, sf_dir)))


@query(f"""WITH RECURSIVE {_fsm_sql()} SELECT session_id, count(*) AS n_turns, max_by(state, p) AS state, max_by(language, p) AS language,
{", ".join(f"first({x} ORDER BY p DESC) AS {x}" for x in _FIELDS)} FROM f WHERE p >= 0 GROUP BY session_id""")
def fsm_final_state(spark, sf_dir):
    return plan.final(plan.features(adapters.turns(spark, sf_dir)))


def _data():
    return F.map_filter(F.create_map(*[x for f in _FIELDS for x in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())


_MISSING = "list_filter([" + ", ".join(f"CASE WHEN {f} IS NULL THEN '{f}' END" for f in sorted(_FIELDS)) + "], lambda x: x IS NOT NULL)"


@query(f"WITH RECURSIVE {_fsm_sql()}, z AS (SELECT * FROM f WHERE p >= 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY p DESC) = 1) SELECT session_id, {_MISSING} AS missing FROM z")
def missing_fields(spark, sf_dir):
    end = plan.final(plan.features(adapters.turns(spark, sf_dir)))
    return end.select("session_id", memory.missing(_data()).alias("missing"))


@query("SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def recent_turns(spark, sf_dir):
    return memory.recent(tables.read(spark, sf_dir, "conversations").select("conv_id", "turn"), 3)


@query("SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user_turns FROM conversations GROUP BY conv_id")
def user_turn_counts(spark, sf_dir):
    return memory.user_turns(tables.read(spark, sf_dir, "conversations"))


def _summary_sql(lang: int) -> str:
    pairs = ", ".join(f"CASE WHEN {f} IS NOT NULL THEN {lit(memory.FIELD_LABELS[f][lang] + ': ')} || {f} END" for f in sorted(_FIELDS))
    gaps = ", ".join(f"CASE WHEN {f} IS NULL THEN {lit(memory.FIELD_LABELS[f][lang])} END" for f in sorted(_FIELDS))
    label = "CASE state " + " ".join(f"WHEN '{s}' THEN {lit(t[lang])}" for s, t in memory.STATE_LABELS.items()) + " END"
    none, head, need, done, now, tail, sep, comma = (
        ("No employment data collected yet.", "Collected so far — ", "Still needed: ", "All required fields collected. ", "Current state: ", " turn(s)).", "; ", ", "),
        ("لم يتم جمع أي بيانات توظيف حتى الآن.", "تم جمعه حتى الآن — ", "لا يزال مطلوبًا: ", "تم جمع جميع الحقول المطلوبة. ", "الحالة الحالية: ", " دورة).", "؛ ", "، "),
    )[lang]

    def joined(xs: str, by: str) -> str:
        return f"array_to_string(list_filter([{xs}], lambda x: x IS NOT NULL), {lit(by)})"

    return f"""CASE WHEN {joined(pairs, sep)} <> '' THEN {lit(head)} || {joined(pairs, sep)} || '.' ELSE {lit(none)} END || ' ' ||
CASE WHEN {joined(gaps, comma)} <> '' THEN {lit(need)} || {joined(gaps, comma)} || '. ' ELSE {lit(done)} END || {lit(now)} || {label} || ' (' || n || {lit(tail)}"""


@query(f"""WITH RECURSIVE {_fsm_sql()}, z AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n FROM f WHERE p >= 0 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY p DESC) = 1)
SELECT session_id, {_summary_sql(0)} AS summary_en, {_summary_sql(1)} AS summary_ar FROM z""")
def session_summaries(spark, sf_dir):
    end = plan.final(plan.features(adapters.turns(spark, sf_dir)))
    s = memory.summary(_data(), F.col("state"), F.col("n_turns"))
    return end.select("session_id", s.alias("s")).select("session_id", F.col("s.en").alias("summary_en"), F.col("s.ar").alias("summary_ar"))


_PROMPTS = "CASE state " + " ".join(f"WHEN '{s}' THEN CASE WHEN detected = 'ar' THEN {lit(t['ar'])} ELSE {lit(t['en'])} END" for s, t in emotion.PROMPTS.items()) + " END"
_CHECK = """
CASE WHEN employment_status IS NULL AND job_title IS NULL AND industry IS NULL AND hours_per_week IS NULL AND employment_type IS NULL THEN 0 ELSE
 (employment_status IS NULL)::INTEGER + (industry IS NULL)::INTEGER
 + (coalesce(employment_status, '') = 'employed')::INTEGER * ((employment_type IS NULL)::INTEGER + (hours_per_week IS NULL)::INTEGER + (job_title IS NULL)::INTEGER)
 + coalesce(hours_per_week::DOUBLE < 1 OR hours_per_week::DOUBLE > 168, false)::INTEGER
 + (coalesce(employment_status, '') IN ('unemployed', 'not_in_labour_force') AND job_title IS NOT NULL)::INTEGER
 + (coalesce(employment_status, '') = 'unemployed' AND coalesce(hours_per_week::DOUBLE > 0, false))::INTEGER
 + (coalesce(employment_status, '') = 'employed' AND coalesce(hours_per_week::DOUBLE = 0, false) AND employment_type IS NOT NULL)::INTEGER END"""


@query(f"""WITH RECURSIVE {_fsm_sql(restart=True)}, {_emotion_sql('cd', 'session_id, p')},
o AS (SELECT f.*, cd.a, cd.l, cd.detected, act.state AS emotion, act.confidence AS ec, act.action FROM f JOIN cd ON cd.session_id = f.session_id AND cd.p = f.p
  JOIN act ON act.session_id = f.session_id AND act.p = f.p),
w AS (SELECT session_id, turn, language, round(a / greatest(a + l, 1), 4) AS arabic_ratio, round(l / greatest(a + l, 1), 4) AS latin_ratio,
  a / greatest(a + l, 1) >= 0.1 AND l / greatest(a + l, 1) >= 0.1 AS code_switched, emotion, ec AS emotion_confidence, action AS survey_action, detected,
  state, array_to_string({_MISSING}, ',') AS missing_fields, {_CHECK} AS n_errors FROM o)
SELECT session_id, turn, language, arabic_ratio, latin_ratio, code_switched, emotion, emotion_confidence, survey_action,
 {_PROMPTS.replace("CASE state", "CASE emotion")} AS adapted_prompt, state, missing_fields, n_errors = 0 AS is_valid, n_errors, state = 'completing' AS session_completed FROM w""")
def turn_results(spark, sf_dir):
    return plan.results(adapters.turns(spark, sf_dir)).drop("detected", "language_confidence", "entities")


@query(f"""WITH RECURSIVE {_fsm_sql(restart=True)},
z AS (SELECT f.session_id, f.turn, f.state, cd.job_title AS title, cd.detected, a / greatest(a + l, 1) >= 0.1 AND l / greatest(a + l, 1) >= 0.1 AS switched FROM f JOIN cd ON cd.session_id = f.session_id AND cd.p = f.p)
SELECT session_id, turn, state, CASE WHEN title IS NULL THEN '' ELSE title || '|' || (1000 + length(title) % 9) || '|' || CASE WHEN length(title) % 100 >= 92 THEN 'semantic' ELSE 'llm_ranked' END END AS matches,
'lang=' || detected || ', code_switched=' || CASE WHEN switched THEN 'True' ELSE 'False' END || ', entities=' || CASE WHEN title IS NULL THEN 0 ELSE 1 END AS decision, r.status, r.quality_score
FROM z LEFT JOIN (SELECT * FROM (WITH {_RESPONSES} SELECT session_id AS sid, quality_score, status FROM j)) r ON r.sid = z.session_id AND z.state = 'completing'
WHERE state <> 'completing' OR r.sid IS NOT NULL""")
def turn_outcomes(spark, sf_dir):
    """Matches, decision and review beside each turn's state. A title is the one that a turn offers, classed by its length; completing turns of sessions with responses."""
    t = adapters.turns(spark, sf_dir)
    titled = plan.features(t).select("session_id", "turn", "text", "job_title")
    one = F.struct(F.col("job_title").alias("text"), F.lit("JOB_TITLE").alias("label"), F.lit("en").alias("language"))
    said = titled.withColumn("entities", F.when(F.col("job_title").isNotNull(), F.array(one))).drop("job_title")
    n = F.length("text")
    classed = titled.where("job_title is not null").select(F.col("job_title").alias("text")).distinct().withColumns({
        "code": (1000 + n % 9).cast("string"), "confidence": (n % 100) / 100.0, "method": F.when(n % 100 >= 92, "semantic").otherwise("llm_ranked")})
    responses = adapters.responses(spark, sf_dir)
    out = plan.outcomes(said, classed, responses)
    shown = F.transform("matches", lambda m: F.concat_ws("|", m["job_title"], m["code"], m["method"]))
    known = responses.select(F.col("session_id").alias("_k")).distinct()
    out = out.join(known, F.col("session_id") == F.col("_k"), "left").where("state <> 'completing' or _k is not null")
    return out.select("session_id", "turn", "state", F.array_join(shown, ";").alias("matches"), F.col("output_summary").alias("decision"), "status", "quality_score")


# --- occupations -----------------------------------------------------------------------------------------------

_KNN = """
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
i AS (SELECT vec_id AS item_id, label::VARCHAR AS code, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT query_id, item_id, code, round(greatest(0.0, least(1.0, list_cosine_similarity(q, x))), 4) AS confidence FROM q, i),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, code, item_id) AS rank FROM s QUALIFY rank <= 5)"""


def stored_index(spark, sf_dir):
    """(queries, path of the stored index) over all vectors; the index is filled once for each state of the table."""
    queries, items = adapters.vectors(spark, sf_dir)
    return queries, vector_index.ensure(items, f"{shared.folder(spark)}/index-labels-{shared.fingerprint(tables.read(spark, sf_dir, 'embeddings'))}")


@query(f"WITH {_KNN} SELECT * FROM k")
def occupation_topk(spark, sf_dir):
    return occupation.top_k(*stored_index(spark, sf_dir), 5)


_ROUTE = """SELECT query_id, min_by(code, rank) AS code, max(confidence) AS confidence,
CASE WHEN max(confidence) >= 0.92 THEN 'semantic' ELSE 'llm_ranked' END AS method, max(confidence) < 0.92 AS needs_rerank, max(confidence) >= 0.35 AS usable FROM {0} GROUP BY query_id"""


@query(f"WITH {_KNN} {_ROUTE.format('k')}")
def occupation_route(spark, sf_dir):
    return occupation.route(occupation_topk(spark, sf_dir))


@query(f"WITH {_KNN.replace('SELECT vec_id AS query_id', 'SELECT vec_id + 1 AS query_id')} SELECT * FROM k")
def occupation_topk_whole(spark, sf_dir):
    """The index stored anew, though one is filled already, and asked under other ids."""
    queries, path = stored_index(spark, sf_dir)
    vector_index.rebuild(adapters.vectors(spark, sf_dir)[1], f"{path}-rebuilt", lists=7)
    return occupation.top_k(queries.withColumn("query_id", F.col("query_id") + 1), f"{path}-rebuilt", 5)


@query(f"WITH {_KNN}, h AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank) FROM k WHERE item_id <> query_id) {_ROUTE.format('h')}")
def occupation_route_whole(spark, sf_dir):
    """Without the query's own item, so that other items decide."""
    return occupation.route(occupation_topk(spark, sf_dir).where("item_id <> query_id"))


@query("SELECT count(*) AS n, count(DISTINCT label) AS n_codes FROM embeddings")
def index_filled(spark, sf_dir):
    """What the stored index holds."""
    path = stored_index(spark, sf_dir)[1]
    stored = spark.read.parquet(f"{path}/vectors").agg(F.countDistinct("code").alias("n_codes"))
    return spark.read.parquet(f"{path}/centres").agg(F.sum("n").alias("n")).join(stored, F.lit(True))


def _dimension_sql() -> str:
    import csv

    with tables.OCCUPATIONS.open(encoding="utf-8") as f:
        rows = ", ".join(f"({lit(r['code'])}, {r['level']}, {lit(r['title_en'])}, {lit(r['title_ar'])})" for r in csv.DictReader(f))
    return f"dim AS (SELECT * FROM (VALUES {rows}) AS v(code, level, title_en, title_ar))"


@query(f"""WITH {_dimension_sql()} SELECT d.code, substr(d.code, 1, 1) AS major_code, coalesce(m.title_en, 'Unknown') AS major_title_en, coalesce(m.title_ar, 'غير معروف') AS major_title_ar,
CASE WHEN length(d.code) >= 2 THEN substr(d.code, 1, 2) END AS sub_major_code, CASE WHEN length(d.code) >= 2 THEN coalesce(s.title_en, 'Unknown') END AS sub_major_title_en,
CASE WHEN length(d.code) >= 2 THEN coalesce(s.title_ar, 'غير معروف') END AS sub_major_title_ar
FROM dim d LEFT JOIN dim m ON m.code = substr(d.code, 1, 1) LEFT JOIN dim s ON length(d.code) >= 2 AND s.code = substr(d.code, 1, 2)""")
def occupation_hierarchy(spark, sf_dir):
    d = tables.occupations(spark)
    return occupation.with_path(d.select("code"), d)


_CODES = "(SELECT list(code ORDER BY code) FROM dim WHERE level = 4)"


def _level4(spark, sf_dir):
    """The items of embeddings with the codes of level 4 dealt to them by id."""
    d = tables.occupations(spark)
    at = F.broadcast(d.where("level = 4").withColumn("at", F.row_number().over(Window.orderBy("code")) - 1))  # the fixed dimension
    n = d.where("level = 4").select(F.count("*").alias("codes"))
    items = adapters.vectors(spark, sf_dir)[1].drop("code").join(F.broadcast(n), F.lit(True))
    return items.join(at.select("at", "code"), (F.col("item_id") * 7) % F.col("codes") == F.col("at")).drop("codes", "at")


@query(f"""WITH {_dimension_sql()}, i AS (SELECT vec_id AS item_id, {_CODES}[1 + (vec_id * 7) % len({_CODES})] AS code FROM embeddings)
SELECT item_id, i.code, substr(i.code, 1, 1) AS major_code, coalesce(m.title_en, 'Unknown') AS major_title_en, coalesce(m.title_ar, 'غير معروف') AS major_title_ar,
substr(i.code, 1, 2) AS sub_major_code, coalesce(s.title_en, 'Unknown') AS sub_major_title_en, coalesce(s.title_ar, 'غير معروف') AS sub_major_title_ar
FROM i LEFT JOIN dim m ON m.code = substr(i.code, 1, 1) LEFT JOIN dim s ON s.code = substr(i.code, 1, 2)""")
def occupation_paths(spark, sf_dir):
    """The path of every coded item; several codes lack a sub-major row."""
    return occupation.with_path(_level4(spark, sf_dir).select("item_id", "code"), tables.occupations(spark))


@query(f"""WITH {_dimension_sql()},
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0),
i AS (SELECT vec_id AS item_id, {_CODES}[1 + (vec_id * 7) % len({_CODES})] AS code, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT query_id, item_id, code, round(greatest(0.0, least(1.0, list_cosine_similarity(q, x))), 4) AS confidence FROM q, i),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, code, item_id) AS rank FROM s QUALIFY rank <= 10),
kept AS (SELECT query_id, code, min_by(confidence, rank) AS confidence, min(rank) AS rank FROM r GROUP BY query_id, code),
par AS (SELECT query_id, substr(code, 1, 2) AS code, round(max(confidence) * 0.85::DOUBLE, 4) AS confidence, min(rank) * 2 AS ord FROM kept GROUP BY ALL
  UNION ALL SELECT query_id, substr(code, 1, 1), round(max(confidence) * 0.70::DOUBLE, 4), min(rank) * 2 + 1 FROM kept GROUP BY query_id, substr(code, 1, 1)),
par2 AS (SELECT * FROM par WHERE code IN (SELECT code FROM dim) AND (query_id, code) NOT IN (SELECT (query_id, code) FROM kept)),
every AS (SELECT query_id, code, confidence, 'semantic' AS stage, 0 AS s, rank AS ord FROM kept UNION ALL SELECT query_id, code, confidence, 'hierarchical_expansion', 1, ord FROM par2),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, s, ord) AS rank FROM every QUALIFY rank <= 5)
SELECT query_id, code, confidence, stage, rank, CASE WHEN max(s) OVER (PARTITION BY query_id) = 1 THEN 'hierarchical' ELSE 'semantic_only' END AS method,
(SELECT count(*) FROM r WHERE r.query_id = o.query_id) AS total_retrieved FROM o""")
def occupation_expand(spark, sf_dir):
    d = tables.occupations(spark)
    queries, coded = adapters.vectors(spark, sf_dir)[0], _level4(spark, sf_dir)
    path = f"{shared.folder(spark)}/index-level4-{shared.fingerprint(tables.read(spark, sf_dir, 'embeddings'))}"
    return occupation.retrieve(queries, vector_index.ensure(coded, path), d, 5)


# --- replies ---------------------------------------------------------------------------------------------------

#: Replies by doc_id % 6, as a model may write them; {code} and {said} are of the document.
_REPLIES = {
    0: '```json\n{"selected_code": "{code}", "reasoning": "{said}"}\n```', 1: 'Sure: {"selected_code": "9{code}"} done', 2: "no json at all: {said}",
    3: '[{"selected_code": "{code}"}]', 4: '{"selected_code": " {code} ", "reasoning": ""}', 5: '{"broken": "{said}',
}


def _replied(spark, sf_dir):
    out = F.lit(None).cast("string")
    for k, v in _REPLIES.items():
        out = F.when(F.col("doc_id") % 6 == k, v).otherwise(out)
    code = (2510 + F.col("n_chars") % 5).cast("string")
    said = F.concat_ws(" ", "lang", "source", F.col("n_chars").cast("string"))
    filled = F.replace(F.replace(out, F.lit("{code}"), code), F.lit("{said}"), said)
    return tables.read(spark, sf_dir, "documents").select("doc_id", filled.alias("reply"))


_REPLY_SQL = "r AS (SELECT doc_id, doc_id % 6 AS k, (2510 + n_chars % 5)::VARCHAR AS code, concat_ws(' ', lang, source, n_chars::VARCHAR) AS said FROM documents)"


@query(f"""WITH {_REPLY_SQL} SELECT doc_id, CASE k WHEN 0 THEN '{{"selected_code": "' || code || '", "reasoning": "' || said || '"}}' WHEN 1 THEN '{{"selected_code": "9' || code || '"}}'
WHEN 4 THEN '{{"selected_code": " ' || code || ' ", "reasoning": ""}}' END AS object FROM r""")
def llm_json_object(spark, sf_dir):
    return _replied(spark, sf_dir).select("doc_id", replies.json_object(F.col("reply")).alias("object"))


@query(f"""WITH {_REPLY_SQL}, c AS (SELECT *, k IN (0, 4) AND code IN ('2511', '2512', '2513') AS named FROM r)
SELECT doc_id, CASE WHEN named THEN code ELSE '2513' END AS code,
CASE WHEN named AND k = 0 THEN said WHEN named THEN 'Selected by LLM classifier.' ELSE 'Fallback to top semantic match (LLM response could not be parsed).' END AS reasoning FROM c""")
def llm_select(spark, sf_dir):
    codes = F.array(*map(F.lit, ("2513", "2512", "2511")))
    return _replied(spark, sf_dir).select("doc_id", F.inline(F.array(replies.selection(F.col("reply"), codes))))


@query("""WITH r AS (SELECT doc_id, coalesce(source, 'nurse') AS s, coalesce(lang, 'en') AS g FROM documents)
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN [s || '|JOB_TITLE|en|5|' || (5 + length(s))] WHEN 1 THEN ['bank ' || g || '|INDUSTRY|en|-|-'] ELSE []::VARCHAR[] END AS entities FROM r""")
def llm_entities(spark, sf_dir):
    """Of replies that name the document's source, or its language beside a label that is none."""
    k, s, g = F.col("doc_id") % 3, F.coalesce("source", F.lit("nurse")), F.coalesce("lang", F.lit("en"))
    raw = F.when(k == 0, F.replace(F.lit('[{"text": " @ ", "label": "job_title", "language": "xx"}, {"text": "", "label": "PERSON"}]'), F.lit("@"), s)).when(
        k == 1, F.replace(F.lit('Found [{"text": "bank @", "label": "INDUSTRY"}, {"text": "x", "label": "COLOUR"}] here'), F.lit("@"), g)).otherwise("[]")
    d = tables.read(spark, sf_dir, "documents").select("doc_id", replies.entities(raw, F.concat(F.lit("am a "), s)).alias("e"))
    shown = F.transform("e", lambda x: F.concat_ws("|", x["text"], x["label"], x["language"], F.coalesce(x["start"].cast("string"), F.lit("-")), F.coalesce(x["end"].cast("string"), F.lit("-"))))
    return d.select("doc_id", shown.alias("entities"))
