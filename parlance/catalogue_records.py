"""Queries of lookups, changes, stores and reply parsers, with the SQL that each must equal; they join those of the catalogue."""

from __future__ import annotations

from datetime import datetime
from uuid import uuid4

from pyspark.sql import functions as F

from .catalogue import _DOCS, _RECORDS, _RESPONSES, _fsm_sql, _sessions, lit, query, stored_index
from .functions import emotion, extract, replies, rules, script
from .operators import audit, memory, occupation, quality, sessions
from .plans import turns as plan
from .sources import adapters, days, keyed, providers, requests, shared, tables

NOON = datetime(2024, 1, 16, 12)
_NOON = "TIMESTAMP '2024-01-16 12:00:00'"


def _users(spark, sf_dir):
    c = tables.read(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("id"), F.lower(F.concat("c_name", F.lit("@example.org"))).alias("email"), (F.col("c_nationkey") % 3 != 0).alias("is_active"))


def _answers(spark, sf_dir):
    x = tables.read(spark, sf_dir, "lineitem")
    return x.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("session_id"), F.col("l_returnflag").alias("answer"))


# --- lookups ---------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey AS id, o_custkey AS user_id FROM orders WHERE o_orderkey = 5 AND o_custkey = (SELECT o_custkey FROM orders WHERE o_orderkey = 5) LIMIT 1")
def session_owned(spark, sf_dir):
    s = _sessions(spark, sf_dir)
    user = s.where("id = 5").select("user_id").first()
    return sessions.owned(s, 5, user[0] if user else -1).select("id", "user_id")


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_returnflag AS answer FROM lineitem WHERE l_orderkey = 201")
def session_responses(spark, sf_dir):
    return sessions.responses_for_review(_answers(spark, sf_dir), 201).select("id", "answer")


@query("SELECT p_partkey AS id, p_partkey // 10 AS session_id, p_brand AS answer FROM part WHERE p_partkey = 57 AND p_partkey // 10 = 5")
def response_by_keys(spark, sf_dir):
    """One response by its own and its session's id; parts are responses of sessions of ten."""
    k = F.col("p_partkey")
    r = tables.read(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 10).alias("session_id"), F.col("p_brand").alias("answer"))
    return sessions.response(r, 57, 5)


@query("SELECT count(*) AS n, min(l_linenumber) AS first FROM lineitem WHERE l_orderkey = 201")
def responses_by_session(spark, sf_dir):
    found = sessions.responses_of(_answers(spark, sf_dir), 201)
    return found.agg(F.count("*").alias("n"), (F.min("id") - 2010).cast("int").alias("first"))


@query("SELECT c_custkey AS id, lower(c_name || '@example.org') AS email FROM customer WHERE c_custkey = 7 AND c_nationkey % 3 <> 0")
def user_by_id(spark, sf_dir):
    return sessions.active_user(_users(spark, sf_dir), user_id=7).select("id", "email")


@query("SELECT c_custkey AS id FROM customer WHERE lower(c_name || '@example.org') = 'customer#000000004@example.org' AND c_nationkey % 3 <> 0")
def user_by_email(spark, sf_dir):
    return sessions.active_user(_users(spark, sf_dir), email="customer#000000004@example.org").select("id")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F'")
def sessions_open(spark, sf_dir):
    return sessions.open_sessions(_sessions(spark, sf_dir)).select("id")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'conflict' ELSE 'accepted' END AS outcome FROM orders")
def session_gate(spark, sf_dir):
    return sessions.gated(_sessions(spark, sf_dir)).select("id", "outcome")


@query("SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM events")
def audit_iso_times(spark, sf_dir):
    return audit.with_iso_time(adapters.logs(spark, sf_dir)[0]).select("id", "timestamp")


@query("SELECT count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31'")
def audit_default_period(spark, sf_dir):
    return audit.within(adapters.logs(spark, sf_dir)[0], *audit.period(adapters.AS_OF)).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM embeddings")
def index_size(spark, sf_dir):
    """From the sizes that the stored index keeps of its lists."""
    return spark.read.parquet(f"{stored_index(spark, sf_dir)[1]}/centres").agg(F.sum("n").alias("n"))


@query("""SELECT o_orderkey AS session_id, CASE WHEN o_orderkey % 100 <> 1 OR o_orderkey % 3 = 0 THEN o_orderstatus ELSE 'completed' END AS status,
CASE WHEN o_orderkey % 100 <> 1 OR o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS version FROM orders WHERE o_orderkey % 500 <> 2
UNION ALL SELECT o_orderkey, o_orderstatus, 1 FROM orders WHERE o_orderkey % 500 = 2 AND o_orderkey % 3 = 1""")
def sessions_changed(spark, sf_dir):
    """One in a hundred sessions is completed, a third of those by a stale change; one in five hundred is deleted, or not where the change is stale."""
    o = tables.read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("status"))
    path = f"{shared.folder(spark)}/sessions-{uuid4().hex}"
    keyed.create(o, path, "session_id")
    k = F.col("session_id")
    done = o.where(k % 100 == 1).select(k, F.lit(1).alias("seq"), F.lit("update").alias("op"), F.when(k % 3 == 0, 7).otherwise(1).alias("made_for"), F.lit("completed").alias("status"))
    gone = o.where(k % 500 == 2).select(k, F.lit(1).alias("seq"), F.lit("delete").alias("op"), F.when(k % 3 == 1, 7).alias("made_for"), F.lit(None).cast("string").alias("status"))
    keyed.apply(done.unionByName(gone), path)
    return keyed.read(spark, path)


def _by_day(spark, sf_dir):
    """The three logs laid out by day, the access log by the day until which its rows are kept."""
    folder = f"{shared.folder(spark)}/logs-{uuid4().hex}"
    own = (("audit", "timestamp", "event_type"), ("access", "retained_until", "access_type"), ("decision", "timestamp", "agent_name"))
    for (name, column, by), log in zip(own, adapters.logs(spark, sf_dir), strict=True):
        days.append(log, f"{folder}/{name}", column, (by,))
    return [f"{folder}/{name}" for name, _, _ in own]


@query("""SELECT event_type, count(*) AS n FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10 07:30:00' AND TIMESTAMP '2024-01-20 16:45:10' GROUP BY event_type""")
def audit_counts_by_day(spark, sf_dir):
    """A period's counts from the kept counts of its whole days and the rows of its first and last."""
    return days.counts(spark, _by_day(spark, sf_dir)[0], datetime(2024, 1, 10, 7, 30), datetime(2024, 1, 20, 16, 45, 10))


@query("""SELECT 'audit' AS log, event_type AS kind, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 2
UNION ALL SELECT 'audit', 'purge_executed', 1 UNION ALL SELECT 'access', '', count(*) FROM events WHERE ts + INTERVAL 15 DAY >= TIMESTAMP '2024-01-31'""")
def logs_purged(spark, sf_dir):
    """What is left of logs laid out by day after a purge, which tells itself once though it is asked for twice."""
    paths = _by_day(spark, sf_dir)
    for _ in range(2):
        days.purge_logs(spark, *paths, adapters.AS_OF, adapters.RETENTION_DAYS)
    kept = days.read(spark, paths[0]).groupBy(F.lit("audit").alias("log"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))
    return kept.unionByName(days.read(spark, paths[1]).agg(F.lit("access").alias("log"), F.lit("").alias("kind"), F.count("*").alias("n")))


# --- changes ---------------------------------------------------------------------------------------------------

_CODES = f"""c AS (SELECT event_id AS id, user_id, lpad((event_id * 7919 % 1000000)::VARCHAR, 6, '0') AS code, ts + INTERVAL 10 MINUTE AS expires_at,
 event_id % 3 = 0 AS is_used FROM events)"""


def _codes(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "user_id", F.lpad((F.col("event_id") * 7919 % 1_000_000).cast("string"), 6, "0").alias("code"),
                    (F.col("ts") + F.expr("interval 10 minutes")).alias("expires_at"), (F.col("event_id") % 3 == 0).alias("is_used"))


@query(f"WITH {_CODES} SELECT id FROM c WHERE user_id = 13 AND NOT is_used AND expires_at > {_NOON} AND code = (SELECT max(code) FROM c WHERE user_id = 13)")
def code_valid(spark, sf_dir):
    c = _codes(spark, sf_dir)
    code = c.where("user_id = 13").agg(F.max("code")).first()[0] or ""
    return sessions.valid_code(c, 13, code, NOON).select("id")


@query(f"WITH {_CODES} SELECT id, code, is_used OR user_id = 13 AS is_used FROM c UNION ALL SELECT -1, '123456', false")
def code_stored(spark, sf_dir):
    return sessions.store_code(_codes(spark, sf_dir), 13, "123456", NOON, -1).select("id", "code", "is_used")


@query(f"""WITH {_CODES}, k AS (SELECT max(code) AS code FROM c WHERE user_id = 13)
SELECT id, is_used OR (user_id = 13 AND c.code = k.code AND expires_at > {_NOON}) AS is_used FROM c, k""")
def code_used(spark, sf_dir):
    c = _codes(spark, sf_dir)
    code = c.where("user_id = 13").agg(F.max("code")).first()[0] or ""
    return sessions.use_code(c, 13, code, NOON).select("id", "is_used")


@query("SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'completed' ELSE 'in_progress' END AS status FROM orders UNION ALL SELECT -c_custkey - 1, 'in_progress' FROM customer")
def session_create(spark, sf_dir):
    new = _users(spark, sf_dir).select((-F.col("id") - 1).alias("id"), F.col("id").alias("user_id"), F.lit("in_progress").alias("status"))
    return sessions.create(_sessions(spark, sf_dir), new).select("id", "status")


_REVIEWS = f"WITH {_RESPONSES}, w AS (SELECT session_id AS id, status = 'escalated' AS escalated FROM j)"


@query(f"{_REVIEWS} SELECT id, escalated, CASE WHEN id = 3 THEN 'checked' END AS reviewer_notes, CASE WHEN id = 3 THEN 9::BIGINT END AS reviewed_by, id = 3 AS resolved FROM w")
def review_resolved(spark, sf_dir):
    r = adapters.responses(spark, sf_dir)
    rows = quality.review_rows(quality.judged(quality.metrics(r)), r, adapters.AS_OF).withColumn("id", F.col("session_id"))
    out = quality.resolve(rows, 3, "checked", NOON, 9)
    return out.select("id", "escalated", "reviewer_notes", "reviewed_by", F.col("reviewed_at").isNotNull().alias("resolved"))


@query("""SELECT o_orderkey AS session_id, 'industry' AS question_id, 'finance' AS answer FROM orders WHERE o_orderkey % 11 <> 0
UNION ALL SELECT o_orderkey, 'job_title', 'clerk' FROM orders WHERE o_orderkey % 4 <> 0""")
def fields_persisted(spark, sf_dir):
    r = adapters.records(spark, sf_dir)
    data = F.create_map(F.lit("job_title"), "job_title", F.lit("industry"), "industry")
    return sessions.persist_fields(r.select(F.col("record_id").alias("session_id"), data.alias("data"))).select("session_id", "question_id", "answer")


@query("""SELECT conv_id AS session_id, 'job_title' AS question_id, 'nurse' AS answer, '2221' AS isco_code, 0.9::DOUBLE AS confidence_score
FROM conversations WHERE role = 'user' AND turn % 2 = 0""")
def titles_persisted(spark, sf_dir):
    ent = F.array(F.struct(F.lit("nurse").alias("text"), F.when(F.col("turn") % 2 == 0, "JOB_TITLE").otherwise("INDUSTRY").alias("label")))
    turns = tables.read(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("session_id"), ent.alias("entities"))
    coded = spark.createDataFrame([("nurse", "2221", 0.9)], "text string, code string, confidence double")
    return sessions.persist_titles(turns, coded)


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN 'driver' ELSE 'clerk' END AS job_title, CASE WHEN o_orderkey % 11 = 0 THEN 'kept' ELSE 'finance' END AS industry,
(o_orderkey % 200)::VARCHAR AS hours_per_week FROM orders""")
def fields_merged(spark, sf_dir):
    r = adapters.records(spark, sf_dir)
    old = F.create_map(F.lit("job_title"), F.lit("driver"), F.lit("industry"), F.lit("kept"))
    new = F.create_map(F.lit("job_title"), "job_title", F.lit("industry"), "industry", F.lit("hours_per_week"), (F.col("record_id") % 200).cast("string"))
    out = r.select(F.col("record_id").alias("id"), memory.merged(old, new).alias("m"))
    return out.select("id", *[F.col("m")[f].alias(f) for f in ("job_title", "industry", "hours_per_week")])


@query("""SELECT o_orderkey AS session_id, (o_orderkey % 4 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND o_orderkey % 19 <> 0 AND (o_orderkey // 4) % 4 <> 3
 OR (o_orderkey % 19 = 0 AND o_orderkey % 17 = 0 AND o_orderkey % 4 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 AND (o_orderkey // 4) % 4 <> 3)) AS complete FROM orders""")
def fields_complete(spark, sf_dir):
    r = adapters.records(spark, sf_dir)
    pairs = F.create_map(*[x for f in extract.FIELDS for x in (F.lit(f), F.col(f))])
    return r.select(F.col("record_id").alias("session_id"), memory.complete(F.map_filter(pairs, lambda _, v: v != "")).alias("complete"))


_STORED = "s AS (SELECT event_id AS session_id, ts AS last_updated FROM events)"


@query(f"WITH {_STORED} SELECT session_id FROM s WHERE last_updated > {_NOON} - INTERVAL 1 DAY")
def sessions_live(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    return memory.live(e.select(F.col("event_id").alias("session_id"), F.col("ts").alias("last_updated")), NOON).select("session_id")


@query(f"""SELECT event_id AS session_id, CASE WHEN event_id % 2 = 0 THEN 'validating' ELSE 'greeting' END AS state, ts AS created_at,
CASE WHEN event_id % 2 = 0 THEN {_NOON} ELSE ts END AS last_updated FROM events UNION ALL SELECT -1, 'greeting', {_NOON}, {_NOON}""")
def session_saved(spark, sf_dir):
    e = tables.read(spark, sf_dir, "events")
    old = e.select(F.col("event_id").alias("session_id"), F.lit("greeting").alias("state"), F.col("ts").alias("created_at"), F.col("ts").alias("last_updated"))
    new = old.where("session_id % 2 = 0").select("session_id", F.lit("validating").alias("state")).unionByName(
        spark.createDataFrame([(-1, "greeting")], "session_id long, state string"))
    return memory.saved(old, new, NOON)


@query("SELECT conv_id AS session_id, turn FROM conversations UNION ALL SELECT DISTINCT conv_id, 1000::BIGINT FROM conversations")
def turn_appended(spark, sf_dir):
    t = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    new = t.select("session_id").distinct().withColumn("turn", F.lit(1000).cast("long"))
    return memory.append_turn(_known(t), t, new, NOON)[1]


def _known(turns):
    """Every third session is in the store."""
    at = F.lit(adapters.AS_OF).cast("timestamp_ntz")
    known = turns.where("session_id % 3 = 0").select("session_id").distinct()
    return known.withColumns({"state": F.lit("validating"), "created_at": at, "last_updated": at})


@query(f"""SELECT DISTINCT conv_id AS session_id, CASE WHEN conv_id % 3 = 0 THEN 'validating' ELSE 'greeting' END AS state,
CASE WHEN conv_id % 3 = 0 THEN TIMESTAMP '2024-01-31' ELSE {_NOON} END AS created_at, {_NOON} AS last_updated FROM conversations""")
def turn_stubs(spark, sf_dir):
    """A turn for an unknown session begins a stub; a known one keeps its state and time of creation."""
    t = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn")
    return memory.append_turn(_known(t), t, t.select("session_id").distinct().withColumn("turn", F.lit(1000).cast("long")), NOON)[0]


_CHANGES = """c AS (SELECT conv_id AS session_id, turn AS seq, TIMESTAMP '2024-01-01' + INTERVAL (turn) SECOND AS ts,
 ['save', 'append', 'append', 'update', 'append', 'update', 'append', 'delete'][1 + (conv_id * 5 + turn) % 8] AS op, CASE WHEN turn % 2 = 0 THEN 'en' ELSE 'ar' END AS language,
 'state ' || turn AS state, CASE WHEN turn % 2 = 0 THEN 'job_title' ELSE 'industry' END AS name, CASE WHEN turn % 3 = 0 THEN '' ELSE role || turn END AS value,
 CASE WHEN turn % 3 = 1 THEN 'assistant' ELSE 'user' END AS role, text AS content FROM conversations),
g AS (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN seq END) OVER (PARTITION BY session_id), -1) AS gone FROM c),
l AS (SELECT *, coalesce(max(CASE WHEN op = 'save' THEN seq END) OVER (PARTITION BY session_id), -1) AS save FROM g WHERE seq > gone),
f AS (SELECT session_id, name, max_by(value, seq) AS value FROM l WHERE seq >= save AND (op = 'save' OR op = 'update' AND value <> '') GROUP BY session_id, name),
fs AS (SELECT session_id, '{' || string_agg('"' || name || '":"' || value || '"', ',' ORDER BY name) || '}' AS fields FROM f GROUP BY session_id)"""


@query(f"""WITH {_CHANGES} SELECT l.session_id, coalesce(max(CASE WHEN seq = save THEN language END), 'en') AS language, coalesce(max(CASE WHEN seq = save THEN state END), 'greeting') AS state,
coalesce(any_value(fields), '{{}}') AS fields, count(*) FILTER (WHERE seq >= save AND op = 'append' AND role = 'user') AS turn_count,
count(*) FILTER (WHERE seq >= save AND op = 'append') AS n_history, coalesce(sum(length(content)) FILTER (WHERE seq >= save AND op = 'append'), 0)::BIGINT AS n_chars,
min_by(ts, seq) AS created_at, max_by(ts, seq) AS last_updated FROM l LEFT JOIN fs ON fs.session_id = l.session_id GROUP BY l.session_id""")
def session_store(spark, sf_dir):
    """What a log of changes leaves in the store: every turn of every conversation is one, by its place a save, an append, an update or a delete."""
    t = tables.read(spark, sf_dir, "conversations")
    ops = F.array(*map(F.lit, ("save", "append", "append", "update", "append", "update", "append", "delete")))
    name, value = F.when(F.col("turn") % 2 == 0, "job_title").otherwise("industry"), F.when(F.col("turn") % 3 == 0, "").otherwise(F.concat("role", F.col("turn").cast("string")))
    changes = t.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.expr("timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, turn)").alias("at"),
        F.get(ops, ((F.col("conv_id") * 5 + F.col("turn")) % 8).cast("int")).alias("op"), F.when(F.col("turn") % 2 == 0, "en").otherwise("ar").alias("language"),
        F.concat(F.lit("state "), F.col("turn").cast("string")).alias("state"), F.to_json(F.create_map(name, value)).alias("fields"),
        F.when(F.col("turn") % 3 == 1, "assistant").otherwise("user").alias("role"), F.col("text").alias("content"),
    )
    said = F.from_json("history", "array<struct<content:string>>")
    chars = F.aggregate(said, F.lit(0).cast("long"), lambda n, h: n + F.coalesce(F.length(h["content"]), F.lit(0)))
    return memory.applied(changes).withColumns({"n_history": F.size(said).cast("long"), "n_chars": chars}).drop("history")


@query("SELECT conv_id AS session_id, turn, role FROM conversations")
def session_documents(spark, sf_dir):
    t = tables.read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("key"), F.col("conv_id").alias("session_id"), "turn", "role")
    return tables.from_documents(tables.documents_as_json(t, "key"), "key", "session_id long, turn long, role string").drop("key")


@query("SELECT count(*) AS n, count(*) AS n_ids FROM customer")
def ids_stable(spark, sf_dir):
    rows = tables.with_ids(tables.read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"])
    return rows.agg(F.count("*").alias("n"), F.count_distinct("id").alias("n_ids"))


@query("""SELECT 'purge_executed' AS event_type, sum((ts < TIMESTAMP '2024-01-16')::INTEGER)::BIGINT AS audit_purged,
sum((ts + INTERVAL 15 DAY < TIMESTAMP '2024-01-31')::INTEGER)::BIGINT AS access_purged FROM events""")
def purge_event(spark, sf_dir):
    (log, _, _), _ = audit.purge(*adapters.logs(spark, sf_dir), adapters.AS_OF, adapters.RETENTION_DAYS)
    own = log.where("event_type = 'purge_executed'")
    return own.select("event_type", *[F.get_json_object("metadata_json", f"$.{c}").cast("long").alias(c) for c in ("audit_purged", "access_purged")])


# --- language, emotion and rules ---------------------------------------------------------------------------------

_GUESS = """CASE doc_id % 5 WHEN 0 THEN [('en', 0.99)] WHEN 1 THEN [('fr', 0.6), ('en', 0.35)] WHEN 2 THEN [('de', 0.7), ('ar', 0.25)] WHEN 3 THEN [('fr', 0.4), ('en', 0.3), ('ar', 0.3)] END"""


@query(f"""WITH {_DOCS} SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'en' WHEN 3 THEN 'ar' ELSE CASE WHEN a + l > 0 AND ra >= 0.5 THEN 'ar' WHEN l > 0 THEN 'en' ELSE 'other' END END AS language,
round(CASE doc_id % 5 WHEN 0 THEN 0.99 WHEN 1 THEN 0.35 WHEN 3 THEN 0.3 ELSE CASE WHEN trim(text) = '' THEN 0.0 WHEN a + l > 0 AND ra >= 0.5 THEN ra WHEN l > 0 THEN 1 - ra ELSE 0.5 END END::DOUBLE, 4) AS confidence FROM x""")
def language_detected(spark, sf_dir):
    """The guesses of a detector by doc_id % 5; it fails for the last."""
    def guess(*pairs):
        return F.array(*[F.struct(F.lit(n).alias("language"), F.lit(p).alias("probability")) for n, p in pairs])

    k = F.col("doc_id") % 5
    found = F.when(k == 0, guess(("en", 0.99))).when(k == 1, guess(("fr", 0.6), ("en", 0.35))).when(k == 2, guess(("de", 0.7), ("ar", 0.25))).when(
        k == 3, guess(("fr", 0.4), ("en", 0.3), ("ar", 0.3)))
    return adapters.documents(spark, sf_dir).select("doc_id", F.inline(F.array(script.detected(found, F.col("text")))))


def _by_state(table, lang: str) -> str:
    return "CASE ['stressed', 'confused', 'frustrated', 'engaged', 'neutral'][1 + doc_id % 5] " + " ".join(f"WHEN '{s}' THEN {lit(t[lang])}" for s, t in table.items()) + " END"


def _state():
    return F.get(F.array(*map(F.lit, (*emotion.STATES, "neutral"))), (F.col("doc_id") % 5).cast("int"))


@query(f"SELECT doc_id, {_by_state(emotion.SUPPORT, 'en')} AS support_en, {_by_state(emotion.SUPPORT, 'ar')} AS support_ar FROM documents")
def support_messages(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select("doc_id", _state().alias("state"))
    return d.select("doc_id", *[emotion.message(emotion.SUPPORT, F.col("state"), x).alias(f"support_{x}") for x in ("en", "ar")])


@query(f"""WITH {_RECORDS}, w AS (SELECT record_id, count(*) FILTER (WHERE severity = 'error') AS ne, count(*) FILTER (WHERE severity = 'warning') AS nw FROM r LEFT JOIN v USING (record_id) GROUP BY ALL),
z AS (SELECT *, ne = 0 AS clean, record_id % 2 = 0 AS ok FROM w)
SELECT record_id, clean AND ok AS is_valid, round(greatest(0.0::DOUBLE, (1 - 0.25::DOUBLE * ne - 0.10::DOUBLE * nw - 0.10::DOUBLE * (clean AND NOT ok)::INTEGER) * CASE WHEN clean THEN 0.8::DOUBLE ELSE 1 END), 4) AS confidence,
clean AS needs_semantic FROM z""")
def validation_semantic(spark, sf_dir):
    """With a provider's verdict: records of odd id are called inconsistent with one issue."""
    ok = F.col("record_id") % 2 == 0
    r = adapters.records(spark, sf_dir).withColumns({
        "semantic_ok": ok, "semantic_confidence": F.lit(0.8), "semantic_issues": F.when(~ok, F.array(F.lit("odd pay"))).otherwise(F.array().cast("array<string>"))})
    return rules.verdict(r).select("record_id", "is_valid", "confidence", "needs_semantic")


@query(f"""WITH {_RECORDS}, n AS (SELECT record_id, count(*) AS n FROM v GROUP BY record_id) SELECT record_id,
CASE WHEN n IS NULL THEN 'All responses passed validation. The employment data is internally consistent and plausible.' END AS explanation_en,
coalesce(n, 0)::INTEGER AS n_found FROM r LEFT JOIN n USING (record_id)""")
def validation_explained(spark, sf_dir):
    v = rules.verdict(adapters.records(spark, sf_dir))
    n = F.size("violations")
    return v.select("record_id", F.when(n == 0, F.col("explanation_en")).alias("explanation_en"), n.alias("n_found"))


@query(f"""WITH {_RESPONSES} SELECT session_id, CASE WHEN quality_score < 0.5 AND flagged_count >= 3 THEN 'Quality score ' || printf('%.2f', round(quality_score, 2)) || ' is below the escalation threshold (0.5) and ' || flagged_count || ' flagged item(s) meet or exceed the limit (3).'
WHEN quality_score < 0.5 THEN 'Quality score ' || printf('%.2f', round(quality_score, 2)) || ' is below the escalation threshold of 0.5.'
WHEN flagged_count >= 3 THEN flagged_count || ' flagged item(s) meet or exceed the escalation limit of 3.' END AS escalation_reason FROM j""")
def escalation_reasons(spark, sf_dir):
    return quality.judged(quality.metrics(adapters.responses(spark, sf_dir))).select("session_id", "escalation_reason")


# --- replies -----------------------------------------------------------------------------------------------------


def _replies(spark, sf_dir, kinds: list[str]):
    d = tables.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.get(F.array(*map(F.lit, kinds)), (F.col("doc_id") % len(kinds)).cast("int")).alias("reply"))


@query("""SELECT doc_id, doc_id % 4 <> 0 AS ok, [1.0, 0.5, 0.0, 0.5][1 + doc_id % 4]::DOUBLE AS confidence, [1, 0, 2, 0][1 + doc_id % 4]::INTEGER AS n_issues FROM documents""")
def llm_semantic(spark, sf_dir):
    kinds = ['```json\n{"is_semantically_consistent": false, "confidence": 7, "issues": ["a", " "]}\n```', "nothing",
             'So: {"is_semantically_consistent": true, "confidence": -1, "issues": ["a", "b"]}', '{"confidence": "high"}']
    d = _replies(spark, sf_dir, kinds).select("doc_id", replies.semantic(F.col("reply")).alias("s"))
    return d.select("doc_id", "s.ok", "s.confidence", F.size("s.issues").alias("n_issues"))


@query("""SELECT doc_id, ['a', 't', 't', 't'][1 + doc_id % 4] AS en, ['b', 'u', 'u', 'u'][1 + doc_id % 4] AS ar FROM documents""")
def llm_bilingual(spark, sf_dir):
    kinds = ['{"en": "a", "ar": "b"}', '{"en": "a"}', "no", '{"en": "", "ar": "b"}']
    d = _replies(spark, sf_dir, kinds).select("doc_id", replies.bilingual(F.col("reply"), ("en", "ar"), (F.lit("t"), F.lit("u"))).alias("s"))
    return d.select("doc_id", "s.en", "s.ar")


@query("""SELECT doc_id, ['engaged', 'stressed', 'stressed'][1 + doc_id % 3] AS state, [0.3, 0.3, 1.0][1 + doc_id % 3]::DOUBLE AS confidence,
['continue', 'slow_down', 'end'][1 + doc_id % 3] AS action FROM documents""")
def llm_emotion(spark, sf_dir):
    kinds = ['Well {"emotional_state": "ENGAGED", "confidence": "x", "survey_action": "dance"}', "none", '{"confidence": 5, "survey_action": "end"}']
    d = _replies(spark, sf_dir, kinds)
    s = replies.emotion(F.col("reply"), F.lit("stressed"), F.lit(0.3), F.lit(0.3))
    return d.select("doc_id", s.alias("s")).select("doc_id", "s.state", "s.confidence", "s.action")


@query("""SELECT doc_id, ['c', 'Matches ''Software developers'' based on semantic similarity to the query.', 'd'][1 + doc_id % 3] AS explanation_en FROM documents""")
def llm_explanations(spark, sf_dir):
    kinds = ['[{"code": "2512", "explanation_en": "a"}, {"code": "2512", "explanation_en": "c"}]', "junk", '```json\n[{"code": " 2512 ", "explanation_en": "d", "explanation_ar": "e"}]\n```']
    d = _replies(spark, sf_dir, kinds).withColumn("code", F.lit("2512"))
    dim = tables.occupations(spark).withColumn("title_en", F.lit("Software developers"))
    return occupation.explained(d, dim, replies.explanations(F.col("reply"))).select("doc_id", "explanation_en")


# --- turns and occupations ---------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_fsm_sql(restart=True)} SELECT session_id, turn, 'message_sent' AS event_type FROM f WHERE p >= 0
UNION ALL SELECT session_id, turn, 'session_completed' FROM f WHERE state = 'completing'""")
def turn_events(spark, sf_dir):
    t = adapters.turns(spark, sf_dir)
    return plan.audit_rows(plan.results(t), t, adapters.AS_OF)[0].select("session_id", "turn", "event_type")


@query("SELECT conv_id AS session_id, turn, text[1:200] AS input_summary FROM conversations")
def turn_input_cut(spark, sf_dir):
    """Whole stored messages, cut as the decision log cuts them."""
    t = tables.read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), "turn", "text")
    return t.select("session_id", "turn", audit.shortened(F.col("text")).alias("input_summary"))


@query("""SELECT doc_id, doc_id % 2 = 0 AS asked, CASE WHEN doc_id % 2 = 0 THEN upper(lang) END AS reply FROM documents""")
def provider_gate(spark, sf_dir):
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "lang")
    out = providers.complete(d, F.col("lang"), F.col("doc_id") % 2 == 0, lambda xs: [x and x.upper() for x in xs])
    return out.select("doc_id", (F.col("doc_id") % 2 == 0).alias("asked"), "reply")


@query("SELECT p_partkey AS part, 'passage: ' || p_name || ' ' || p_brand || ' ' || p_type AS text FROM part")
def passage_texts(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), providers.embedding_text(F.col("p_name"), F.col("p_brand"), F.col("p_type")).alias("text"))


@query("SELECT doc_id, '' AS code, 'Unknown' AS title_en, 0.0::DOUBLE AS confidence, 'semantic' AS method FROM documents")
def occupation_empty(spark, sf_dir):
    r = tables.read(spark, sf_dir, "documents").select("doc_id", occupation.empty_route(F.lit("")).alias("r"))
    return r.select("doc_id", "r.code", "r.title_en", F.col("r.confidence").cast("double").alias("confidence"), "r.method")


def _upper(texts):
    return [t.upper() for t in texts]


def _upper_but_french(texts):
    if any(t.startswith("fr") for t in texts):
        raise RuntimeError("no French")
    return _upper(texts)


@query("""SELECT doc_id, coalesce(upper(lang || ' ' || source), 'NONE') AS reply, CASE WHEN n_chars % 2 = 0 THEN upper(source) ELSE 'calm' END AS other FROM documents""")
def replies_stored(spark, sf_dir):
    """Each kind of document is asked for once; a batch with French ones fails at first and is asked again; the other stage doesn't notice."""
    d = tables.read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    path = f"{shared.folder(spark)}/replies-{uuid4().hex}"
    kind = F.concat("lang", F.lit(" "), "source")
    other = requests.Enrichment(F.col("source"), F.col("n_chars") % 2 == 0, _upper, "calm")
    requests.enriched(d, path, {"reply": requests.Enrichment(kind, F.lit(True), _upper_but_french, "NONE"), "other": other})
    return requests.enriched(d, path, {"reply": requests.Enrichment(kind, F.lit(True), _upper, "NONE"), "other": other}).select("doc_id", "reply", "other")
