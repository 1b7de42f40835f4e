"""Operators on small rows with results computed by hand."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from parlance import catalogue
from parlance.functions import emotion, extract, replies, rules, script
from parlance.operators import audit, memory, occupation, quality, sessions
from parlance.plans import turns as plan
from parlance.sources import adapters, providers, tables


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_ratios_and_switch(spark):
    text = "أنا software engineer في"
    df = spark.createDataFrame([(text,)], "t string")
    a, b = script.ratios(F.col("t"))
    row = df.select(F.round(a, 4), F.round(b, 4), script.code_switched(F.col("t")), script.class4(F.col("t"))).first()
    assert list(row) == [0.2381, 0.7619, True, "mixed"]


@pytest.mark.parametrize("f", [script.language, script.class3, script.class4, script.code_switched, lambda t: script.ratios(t)[0]])
def test_scripts_are_counted_once(spark, f):
    df = spark.createDataFrame([("a",)], "t string").select(f(F.col("t")).alias("x"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[^A-Za-z]+") == plan.count("[^" + script.ARABIC[:9]) == 1


def test_languages_of_odd_texts(spark):
    rows = [(0, None), (1, ""), (2, " \u00a0\n"), (3, "12 \U0001F600"), (4, "ab\U0001F600é ب"), (5, "ab بت"), (6, "Привет"), (7, "é" * 50_000 + "ﻻ،b")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", script.language(F.col("t")).alias("x"), script.class4(F.col("t")), script.class3(F.col("t"))).collect()
    assert {r[0]: (*r[1], r[2], r[3]) for r in got} == {
        0: ("other", 0.5, "mixed", "en"), 1: ("other", 0.0, "other", "en"), 2: ("other", 0.0, "other", "en"), 3: ("other", 0.5, "other", "en"),
        4: ("en", 0.6667, "mixed", "mixed"), 5: ("ar", 0.5, "mixed", "mixed"), 6: ("other", 0.5, "other", "en"), 7: ("ar", 0.6667, "mixed", "mixed")}


def model_segments(text):
    """Character loop: a leading run of other characters stands alone, later ones join the run before."""
    def kind(c):
        n = ord(c)
        if any(a <= n <= b for a, b in ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF))):
            return "arabic"
        return "latin" if c.isalpha() else "other"

    runs = []
    for c in text:
        k = kind(c)
        if runs and (k == "other" or runs[-1][1] == k):
            runs[-1][0] += c
        elif not runs or k != "other":
            runs.append([c, k])
    return [tuple(r) for r in runs if r[0].strip()]


@pytest.mark.parametrize("text", ["40 hours", "أنا software engineer في البنك", "", "  ", "12345 !!", "a1 ب2 c", "أ b، c", "!a\nب"])
def test_segments_equal_the_loop(spark, text):
    got = one(spark, text, script.segments)
    assert [(r.text, r.script) for r in got] == model_segments(text)


def test_segments_of_long_texts(spark):
    text = "12 " + "latin words, " * 20_000 + "كلمات 3، " * 20_000 + "Привет 中文"
    assert [(r.text, r.script) for r in one(spark, text, script.segments)] == model_segments(text)


def test_whole_documents_keep_every_row_and_text(spark, tmp_path):
    rows = [(i, f"stored text {i} " * 900) for i in range(-1, 32)] + [(40, None), (None, "no id")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r.segments for r in catalogue.script_segments(spark, str(tmp_path)).collect()}
    assert len(got) == len(rows) and got[40] is None
    for i, text in rows:
        if text is not None:
            want = model_segments(text + ("" if i is None or i < 0 else adapters.SEEDS[i % 16]))
            assert got[i] == [f"{t}|{k}" for t, k in want]


def test_stable_id(spark):
    assert one(spark, "2512", script.stable_id) == 171025987359200099


@pytest.mark.parametrize(
    "text, state, confidence, action",
    [("Enough!!!", "frustrated", 0.5, "slow_down"), ("ok!!!", "stressed", 0.2, "slow_down"), ("THIS SURVEY WRONG", "frustrated", 0.25, "slow_down"),
     ("I don't understand, I am confused", "confused", 0.6, "pause"), ("hello", "neutral", 1.0, "continue"), ("", "neutral", 1.0, "continue"),
     ("أنا متوتر", "stressed", 0.3, "slow_down")],
)
def test_emotion(spark, text, state, confidence, action):
    v = emotion.verdict(emotion.scores(F.col("t")))
    row = spark.createDataFrame([(text,)], "t string").select(v.alias("v")).select("v.*", emotion.action(F.col("v.state"), F.col("v.intensity"))["action"].alias("a")).first()
    assert (row.state, row.confidence, row.a) == (state, confidence, action)


def test_signals_in_order(spark):
    got = one(spark, "Enough!!! THIS SURVEY WRONG of course", emotion.signals)
    assert [(s.type, s.text) for s in got] == [("keyword", "Enough"), ("keyword", "of course"), ("punctuation", "!!!"), ("caps", "THIS SURVEY WRONG")]


def test_ambiguity_and_confirmation(spark):
    assert one(spark, "40", extract.ambiguous) and one(spark, " okay ", extract.ambiguous) and not one(spark, "maybe so", extract.ambiguous)
    assert one(spark, "not right", lambda c: extract.confirmed(c, "en")) and not one(spark, "I want to correct my industry", lambda c: extract.confirmed(c, "en"))
    assert one(spark, "نعم صحيح", lambda c: extract.confirmed(c, "ar"))


def test_substring_extraction(spark):
    df = spark.createDataFrame([("not working",), ("visit the hospital",), ("I am a self-employed nurse, 35 hrs",), ("أعمل مهندس 40 ساعة",)], "t string")
    rows = df.select(*[c.alias(n) for n, c in extract.candidates(F.col("t")).items()]).collect()
    assert rows[0].employment_status == "employed"
    assert rows[1].industry == "technology"
    assert (rows[2].employment_status, rows[2].employment_type, rows[2].hours_per_week, rows[2].job_title) == ("employed", "self_employed", "35", "I am a self-employed nurse, 35 hrs")
    assert (rows[3].employment_status, rows[3].hours_per_week) == ("employed", "40")


RECORD = "employment_status string, job_title string, industry string, hours_per_week string, employment_type string"


@pytest.mark.parametrize(
    "record, found, confidence",
    [
        (("employed", "clerk", "finance", "0", "full_time"), ["R03", "R10"], 0.5),
        (("employed", "clerk", "finance", "40.9", "full_time"), [], 1.0),
        (("employed", "clerk", "finance", "12", " FULL_TIME "), ["R08"], 0.9),
        (("employed", "clerk", "finance", "40", "part_time"), ["R09"], 0.9),
        (("unemployed", "clerk", "finance", "10", ""), ["R05", "R06"], 0.5),
        (("not_in_labour_force", "clerk", "finance", None, None), ["R07"], 0.75),
        (("employed", "clerk", "finance", "100", "full_time"), ["R04"], 0.9),
        (("employed", "clerk", "finance", "inf", "full_time"), ["R03", "R04"], 0.65),
        (("employed", "clerk", "finance", "nan", "full_time"), [], 1.0),
        (("employed", "clerk", "finance", "٤٠", "full_time"), [], 1.0),
        (("employed", "clerk", "finance", "40d", "full_time"), ["R02"], 0.75),
        (("employed", "", "", "", ""), ["R01"] * 4, 0.0),
        ((None, None, None, None, None), ["R01", "R01"], 0.5),
    ],
)
def test_rules(spark, record, found, confidence):
    row = rules.verdict(spark.createDataFrame([record], RECORD)).first()
    assert [v.rule_id for v in row.violations] == found
    assert row.confidence == confidence and row.is_valid == (row.n_errors == 0)
    assert row.explanation_en and row.explanation_ar


def test_rule_order_of_missing_fields(spark):
    row = rules.verdict(spark.createDataFrame([("employed", "", "", "", "")], RECORD)).first()
    assert [v.field for v in row.violations] == ["employment_type", "hours_per_week", "industry", "job_title"]


def test_semantic_stage(spark):
    df = spark.createDataFrame([("employed", "clerk", "finance", "40", "full_time", False, 0.8, ["odd pay"])], RECORD + ", semantic_ok boolean, semantic_confidence double, semantic_issues array<string>")
    row = rules.verdict(df).first()
    assert not row.is_valid and row.confidence == 0.72 and "odd pay" in row.explanation_en


RESPONSES = "id long, session_id long, question_id string, isco_code string, confidence_score double"


@pytest.mark.parametrize(
    "rows, score, status, flagged",
    [([("2512", 0.4), ("2512", 0.75)], 0.6875, "fail", 1), ([("2512", 0.95)] * 3, 0.975, "pass", 0), ([(None, None)], 0.2, "escalated", 1),
     ([(" ", 0.9)] * 3, 0.65, "escalated", 3), ([], 0.0, "escalated", 0)],
)
def test_quality(spark, rows, score, status, flagged):
    r = spark.createDataFrame([(i, 1, "job_title", c, s) for i, (c, s) in enumerate(rows)], RESPONSES)
    row = quality.review(spark.createDataFrame([(1,)], "session_id long"), r).first()
    assert (row.quality_score, row.status, row.flagged_count) == (score, status, flagged)
    assert (row.escalation_reason is not None) == (status == "escalated") and "{" not in row.report_en + row.report_ar


def test_resolve_review(spark):
    df = spark.createDataFrame([(1, True, None, None, None)], "id long, escalated boolean, reviewer_notes string, reviewed_by long, reviewed_at timestamp_ntz")
    assert quality.resolve(df, 1, "fine", datetime(2024, 1, 1), 9).first().reviewed_by == 9
    with pytest.raises(ValueError):
        quality.resolve(df, 2, "x", datetime(2024, 1, 1))


def test_purge(spark):
    now = datetime(2024, 4, 1)
    log = "id long, event_type string, timestamp timestamp_ntz"
    a = spark.createDataFrame([(1, "x", datetime(2024, 1, 1)), (2, "x", datetime(2024, 3, 1))], log)
    d = spark.createDataFrame([(1, datetime(2024, 1, 1))], "id long, timestamp timestamp_ntz")
    c = spark.createDataFrame([(1, datetime(2024, 1, 1), datetime(2024, 3, 31)), (2, datetime(2024, 1, 1), now)], "id long, timestamp timestamp_ntz, retained_until timestamp_ntz")
    (a2, c2, d2), n = audit.purge(a, c, d, now)
    assert tuple(n.first()) == (1, 1, 1) and c2.count() == 1 and d2.count() == 0
    assert sorted(r.event_type for r in a2.collect()) == ["purge_executed", "x"]
    assert audit.purge(a, c, d, now, dry_run=True)[0][0].count() == 2


def test_idle_report(spark):
    empty = spark.createDataFrame([], "event_type string, access_type string, agent_name string")
    assert audit.report(empty, empty, empty).first().report_en.startswith("Audit period: No survey")


def test_memory(spark):
    df = spark.createDataFrame([({"industry": "tech", "job_title": "x"}, {"industry": "", "job_title": "y", "hours_per_week": None})], "a map<string,string>, b map<string,string>")
    row = df.select(memory.merged(F.col("a"), F.col("b")).alias("m"), memory.missing(F.col("a")).alias("g"), memory.summary(F.col("a"), F.lit("validating"), F.lit(2)).alias("s")).first()
    assert row.m == {"industry": "tech", "job_title": "y"} and row.g == ["employment_status", "employment_type", "hours_per_week"]
    assert row.s.en == "Collected so far — Industry / sector: tech; Job title: x. Still needed: Employment status, Employment type, Hours per week. Current state: validating answers (2 turn(s))."
    turns = spark.createDataFrame([(1, i, "user") for i in range(4)], "conv_id long, turn long, role string")
    assert sorted(r.turn for r in memory.recent(turns, 2).collect()) == [2, 3] and memory.recent(turns, 0).count() == 0 and memory.recent(turns, None).count() == 4


def expanded(spark, codes, k=5):
    raw = spark.createDataFrame([(1, c, s, i + 1) for i, (c, s) in enumerate(codes)], "query_id long, code string, confidence double, rank int")
    return [(r.code, r.confidence, r.stage, r.method) for r in occupation.expand(raw, tables.occupations(spark), k).orderBy("rank").collect()]


def test_expansion(spark):
    assert expanded(spark, [("2512", 0.8)]) == [("2512", 0.8, "semantic", "hierarchical"), ("25", 0.68, "hierarchical_expansion", "hierarchical"), ("2", 0.56, "hierarchical_expansion", "hierarchical")]
    assert [x[:2] for x in expanded(spark, [("9411", 0.8)])] == [("9411", 0.8), ("9", 0.56)]
    assert expanded(spark, [("2512", 0.8)], k=1) == [("2512", 0.8, "semantic", "semantic_only")]
    path = occupation.with_path(spark.createDataFrame([("9411",)], "code string"), tables.occupations(spark)).first()
    assert path.sub_major_title_en == "Unknown" and path.major_code == "9"
    assert tables.occupations(spark).count() == 124 and occupation.clamped_k(0) == 1 and occupation.clamped_k(50) == 10


def test_retrieval_takes_twice_k_and_reports_none(spark):
    rows = [(i, f"{i}", [1.0, float(i)]) for i in range(30)]
    index = spark.createDataFrame(rows, "item_id long, code string, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 5.0])], "query_id long, embedding array<double>")
    dim = tables.occupations(spark)
    got = occupation.retrieve(q, index, dim, 3).collect()
    assert len(got) == 3 and {r.total_retrieved for r in got} == {6} and {r.method for r in got} == {"semantic_only"}
    assert occupation.retrieve(q, index, dim, 99).first().total_retrieved == 20
    none = occupation.retrieve(q, index.where("false"), dim).collect()
    assert [(r.code, r.total_retrieved, r.method) for r in none] == [(None, 0, "semantic_only")]


def test_turns_leave_audit_rows_matches_and_reports(spark):
    ent = "array<struct<text:string,label:string,language:string>>"
    long = "I am employed full time 40 hours as a nurse in a hospital" + " and so on" * 40
    said = ["hello there", long, "yes that is right", "thanks again"]
    rows = [(1, i, t, [("nurse", "JOB_TITLE", "en")] if i == 1 else None) for i, t in enumerate(said)]
    turns = spark.createDataFrame(rows, f"session_id long, turn long, text string, entities {ent}")
    got = plan.results(turns)
    assert [r.state for r in got.orderBy("turn").collect()] == ["collecting_info", "validating", "completing", "collecting_info"]
    events, decisions = plan.audit_rows(got, turns, datetime(2024, 1, 1))
    assert sorted(r.event_type for r in events.collect()) == ["message_sent"] * 4 + ["session_completed"]
    d = {r.turn: r for r in decisions.collect()}
    assert d[1].input_summary == long[:200] and d[1].output_summary == "lang=en, code_switched=False, entities=1"
    coded = spark.createDataFrame([("nurse", "2221", 0.95, "semantic")], "text string, code string, confidence double, method string")
    assert [tuple(r) for r in plan.occupation_matches(got, coded).collect()] == [(1, 1, "nurse", "2221", 0.95, "semantic")]
    assert [(r.session_id, r.status) for r in plan.quality_reports(got, spark.createDataFrame([], RESPONSES)).collect()] == [(1, "escalated")]


def test_explanations(spark):
    df = spark.createDataFrame([("2512", '```json\n[{"code": "2512", "explanation_en": "a", "explanation_ar": "b"}, {"code": "2512", "explanation_en": "c"}]\n```'), ("2512", "junk")], "code string, r string")
    rows = occupation.explained(df, tables.occupations(spark), replies.explanations(F.col("r"))).collect()
    assert sorted(r.explanation_en[:7] for r in rows) == ["Matches", "c"]


def test_reply_parsers(spark):
    sem = one(spark, '```json\n{"is_semantically_consistent": false, "confidence": 7, "issues": ["a", " "]}\n```', replies.semantic)
    assert (sem.ok, sem.confidence, sem.issues) == (False, 1.0, ["a"])
    sem = one(spark, "nothing", replies.semantic)
    assert (sem.ok, sem.confidence, sem.issues) == (True, 0.5, [])
    emo = one(spark, 'Well {"emotional_state": "ENGAGED", "confidence": "x", "survey_action": "dance"}', lambda c: replies.emotion(c, F.lit("stressed"), F.lit(0.3), F.lit(0.3)))
    assert (emo.state, emo.confidence, emo.action, emo.adapted_prompt_en) == ("engaged", 0.3, "continue", emotion.PROMPTS["engaged"]["en"])
    two = one(spark, '{"en": "x"}', lambda c: replies.bilingual(c, ("en", "ar"), (F.lit("t"), F.lit("u"))))
    assert (two.en, two.ar) == ("t", "u")


def test_sessions(spark):
    s = spark.createDataFrame([(1, 7, "in_progress", None), (2, 7, "completed", datetime(2024, 1, 1))], "id long, user_id long, status string, completed_at timestamp_ntz")
    now = datetime(2024, 2, 1)
    assert [r.completed_at for r in sessions.complete(s, s, now).orderBy("id").collect()] == [now, datetime(2024, 1, 1)]
    assert sessions.owned(s, 1, 8).count() == 0 and sessions.open_sessions(s).count() == 1
    codes = spark.createDataFrame([(1, 7, "111", now, False)], "id long, user_id long, code string, expires_at timestamp_ntz, is_used boolean")
    codes = sessions.store_code(codes, 7, "222", now, 2)
    assert sessions.valid_code(codes, 7, "111", datetime(2024, 1, 1)).count() == 0 and sessions.valid_code(codes, 7, "222", now).count() == 1
    assert sessions.valid_code(sessions.use_code(codes, 7, "222", now), 7, "222", now).count() == 0
    rows = sessions.persist_fields(spark.createDataFrame([(1, {"a": "x", "b": ""})], "session_id long, data map<string,string>")).collect()
    assert [(r.question_id, r.answer) for r in rows] == [("a", "x")]
    turns = spark.createDataFrame([(1, [("nurse", "JOB_TITLE"), ("bank", "INDUSTRY")])], "session_id long, entities array<struct<text:string,label:string>>")
    coded = spark.createDataFrame([("nurse", "2221", 0.9)], "text string, code string, confidence double")
    assert sessions.persist_titles(turns, coded).first().isco_code == "2221"


def test_provider_sees_only_gated_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    out = providers.complete(df, F.col("t"), F.col("id") == 1, lambda xs: [x.upper() for x in xs])
    assert sorted((r.id, r.reply) for r in out.collect()) == [(1, "A"), (2, None)]

    def broken(xs):
        raise RuntimeError

    assert providers.complete(df, F.col("t"), F.lit(True), broken).where("reply is null").count() == 2
    with pytest.raises(ValueError):
        providers.settings("odd")
    with pytest.raises(EnvironmentError):
        providers.settings("critical")
    vec = providers.embed(df, F.col("t"), lambda xs: [[3.0, 4.0]] * len(xs)).first().embedding
    assert vec == [0.6, 0.8]


def test_key_value_documents(spark, tmp_path):
    docs = tables.documents_as_json(spark.createDataFrame([(1, "greeting", 2)], "id long, state string, n int"), "id")
    bad = docs.unionByName(spark.createDataFrame([(2, "not json")], "id long, doc string"))
    rows = {r.id: r.state for r in tables.from_documents(bad, "id", "state string, n int").collect()}
    assert rows == {1: "greeting", 2: None}
    path = str(tmp_path / "t")
    assert tables.ensure(spark, docs, path).count() == 1 and tables.ensure(spark, bad, path).count() == 1
    tables.append(docs, path)
    assert spark.read.parquet(path).count() == 2




def test_a_provider_with_too_few_or_too_many_replies_gives_none(spark):
    df = spark.range(128).coalesce(1).select("id", F.col("id").cast("string").alias("p"))
    short = lambda texts: texts[:-1] if "0" in texts else [*texts, "x"] if "70" in texts else texts

    def broken(texts):
        yield "one"
        raise RuntimeError

    assert {r.reply for r in providers.complete(df, F.col("p"), F.lit(True), short).collect()} == {None}
    assert {r.reply for r in providers.complete(df, F.col("p"), F.lit(True), broken).collect()} == {None}
    assert all(r.reply == r.p for r in providers.complete(df, F.col("p"), F.lit(True), lambda texts: texts).collect())
    with pytest.raises(Exception, match="64 texts gave 63 vectors"):
        providers.embed(df, F.col("p"), lambda texts: [[1.0]] * (len(texts) - 1)).collect()
