"""Interview turns: per-turn features, the state machine replayed in order, and the whole turn result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import emotion, extract, rules, script
from ..operators import audit, memory, quality
from ..sources import shared
from . import machine

#: Turn numbers of a block; blocks of a session are replayed in parallel once the place at which each begins is known.
BLOCK = 1024
#: Maps of blocks that one task composes.
FAN = 8


def features(turns: DataFrame, text: str = "text") -> DataFrame:
    """turns(session_id, turn, text) with field candidates, predicates and the detected language; all without a shuffle."""
    t = F.coalesce(F.col(text), F.lit(""))
    return turns.withColumns({
        **extract.candidates(t), "ambiguous": extract.ambiguous(t), "confirmed_en": extract.confirmed(t, "en"),
        "confirmed_ar": extract.confirmed(t, "ar"), "detected": script.language(t)["language"],
    })


def _same(key: str, right: str) -> Column:
    return F.col(key).eqNullSafe(F.col(right))


def blocks(feats: DataFrame, key: str, size: int) -> DataFrame:
    """(key, block, turns): the turns' kinds and offered fields (never their texts) of each stretch of ``size`` turn numbers, in order; null turns first."""
    at = F.coalesce(F.floor(F.col("turn") / size), F.lit(-(2**40)))
    rows = feats.select(key, F.col("turn").cast("bigint").alias("turn"), machine.kind().alias("kind"), *extract.FIELDS)
    return rows.groupBy(key, at.alias("block")).agg(F.array_sort(F.collect_list(F.struct("turn", "kind", *extract.FIELDS))).alias("turns"))


def entries(maps: DataFrame, key: str) -> DataFrame:
    """(key, block, entry): where each block begins, by a prefix scan over maps (key, block, exits).

    Neighbouring maps are composed in groups of 2^FAN until each session has one; then the places are carried down again, each group
    from where it begins. No task holds more than a group.
    """
    levels = [maps]
    while not (top := levels[-1]).groupBy(key).count().where("count > 1").isEmpty():
        whole = F.array(*map(F.lit, range(machine.PLACES))).cast("array<smallint>")
        run = F.array_sort(F.collect_list(F.struct("block", "exits")))
        joined = F.aggregate("run", whole, lambda acc, m: F.transform(acc, lambda place: F.get(m["exits"], place.cast("int"))))
        grouped = top.groupBy(key, F.shiftright("block", FAN).alias("block")).agg(run.alias("run"))
        levels.append(shared.cut(grouped.select(key, "block", joined.alias("exits"))))
    out = levels[-1].select(key, "block", F.lit(machine.START).alias("entry"))
    log = "array<struct<block:bigint,entry:int>>"
    for level in levels[-2::-1]:
        up = out.select(F.col(key).alias("_k"), F.col("block").alias("_b"), "entry")
        down = level.groupBy(key, F.shiftright("block", FAN).alias("_up")).agg(F.array_sort(F.collect_list(F.struct("block", "exits"))).alias("run"))
        down = down.join(up, _same(key, "_k") & (F.col("_up") == F.col("_b")))
        begin = F.struct(F.col("entry").alias("now"), F.array().cast(log).alias("log"))

        def passed(acc: Column, m: Column) -> Column:
            here = F.array(F.struct(m["block"].alias("block"), acc["now"].alias("entry")))
            return F.struct(F.get(m["exits"], acc["now"]).cast("int").alias("now"), F.concat(acc["log"], here).cast(log).alias("log"))

        out = shared.cut(down.select(key, F.explode(F.aggregate("run", begin, passed)["log"]).alias("e")).select(key, "e.*"))
    return out


def _walked(language: str, restart: bool, last: bool):
    """Blocks with the place and values at which they begin to a row after every turn; with ``last`` to the values that each block sets, by its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(6 + len(extract.FIELDS))]
            for at in range(len(b)):
                turns = b.column("turns")[at].as_py()
                place, values = b.column("entry")[at].as_py(), [b.column(f"from_{f}")[at].as_py() for f in extract.FIELDS]
                for nth, turn in enumerate(turns):
                    place, values = machine.step(place, values, turn["kind"], [turn[f] for f in extract.FIELDS], language, restart)
                    if not last or nth == len(turns) - 1:
                        row = (at, b.column("block")[at].as_py(), nth, turn["turn"], machine.state_of(place), machine.language_of(place, language), *values)
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.string()] * (2 + len(extract.FIELDS))]
            arrays = [pa.array(v, k) for v, k in zip(out[1:], kinds, strict=True)]
            key = b.column(0).take(pa.array(out[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([key, *arrays], names=[b.schema.names[0], "block", "nth", "turn", "state", "language", *extract.FIELDS])

    return run


def _replayed(feats: DataFrame, key: str, language: str, restart: bool, size: int) -> DataFrame:
    """(key, block, nth, turn, state, language, fields...) after every turn."""
    kind = f"{key} {feats.schema[key].dataType.simpleString()}, block bigint, nth bigint, turn bigint, state string, language string, "
    kind += ", ".join(f"{f} string" for f in extract.FIELDS)
    nothing = {f"from_{f}": F.lit(None).cast("string") for f in extract.FIELDS}
    cut_up = shared.cut(blocks(feats, key, size))
    many = shared.cut(cut_up.groupBy(key).count().where("count > 1").select(F.col(key).alias("_k")))
    if many.isEmpty():
        return cut_up.withColumns({"entry": F.lit(machine.START), **nothing}).mapInArrow(_walked(language, restart, False), kind)
    single = cut_up.join(many, _same(key, "_k"), "left_anti").withColumns({"entry": F.lit(machine.START), **nothing})

    @F.pandas_udf("array<smallint>")
    def exits(kinds: pd.Series) -> pd.Series:
        return pd.Series([machine.mapped(k, language, restart) for k in kinds])

    long = cut_up.join(many, _same(key, "_k"), "left_semi")
    begun = entries(shared.cut(long.select(key, "block", exits("turns.kind").alias("exits"))), key).withColumnsRenamed({key: "_k", "block": "_b"})
    long = long.join(begun, _same(key, "_k") & (F.col("block") == F.col("_b"))).drop("_k", "_b")
    # A field that has a value where a block begins has the one that was set last before it.
    ends = long.withColumns(nothing).mapInArrow(_walked(language, restart, True), kind)
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(F.col(key).alias("_k"), F.col("block").alias("_b"), *[F.last(f, ignorenulls=True).over(before).alias(f"from_{f}") for f in extract.FIELDS])
    long = long.join(shared.cut(carried), _same(key, "_k") & (F.col("block") == F.col("_b"))).drop("_k", "_b")
    has = {f"from_{f}": F.when(F.col("entry").bitwiseAND(1 << at) > 0, F.col(f"from_{f}")) for at, f in enumerate(extract.FIELDS)}
    return single.unionByName(long.withColumns(has)).mapInArrow(_walked(language, restart, False), kind)


def replay(feats: DataFrame, key: str = "session_id", language: str = "en", restart: bool = False, size: int = BLOCK) -> DataFrame:
    """(session_id, turn, state, language, fields...) after every turn: first values win, fields are read while collecting or clarifying.

    Sessions are cut into blocks of turns, so a session of any length is replayed in parallel: each block is first a map from the places
    at which it may begin to those at which it ends, and a prefix scan over these maps says where it does begin.
    With ``restart`` a turn after the completing one begins a new interview, as where the session's context is dropped then.
    """
    return _replayed(feats, key, language, restart, size).drop("block", "nth")


def final(feats: DataFrame, key: str = "session_id", language: str = "en", size: int = BLOCK) -> DataFrame:
    """One row for each session: its last state."""
    rows = _replayed(feats, key, language, False, size)
    last = F.max_by(F.struct("state", "language", *extract.FIELDS), F.struct("block", "nth"))
    return rows.groupBy(key).agg(F.count("*").alias("n_turns"), last.alias("f")).select(key, "n_turns", "f.*")


def _described(turns: DataFrame) -> DataFrame:
    """turns with all that a text alone says: features, scripts, emotion and the language's confidence; entities are none where they lack."""
    t = F.coalesce(F.col("text"), F.lit(""))
    a, lat = script.ratios(t)
    own = features(turns).withColumns({
        "arabic_ratio": F.round(a, 4), "latin_ratio": F.round(lat, 4), "code_switched": script.code_switched(t),
        "verdict": emotion.verdict(emotion.scores(t)), "language_confidence": script.language(t)["confidence"],
    })
    return own if "entities" in turns.columns else own.withColumn("entities", _no_entities())


def _no_entities() -> Column:
    return F.array().cast("array<struct<text:string,label:string,language:string>>")


def results(turns: DataFrame, language: str = "en") -> DataFrame:
    """The turn result of every turn: language, scripts, emotion and action, state, missing fields, validation, completion.

    Where turns have ``entities`` (of a provider's reply), they are kept and counted; without them there are none. The context of
    a completed session is dropped, so a later turn begins anew.

    Features, emotion and validation are columns; the only shuffles are those of the replay and of its join back.
    """
    own = _described(turns)
    after = replay(own.drop("text"), language=language, restart=True).withColumnsRenamed({f: f"c_{f}" for f in extract.FIELDS} | {"session_id": "_s", "turn": "_t"})
    out = own.drop(*extract.FIELDS).join(after, (F.col("session_id") == F.col("_s")) & (F.col("turn") == F.col("_t"))).drop("_s", "_t")
    return _resulted(out)


def results_of(states: DataFrame) -> DataFrame:
    """The turn results of turns that were replayed already: states (session_id, turn, text, state, language, fields...)."""
    kept = states.withColumnsRenamed({f: f"c_{f}" for f in extract.FIELDS})
    return _resulted(_described(kept).drop(*extract.FIELDS))


def _resulted(out: DataFrame) -> DataFrame:
    out = out.withColumnsRenamed({f"c_{f}": f for f in extract.FIELDS})
    data = F.map_filter(F.create_map(*[x for f in extract.FIELDS for x in (F.lit(f), F.col(f))]), lambda _, v: v.isNotNull())
    out = out.withColumn("missing_fields", memory.missing(data))
    empty = F.size("missing_fields") == len(extract.FIELDS)
    checked = rules.normalised(out)
    found = rules.violations(checked)
    checked = checked.withColumn("_n", F.size(F.filter(found, lambda v: v["severity"] == "error")))
    return checked.select(
        "session_id", "turn", "language", "arabic_ratio", "latin_ratio", "code_switched", F.col("verdict.state").alias("emotion"),
        F.col("verdict.confidence").alias("emotion_confidence"),
        emotion.action(F.col("verdict.state"), F.col("verdict.intensity"))["action"].alias("survey_action"),
        emotion.message(emotion.PROMPTS, F.col("verdict.state"), F.col("detected")).alias("adapted_prompt"), "state",
        F.array_join("missing_fields", ",").alias("missing_fields"), (empty | (F.col("_n") == 0)).alias("is_valid"),
        F.when(empty, 0).otherwise(F.col("_n")).alias("n_errors"), (F.col("state") == "completing").alias("session_completed"),
        F.col("detected").alias("detected"), F.col("language_confidence"), F.coalesce(F.col("entities"), _no_entities()).alias("entities"),
    )


def audit_rows(results: DataFrame, turns: DataFrame, as_of) -> tuple[DataFrame, DataFrame]:
    """(interactions, decisions) that a turn leaves in the logs: what was said is cut to 200 characters; a completion is an event of its own."""
    now = F.lit(as_of).cast("timestamp_ntz").alias("timestamp")
    said = F.format_string("Turn in state '%s'; lang=%s; emotion=%s", "state", "detected", "emotion")
    sent = results.select("session_id", "turn", F.lit("message_sent").alias("event_type"), said.alias("description"), now)
    done = results.where("session_completed").select(
        "session_id", "turn", F.lit("session_completed").alias("event_type"), F.lit("Survey session completed by ConversationManager FSM.").alias("description"), now)
    heard = turns.select(F.col("session_id").alias("_s"), F.col("turn").alias("_t"), audit.shortened(F.col("text")).alias("input_summary"))
    both = results.join(heard, (F.col("session_id") == F.col("_s")) & (F.col("turn") == F.col("_t")))
    switched = F.when(F.col("code_switched"), "True").otherwise("False")
    decisions = both.select(
        "session_id", "turn", F.lit("LanguageProcessor").alias("agent_name"), F.lit("language_detection").alias("decision_type"), "input_summary",
        F.format_string("lang=%s, code_switched=%s, entities=%d", "detected", switched, F.size("entities")).alias("output_summary"),
        F.col("language_confidence").alias("confidence"), now,
    )
    return sent.unionByName(done), decisions


def occupation_matches(results: DataFrame, classified: DataFrame) -> DataFrame:
    """(session_id, turn, job_title, code, confidence, method): each job title among a turn's entities with its class; classified is (text, code, confidence, method)."""
    titles = results.select("session_id", "turn", F.explode(F.filter("entities", lambda e: e["label"] == "JOB_TITLE")).alias("e"))
    return titles.select("session_id", "turn", F.col("e.text").alias("job_title")).join(classified, F.col("job_title") == F.col("text")).drop("text")


def quality_reports(results: DataFrame, responses: DataFrame) -> DataFrame:
    """The quality review of each session that completes; one whose review has no responses is escalated."""
    return quality.review(results.where("session_completed").select("session_id"), responses)


def outcomes(turns: DataFrame, classified: DataFrame, responses: DataFrame) -> DataFrame:
    """The whole outcome of every turn: its result, the matches of its job titles in the order of their text, what the decision log keeps of it, and where it completes the session the quality review.

    classified is (text, code, confidence, method), a row for each title; one that it lacks has no match.
    """
    found = shared.cut(results(turns))
    matches = occupation_matches(found, classified).groupBy(F.col("session_id").alias("_s"), F.col("turn").alias("_t")).agg(
        F.array_sort(F.collect_list(F.struct("job_title", "code", "confidence", "method"))).alias("matches"))
    reviewed = quality_reports(found, responses).dropDuplicates(["session_id"]).select(F.col("session_id").alias("_q"), "status", "quality_score")
    _, decisions = audit_rows(found, turns, "2000-01-01")
    decisions = decisions.select(F.col("session_id").alias("_ds"), F.col("turn").alias("_dt"), "output_summary")
    out = found.join(matches, (F.col("session_id") == F.col("_s")) & (F.col("turn") == F.col("_t")), "left").join(
        decisions, (F.col("session_id") == F.col("_ds")) & (F.col("turn") == F.col("_dt")), "left").join(
        reviewed, F.col("session_completed") & (F.col("session_id") == F.col("_q")), "left")
    none = F.array().cast("array<struct<job_title:string,code:string,confidence:double,method:string>>")
    return out.drop("_s", "_t", "_ds", "_dt", "_q").withColumn("matches", F.coalesce("matches", none))
