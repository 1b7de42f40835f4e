"""Parsers of language-model replies. Anything that is not the JSON wanted gives the fallback; nothing raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import stripped

# The entity labels that are kept.
LABELS = ["JOB_TITLE", "ORGANIZATION", "LOCATION", "INDUSTRY", "EMPLOYMENT_STATUS", "DURATION", "HOURS", "PERSON"]


def _bare(raw: Column) -> Column:
    return stripped(F.regexp_replace(F.coalesce(raw, F.lit("")), r"^```(?:json)?\s*|\s*```$", ""))


def _json(raw: Column, opening: str, pattern: str) -> Column:
    """The reply's JSON text of the wanted kind, whole or the widest that begins and ends with its brackets; else null."""
    bare = _bare(raw)

    def good(text: Column) -> Column:
        return F.when(F.try_parse_json(text).isNotNull() & text.startswith(opening), text)

    inner = F.regexp_extract(bare, pattern, 0)
    whole = F.try_parse_json(bare).isNotNull()
    return F.when(whole, good(bare)).otherwise(good(inner))


def json_object(raw: Column) -> Column:
    """Text of a JSON object in the reply, code fences and prose around it removed; null if there is none."""
    return _json(raw, "{", r"(?s)\{.*\}")


def json_array(raw: Column) -> Column:
    return _json(raw, "[", r"(?s)\[.*\]")


def text_field(obj: Column, key: str) -> Column:
    """A field of a JSON object as text without outer white space; empty if absent."""
    return stripped(F.coalesce(F.get_json_object(obj, f"$.{key}"), F.lit("")))


def entities(raw: Column, original: Column) -> Column:
    """array<struct<text, label, language, start, end>>: entries with a text and a known label; offsets of the first occurrence."""
    items = F.from_json(json_array(raw), "array<struct<text:string,label:string,language:string>>")

    def item(x: Column) -> Column:
        text, lang = stripped(x["text"]), F.lower(stripped(F.coalesce(x["language"], F.lit("en"))))
        at = F.call_function("position", text, original) - 1
        found = at >= 0
        return F.struct(
            text.alias("text"), F.upper(stripped(x["label"])).alias("label"), F.when(lang.isin("en", "ar"), lang).otherwise("en").alias("language"),
            F.when(found, at).alias("start"), F.when(found, at + F.length(text)).alias("end"),
        )

    kept = F.filter(items, lambda x: (stripped(F.coalesce(x["text"], F.lit(""))) != "") & F.upper(stripped(F.coalesce(x["label"], F.lit("")))).isin(LABELS))
    none = F.array().cast("array<struct<text:string,label:string,language:string,start:int,end:int>>")
    return F.coalesce(F.transform(kept, item), none)


def selection(raw: Column, codes: Column) -> Column:
    """struct(code, reasoning): the code selected if it is among the candidates (array, best first), else the best one."""
    obj = json_object(raw)
    code, why = text_field(obj, "selected_code"), text_field(obj, "reasoning")
    known = F.array_contains(codes, code)
    return F.struct(
        F.when(known, code).otherwise(F.get(codes, 0)).alias("code"),
        F.when(known, F.when(why != "", why).otherwise("Selected by LLM classifier."))
        .otherwise("Fallback to top semantic match (LLM response could not be parsed).").alias("reasoning"),
    )


def _clamped(text: Column, default: Column) -> Column:
    x = text.try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))).otherwise(default)


def semantic(raw: Column) -> Column:
    """struct(ok, confidence, issues, explanation_en, explanation_ar) of a consistency verdict."""
    obj = json_object(raw)
    ok = F.get_json_object(obj, "$.is_semantically_consistent")
    issues = F.from_json(F.get_json_object(obj, "$.issues"), "array<string>")
    return F.struct(
        F.coalesce(~F.lower(ok).isin("false", "0", "", "[]", "{}", "0.0"), F.lit(True)).alias("ok"),
        _clamped(F.get_json_object(obj, "$.confidence"), F.lit(0.5)).alias("confidence"),
        F.coalesce(F.filter(issues, lambda i: stripped(i) != ""), F.array().cast("array<string>")).alias("issues"),
        text_field(obj, "explanation_en").alias("explanation_en"), text_field(obj, "explanation_ar").alias("explanation_ar"),
    )


def bilingual(raw: Column, keys: tuple[str, str], fallback: tuple[Column, Column]) -> Column:
    """struct(en, ar): both texts of the reply, or both of the template if either is missing."""
    obj = json_object(raw)
    en, ar = text_field(obj, keys[0]), text_field(obj, keys[1])
    both = (en != "") & (ar != "")
    return F.struct(F.when(both, en).otherwise(fallback[0]).alias("en"), F.when(both, ar).otherwise(fallback[1]).alias("ar"))


def emotion(raw: Column, state: Column, confidence: Column, intensity: Column) -> Column:
    """struct of an emotion reply, each field that is missing or wrong replaced by the rules' value or the template."""
    from . import emotion as rules

    obj = json_object(raw)
    said = F.lower(text_field(obj, "emotional_state"))
    new = F.when(said.isin("neutral", *rules.STATES), said).otherwise(state)
    level = _clamped(F.get_json_object(obj, "$.intensity"), intensity)
    due = rules.action(new, level)
    act, why = F.lower(text_field(obj, "survey_action")), text_field(obj, "action_reason")

    def field(key: str, fallback: Column) -> Column:
        got = text_field(obj, key)
        return F.when(got != "", got).otherwise(fallback).alias(key)

    return F.struct(
        new.alias("state"), _clamped(F.get_json_object(obj, "$.confidence"), confidence).alias("confidence"), level.alias("intensity"),
        F.when(act.isin("continue", "slow_down", "pause", "end"), act).otherwise(due["action"]).alias("action"),
        F.when(why != "", why).otherwise(due["reason"]).alias("reason"),
        *(field(f"adapted_prompt_{x}", rules.message(rules.PROMPTS, new, x)) for x in ("en", "ar")),
        *(field(f"support_message_{x}", rules.message(rules.SUPPORT, new, x)) for x in ("en", "ar")),
    )


def explanations(raw: Column) -> Column:
    """map<code, struct<en, ar>> of explanations; later entries of a code win, entries without code or English text are dropped."""
    items = F.from_json(json_array(raw), "array<struct<code:string,explanation_en:string,explanation_ar:string>>")
    kept = F.filter(items, lambda x: (stripped(F.coalesce(x["code"], F.lit(""))) != "") & (stripped(F.coalesce(x["explanation_en"], F.lit(""))) != ""))
    empty = F.map_from_entries(F.array().cast("array<struct<k:string,v:struct<en:string,ar:string>>>"))

    def add(acc: Column, x: Column) -> Column:
        code = stripped(x["code"])
        pair = F.struct(stripped(x["explanation_en"]).alias("en"), stripped(F.coalesce(x["explanation_ar"], F.lit(""))).alias("ar"))
        return F.map_concat(F.map_filter(acc, lambda k, _: k != code), F.create_map(code, pair))

    return F.aggregate(F.coalesce(kept, F.array().cast("array<struct<code:string,explanation_en:string,explanation_ar:string>>")), empty, add)
