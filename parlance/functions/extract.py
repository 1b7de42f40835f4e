"""Stateless candidates for interview fields, and the ambiguity and confirmation predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import stripped

FIELDS = ("employment_status", "job_title", "industry", "hours_per_week", "employment_type")

# Keywords of the fields, in the order in which they are tried.
STATUS: dict[str, list[str]] = {
    "unemployed": ["unemployed", "looking for work", "عاطل", "أبحث عن عمل"],
    "employed": ["employed", "working", "موظف", "أعمل", "أنا أعمل"],
    "not_in_labour_force": ["retired", "student", "housewife", "متقاعد", "طالب", "ربة منزل"],
}
HOURS = r"(\d+)\s*(?:hours?|hrs?|ساعات?|ساعة)"
TYPES: dict[str, str] = {
    "full_time": r"full[\s-]?time|دوام كامل",
    "part_time": r"part[\s-]?time|دوام جزئي",
    "self_employed": r"self[\s-]?employ|freelanc|عمل حر|مستقل",
}
PROFESSIONS = [
    "engineer", "manager", "director", "teacher", "professor", "doctor", "nurse", "driver", "analyst", "developer", "accountant",
    "officer", "architect", "consultant",
    "مهندس", "مدير", "معلم", "أستاذ", "طبيب", "ممرض", "سائق", "محلل", "مطور", "محاسب", "مسؤول", "مهندس معماري",
]
SECTORS: dict[str, list[str]] = {
    "technology": ["software", "tech", "it ", "technology", "تقنية", "برمجة", "معلومات"],
    "healthcare": ["hospital", "clinic", "health", "medical", "صحة", "مستشفى", "عيادة"],
    "education": ["school", "university", "college", "teach", "تعليم", "مدرسة", "جامعة"],
    "construction": ["construction", "build", "infrastructure", "بناء", "مقاولات", "تشييد"],
    "retail_trade": ["shop", "store", "retail", "trade", "تجزئة", "تجارة", "محل"],
    "government": ["government", "ministry", "public sector", "civil service", "حكومة", "وزارة", "قطاع عام", "خدمة مدنية"],
    "finance": ["bank", "finance", "insurance", "investment", "بنك", "مالية", "تأمين"],
    "manufacturing": ["factory", "manufactur", "production", "مصنع", "إنتاج", "تصنيع"],
}
VAGUE = ["yes", "no", "ok", "okay", "sure", "fine", "نعم", "لا", "حسنًا", "موافق", "طيب"]
CONFIRMATIONS: dict[str, list[str]] = {
    "en": ["yes", "right", "confirm", "that's right", "that's correct", "looks good", "all good", "perfect", "exactly", "yep", "yup", "sure", "absolutely"],
    "ar": ["نعم", "صحيح", "موافق", "تأكيد", "هذا صحيح", "كل شيء صحيح", "ممتاز", "بالضبط", "أجل", "طبعًا"],
}


def _has(lower: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | lower.contains(w)
    return out


def _first(lower: Column, table: dict[str, list[str]]) -> Column:
    return F.coalesce(*(F.when(_has(lower, words), name) for name, words in table.items()))


def candidates(text: Column) -> dict[str, Column]:
    """What each field would be set to by this message alone; null where nothing is said."""
    lower = F.lower(text)
    hours = F.regexp_extract(lower, HOURS, 1)
    return {
        "employment_status": _first(lower, STATUS),
        "job_title": F.when(_has(lower, PROFESSIONS), stripped(text)),
        "industry": _first(lower, SECTORS),
        "hours_per_week": F.when(hours != "", hours),
        "employment_type": F.coalesce(*(F.when(lower.rlike(p), name) for name, p in TYPES.items())),
    }


def ambiguous(text: Column) -> Column:
    """Shorter than five characters, or a vague word alone."""
    bare = stripped(text)
    return (F.length(bare) < 5) | F.lower(bare).isin(VAGUE)


def confirmed(text: Column, lang: str) -> Column:
    """Some confirmation of the language as whole words."""
    any_of = "|".join(CONFIRMATIONS[lang])
    return F.lower(stripped(text)).rlike(rf"(?U)\b(?:{any_of})\b")
