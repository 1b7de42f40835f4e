"""Script and language functions on text columns (Arabic and Latin)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic blocks, digits and punctuation included.
ARABIC = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
SWITCH_SHARE = 0.10
SECOND_CHOICE = 0.30


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), 0)


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def n_arabic(text: Column) -> Column:
    beyond = F.regexp_replace(text, r"[\x00-\x7F]+", "")  # one range is searched faster than the complement of five
    return F.when(text.rlike(f"[{ARABIC}]"), F.length(F.regexp_replace(beyond, f"[^{ARABIC}]+", ""))).otherwise(F.when(text.isNotNull(), 0))


def n_latin(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))


def counted(text: Column, f: Callable[[Column, Column, Column], Column]) -> Column:
    """f of the text's numbers of Arabic and Latin characters and the share of Arabic among both (0 without any); each text is searched once."""
    def shared(n: Column) -> Column:
        a, b = n["a"], n["b"]
        return f(a, b, a / F.greatest(a + b, F.lit(1)))

    return bound(F.struct(n_arabic(text).alias("a"), n_latin(text).alias("b")), shared)


def ratios(text: Column) -> tuple[Column, Column]:
    """Shares of Arabic and Latin among the characters of both, unrounded; 0 without any."""
    both = counted(text, lambda a, b, share: F.struct(share.alias("a"), (b / F.greatest(a + b, F.lit(1))).alias("b")))
    return both["a"], both["b"]


def code_switched(text: Column) -> Column:
    return counted(text, lambda a, b, share: (share >= SWITCH_SHARE) & (b / F.greatest(a + b, F.lit(1)) >= SWITCH_SHARE))


def language(text: Column) -> Column:
    """struct(language, confidence) from the scripts alone: ar, en or other; blank text is other with 0."""
    found = counted(text, lambda a, b, share: F.when((a + b > 0) & (share >= 0.5), _lang("ar", share)).when(
        b > 0, _lang("en", 1 - share)).otherwise(_lang("other", F.lit(0.5))))
    return F.when(~text.rlike(r"(?U)\S"), _lang("other", F.lit(0.0))).otherwise(found)


def detected(found: Column, text: Column) -> Column:
    """struct(language, confidence) from a detector's guesses, array<struct<language, probability>> with the surest first; null where it failed.

    English or Arabic at the top is taken, else Arabic, then English, from a probability of 0.30; else the scripts decide.
    """
    def of(name: str) -> Column:
        return F.get(F.filter(found, lambda g: (g["language"] == name) & (g["probability"] >= SECOND_CHOICE)), 0)["probability"]

    top = F.get(found, 0)

    def taken(name: str, confidence: Column) -> Column:
        return F.struct(F.lit(name).alias("language"), F.round(confidence, 4).alias("confidence"))

    return F.coalesce(*(F.when(top["language"] == x, taken(x, top["probability"])) for x in ("ar", "en")),
                      *(F.when(of(x).isNotNull(), taken(x, of(x))) for x in ("ar", "en")), language(text))


def _lang(name: str, confidence: Column) -> Column:
    return F.struct(F.lit(name).alias("language"), F.round(confidence, 4).alias("confidence"))


def class4(text: Column) -> Column:
    """ar from 90 % Arabic, en up to 10 %, mixed between, other without either script."""
    return counted(text, lambda a, b, share: F.when(a + b == 0, "other").when(share >= 0.90, "ar").when(share <= 0.10, "en").otherwise("mixed"))


def class3(text: Column) -> Column:
    """ar from 90 % Arabic, mixed from 10 %, else en, also without either script."""
    return counted(text, lambda a, b, share: F.when(a + b == 0, "en").when(share >= 0.90, "ar").when(share >= 0.10, "mixed").otherwise("en"))


def segments(text: Column) -> Column:
    """array<struct<text, script, lang>>: runs of one script, a leading run of other characters on its own.

    Later other characters belong to the run before them. Blank runs are dropped; runs of
    four or more characters that are not other get a language.
    """
    a = f"[{ARABIC}]"
    # Character classes only: Java matches repeated groups by recursion, which long runs overflow.
    runs = F.regexp_extract_all(text, F.lit(rf"[^\p{{L}}{ARABIC}]+|{a}[{ARABIC}\P{{L}}]*|\p{{L}}[^{ARABIC}]*"), F.lit(0))

    def segment(run: Column) -> Column:
        script = F.when(run.rlike(f"^{a}"), "arabic").when(run.rlike(rf"^\p{{L}}"), "latin").otherwise("other")
        four = run.rlike(r"(?Us)\S.{2,}\S")
        # An Arabic run holds no other letters and a Latin one no Arabic ones, so the run's language follows from its script.
        lang = F.when(script == "arabic", "ar").when(script == "latin", F.when(run.rlike("[A-Za-z]"), "en").otherwise("other"))
        return F.struct(run.alias("text"), script.alias("script"), F.when(four, lang).alias("lang"))

    return F.transform(F.filter(runs, lambda r: r.rlike(r"(?U)\S")), segment)


def stable_id(code: Column) -> Column:
    """60-bit id: the first 15 hexadecimal digits of the SHA-256."""
    return F.conv(F.substring(F.sha2(code.cast("binary"), 256), 1, 15), 16, 10).cast("long")
