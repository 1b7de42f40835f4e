"""Validation rules over survey records: normalisation, ten rules, verdict and explanation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .script import stripped

ALWAYS = ("employment_status", "industry")
IF_EMPLOYED = ("employment_type", "hours_per_week", "job_title")
LOW, HIGH, EXTREME, FULL_TIME_MIN, PART_TIME_MAX = 1, 168, 80, 20, 35
ERROR, WARNING, SEMANTIC = 0.25, 0.10, 0.10
_NUMBER = r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:[eE][+-]?\d+(?:_\d+)*)?$"
_SPECIAL = r"(?i)^[+-]?(?:inf|infinity|nan)$"


def number(bare: Column) -> Column:
    """A double where a text without outer white space, its digits ASCII, is a number, grouped underscores allowed; else null. Never raises."""
    special = F.regexp_replace(F.lower(bare), "^[+]", "")
    return F.when(bare.rlike("^[0-9]{1,15}$"), bare.try_cast("double")).when(
        bare.rlike(_NUMBER), F.replace(bare, F.lit("_"), F.lit("")).try_cast("double")
    ).when(
        bare.rlike(_SPECIAL),
        F.when(special.contains("nan"), F.lit(float("nan"))).when(special.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
    )


def normalised(records: DataFrame) -> DataFrame:
    """Fields without outer white space (null as empty), status and type in lower case, hours cut to whole numbers where possible.

    ``hours_value`` is added: the hours as a number, null where they are none. Each step is a column of its own, so it is computed once.
    """
    def bare(c: str) -> Column:
        return stripped(F.coalesce(F.col(c).cast("string"), F.lit("")))

    out = {c: bare(c) for c in (*ALWAYS, *IF_EMPLOYED)}
    out |= {c: F.lower(out[c]) for c in ("employment_status", "employment_type")}
    rows = records.withColumns(out)
    rows = rows.withColumn("_digits", F.translate("hours_per_week", "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"))
    rows = rows.withColumn("_number", number(F.col("_digits")))
    rows = rows.withColumn("_whole", F.when(~F.isnan("_number"), F.col("_number")).try_cast("bigint"))
    return rows.withColumns({
        "hours_per_week": F.coalesce(F.col("_whole").cast("string"), "hours_per_week"),
        "hours_value": F.coalesce(F.col("_whole").cast("double"), "_number"),
    }).drop("_digits", "_number", "_whole")


def violations(records: DataFrame) -> Column:
    """array<struct<rule_id, field, severity, message_en, message_ar>> of a normalised record, in the order of the rules."""
    status, kind, title, raw = (F.col(c) for c in ("employment_status", "employment_type", "job_title", "hours_per_week"))
    h = F.col("hours_value")
    usable = h.isNotNull() & ~F.isnan(h)
    shown = F.when(F.abs(h) == float("inf"), F.lower(raw)).otherwise(F.format_string("%.0f", h))
    employed = status == "employed"

    def v(cond: Column, rule: str, field: str, severity: str, en: Column | str, ar: Column | str) -> Column:
        return F.when(cond, F.struct(
            F.lit(rule).alias("rule_id"), F.lit(field).alias("field"), F.lit(severity).alias("severity"),
            (F.lit(en) if isinstance(en, str) else en).alias("message_en"), (F.lit(ar) if isinstance(ar, str) else ar).alias("message_ar"),
        ))

    def s(pattern: str, *args: Column) -> Column:
        return F.format_string(pattern, *args)

    missing = [
        v((F.col(f) == "") & (F.lit(f in ALWAYS) | employed), "R01", f, "error",
          f"Required field '{f}' is missing or empty.", f"الحقل المطلوب '{f}' مفقود أو فارغ.")
        for f in sorted((*ALWAYS, *IF_EMPLOYED))
    ]
    zero = usable & (h == 0) & employed & (kind != "")
    both = usable & (kind != "") & (h >= LOW) & (h <= HIGH)
    rest = [
        v((raw != "") & h.isNull(), "R02", "hours_per_week", "error",
          s("'hours_per_week' value '%s' is not a valid number.", raw), s("قيمة ساعات العمل الأسبوعية '%s' ليست رقمًا صحيحًا.", raw)),
        v(usable & ((h < LOW) | (h > HIGH)), "R03", "hours_per_week", "error",
          s("'hours_per_week' (%s) must be between 1 and 168.", shown), s("ساعات العمل الأسبوعية (%s) يجب أن تكون بين 1 و168.", shown)),
        v(usable & (h > EXTREME), "R04", "hours_per_week", "warning",
          s("'hours_per_week' (%s) is unusually high (> 80). Please verify with the respondent.", shown),
          s("ساعات العمل الأسبوعية (%s) مرتفعة بشكل غير معتاد (أكثر من 80). يرجى التحقق مع المشارك.", shown)),
        v((status == "unemployed") & (title != ""), "R05", "job_title", "error",
          "Respondent is unemployed but a 'job_title' was provided. This contradicts the stated employment status.",
          "المشارك عاطل عن العمل لكن تم تقديم 'مسمى وظيفي'. هذا يتعارض مع حالة التوظيف المذكورة."),
        v((status == "unemployed") & usable & (h > 0), "R06", "hours_per_week", "error",
          s("Respondent is unemployed but 'hours_per_week' is %s.", shown),
          s("المشارك عاطل عن العمل لكن ساعات العمل الأسبوعية هي %s.", shown)),
        v((status == "not_in_labour_force") & (title != ""), "R07", "job_title", "error",
          "Respondent is not in the labour force but a 'job_title' was provided. This contradicts the stated status.",
          "المشارك خارج سوق العمل لكن تم تقديم 'مسمى وظيفي'. هذا يتعارض مع الحالة المذكورة."),
        v(zero, "R10", "hours_per_week", "error",
          "Respondent is employed but reported 0 hours worked per week.", "المشارك موظف لكنه أفاد بصفر ساعات عمل أسبوعيًا."),
        v(both & (kind == "full_time") & (h < FULL_TIME_MIN), "R08", "hours_per_week", "warning",
          s("Full-time employment with only %s hours/week is unusual (expected ≥ 20).", shown),
          s("العمل بدوام كامل مع %s ساعات أسبوعيًا فقط أمر غير معتاد (المتوقع ≥ 20 ساعة).", shown)),
        v(both & (kind == "part_time") & (h >= PART_TIME_MAX), "R09", "hours_per_week", "warning",
          s("Part-time employment with %s hours/week may actually be full-time (threshold: 35 h).", shown),
          s("العمل بدوام جزئي مع %s ساعات أسبوعيًا قد يكون في الواقع دوامًا كاملًا (الحد: 35 ساعة).", shown)),
    ]
    return F.array_compact(F.array(*missing, *rest))


def verdict(records: DataFrame) -> DataFrame:
    """records normalised, with violations, n_errors, n_warnings, is_valid, confidence, needs_semantic and both explanations.

    If records have columns semantic_ok, semantic_confidence and semantic_issues (of a provider's reply), they count where
    no rule fails; without them the semantic stage is taken as passed.
    """
    semantic = "semantic_ok" in records.columns
    out = normalised(records)
    out = out.withColumn("violations", violations(out))

    def of(kind: str) -> Column:
        return F.filter("violations", lambda x: x["severity"] == kind)

    out = out.withColumns({"n_errors": F.size(of("error")), "n_warnings": F.size(of("warning"))})
    clean = F.col("n_errors") == 0
    issues = F.when(clean, F.col("semantic_issues")).otherwise(F.array().cast("array<string>")) if semantic else F.array().cast("array<string>")
    issues = F.coalesce(issues, F.array().cast("array<string>"))
    raw = 1 - ERROR * F.col("n_errors") - WARNING * F.col("n_warnings") - SEMANTIC * F.size(issues)
    factor = F.when(clean, F.coalesce("semantic_confidence", F.lit(1.0))).otherwise(1.0) if semantic else F.lit(1.0)
    valid = clean & (F.coalesce("semantic_ok", F.lit(True)) if semantic else F.lit(True))

    def parts(lang: str) -> Column:
        sep = "; " if lang == "en" else "؛ "
        head = {
            "error": "%d error(s) found: %s" if lang == "en" else "تم العثور على %d خطأ(أخطاء): %s",
            "warning": "%d warning(s): %s" if lang == "en" else "%d تحذير(ات): %s",
        }
        listed = {k: F.array_join(F.transform(of(k), lambda x: x[f"message_{lang}"]), sep) for k in head}
        said = [F.when(F.size(of(k)) > 0, F.format_string(head[k], F.size(of(k)), listed[k])) for k in head]
        title = "Semantic issues: %s" if lang == "en" else "مشكلات دلالية: %s"
        said.append(F.when(F.size(issues) > 0, F.format_string(title, F.array_join(issues, "; "))))
        failed, passed = (
            ("Validation failed. ", "Validation passed with warnings. ") if lang == "en" else ("فشل التحقق. ", "نجح التحقق مع تحذيرات. ")
        )
        fine = (
            "All responses passed validation. The employment data is internally consistent and plausible."
            if lang == "en" else "اجتازت جميع الإجابات عملية التحقق. بيانات التوظيف متسقة داخليًا ومعقولة."
        )
        quiet = F.col("is_valid") & (F.col("n_warnings") == 0) & (F.size(issues) == 0)
        return F.when(quiet, fine).otherwise(F.concat(F.when(F.col("is_valid"), passed).otherwise(failed), F.concat_ws(" ", *said)))

    out = out.withColumns({
        "is_valid": valid, "needs_semantic": clean,
        "confidence": F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw * factor)), 4),
    })
    return out.withColumns({"explanation_en": parts("en"), "explanation_ar": parts("ar")})
