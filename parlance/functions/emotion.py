"""Rule-based emotion scores, signals, actions and prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .script import bound

STATES = ("stressed", "confused", "frustrated", "engaged")

# Patterns by state, case ignored, in this order.
PATTERNS: dict[str, list[str]] = {
    "stressed": [
        r"\bstress(ed)?\b", r"\boverwhelm(ed)?\b", r"\banxious\b", r"\bworried\b", r"\bnervous\b", r"\bpanic(k?ing|k?ed|ky)?\b",
        r"\btoo much\b", r"\bcan'?t (take|handle|cope)\b", r"\bexhausted?\b", r"\bburn(ed|t)? out\b",
        r"\bunder (a lot of )?pressure\b", r"\bscared\b",
        "متوتر", "مرهق", "قلق", "خائف", "ضغط نفسي", "منهك", "مضغوط", "مرعوب",
    ],
    "confused": [
        r"\bconfus(ed|ing)\b", r"\bdon'?t understand\b", r"\bwhat do you mean\b", r"\bnot sure (what|how|why)\b", r"\bunclear\b",
        r"\bi'?m lost\b", r"\bi don'?t know\b", r"\bhelp me understand\b", r"\bmakes? no sense\b", r"\bdon'?t get it\b",
        "لا أفهم", "لا أعرف", "ماذا تقصد", "غير واضح", "محتار", "مش فاهم", "مو واضح", "مبهم",
    ],
    "frustrated": [
        r"\bfrustrat(ed|ing)\b", r"\bann?oy(ed|ing)\b", r"\btired of (this|the|these)\b", r"\bstop (it|asking|this)\b", r"\benough\b",
        r"\bpointless\b", r"\bwaste of (my |your )?time\b", r"\bthis is ridiculous\b", r"\bleave me alone\b",
        r"\bI (hate|can'?t stand) this\b",
        "محبط", "مستاء", "تعبت من", "كفاية", "اتركني", "ملل", "مزعج", "سخيف", "ما فائدة",
    ],
    "engaged": [
        r"\bhappy to (help|answer|continue|participate)\b", r"\bglad to\b", r"\bof course\b", r"\bcertainly\b", r"\bwith pleasure\b",
        r"\bexcited?\b", r"\binterested?\b", r"\bno problem\b", r"\bsounds good\b", r"\blook forward\b",
        "بكل سرور", "بالتأكيد", "طبعًا", "ممتاز", "لا مشكلة", "مع السرور", "يسعدني", "أهلًا وسهلًا",
    ],
}
KEYWORD, PUNCTUATION, CAPS, THRESHOLD, STRONG = 0.30, 0.20, 0.25, 0.20, 0.60

# Prompt and support message by state and language.
PROMPTS: dict[str, dict[str, str]] = {
    "stressed": {
        "en": "I understand this may feel like a lot right now. Let's take it slowly — there is absolutely no rush, and we can pause at any time.",
        "ar": "أفهم أن هذا قد يبدو كثيرًا في الوقت الحالي. دعنا نأخذها بهدوء — لا يوجد أي تسرع، ويمكننا التوقف في أي وقت.",
    },
    "confused": {
        "en": "I notice this might be unclear — let me rephrase the question. Please feel free to ask me to explain anything at any point.",
        "ar": "أرى أن هذا قد يكون غير واضح — دعني أعيد صياغة السؤال. لا تتردد في طلب توضيح أي شيء في أي وقت.",
    },
    "frustrated": {
        "en": "I hear you, and I truly appreciate your patience. Let's keep this as simple and brief as possible.",
        "ar": "أسمعك، وأقدّر صبرك حقًا. دعنا نجعل هذا بسيطًا وموجزًا قدر الإمكان.",
    },
    "neutral": {
        "en": "Thank you for your response. Let's continue with the next question.",
        "ar": "شكرًا لإجابتك. لنكمل السؤال التالي.",
    },
    "engaged": {"en": "Thank you — that is very helpful! Let's continue.", "ar": "شكرًا — هذا مفيد جدًا! لنكمل."},
}
SUPPORT: dict[str, dict[str, str]] = {
    "stressed": {
        "en": "Your participation is entirely voluntary. You can stop or take a break at any time — we truly appreciate your time.",
        "ar": "مشاركتك طوعية تمامًا. يمكنك التوقف أو أخذ استراحة في أي وقت — نحن نقدّر وقتك حقًا.",
    },
    "confused": {
        "en": "There are no wrong answers here. Just share what you know, and I will guide you through each step.",
        "ar": "لا توجد إجابات خاطئة هنا. فقط شاركنا ما تعرفه وسأرشدك في كل خطوة.",
    },
    "frustrated": {
        "en": "Thank you for bearing with us. Your input genuinely contributes to important national employment research.",
        "ar": "شكرًا لتحملّك معنا. مساهمتك تُسهم فعلًا في أبحاث التوظيف الوطنية المهمة.",
    },
    "neutral": {
        "en": "Your responses are helping us understand employment conditions in your region.",
        "ar": "إجاباتك تساعدنا على فهم أوضاع التوظيف في منطقتك.",
    },
    "engaged": {
        "en": "Your detailed responses are extremely valuable for our research — thank you!",
        "ar": "إجاباتك التفصيلية ذات قيمة كبيرة لأبحاثنا — شكرًا لك!",
    },
}

#: What a word in capitals may consist of, a superset that is cheap to find.
_CAPS_RUN = r"(?U)(?<!\S)[\p{L}&&[^a-z]]{3,}(?!\S)"


def _caps(text: Column) -> Column:
    """Words of three or more letters, all capitals."""
    found = F.regexp_extract_all(text, F.lit(_CAPS_RUN), F.lit(0))
    return F.filter(found, lambda w: (F.upper(w) == w) & (F.lower(w) != w))


#: All patterns in their order, and the first and last place of each state's.
ORDERED = [p for s in STATES for p in PATTERNS[s]]
SPANS = {s: (sum(len(PATTERNS[x]) for x in STATES[:at]), sum(len(PATTERNS[x]) for x in STATES[: at + 1]) - 1) for at, s in enumerate(STATES)}


def one_pass(patterns: list[str]) -> str:
    """One pattern that finds, at each place of a text, the match of any of the patterns that begins there.

    Patterns of whole words are tried at word boundaries only, all are told apart by their first letter before the rest is tried, and
    nothing is consumed, so matches that overlap are all found. Group 1 is the match. No two patterns may match at one place.
    """

    def by_letter(some: list[str]) -> str:
        letters: dict[str, list[str]] = {}
        for p in some:
            letters.setdefault(p[0].lower(), []).append(p[1:])
        return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in letters.items())

    bare = [p.removeprefix(r"\b").removesuffix(r"\b") for p in patterns if p.startswith(r"\b")]
    rest = [p for p in patterns if not p.startswith(r"\b")]
    return rf"(?iU)(?=(\b(?:{by_letter(bare)})\b|{by_letter(rest)}))"


def matches(text: Column, patterns: list[str] = ORDERED) -> Column:
    """array<struct<pattern, text>>: the first match of each pattern that matches, in the order of the patterns; the text is walked once."""

    def which(hit: Column) -> Column:
        return F.coalesce(*(F.when(hit.rlike(f"(?iU)^(?:{p})$"), at) for at, p in enumerate(patterns)))

    def first(placed: Column) -> Column:
        kept = F.filter(placed, lambda x, at: (at == 0) | (F.get(placed, at - 1)["pattern"] != x["pattern"]))
        return F.transform(kept, lambda x: F.struct(x["pattern"].alias("pattern"), x["text"].alias("text")))

    def ordered(hits: Column) -> Column:
        placed = F.transform(hits, lambda hit, at: F.struct(which(hit).alias("pattern"), at.alias("nth"), hit.alias("text")))
        return F.when(F.size(hits) == 0, F.array().cast("array<struct<pattern:int,text:string>>")).otherwise(bound(F.array_sort(placed), first))

    return bound(F.regexp_extract_all(text, F.lit(one_pass(patterns)), F.lit(1)), ordered)


def scores(text: Column) -> Column:
    """struct of a score for each state, 0 to 1 to four places."""
    bang = F.when(text.rlike("!{3,}"), PUNCTUATION).otherwise(0.0)
    ask = F.when(text.rlike(r"\?{3,}"), PUNCTUATION).otherwise(0.0)
    caps = F.when(F.size(_caps(text)) >= 2, CAPS).otherwise(0.0)

    def all_states(b: Column) -> Column:
        extra = {"stressed": b["bang"], "confused": b["ask"], "frustrated": b["bang"] + b["caps"], "engaged": F.lit(0.0)}

        def state(name: str) -> Column:
            hits = F.size(F.filter(b["hits"], lambda h: h["pattern"].between(*SPANS[name])))
            return F.round(F.least(F.lit(1.0), hits * KEYWORD + extra[name]), 4).alias(name)

        return F.struct(*map(state, STATES))

    once = F.struct(matches(text).alias("hits"), bang.alias("bang"), ask.alias("ask"), caps.alias("caps"))
    return F.when(text.isNotNull(), bound(once, all_states))


def verdict(score: Column) -> Column:
    """struct(state, confidence, intensity) of a struct of scores: the first of the largest, neutral below the threshold."""
    def of(x: Column) -> Column:
        best = x["best"]
        state = F.coalesce(*(F.when(x["score"][s] == best, s) for s in STATES))
        calm = best < THRESHOLD
        return F.struct(
            F.when(calm, "neutral").otherwise(state).alias("state"),
            F.when(calm, 1.0).otherwise(F.least(best, F.lit(0.95))).alias("confidence"),
            F.when(calm, 0.0).otherwise(F.least(best, F.lit(1.0))).alias("intensity"),
        )

    return bound(bound(score, lambda x: F.struct(x.alias("score"), F.greatest(*(x[s] for s in STATES)).alias("best"))), of)


def signals(text: Column) -> Column:
    """array<struct<type, text, weight>>: the first match of each pattern in order, then punctuation and capitals."""

    def signal(kind: str, found: Column, weight: float) -> Column:
        return F.struct(F.lit(kind).alias("type"), found.alias("text"), F.lit(weight).alias("weight"))

    def found(b: Column) -> Column:
        words = F.transform(b["hits"], lambda h: signal("keyword", h["text"], KEYWORD))
        rest = [
            F.when(b["text"].rlike("!{3,}"), signal("punctuation", F.lit("!!!"), PUNCTUATION)),
            F.when(b["text"].rlike(r"\?{3,}"), signal("punctuation", F.lit("???"), PUNCTUATION)),
            F.when(F.size(b["caps"]) >= 2, signal("caps", F.array_join(F.slice(b["caps"], 1, 3), " "), CAPS)),
        ]
        return F.concat(words, F.array_compact(F.array(*rest)))

    once = F.struct(text.alias("text"), matches(text).alias("hits"), _caps(text).alias("caps"))
    return F.when(text.isNotNull(), bound(once, found))


# Action and reason by state, for a strong and for a mild degree.
ACTIONS: dict[str, tuple[tuple[str, str], tuple[str, str]]] = {
    "confused": (("pause", "Significant confusion detected; offer a short break or clarification."),
                 ("slow_down", "Mild confusion detected; simplify the question wording.")),
    "stressed": (("pause", "High stress detected; offer a short break."),
                 ("slow_down", "Mild stress detected; proceed more gently and reassure the respondent.")),
    "frustrated": (("end", "Significant frustration detected; recommend ending the session respectfully."),
                   ("slow_down", "Mild frustration detected; acknowledge feelings and simplify.")),
}
CALM = ("continue", "Respondent is calm and cooperative; proceed normally.")


def action(state: Column, intensity: Column) -> Column:
    """struct(action, reason) for a state and its intensity."""

    def to(pair: tuple[str, str]) -> Column:
        return F.struct(F.lit(pair[0]).alias("action"), F.lit(pair[1]).alias("reason"))

    out = to(CALM)
    for name, (strong, mild) in ACTIONS.items():
        out = F.when(state == name, F.when(intensity >= STRONG, to(strong)).otherwise(to(mild))).otherwise(out)
    return out


def message(table: dict[str, dict[str, str]], state: Column, lang: str | Column) -> Column:
    """The prompt or support message of a state, in one language or that of a column (Arabic if ar, else English)."""
    if isinstance(lang, str):
        out = F.lit(None).cast("string")
        for name, by in table.items():
            out = F.when(state == name, by[lang]).otherwise(out)
        return out
    return F.when(lang == "ar", message(table, state, "ar")).otherwise(message(table, state, "en"))
