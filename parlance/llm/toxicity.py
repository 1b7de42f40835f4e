"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause word by word. Insult and threat emit the weight of a pattern (a
threat's in full only shortly after a word of intent), negation and reported speech scale what is
emitted while they hold, and target scales the whole clause at its end, wherever in it the target
stands. ``compose`` builds one machine of the five, so "an idiot", "you idiot", "not an idiot" and
"she said: you idiot" score apart. A document is scored by figures of its clauses, never by
isolated words.

Patterns are words and word beginnings. A few are given below; the others are learned from
labelled documents with their log odds, and a logistic layer with a prior turns the clause
figures into a probability.
"""

from __future__ import annotations

import math
import re
from heapq import nlargest

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: Words known beforehand by symbol, in four languages: a short general lexicon, not taken from any corpus.
LEXICON: dict[str, str] = {
    "insult": "idiot fool jerk imbecile bastard coward dumbass loser dummkopf trottel depp arschloch mistkerl crétin imbécile abruti connard salaud "
              "imbécil tonto estúpido cabrón gilipollas cretino",
    "threat": "kill murder destroy hurt strangle stab shoot töten umbringen verletzen erwürgen tuer frapper étrangler matar golpear destruir",
    "intent": "will gonna going shall i'll we'll werde werden wird vais allons va voy vamos",
    "target": "you your you're yourself u du dich dir dein deine ihr euch tu toi te ton ta vous tú ti usted vosotros eres",
    "negation": "not no never isn't aren't wasn't don't won't nicht kein keine nie ne pas jamais nunca jamás ni",
    "report": "said says say told called calls wrote quoted claims sagte schrieb nannte dit disait écrit dijo dice escribió llamó",
}
SYMBOLS = (*LEXICON, "other")
SEED_WEIGHT = 4.0
SCOPE = 3
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


def _fading(name: str) -> dict:
    """Moves of a machine that its symbol arms for SCOPE words."""
    return {s: {x: SCOPE if x == name else max(0, s - 1) for x in SYMBOLS} for s in range(SCOPE + 1)}


def _latched(name: str) -> dict:
    return {s: {x: 1 if x == name else s for x in SYMBOLS} for s in (0, 1)}


#: The transducers. emits: symbol and state to a share of the pattern's weight; scales: state to a factor of what is
#: emitted; ends: state to a factor of the whole clause.
TRANSDUCERS: dict[str, dict] = {
    "insult": {"moves": {0: dict.fromkeys(SYMBOLS, 0)}, "emits": {("insult", 0): 1.0}},
    "threat": {"moves": _fading("intent"), "emits": {("threat", s): 1.0 if s else 0.6 for s in range(SCOPE + 1)}},
    "negation": {"moves": _fading("negation"), "scales": {s: 0.35 for s in range(1, SCOPE + 1)}},
    "report": {"moves": _latched("report"), "scales": {1: 0.5}},
    "target": {"moves": _latched("target"), "ends": {1: 1.3}},
}
#: What stays over a colon: who is quoted.
OVER_COLON = ("report",)


def compose(machines: dict[str, dict]) -> dict:
    """One machine: states are tuples of the machines' states, reached from all zeros.

    step: state to symbol to (next state, {emitting machine: share times all scales}); end: state to the clause's factor.
    """
    names = list(machines)
    todo, step, end = [(0,) * len(names)], {}, {}
    while todo:
        state = todo.pop()
        if state in step:
            continue
        at = dict(zip(names, state, strict=True))
        scale = math.prod(m.get("scales", {}).get(at[k], 1.0) for k, m in machines.items())
        end[state] = math.prod(m.get("ends", {}).get(at[k], 1.0) for k, m in machines.items())
        step[state] = {}
        for x in SYMBOLS:
            new = tuple(m["moves"][at[k]][x] for k, m in machines.items())
            step[state][x] = (new, {k: m["emits"][x, at[k]] * scale for k, m in machines.items() if (x, at[k]) in m.get("emits", {})})
            todo.append(new)
        todo.append(tuple(s if k in OVER_COLON else 0 for k, s in at.items()))
    return {"names": names, "step": step, "end": end}


def seed_symbols() -> dict[str, tuple[str, float]]:
    """Word to its symbol and weight."""
    return {w: (x, SEED_WEIGHT if x in ("insult", "threat") else 0.0) for x, words in LEXICON.items() for w in words.split()}


def clauses(words: list[str], known: dict[str, tuple[str, float]], machine: dict) -> list[tuple[float, float, float]]:
    """(score, threat's part, weight lost to negation and report) of each clause of a text's words and marks that emits something."""
    step, end = machine["step"], machine["end"]
    zero = (0,) * len(machine["names"])
    keep = [k in OVER_COLON for k in machine["names"]]
    out, state = [], zero
    score = threat = plain = 0.0
    for w in [*words, "."]:
        if w in ENDS:
            if plain:
                out.append((score * end[state], threat * end[state], plain - score))
                score = threat = plain = 0.0
            state = tuple(s if k else 0 for s, k in zip(state, keep, strict=True)) if w == ":" else zero
            continue
        symbol, weight = known.get(w, _OTHER)
        state, emits = step[state][symbol]
        if emits:
            for k, share in emits.items():
                score += weight * share
                threat += weight * share * (k == "threat")
            plain += weight
    return out


_OTHER = ("other", 0.0)
#: Lengths of word beginnings that may become patterns.
STEMS = (3, 4, 5, 6, 7)
#: Of a document's clauses: the best score, the second, their sum, how many are strong, the best threat, the most that
#: negation and report took away, and the share of strong clauses.
FIGURES = ("best", "second", "sum", "strong", "threat", "lost", "share", "one")
STRONG = 3.0


def known_words(found: list[str], learned: dict[str, float], seeds: dict) -> dict[str, tuple[str, float]]:
    """Symbol and weight of the words that have one: given words keep their part, others are insults if a pattern fits."""
    known = {}
    for w in set(found) - ENDS:
        if w in seeds:
            known[w] = seeds[w]
            continue
        weight = max((learned.get(k, 0.0) for k in (w + "$", *(w[:n] for n in STEMS if len(w) >= n))), default=0.0)
        if weight:
            known[w] = ("insult", weight)
    return known


def _figures(text: str | None, learned: dict[str, float], machine: dict, seeds: dict) -> list[float]:
    found = WORD.findall((text or "").lower())
    known = known_words(found, learned, seeds)
    if not any(weight for _, weight in known.values()):
        return [0.0] * (len(FIGURES) - 1) + [1.0]
    got = clauses(found, known, machine)
    best, second, *_ = [*nlargest(2, (c[0] for c in got)), 0.0, 0.0]
    strong = sum(c[0] >= STRONG for c in got)
    n = 1 + sum(w in ENDS for w in found)
    return [math.log1p(best), math.log1p(second), math.log1p(sum(c[0] for c in got)), math.log1p(strong),
            math.log1p(max((c[1] for c in got), default=0.0)), math.log1p(max((c[2] for c in got), default=0.0)), strong / n, 1.0]


def figures(text: Column, learned: dict[str, float]) -> Column:
    """The clause figures of whole texts, in the order of FIGURES; null and empty texts have none but the constant."""
    machine, seeds = compose(TRANSDUCERS), seed_symbols()

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def clause_figures(texts: pd.Series) -> pd.Series:
        return pd.Series([_figures(t, learned, machine, seeds) for t in texts])

    return clause_figures(text)


def learn_patterns(rows: DataFrame, most: int = 20_000, at_least: int = 4, odds: float = 1.5) -> dict[str, float]:
    """Words and word beginnings with their log odds of a toxic document, the ``most`` that are surest; rows have text and y."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}']+"))
    parts = F.flatten(F.array(
        F.transform(words, lambda w: F.concat(w, F.lit("$"))),
        *(F.transform(F.filter(words, lambda w, n=n: F.length(w) >= n), lambda w, n=n: F.substring(w, 1, n)) for n in STEMS),
    ))
    total = rows.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    t_all, n_all = int(total[0]), int(total[1]) - int(total[0])
    stats = (
        rows.select("y", F.explode(F.array_distinct(parts)).alias("k")).groupBy("k")
        .agg(F.sum("y").alias("t"), F.sum(1 - F.col("y")).alias("n")).where(F.col("t") >= at_least)
    )
    score = F.log((F.col("t") + 0.5) / (t_all + 1)) - F.log((F.col("n") + 0.5) / (n_all + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") + 0.5))
    kept = stats.withColumn("s", score).withColumn("low", score - 2 * error).where(F.col("low") >= odds)
    got = kept.orderBy(F.desc("low"), "k").limit(most).collect()
    return {r.k: float(min(6.0, r.s)) for r in got}


def _one_of_copies(rows: DataFrame) -> DataFrame:
    """One row of those whose whole texts have the same words in the same order, case aside."""
    return rows.withColumn("print", F.xxhash64(shared.words(F.lower("text")))).dropDuplicates(["y", "print"]).drop("print")


def _logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Ridge towards the prior, by Newton steps that are halved until the loss falls."""

    def loss(b: np.ndarray) -> float:
        z = x @ b
        return float((np.logaddexp(0, z) - y * z).sum() + ridge / 2 * ((b - prior) ** 2).sum())

    beta = prior.copy()
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + ridge * np.eye(len(prior)), x.T @ (y - p) - ridge * (beta - prior))
        size = 1.0
        while loss(beta + size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta + size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", mod: int = 4, left_out: int = 2, bound: int = 12_000) -> dict:
    """Patterns and logistic coefficients from at most about ``bound`` labelled documents, two thirds for the patterns.

    Without labels of both kinds the given patterns and the prior stand alone.
    """
    rows = shared.cut(_one_of_copies(shared.fit_rows(docs, labels, label, mod, left_out, bound)))
    learned = learn_patterns(rows.where("u < 0.66"))
    got = rows.where("u >= 0.66").select(figures(F.col("text"), learned).alias("x"), "y").toPandas()
    # Prior: a strong clause at a target is toxic, two strong ones or a threat more so, a lone negated or reported one is not.
    prior = np.array([1.0, 0.5, 0.5, 1.0, 1.0, -0.5, 0.0, -3.5])
    beta = prior.copy()
    if got["y"].nunique() == 2:
        beta = _logistic(np.array(got["x"].tolist()), got["y"].to_numpy(float), prior)
    return {"patterns": learned, "beta": [float(b) for b in beta]}


def score(text: Column, model: dict) -> Column:
    """Probability of a toxic text, 0 to 1."""
    x = figures(text, model["patterns"])
    z = F.aggregate(F.zip_with(x, F.array(*map(F.lit, model["beta"])), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return 1 / (1 + F.exp(-z))


def scored(docs: DataFrame, labels: DataFrame, mod: int = 4, left_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs; null and empty texts get the score of a text without a match.

    Equal texts score alike, repeated rows give a row each. Extra columns are ignored, whatever their names. An empty table gives no row.
    """
    model = fit(docs, labels, mod=mod, left_out=left_out)
    out = docs.select("doc_id", (shared.fold("doc_id", mod) == left_out).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """docs without the rows scored ``threshold`` or more; all columns stay."""
    model = fit(docs, labels)
    return docs.where(score(F.col("text"), model) < threshold)
