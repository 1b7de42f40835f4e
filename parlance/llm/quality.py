"""Quality classifier: regularised quadratic discriminant analysis over transformed document statistics.

Each class has its own covariance, shrunk towards a mix of the pooled covariance and its
diagonal; the Cholesky factor of each is computed once and ships with the model. A document's
score is the logistic of the difference of both classes' Mahalanobis log densities.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

STATISTICS = (
    "log_words", "log_bytes", "upper", "digit", "mark", "rare_mark", "mark_runs", "high", "space", "line_rate", "word_length",
    "long_word", "distinct_words", "top_word", "distinct_lines", "short_lines", "bars", "end_marks", "repeat_next", "distinct_pairs",
)
_CLASS = np.zeros(256, np.int64)
_CLASS[list(range(65, 91))] = 1
_CLASS[list(range(97, 123))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[[9, 10, 11, 12, 13, 32]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:!?'\"()-"]] = 6
_CLASS[128:] = 7
_MARKS = re.compile(rb"([^\w\s\x80-\xff])\1")


def _logit(part: float, whole: float) -> float:
    """Log odds of a share, smoothed so that 0 and 1 stay finite and long texts tell more."""
    return float(np.log((part + 0.5) / (max(whole - part, 0) + 0.5)) if whole else 0.0)


def _statistics(text: str | None) -> list[float]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    n = len(raw)
    kinds = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=8) if n else np.zeros(8, int)
    words = raw.split()
    lines = raw.split(b"\n")
    m = len(words)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = kinds[1] + kinds[2] + kinds[7]
    return [
        np.log1p(m), np.log1p(n), _logit(kinds[1], letters), _logit(kinds[3], n), _logit(kinds[5], n), _logit(kinds[6], n),
        _logit(len(_MARKS.findall(raw)), m), _logit(kinds[7], n), _logit(kinds[4], n), _logit(len(lines), n),
        np.log1p(n / (m + 1)), _logit(sum(len(w) > 20 for w in words), m), _logit(len(counts), m),
        _logit(max(counts.values(), default=0), m), _logit(len(set(lines)), len(lines)), _logit(sum(len(x) < 30 for x in lines), len(lines)),
        _logit(raw.count(b"|"), m), _logit(sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines), len(lines)),
        _logit(same, m), _logit(pairs, m),
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics(texts: pd.Series) -> pd.Series:
    """The transformed statistics of whole texts, in the order of STATISTICS; null counts as empty."""
    return pd.Series([[float(v) for v in _statistics(t)] for t in texts])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", mod: int = 3, left_out: int = 1, bound: int = 20_000,
        shrink: float = 0.1, diagonal: float = 0.1) -> dict | None:
    """Means, Cholesky factors and priors from at most about ``bound`` labelled documents; None without both classes."""
    rows = shared.fit_rows(docs, labels, label, mod, left_out, bound)
    got = rows.select(statistics(F.col("text")).alias("x"), "y").toPandas()
    x, y = np.array(got["x"].tolist(), float), got["y"].to_numpy(int)
    if len(set(y)) < 2:
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / scale
    own = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    pooled = sum(own[c] * (y == c).mean() for c in (0, 1))
    model = {"mean": mean, "scale": scale, "classes": []}
    for c in (0, 1):
        n = int((y == c).sum())
        a = max(shrink, len(mean) / (len(mean) + n))  # few rows lean on the pooled covariance
        cov = (1 - a) * own[c] + a * ((1 - diagonal) * pooled + diagonal * np.diag(np.diag(pooled))) + 1e-3 * np.eye(len(mean))
        factor = np.linalg.cholesky(cov)
        model["classes"].append((z[y == c].mean(axis=0), np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum(), np.log(n / len(y))))
    return model


def score(text: Column, model: dict | None) -> Column:
    """Probability of class 1; 0.5 where nothing could be fitted."""

    @F.pandas_udf(T.DoubleType())
    def discriminant(texts: pd.Series) -> pd.Series:
        if model is None or not len(texts):
            return pd.Series(np.full(len(texts), 0.5))
        z = (np.array([_statistics(t) for t in texts], float) - model["mean"]) / model["scale"]
        density = [prior - 0.5 * (logdet + (((z - mu) @ inv.T) ** 2).sum(axis=1)) for mu, inv, logdet, prior in model["classes"]]
        return pd.Series(1 / (1 + np.exp(np.clip(density[0] - density[1], -500, 500))))

    return discriminant(text)


def scored(docs: DataFrame, labels: DataFrame, mod: int = 3, left_out: int = 1, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, null and empty texts too, equal rows alike."""
    model = fit(docs, labels, mod=mod, left_out=left_out)
    out = docs.select("doc_id", (shared.fold("doc_id", mod) == left_out).alias("held_out"), score(F.col("text"), model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
