"""Optional model stages: a provider is a picklable function over batches of texts; the default is none.

Rows that need a provider are split off by their gate before it runs, so it never sees the others.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Provider = Callable[[list[str]], list[str | None]]
Embedder = Callable[[list[str]], list[list[float]]]
BATCH = 64
#: Class of task to the variable that must hold a key, and the default temperature.
TASKS: dict[str, tuple[str | None, float]] = {"general": (None, 0.3), "critical": ("PARLANCE_CRITICAL_KEY", 0.1)}


def settings(task: str = "general", temperature: float | None = None) -> dict:
    """Settings of a class of task; an unknown class is a ValueError, a missing key an EnvironmentError."""
    if task not in TASKS:
        raise ValueError(f"unknown task class {task!r}")
    key, default = TASKS[task]
    if key and not os.environ.get(key):
        raise EnvironmentError(f"{key} is not set")
    return {"task": task, "temperature": default if temperature is None else temperature, "key": key and os.environ[key]}


def complete(df: DataFrame, prompt: Column, gate: Column, provider: Provider | None, out: str = "reply") -> DataFrame:
    """df with a reply column: the provider's for rows that pass the gate, null for others, for errors and without provider."""
    if provider is None:
        return df.withColumn(out, F.lit(None).cast("string"))
    asked = df.where(F.coalesce(gate, F.lit(False))).withColumn("_prompt", prompt)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies: list[str | None] = []
            for at in range(0, len(b), BATCH):
                part = b["_prompt"].iloc[at : at + BATCH].tolist()
                try:
                    got = list(provider(part))
                except Exception:  # a failed call gives the fallback downstream
                    got = []
                replies += got if len(got) == len(part) else [None] * len(part)  # else replies would stand at other rows
            yield b.drop(columns="_prompt").assign(**{out: replies})

    rest = df.where(~F.coalesce(gate, F.lit(False))).withColumn(out, F.lit(None).cast("string"))
    return asked.mapInPandas(run, schema).unionByName(rest)


def embedding_text(title_en: Column, title_ar: Column, description: Column) -> Column:
    return F.concat(F.lit("passage: "), title_en, F.lit(" "), title_ar, F.lit(" "), description)


def embed(df: DataFrame, text: Column, embedder: Embedder, out: str = "embedding") -> DataFrame:
    """df with unit-length vectors of a text column, embedded in batches."""
    import numpy as np

    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{out}` array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got: list[list[float]] = []
            for at in range(0, len(b), BATCH):
                part = b["_text"].iloc[at : at + BATCH].tolist()
                x = np.asarray(embedder(part), float)
                if len(x) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(x)} vectors")
                got += (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)).tolist()
            yield b.drop(columns="_text").assign(**{out: got})

    return df.withColumn("_text", text).mapInPandas(run, schema)
