"""License scan: winnowed fingerprints in an inverted index, then banded alignment.

Templates are cut into runs of ``k`` words; of each window of such runs the smallest hash is
kept (winnowing). The kept hashes, with template and position, are the inverted index: a
fixed table that grows with the number of templates, not of documents. Every run of words of
every document probes it. Hits of a template are counted by diagonal (document position
less template position). The template is aligned to the document within a band about every diagonal
with a hit and a band's half to both sides of it, so hits that inserted or missing words spread
over diagonals meet in one band; that gives the matched words, their share and their span. What is left beside a
reported span is aligned again, so every copy is reported.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

# Notices of public licenses as they are usually written.
TEMPLATES: dict[str, str] = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the "
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law "
        "or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
        "CONDITIONS OF ANY KIND, either express or implied."
    ),
    "MIT-line": "Released under the MIT License.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:"
    ),
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:"
    ),
}


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def index(spark: SparkSession, templates: dict[str, str], k: int = 4, window: int = 4) -> DataFrame:
    """(license, pos, h, m): the winnowed fingerprints of each template, and its number of words."""
    t = spark.createDataFrame(sorted(templates.items()), "license string, text string")
    t = t.select("license", terms(F.col("text")).alias("w")).withColumn("m", F.size("w")).where("m > 0")
    runs = t.withColumn("pos", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("m") - k))))
    short = F.coalesce(*[F.when(F.col("m") == j, _run_hash(j)) for j in range(1, k)], _run_hash(k))  # a template of less words is one run
    runs = runs.select("license", "m", "pos", short.alias("h"))
    last = F.greatest(F.lit(0), F.col("m") - k)
    near = runs.alias("a").join(
        runs.select("license", F.col("pos").alias("pos2"), F.col("h").alias("h2")).alias("b"), "license"
    ).where((F.col("pos2") >= F.col("pos")) & (F.col("pos2") < F.col("pos") + window) & (F.col("pos") <= F.greatest(F.lit(0), last - window + 1)))
    kept = near.groupBy("license", "m", "pos").agg(F.min(F.struct("h2", -F.col("pos2"))).alias("x"))
    return kept.select("license", (-F.col("x.col2")).cast("int").alias("pos"), F.col("x.h2").alias("h"), "m").distinct()


def _run_hash(k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get("w", F.col("pos") + j) for j in range(k)])


def candidates(docs: DataFrame, fingerprints: DataFrame, ks: list[int], band: int = 8) -> DataFrame:
    """Runs of each length of ks probe the index. (doc_id, th, license, at, n): each diagonal with n fingerprints of a template, and those ``band`` to both sides; at may be negative."""
    w = docs.select("doc_id", F.xxhash64("text").alias("th"), terms(F.col("text")).alias("w")).where("size(w) > 0")
    runs = None
    for k in ks:
        at = w.where(F.size("w") >= k).select("doc_id", "th", "w", F.explode(F.sequence(F.lit(0), F.size("w") - k)).alias("pos"))
        at = at.select("doc_id", "th", F.col("pos").alias("dpos"), _run_hash(k).alias("h"))
        runs = at if runs is None else runs.unionByName(at)
    hits = runs.join(F.broadcast(fingerprints), "h").withColumn("b", F.col("dpos") - F.col("pos"))
    lines = hits.withColumn("at", F.explode(F.array(*[F.col("b") + x for x in (-band, 0, band)])))
    return lines.groupBy("doc_id", "th", "license", "at").agg(F.count_distinct("pos").cast("int").alias("n"))


def _align(a: list[str], b: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """Matched words, and the span in b of the first and last match, of the alignment of a to b with the most matches; b[i] stands near a[i - shift]."""
    width = 2 * band + 1
    best = np.zeros((len(a) + 1, width), np.int32)
    move = np.zeros((len(a) + 1, width), np.int8)
    for i in range(1, len(a) + 1):
        for d in range(width):
            j = i + shift + d - band  # words of b used
            top, how = best[i - 1, d + 1] if d + 1 < width else 0, 1  # skip a word of a
            if d and best[i, d - 1] > top:
                top, how = best[i, d - 1], 2  # skip a word of b
            if 1 <= j <= len(b) and a[i - 1] == b[j - 1] and best[i - 1, d] + 1 >= top:
                top, how = best[i - 1, d] + 1, 3
            best[i, d], move[i, d] = top, how
    i, d = len(a), int(best[len(a)].argmax())
    matched, first, last = int(best[i, d]), -1, -1
    while i > 0 and d < width:
        if move[i, d] == 3:
            first, last = i + shift + d - band - 1, last if last >= 0 else i + shift + d - band - 1
            i -= 1
        elif move[i, d] == 2:
            d -= 1
        else:
            i, d = i - 1, d + 1
    return matched, first, last + 1


def _places(a: list[str], b: list[str], places: list[tuple[int, int]], band: int, coverage: float) -> list[tuple[int, int, int]]:
    """(matched, first, end) of the spans of b that hold a by ``coverage``, none over another; places are (diagonal, fingerprints)."""
    need = coverage * len(a) - 1e-9
    queue, found, taken = [], [], np.zeros(len(b), bool)

    def add(at: int, n: int, lo: int, hi: int) -> None:
        if hi - lo >= need:
            matched, first, end = _align(a, b[lo:hi], at - lo, band)
            if matched >= need:
                heapq.heappush(queue, (-matched, end - first, -n, at, lo, hi, lo + first, lo + end))

    for at, n in places:
        add(at, n, max(0, at - band), min(len(b), at + len(a) + band))
    while queue:
        matched, _, n, at, lo, hi, first, end = heapq.heappop(queue)
        if not taken[lo:hi].any():
            found.append((-matched, first, end))
            taken[first:end] = True
            add(at, -n, lo, first)
            add(at, -n, end, hi)
            continue
        free = np.flatnonzero(np.diff(np.concatenate([[True], taken[lo:hi], [True]])))
        for s, e in zip(free[::2].tolist(), free[1::2].tolist(), strict=True):
            add(at, -n, lo + s, lo + e)
    return sorted(found, key=lambda x: x[1])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, k: int = 4, window: int = 4, band: int = 8) -> DataFrame:
    """(doc_id, th, license, matched, coverage, span_start, span_end) of each place where a document holds a template by at least ``coverage``.

    Spans count the document's words (runs of letters and digits, any case), the end excluded; spans of one template
    do not overlap, the fullest go first. Shorter templates inside longer ones are both reported. Null and wordless texts hold nothing; equal rows give one row, rows with
    equal ids and other texts one each. Extra columns are ignored; empty tables give no row. Runs of common words
    that a template shares with at least window + k - 1 words in a row are always found, and templates of less words whole.
    """
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    words = {name: [w for w in _split(text)] for name, text in templates.items()}
    ks = sorted({min(k, len(w)) for w in words.values() if w} | {k})
    found = shared.cut(candidates(docs, shared.cut(index(spark, templates, k, window)), ks, band))
    held = shared.cut(found.groupBy("doc_id", "th").agg(F.collect_list(F.struct("license", "at", "n")).alias("places")))
    texts = docs.withColumn("th0", F.xxhash64("text")).withColumnRenamed("doc_id", "d0")
    near = texts.join(shared.small(held), F.col("d0").eqNullSafe(F.col("doc_id")) & (F.col("th0") == F.col("th")))
    part = near.dropDuplicates(["doc_id", "th"]).select("doc_id", "th", "places", terms(F.col("text")).alias("w"))

    def align(batches):
        for batch in batches:
            rows = []
            for d, th, places, w in zip(batch["doc_id"], batch["th"], batch["places"], batch["w"], strict=True):
                w, by = list(w), {}
                for p in places:
                    by.setdefault(p["license"], []).append((p["at"], p["n"]))
                for name, at in by.items():
                    a = words[name]
                    rows += [(d, th, name, n, n / len(a), first, end) for n, first, end in _places(a, w, sorted(at), band, coverage)]
            out = pd.DataFrame(rows, columns=["doc_id", "th", "license", "matched", "coverage", "span_start", "span_end"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    kind = "doc_id long, th long, license string, matched int, coverage double, span_start int, span_end int"
    return part.mapInPandas(align, kind)


def _split(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]
