"""Phrase collocations by sorted n-grams of word numbers.

Words that occur often enough in their language get a number; texts become runs of numbers,
broken at the separators and at every other word. The phrase that begins at a word is packed into a
binary key of fixed width, four bytes a word, zeros after its end, so keys in byte order hold
all beginnings of equal phrases together. Keys are counted where they arise, by a
radix sort of 16-bit digits and run lengths; the counted keys are partitioned by range and
each range is sorted and run-length counted again for every phrase length at once. A run that
meets the edge of its range is given with what it has, and the pieces are summed.

Pairs come first; longer phrases are then looked for only where neighbours make a frequent pair, as
long as the pairs fit in ``PAIRS``; beyond that every run is packed whole. The dictionary is sent in blocks of
at most ``WORDS`` words, and every block takes one pass over the texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

#: Separators of pieces become commas; letters A-Z are lower-cased apart.
_BREAKS = bytes.maketrans(b".;:!?\n\x0b\x0c\r", b",,,,,,,,,")
#: Words of the dictionary that one broadcast holds, frequent pairs that one holds, distinct words counted and keys packed before they are given on.
WORDS, PAIRS, HELD, PACKED = 1_000_000, 8_000_000, 300_000, 1 << 20
#: Bytes of a text that are cut into words at a time, and keys of one range.
SLICE, RANGE = 1 << 20, 1 << 20


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Lower-case words of a text in order, with a comma for each separator, some at a time."""
    text = text.lower().translate(_BREAKS)
    at = 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" \t,":
            end += 1
        yield text[at:end].replace(b",", b" , ").split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), words counted within the task."""
    counts: dict[str, Counter] = {}

    def give() -> Iterator[pa.RecordBatch]:
        for lang, found in counts.items():
            found.pop(b",", None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())],
                names=["lang", "word", "n"],
            )
        counts.clear()

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            for words in tokens(text.as_py()):
                counts.setdefault(lang, Counter()).update(words)
                if sum(map(len, counts.values())) > HELD:
                    yield from give()
    yield from give()


def _numbered(sent):
    """(lang, text, ids) to the same with the numbers of the dictionary's block in ids: 0 for other words, one 0 after each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        for lang, words, ids in sent.value:
            known[lang] = dict(zip(words, ids, strict=True))
        for b in batches:
            out = []
            for lang, text, had in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                get = known.get(lang, {}).get
                found = [np.fromiter(map(get, words, repeat(0)), np.int32, len(words)) for words in tokens(text.as_py())]
                ids = np.concatenate([*found, np.zeros(1, np.int32)])
                out.append(ids if not had.is_valid else ids + had.values.to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.int32()))], names=["lang", "text", "ids"])

    return run


def radix_order(keys: np.ndarray) -> np.ndarray:
    """Order of rows of 32-bit numbers, first column most significant: stable sorts by 16-bit digits, the last first."""
    order = np.arange(len(keys))
    for c in range(keys.shape[1] - 1, -1, -1):
        column = keys[:, c]
        for digit in (column & 0xFFFF, column >> 16):
            if digit.any():
                digit = digit.astype(np.uint16)
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def _changes(keys: np.ndarray, width: int) -> np.ndarray:
    """Where a row's first ``width`` numbers differ from those of the row before."""
    out = np.ones(len(keys), bool)
    out[1:] = (keys[1:, :width] != keys[:-1, :width]).any(axis=1)
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    """Rows of numbers as binary values, big-endian."""
    data = np.ascontiguousarray(keys, dtype=">u4")
    ends = np.arange(len(keys) + 1, dtype=np.int32) * (4 * keys.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of one width as rows of numbers."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]] if len(column) else np.empty(0, np.uint8)
    return np.frombuffer(data.tobytes(), ">u4").reshape(-1, width).astype(np.uint32)


def _packed(width: int, least: int, pairs):
    """Runs of numbers to (k, n): keys of phrases of at least ``least`` and at most ``width`` words, one for each word that begins one, counted."""

    def give(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        keys = keys[radix_order(keys)]
        start = np.flatnonzero(_changes(keys, width))
        n = np.diff(np.r_[start, len(keys)])
        for s in range(0, len(start), 1 << 16):
            yield pa.RecordBatch.from_arrays([_binary(keys[start[s : s + (1 << 16)]]), pa.array(n[s : s + (1 << 16)])], names=["k", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            flat = b.column(0).flatten().to_numpy().astype(np.uint32)
            for s in range(0, len(flat), PACKED):
                a = np.r_[flat[s : s + PACKED + width - 1], np.zeros(width, np.uint32)]
                together = (a[:-1] != 0) & (a[1:] != 0)
                if pairs is not None:
                    pair = a[:-1].astype(np.uint64) << np.uint64(32) | a[1:]
                    at = np.minimum(np.searchsorted(pairs.value, pair), max(0, len(pairs.value) - 1))
                    together &= pairs.value[at] == pair if len(pairs.value) else False
                keys = np.zeros((len(a), width), np.uint32)
                keys[:, 0], on = a, np.ones(len(a), bool)
                for w in range(1, width):
                    on = on & np.r_[together[w - 1 :], np.zeros(w, bool)][: len(a)]
                    keys[: len(a) - w, w] = np.where(on[: len(a) - w], a[w:], 0)
                keys = keys[: len(flat[s : s + PACKED])]
                held.append(keys[keys[:, least - 1] != 0])
                size += len(held[-1])
                if size >= PACKED:
                    yield from give(held)
                    held, size = [], 0
        if size:
            yield from give(held)

    return run


def _run_lengths(width: int, least: int, often: int):
    """Counted keys of one range to (k, f) for every beginning of ``least`` words and more that occurs often in the range or meets its edge."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(_matrix(b.column(0), width), b.column(1).to_numpy()) for b in batches if len(b)]
        if not parts:
            return
        keys, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = radix_order(keys)
        keys, n = keys[order], n[order]
        for length in range(least, width + 1):
            start = np.flatnonzero(_changes(keys, length))
            f = np.add.reduceat(n, start)
            edge = np.zeros(len(start), bool)
            edge[[0, -1]] = True
            keep = (keys[start, length - 1] != 0) & ((f >= often) | edge)
            if keep.any():
                yield pa.RecordBatch.from_arrays([_binary(keys[start[keep], :length]), pa.array(f[keep])], names=["k", "f"])

    return run


def _grams(runs: DataFrame, width: int, least: int, often: int, pairs, store: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(k, f): phrases of ``least`` to ``width`` words that occur at least ``often`` times; k holds four bytes a word."""
    keys = store(runs.select("ids").mapInArrow(_packed(width, least, pairs), "k binary, n long"))
    ranges = max(1, -(-keys.count() // RANGE))
    counts = keys.repartitionByRange(ranges, "k").mapInArrow(_run_lengths(width, least, often), "k binary, f long")
    return store(counts.groupBy("k").agg(F.sum("f").alias("f")).where(F.col("f") >= often))


def _word(k: Column, at: Column | int) -> Column:
    """The number at a place, from 0, of a key."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.hex(F.substring(k, at * 4 + 1, F.lit(4))), 16, 10).cast("long")


def collocations(
    docs: DataFrame, often: int = 100, longest: int = 5, top: int = 2000, closed: int = 100, words: int = WORDS, pairs: int = PAIRS
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to ``longest`` words of each language by score, a, phrase.

    Letters A-Z are lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at space and tab. n counts the words of a language (null: ``und``),
    a the occurrences of a phrase within pieces, overlaps included; phrases of at least ``often`` count. A phrase cut after k words
    into parts of l and r occurrences scores floor(1000 a n / (l r)); its lowest cut counts, ties to the smallest k. A phrase inside a longer one (of at most ``longest`` words)
    with at least ``closed`` percent of its occurrences is left out. Every text counts, whole; null and empty texts hold no words, equal rows
    count as often as they occur, other columns are ignored. ``words`` and ``pairs`` bound what is broadcast and change no result. An empty table gives no row.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    with shared.scratch(spark) as store:
        counts = texts.mapInArrow(_counted, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
        counts = store(counts)
        totals = shared.cut(counts.groupBy("lang").agg(F.sum("f").alias("n")))
        known = store(counts.where(F.col("f") >= often).withColumn("m", F.monotonically_increasing_id()))
        part = F.shiftright("m", 33)
        sizes = {r["part"]: r["count"] for r in known.groupBy(part.alias("part")).count().collect()}
        starts, total = {}, 0
        for p in sorted(sizes):
            starts[p], total = total, total + sizes[p]
        rows = [(p, s) for p, s in starts.items()]
        offsets = F.broadcast(spark.createDataFrame(rows, "part long, start long"))  # one row for each partition of the dictionary
        number = (F.col("start") + F.col("m").bitwiseAND((1 << 33) - 1) + 1).alias("id")
        known = store(known.withColumn("part", part).join(offsets, "part").select("lang", "word", "f", number))
        runs, sent = texts.withColumn("ids", F.lit(None).cast("array<int>")), []
        for s in range(0, max(1, total), words):
            block = known.where(F.col("id").between(s + 1, s + words)).select("lang", "word", "id").toArrow()
            by: dict[str, tuple[list, list]] = {}
            for lang, word, i in zip(*(block.column(c).to_pylist() for c in ("lang", "word", "id")), strict=True):
                by.setdefault(lang, ([], []))
                by[lang][0].append(word)
                by[lang][1].append(i)
            sent.append(spark.sparkContext.broadcast([(lang, *found) for lang, found in by.items()]))
            runs = runs.mapInArrow(_numbered(sent[-1]), "lang string, text binary, ids array<int>")
            runs = store(runs if s + words < total else runs.select("ids"))
        two = _grams(runs, 2, 2, often, None, store)
        filter_by = None
        if longest > 2 and (n_pairs := two.count()) <= pairs:
            found = two.select((_word(F.col("k"), 0) * (1 << 32) + _word(F.col("k"), 1)).alias("p")).toArrow().column("p").to_numpy()
            assert len(found) == n_pairs
            filter_by = spark.sparkContext.broadcast(np.sort(found.astype(np.uint64)))
            sent.append(filter_by)
        grams = two if longest == 2 else two.unionByName(_grams(runs, longest, 3, often, filter_by, store))
        for b in sent:
            b.destroy()
        return shared.cut(_ranked(grams, known, totals, longest, top, closed, store))


def _ranked(grams: DataFrame, known: DataFrame, totals: DataFrame, longest: int, top: int, closed: int, store) -> DataFrame:
    """The result from the frequent phrases, the dictionary and the words of each language."""
    size = (F.octet_length("k") / 4).cast("int")
    inner = grams.where(size > 2).select("f", F.explode(F.array(F.expr("substring(k, 1, octet_length(k) - 4)"), F.expr("substring(k, 5)"))).alias("k"))
    inside = inner.groupBy("k").agg(F.max("f").alias("over"))
    kept = grams.join(inside, "k", "left").where(F.col("over").isNull() | (100 * F.col("over") < closed * F.col("f"))).drop("over")
    first = known.select(F.col("id").alias("first"), "lang")
    kept = kept.withColumn("first", _word(F.col("k"), 0)).join(first, "first").join(shared.small(totals, width=F.octet_length("lang") + 16), "lang").drop("first")
    single = known.select(F.unhex(F.lpad(F.hex("id"), 8, "0")).alias("k"), "f")
    parts = store(grams.unionByName(single))
    cuts = kept.withColumn("at", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumns({"lk": F.expr("substring(k, 1, 4 * at)"), "rk": F.expr("substring(k, 4 * at + 1)")})
    cuts = cuts.join(parts.select(F.col("k").alias("lk"), F.col("f").alias("l")), "lk").join(parts.select(F.col("k").alias("rk"), F.col("f").alias("r")), "rk")
    wide = "decimal(38,0)"
    score = F.expr(f"(cast(1000 as {wide}) * f * n) div (cast(l as {wide}) * r)")
    scored = cuts.select("lang", "k", F.col("f").alias("a"), "n", F.struct(score.alias("score"), "at", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "k", "a", "n").agg(F.min("cut").alias("cut")).select("lang", "k", "a", "n", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a")]
    likely = store(scored.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank"))
    spelt = likely.select("k", F.posexplode(F.sequence(F.lit(0), size - 1)).alias("at", "_")).withColumn("id", _word(F.col("k"), F.col("at")))
    spelt = spelt.join(known.select("id", "word"), "id").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("ws"))
    phrase = F.array_join(F.transform("ws", lambda w: w["word"].cast("string")), " ")
    last = Window.partitionBy("lang").orderBy(*order, "phrase")
    out = likely.join(spelt.select("k", phrase.alias("phrase")), "k").withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
