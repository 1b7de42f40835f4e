"""Repair of conversation structure by error-correcting Earley parsing.

The grammar says which prefixes of a conversation are sound: nothing, a system turn, and then
questions and answers in turn. It is left-recursive, so every item begins at the first turn and a
chart column needs only the column before it. Each turn symbol has productions
that keep a turn, change its role, or insert one, and ``gone`` deletes a turn; all have
prices. The chart keeps for each item the least (price, audit), the audit being the letters of
its edits; the completed chart gives the repair.

A conversation of any length is cut into blocks of turns. Each block is parsed once from every
prefix that may stand before it, in parallel, and gives the price of each way through; a pass over
these few numbers in the order of blocks chooses the ways, and the turns are then edited in
parallel. Columns that look alike are advanced alike, so a step is computed once and looked up after that.
Prices of two audits that end with an edited turn are only equal if neither is the beginning of the other, so comparing
audits up to a turn decides for whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Prefixes and what they are made of; ``whole`` is a sound conversation.
GRAMMAR = (
    ("none", ("none", "gone")),
    ("opened", ("none", "system")),
    ("opened", ("opened", "gone")),
    ("asked", ("none", "user")),
    ("asked", ("opened", "user")),
    ("asked", ("answered", "user")),
    ("asked", ("asked", "gone")),
    ("answered", ("asked", "assistant")),
    ("answered", ("answered", "gone")),
    ("whole", ("none",)),
    ("whole", ("answered",)),
)
#: Productions of a turn symbol: the edit's letter, the turns it takes ("" none), its price.
EDITS = {
    "system": (("K", "s", 0),),
    "user": (("K", "u", 0), ("R", "suao", 2), ("I", "", 2)),
    "assistant": (("K", "a", 0), ("R", "suao", 2), ("I", "", 2)),
    "gone": (("D", "suaox", 3),),
}
#: A turn is the initial of its role (o: any other), a capital if it is truncated, or x if it must be deleted.
TRUNCATED = 1
PREFIXES = ("none", "opened", "asked", "answered")
#: Turns of a block, as a power of two.
SHIFT = 10

Item = tuple[str, tuple[str, ...]]
Column_ = dict[Item, tuple[int, str]]


def advance(column: Column_, turn: str) -> Column_:
    """Items after a turn from those before it, or with no turn all items that the column completes; each with its least (price, audit)."""
    agenda = [(*weight, *item) for item, weight in column.items()]
    agenda.sort()
    chart: Column_ = {}
    after: Column_ = {}
    while agenda:
        price, audit, name, rest = heappop(agenda)
        if (name, rest) in chart:
            continue
        chart[name, rest] = (price, audit)
        if not rest:  # completed: goes on in every production that begins with it
            for left, right in GRAMMAR:
                if right[0] == name:
                    heappush(agenda, (price, audit, left, right[1:]))
            continue
        for letter, takes, cost in EDITS[rest[0]]:
            if not takes:
                heappush(agenda, (price + cost, audit + letter, name, rest[1:]))
            elif turn and turn.lower() in takes:
                cost += TRUNCATED if turn.isupper() and letter != "D" else 0
                weight = (price + cost, audit + letter)
                after[name, rest[1:]] = min(after.get((name, rest[1:]), weight), weight)
    return after if turn else chart


@cache
def _step(state: tuple[tuple[Item, int], ...], turn: str) -> tuple[tuple[tuple[Item, int], ...], int, tuple[tuple[int, str], ...]]:
    """The next state, the price all its items share, and of each item the place of the one it comes from and the edits.

    A state holds items in the order of their audits, with prices over the least; each audit is stood for by its place.
    """
    after = advance({item: (price, chr(48 + at)) for at, (item, price) in enumerate(state)}, turn)
    least = min(price for price, _ in after.values())
    ordered = sorted(after.items(), key=lambda x: x[1][1])
    return tuple((item, price - least) for item, (price, _) in ordered), least, tuple((ord(audit[0]) - 48, audit[1:]) for _, (_, audit) in ordered)


def ways(turns: str, entry: str) -> dict[str, tuple[int, int, list[str]]]:
    """From one prefix through a block: for each prefix after it the price, the place of its audit among them, and the edits up to each turn."""
    state, total, trail = (((entry, ()), 0),), 0, []
    for turn in turns:
        state, price, back = _step(state, turn)
        total += price
        trail.append(back)
    out = {}
    for place, ((name, _), price) in enumerate(state):
        at, edits = place, []
        for back in reversed(trail):
            at, letters = back[at]
            edits.append(letters)
        out[name] = (total + price, place, edits[::-1])
    return out


def closing(column: Column_) -> tuple[int, str]:
    """Least (price, audit) of a sound conversation from the prefixes at its end."""
    return advance(column, "")["whole", ()]


def _prices(turns: pd.Series) -> pd.Series:
    """Of each block the price and the audit's place for each pair of prefixes before and after it, -1 where there is no way."""

    def table(block: str) -> list[int]:
        out = []
        for entry in PREFIXES:
            found = ways(block, entry)
            for name in PREFIXES:
                out += found[name][:2] if name in found else (-1, -1)
        return out

    return pd.Series([table(x) for x in turns])


def added(prefix: str, letters: str) -> tuple[str, list[str]]:
    """The prefix after insertions, and the roles inserted."""
    roles = []
    for _ in letters:
        roles.append("assistant" if prefix == "asked" else "user")
        prefix = "answered" if prefix == "asked" else "asked"
    return prefix, roles


def _edits(turns: pd.Series, entry: pd.Series, end: pd.Series) -> pd.Series:
    """Of each block, for each turn on the chosen way: its letters, the roles inserted before it, and its role ("" its own, null if it goes)."""

    def edited(block: str, prefix: str, letters: list[str]) -> Iterator[dict]:
        for turn, own in zip(block, letters, strict=True):
            prefix, before = added(prefix, own[:-1])
            role = None
            if own[-1] == "K" and turn.lower() == "s":
                prefix, role = "opened", ""
            elif own[-1] != "D":
                prefix, (role,) = added(prefix, "I")
                role = "" if own[-1] == "K" else role
            yield {"letters": own, "before": before, "role": role}

    return pd.Series([
        list(edited(t, PREFIXES[e], ways(t, PREFIXES[e])[PREFIXES[x]][2])) for t, e, x in zip(turns, entry, end, strict=True)
    ])


def _chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by conversation and place to (conv_id, block, entry, end) and, on its last block, the conversation's figures."""
    now, blocks, kind = None, None, None

    def give() -> pa.RecordBatch:
        column = {(PREFIXES[p], ()): (cost, chr(48 + at)) for at, (p, cost) in enumerate(state)}
        cost, audit = closing(column)
        at = next(p for p, _ in state if chr(48 + order[p]) == audit[0])
        ends = []
        for back in reversed(blocks):
            before = back[1][at]
            ends.append((back[0], before, at))
            at = before
        ends.reverse()
        n = len(ends)
        tail = added(PREFIXES[ends[-1][2]], audit[1:])[1]
        lows, highs = figures["low"], figures["high"]
        gaps = highs - lows + 1 - figures["turns"] if lows is not None else 0
        last = [None] * (n - 1)
        return pa.RecordBatch.from_arrays(
            [pa.array([now] * n, kind), *(pa.array([e[i] for e in ends], pa.int64()) for i in range(3)),
             *(pa.array([*last, x], pa.int64()) for x in ((gaps + 2**63) % 2**64 - 2**63, figures["illegal"], cost)), pa.array([*last, tail], pa.list_(pa.string()))],
            names=["conv_id", "block", "entry", "end", "gaps", "illegal", "cost", "tail"],
        )

    for b in batches:
        kind = b.schema.field("conv_id").type
        for row in b.to_pylist():
            if blocks is None or row["conv_id"] != now:
                if blocks is not None:
                    yield give()
                now, blocks, state, order = row["conv_id"], [], [(0, 0)], {0: 0}
                figures = {"illegal": 0, "turns": 0, "low": None, "high": None, "initial": ""}
            after = {}
            for p, cost in state:
                for x in range(len(PREFIXES)):
                    price, place = row["prices"][8 * p + 2 * x : 8 * p + 2 * x + 2]
                    if price >= 0:
                        after[x] = min(after.get(x, (cost + price, order[p], place, p)), (cost + price, order[p], place, p))
            state = sorted(((x, w[0]) for x, w in after.items()), key=lambda s: after[s[0]][1:3])
            order = {x: at for at, (x, _) in enumerate(state)}
            blocks.append((row["block"], {x: w[3] for x, w in after.items()}))
            initials = figures["initial"] + row["initials"]
            figures["illegal"] += sum(initials[i : i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))
            figures["initial"] = initials[-1:]
            if row["low"] is not None:
                figures["turns"] += row["n_turns"] - (row["low"] == figures["high"])
                figures["low"] = row["low"] if figures["low"] is None else figures["low"]
                figures["high"] = row["high"]
    if blocks is not None:
        yield give()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edited turns sorted by conversation and place to (conv_id, audit, repaired_sha256); one conversation's letters and one batch are held."""
    now, digest, kind = None, None, None

    def give() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([now], kind), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])], names=["conv_id", "audit", "repaired_sha256"]
        )

    for b in batches:
        kind = b.schema.field("conv_id").type
        for conv, letters, lines in zip(b.column("conv_id").to_pylist(), b.column("letters").to_pylist(), b.column("lines"), strict=True):
            if digest is None or conv != now:
                if digest is not None:
                    yield give()
                now, digest, audit, begun = conv, hashlib.sha256(), [], False
            audit.append(letters)
            if lines.is_valid:
                digest.update((b"\n" if begun else b"") + lines.as_py().encode())
                begun = True
    if digest is not None:
        yield give()


def _key(conv: Column, turn: Column) -> Column:
    blank = F.lit(" ")
    return F.concat(F.coalesce(conv.cast("string"), blank), F.lit(":"), F.coalesce(turn.cast("string"), blank))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): rows with known faults, chosen by a CRC-32 of conversation and turn; n copies of each. Nulls of role and text become one space."""
    kind = F.pmod(F.crc32(_key(F.col("conv_id"), F.col("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).alias("n"))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join on the keys, nulls equal."""
    right = right.toDF(*(f"_{c}" if c in keys else c for c in right.columns))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return left.join(right, same, how).drop(*(f"_{k}" for k in keys))


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, fault): a row for each copy, with its first fault: blank, duplicate, truncated or null.

    Equal rows meet as one with their number; of rows with one role and text in a conversation all but the first by turn, nulls first, are duplicates.
    """
    hashes = {"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit(1), "text")}
    one = rows.withColumns(hashes).groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.first("text").alias("text"), F.sum("n").alias("n"))
    one = shared.cut(one)
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = one.groupBy("conv_id", "role", "h1", "h2").agg(F.min(place).alias("least"))
    one = _joined(one, first, ["conv_id", "role", "h1", "h2"])
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    own = F.when(last == "", "blank").when(F.col("least.turn").eqNullSafe(F.col("turn")), F.when(~last.isin(".", "!", "?"), "truncated")).otherwise("duplicate")
    each = one.select("conv_id", "turn", "role", "text", own.alias("own"), F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    fault = F.when((F.col("copy") == 1) | (F.col("own") == "blank"), F.col("own")).otherwise("duplicate")
    return each.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


def repaired(rows: DataFrame, store=shared.cut, shift: int = SHIFT) -> tuple[DataFrame, DataFrame]:
    """The figures of each conversation, and its turns after repair: (conv_id, place, letters, lines).

    rows: (conv_id, turn, role, text, n), n copies of a row. A turn's letters are its edits, insertions before it first, and lines the
    ``role:text`` they leave, newline-joined, or null. Rows are taken by turn, nulls first, then by role and text.
    """
    order = ["conv_id", "turn", "role", F.substring("text", 1, 64), "copy"]
    turns = store(faults(rows))
    turns = turns.repartitionByRange(*order).sortWithinPartitions("conv_id", "turn", "role", "text", "copy")
    initial = F.when(F.left("role", F.lit(1)).isin("s", "u", "a"), F.left("role", F.lit(1))).otherwise("o")
    token = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(initial)).otherwise(initial)
    turns = store(turns.withColumns({"place": F.monotonically_increasing_id(), "initial": initial, "token": token}))
    turns = turns.withColumn("block", F.shiftright("place", shift))
    run = F.array_sort(F.collect_list(F.struct("place", "token", "initial")))
    blocks = turns.groupBy("conv_id", "block").agg(
        run.alias("run"), F.min("place").alias("start"), F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("n_turns"),
        *(F.count_if(F.col("fault") == kind).alias(kind) for kind in ("blank", "duplicate", "truncated")),
    )
    blocks = blocks.withColumns({"turns": F.array_join("run.token", ""), "initials": F.array_join("run.initial", "")}).drop("run")
    prices = F.pandas_udf(_prices, "array<long>")
    blocks = store(blocks.withColumn("prices", prices("turns")))
    key = rows.schema["conv_id"].dataType.simpleString()
    need = blocks.select("conv_id", "block", "prices", "initials", "low", "high", "n_turns").repartition("conv_id").sortWithinPartitions("conv_id", "block")
    chosen = store(need.mapInArrow(_chosen, f"conv_id {key}, block long, entry long, end long, gaps long, illegal long, cost long, tail array<string>"))
    counts = blocks.groupBy("conv_id").agg(*(F.sum(kind).alias(kind) for kind in ("blank", "duplicate", "truncated")))
    figures = _joined(chosen.where("cost is not null").select("conv_id", "gaps", "illegal", "cost"), counts, ["conv_id"])
    edits = F.pandas_udf(_edits, "array<struct<letters:string,before:array<string>,role:string>>")
    way = _joined(blocks.select("conv_id", "block", "start", "turns"), chosen.select("conv_id", "block", "entry", "end"), ["conv_id", "block"])
    way = way.select("conv_id", "block", "start", edits("turns", "entry", "end").alias("edits"))
    each = _joined(turns.select("conv_id", "block", "place", "role", "text"), way, ["conv_id", "block"])
    edit = F.get("edits", (F.col("place") - F.col("start")).cast("int"))
    each = each.select("conv_id", "place", "text", F.col("role").alias("own"), edit.alias("edit")).select("conv_id", "place", "text", "own", "edit.*")
    line = F.when(F.col("role").isNotNull(), F.concat(F.when(F.col("role") == "", F.col("own")).otherwise(F.col("role")), F.lit(":"), "text"))
    tail = chosen.where("size(tail) > 0").select("conv_id", F.lit(2**63 - 1).alias("place"), F.repeat(F.lit("I"), F.size("tail")).alias("letters"), _empty("tail").alias("lines"))
    more = F.when(F.size("before") > 0, _empty("before"))
    each = each.select("conv_id", "place", "letters", F.when(more.isNotNull() | line.isNotNull(), F.concat_ws("\n", more, line)).alias("lines"))
    return figures, each.unionByName(tail)


def _empty(roles: str) -> Column:
    """Lines of turns without a text."""
    return F.array_join(F.transform(roles, lambda r: F.concat(r, F.lit(":"))), "\n")


def mended(conversations: DataFrame) -> DataFrame:
    """Figures and repair of every conversation after :func:`damaged`.

    Returns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256: gaps is the number of turns missing between the
    first and the last, illegal that of neighbours whose role initials are none of su, ua, au. The audit gives the cheapest repair, the least in byte order
    of several: K keeps a turn, R makes it the user's or the assistant's (2), D deletes it (3; blank and duplicate turns must go), I inserts an empty turn
    (2); a truncated turn that stays adds 1. The hash is of the repaired ``role:text``, newline-joined. A null conv_id is a conversation of its own. Null turns come first and
    count for no gap; turns that share a number are taken by role and text. A role counts by its first character, and one that is empty must be changed or go. Equal rows are duplicates
    of the first. A conversation that lost all its rows has zeros, an empty audit and the hash of nothing. Other columns are ignored; an empty table gives no row.
    One conversation's texts pass through one task, a batch at a time, to be hashed in their order; all else is done in blocks of turns.
    """
    rows = damaged(conversations)
    key = rows.schema["conv_id"].dataType.simpleString()
    with shared.scratch(conversations.sparkSession) as store:
        figures, turns = repaired(rows, store)
        turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
        hashes = turns.mapInArrow(_hashed, f"conv_id {key}, audit string, repaired_sha256 string")
        out = _joined(_joined(conversations.select("conv_id").distinct(), figures, ["conv_id"], "left"), hashes, ["conv_id"], "left")
        zeros = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        nothing = hashlib.sha256().hexdigest()
        return shared.cut(out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
