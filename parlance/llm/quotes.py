"""Quotation linking of conversations; DataFrame functions only.

A line that begins with quote marks (``>``, ``> >``, ``>>``) is quoted at the depth of their
number. Consecutive lines of one depth are a passage. Passages are normalised (quote marks
gone, lower case, white space single) and hashed, and linked to the message of the same
conversation that first said them unquoted: an equal passage, or else equal lines. The
message that the most lines of a message's shallowest quotes come from is its parent; without a quote
that is found it answers the message before it. Messages are then ordered by depth first in the tree of
replies and given back without quotes.

Only hashes are joined, within one conversation, so texts are never compared pairwise. A
passage said in many messages counts for the earliest of them, found by a minimum per hash,
so a common greeting makes no group of pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import shared

MARKS = r"^(?:\x20{0,3}>)+\x20?"


def normalised(text: Column) -> Column:
    """Lower case, single white space, no ends, no quote marks."""
    return F.array_join(shared.words(F.lower(text)), " ")


def parsed(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mh, line_no, depth, body, h): a row for each line of each message, h a hash of its words or null if it has none."""
    lines = messages.select(
        "conv_id", "turn", F.xxhash64("role", "text").alias("mh"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\r?\n")).alias("line_no", "line")
    )
    prefix = F.regexp_extract("line", MARKS, 0)
    body = F.substring(F.col("line"), F.length(prefix) + 1, F.length("line"))
    norm = normalised(F.col("body"))
    return (
        lines.withColumn("depth", F.length(F.translate(prefix, " ", ""))).withColumn("body", body)
        .withColumn("h", F.when(norm != "", F.xxhash64(norm))).drop("line")
    )


def passages(lines: DataFrame) -> DataFrame:
    """(conv_id, turn, mh, depth, start, n_lines, text, ph): runs of lines of one depth, in the order of the message."""
    w = Window.partitionBy("conv_id", "turn", "mh").orderBy("line_no")
    new = F.when(F.col("depth") == F.lag("depth").over(w), 0).otherwise(1)
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("conv_id", "turn", "mh", "run", "depth").agg(
        F.min("line_no").alias("start"), F.count("*").alias("n_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "body"))), lambda x: x["body"]), "\n").alias("text"),
    )
    norm = normalised(F.col("text"))
    return out.withColumn("ph", F.when(norm != "", F.xxhash64(norm))).drop("run")


def linked(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, mh, start, depth, n_lines, quoted_turn): each quoted passage with the earlier message it comes from.

    An equal passage said unquoted earlier wins, else the earlier message that first said
    most of its lines; null if none did. A message that only repeats a quote is no origin.
    """
    lines = parsed(messages)
    runs = passages(lines)
    said = runs.where("depth = 0 and ph is not null").groupBy(F.col("conv_id").alias("c"), F.col("ph").alias("p")).agg(F.min("turn").alias("from_turn"))
    quoted = runs.where("depth > 0 and ph is not null")
    whole = quoted.join(said, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("ph") == F.col("p")), "left").drop("c", "p")
    whole = whole.withColumn("from_turn", F.when(F.col("from_turn") < F.col("turn"), F.col("from_turn")))
    own = lines.where("depth = 0 and h is not null").groupBy(F.col("conv_id").alias("c"), F.col("h").alias("lh")).agg(F.min("turn").alias("line_turn"))
    bits = (
        whole.where("from_turn is null").withColumn("piece", F.explode(F.split("text", "\n")))
        .withColumn("lh0", F.xxhash64(normalised(F.col("piece"))))
    )
    votes = (
        bits.join(own, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("lh0") == F.col("lh")) & (F.col("line_turn") < F.col("turn")))
        .groupBy("conv_id", "turn", "mh", "start", "line_turn").count()
        .groupBy("conv_id", "turn", "mh", "start").agg(F.max_by("line_turn", F.struct("count", -F.col("line_turn"))).alias("vote"))
        .toDF("vc", "vt", "vm", "vs", "vote")
    )
    same = F.col("conv_id").eqNullSafe(F.col("vc")) & F.col("turn").eqNullSafe(F.col("vt")) & (F.col("mh") == F.col("vm")) & (F.col("start") == F.col("vs"))
    return whole.join(votes, same, "left").select(
        "conv_id", "turn", "mh", "start", "depth", "n_lines", F.coalesce("from_turn", "vote").alias("quoted_turn")
    )


#: Turns to a chunk: what depends on the order of a conversation is found within chunks, then carried over them.
CHUNK = 1024


def _carried(df: DataFrame, keys: list[str], value: str, out: str, strictly: bool) -> DataFrame:
    """df with out: the last value that is not null among the rows of the same keys up to this turn (before it, if strictly)."""
    df = df.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    near = Window.partitionBy(*keys, "chunk").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1 if strictly else 0)
    far = Window.partitionBy(*keys).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = df.where(F.col(value).isNotNull()).groupBy(*keys, "chunk").agg(F.max_by(value, "turn").alias("end"))
    chunks = df.select(*keys, "chunk").distinct()
    ends = _keyed(chunks, [*keys, "chunk"], ends).withColumn("carry", F.last("end", ignorenulls=True).over(far)).drop("end")
    return _keyed(df.withColumn("near", F.last(value, ignorenulls=True).over(near)), [*keys, "chunk"], ends).withColumn(
        out, F.coalesce("near", "carry")
    ).drop("near", "carry", "chunk")


def _keyed(base: DataFrame, keys: list[str], *others: DataFrame) -> DataFrame:
    """Left joins on the keys, nulls equal."""
    for other in others:
        other = other.withColumnsRenamed({k: f"_{k}" for k in keys})
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        base = base.join(other, same, "left").drop(*(f"_{k}" for k in keys))
    return base


def _threads(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, parent_turn, branch, path): turns with what they answer and the branch of the reply tree they stand in.

    A turn that quotes another than the one before it starts a branch. The path of a branch holds the forks above it,
    later forks first, so that paths sort in depth-first order; it is found by doubling over branches.
    """
    t = _carried(turns.withColumn("own", F.col("turn")), ["conv_id"], "own", "previous", strictly=True).drop("own")
    fork = F.col("quoted_parent").isNotNull() & ~F.col("quoted_parent").eqNullSafe(F.col("previous"))
    first = F.col("previous").isNull()
    t = t.withColumn("start", F.when(fork | first, F.col("turn"))).withColumn("parent_turn", F.coalesce("quoted_parent", "previous"))
    t = shared.cut(_carried(t, ["conv_id"], "start", "branch", strictly=False))
    holder = t.select("conv_id", F.col("turn").alias("parent_turn"), F.col("branch").alias("above"))
    step = F.struct((-F.col("parent_turn")).alias("fork"), F.col("turn").alias("start"))
    paths = _keyed(t.where("start is not null").select("conv_id", "turn", "parent_turn"), ["conv_id", "parent_turn"], holder)
    none = F.array().cast("array<struct<fork:bigint,start:bigint>>")
    kind = "array<struct<fork:bigint,start:bigint>>"
    paths = shared.cut(paths.select("conv_id", F.col("turn").alias("branch"), "above", F.when(F.col("parent_turn").isNull(), none).otherwise(F.array(step).cast(kind)).alias("path")))
    while paths.where("above is not null").limit(1).count():
        up = paths.select("conv_id", F.col("branch").alias("above"), F.col("above").alias("above2"), F.col("path").alias("path2"))
        joined = _keyed(paths, ["conv_id", "above"], up)
        paths = shared.cut(joined.select("conv_id", "branch", F.col("above2").alias("above"), F.concat(F.coalesce("path2", none), "path").alias("path")))
    return _keyed(t, ["conv_id", "branch"], paths.drop("above")).select("conv_id", "turn", "parent_turn", "branch", "path")


def rebuilt(messages: DataFrame) -> DataFrame:
    """Conversations without quotes, in the order of replies.

    Returns a row for each row of messages: conv_id, turn, role, clean_text (its unquoted lines, ends trimmed),
    n_quotes, n_linked, max_depth, parent_turn, reply_depth (forks above it) and reply_order, from 0 in each conversation,
    depth first with siblings by turn. A first message has no parent. Null texts are empty messages, null ids a
    conversation; rows with a null turn link with nothing and come last in their conversation. Equal rows are kept, with
    the same parent; rows of one turn are ordered by role and text. Other columns are left out. An empty table gives no row.
    """
    base = messages.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text").withColumn("mh", F.xxhash64("role", "text"))
    key = ["conv_id", "turn", "mh"]
    only = shared.cut(base.dropDuplicates(key))
    runs = passages(parsed(only))
    clean = runs.groupBy(*key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.when(F.col("depth") == 0, F.struct("start", "text")))), lambda x: x["text"]), "\n"
        ).alias("clean_text"),
        F.count_if(F.col("depth") > 0).alias("n_quotes"), F.max("depth").alias("max_depth"),
    )
    links = linked(only.where("turn is not null")).where("quoted_turn is not null")
    quoted = (
        links.groupBy(*key, "quoted_turn", "depth").agg(F.sum("n_lines").alias("w"), F.count("*").alias("k"))
        .groupBy(*key).agg(
            F.min_by("quoted_turn", F.struct("depth", -F.col("w"), -F.col("quoted_turn"))).alias("quoted_parent"), F.sum("k").alias("n_linked"))
    )
    row = shared.cut(_keyed(only.select(*key, "role"), key, clean, quoted))
    turns = row.where("turn is not null").groupBy("conv_id", "turn").agg(F.min_by("quoted_parent", "mh").alias("quoted_parent"))
    where = _threads(shared.cut(turns))
    row = shared.cut(_keyed(_keyed(base.select(*key, "role", "text"), ["conv_id", "turn"], where), key, row.drop("role")))
    branch = ["conv_id", "branch"]
    chunk = row.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
    sizes = chunk.groupBy(*branch, "chunk").agg(F.count("*").alias("n"), F.first("path").alias("path"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy(F.col("branch").isNull(), "path", "chunk")) - F.col("n")
    place = F.row_number().over(Window.partitionBy(*branch, "chunk").orderBy("turn", "role", "text")) - 1
    out = _keyed(chunk.withColumn("place", place), [*branch, "chunk"], sizes.withColumn("before", before).drop("n", "path"))
    return out.select(
        "conv_id", "turn", "role", F.trim("clean_text", F.lit(" \n\r\t")).alias("clean_text"), F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"), F.coalesce("max_depth", F.lit(0)).alias("max_depth"), "parent_turn",
        F.coalesce(F.size("path"), F.lit(0)).alias("reply_depth"), (F.col("before") + F.col("place")).alias("reply_order"),
    )
