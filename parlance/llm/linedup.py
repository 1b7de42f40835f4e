"""Line dedup by an exact set-similarity join; DataFrame functions only.

A line is the set of its lower-cased words. Its words are ordered by rarity in the
corpus, and two lines of Jaccard similarity ``t`` or more must share one of their first
``n - ceil(t n) + 1`` words; the shorter of both even one of its first
``n - ceil(2 t / (1 + t) n) + 1``. Pairs that share one pass the length filter, the positional
filter of their first common word and a bound from the parities of their words' bits (sets
differ in at least as many words as their parities in bits), all inside the join, and are
verified on the words themselves. A line goes if any earlier line is as similar; earlier
means by doc_id (null first), then line number, then hash of the text.

* Texts are cut into words once: the hashes of each line's words are written, counted and ranked from there.
* Words are counted over all distinct lines in ``buckets`` buckets of their hash. The table of the
  counts' levels has a fixed size (8 bytes for each bucket) and reaches the tasks as a scalar subquery.
* Equal lines (white space and case aside) are one line at their first place before any is counted or compared.
* First each line is paired only with the earliest line of each of its words that occur ``OFTEN`` and with the
  one before it; the lines of a very common word are dealt out to several groups of ``CROWD``. That settles
  nearly all members of a large group of near copies; only lines that are still undecided then meet all
  earlier lines. The answer is that of the full join.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BUCKETS = 1 << 20
#: Lines of a word among which the earliest is tried first; words that occur oftener are dealt out at random.
CROWD = 4096
#: Occurrences from which a word's earliest line is tried first.
OFTEN = 256
#: Lines of more words carry a second parity, of half their words.
LONG = 96
_MASK = (1 << 56) - 1
_FIRST = -(1 << 63)
_PLACE = ("d", "line_no", "th")


def _normal(text: Column) -> Column:
    """Lower case, all white space but line feeds as spaces."""
    plain = low = F.lower(text)
    some = F.lit(False)
    for c in "\t\x0b\x0c\r":
        plain, some = F.replace(plain, F.lit(c), F.lit(" ")), some | text.contains(c)
    return F.when(some, plain).otherwise(low)  # contains compares bytes; a regex decodes the text first


def _id() -> Column:
    """The document's id, null as the least number."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_FIRST))


def _hash() -> Column:
    """Tells apart rows of one _id()."""
    return F.xxhash64("text", F.col("doc_id").isNull())


def _lines(docs: DataFrame) -> DataFrame:
    """(d, th, line_no, line): a row for each line with a word, normalised."""
    rows = docs.select("d", "th", F.posexplode(F.split(_normal(F.col("text")), "\n")).alias("line_no", "line"))
    return rows.where(F.trim("line") != "")


def _words(line: Column) -> Column:
    """The hashes of a line's distinct words."""
    found = F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w)))
    gaps = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    return F.when(gaps, F.array_remove(found, F.xxhash64(F.lit("")))).otherwise(found)


def _shift(x: Column, bits: int | Column) -> Column:
    return F.call_function("shiftleft", x, F.lit(bits) if isinstance(bits, int) else bits)


def placed_lines(docs: DataFrame) -> DataFrame:
    """(id, d, th, line_no, h1, h2, ws) for each line with a word: a number in the order of places, two hashes, the hashes of its words.

    Where no two documents share an id and the ids span less than 2^31, the number is made of id and line number; else the documents are sorted.
    Equal documents then have two numbers for one place, one after the other.
    """
    ids = docs.agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.count("d").alias("n"), F.count_distinct("d").alias("u")).first()
    if ids.n and ids.n == ids.u and ids.hi - ids.lo < 1 << 31:
        number = _shift(F.col("d") - F.lit(ids.lo), 31).bitwiseOR(F.col("line_no").cast("long"))
    else:
        docs, number = docs.orderBy("d", "th"), F.monotonically_increasing_id()
    return _lines(docs).select(
        number.alias("id"), *_PLACE, F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), _words(F.col("line")).alias("ws"))


def rarity(lines: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """One row, an array of a long for each bucket of word hashes: in its upper byte four times log2 of the bucket's count over all lines."""
    counts = lines.select(F.explode("ws").alias("w")).groupBy(F.col("w").bitwiseAND(F.lit(buckets - 1)).alias("b")).count()
    level = _shift(F.least(F.lit(124), 4 * F.log2("count")).cast("long"), 56)
    every = lines.sparkSession.range(buckets).select(F.col("id").alias("b")).join(counts.select("b", level.alias("v")), "b", "left")
    every = every.select("b", F.coalesce("v", F.lit(0).cast("long")).alias("v"))
    run = F.transform(F.array_sort(F.collect_list(F.struct("b", "v"))), lambda x: x["v"])
    runs = every.groupBy(F.floor(F.col("b") / 4096).alias("k")).agg(run.alias("vs"))
    return runs.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "vs"))), lambda x: x["vs"])).alias("levels"))


def _parity(ranked: Column, half: bool) -> Column:
    """64 bits, each the parity of the number of words whose hash names it; of half the words if half."""

    def flip(bits: Column, k: Column) -> Column:
        one = F.call_function("shiftright", k, F.lit(6)).bitwiseAND(F.lit(1)) if half else F.lit(1).cast("long")
        return bits.bitwiseXOR(_shift(one, k.bitwiseAND(F.lit(63)).cast("int")))

    return F.aggregate(ranked, F.lit(0).cast("long"), flip)


def _most(n: Column, share: float) -> Column:
    """Words of a prefix that a set of n words with a share in common cannot all lack."""
    return (n - F.ceil(share * n - 1e-9) + 1).cast("int")


def ranked_lines(lines: DataFrame, t: float, buckets: int = BUCKETS) -> DataFrame:
    """Of each line its id, number of words n, prefix p (rarest first) and parities b1, b2.

    Words are named by 56 bits of their hash after 8 bits of rarity. b1 is of all words; b2 of half of them, in lines of more than LONG words.
    """
    # The subquery's column is used once, so the optimizer puts it where it is used and no row carries the table.
    rows = lines.select("id", "ws", rarity(lines, buckets).scalar().alias("levels"))

    def rank(w: Column) -> Column:
        return F.get(F.col("levels"), w.bitwiseAND(F.lit(buckets - 1)).cast("int")).bitwiseOR(w.bitwiseAND(F.lit(_MASK)))

    rows = rows.select("id", F.sort_array(F.transform("ws", rank)).alias("r"))
    n = F.size("r")
    return rows.select(
        "id", n.alias("n"), F.slice("r", F.lit(1), _most(n, t)).alias("p"),
        _parity(F.col("r"), False).alias("b1"), F.when(n > LONG, _parity(F.col("r"), True)).otherwise(0).alias("b2"),
    )


def _postings(first: DataFrame) -> DataFrame:
    """(w, id, size, b1, b2): a row for each word of each prefix; size holds the line's number of words and, below, the word's place."""
    rows = first.select("id", "n", "b1", "b2", F.posexplode("p").alias("i", "w"))
    return rows.select("w", "id", _shift(F.col("n").cast("long"), 32).bitwiseOR(F.col("i").cast("long")).alias("size"), "b1", "b2")


def _n(size: Column) -> Column:
    return F.call_function("shiftright", size, F.lit(32)).bitwiseAND(F.lit(0x3FFFFFFF))


def _i(size: Column) -> Column:
    return size.bitwiseAND(F.lit(0x7FFFFFFF))


def _may(x: dict[str, Column], y: dict[str, Column], t: float) -> Column:
    """Length, positional and parity filters of two postings at the first common word of their lines."""
    nx, ny = _n(x["size"]), _n(y["size"])
    need = F.ceil(t / (1 + t) * (nx + ny) - 1e-9)
    b1, b2 = x["b1"].bitwiseXOR(y["b1"]), x["b2"].bitwiseXOR(y["b2"])
    both = (nx > LONG) & (ny > LONG)
    differ = F.when(both, F.bit_count(b1.bitwiseXOR(b2)) + F.bit_count(b2)).otherwise(F.bit_count(b1))
    return (
        (F.least(nx, ny) >= t * F.greatest(nx, ny) - 1e-9) & (F.least(nx - _i(x["size"]), ny - _i(y["size"])) >= need)
        & (differ <= nx + ny - 2 * need)
    )


_KEPT = ("id", "size", "b1", "b2")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, store: Callable[[DataFrame], DataFrame], t: float) -> DataFrame:
    """The ids of the lines x of pairs (x, y) whose words (64 bits each), read from the texts again, are similar by t or more."""
    pairs = store(pairs.distinct())
    ids = shared.small(store(pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()))
    need = store(rows.select("id", *_PLACE).join(ids, "id"))
    some = docs.join(shared.small(need.select("d", "th").distinct()), ["d", "th"], "left_semi")
    some = some.select("d", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).join(shared.small(need), list(_PLACE))
    some = store(some.select("id", _words(_normal(F.col("line"))).alias("s")).dropDuplicates(["id"]))
    x, y = (some.select(F.col("id").alias(e), F.col("s").alias(f"s{e}")) for e in "xy")
    both = pairs.join(x, "x").join(y, "y").select("x", F.size("sx").alias("nx"), F.size("sy").alias("ny"), F.size(F.array_intersect("sx", "sy")).alias("c"))
    return both.where(F.col("c") >= t * (F.col("nx") + F.col("ny") - F.col("c")) - 1e-9).select(F.col("x").alias("id")).distinct()


def later_matches(first: DataFrame, rows: DataFrame, docs: DataFrame, store: Callable[[DataFrame], DataFrame], t: float = 0.8, crowd: int = CROWD) -> DataFrame:
    """(id) of the distinct lines ``first`` to which some earlier distinct line is similar by t or more."""
    post = _postings(first)
    short = post.where(_i(F.col("size")) < _most(_n(F.col("size")), 2 * t / (1 + t)))
    # The earliest line of each word, and the one before in its order. Groups of fewer lines than OFTEN have few pairs anyway.
    level = F.call_function("shiftright", F.col("w"), F.lit(56))
    salt = F.pmod(F.xxhash64("id"), F.ceil(F.pow(F.lit(2.0), level / 4) / crowd)).cast("int")
    met = Window.partitionBy("w", "salt").orderBy("id")
    ends = short.where(level >= int(4 * math.log2(OFTEN))).withColumn("salt", salt).select(
        *_KEPT, *[F.first(c).over(met).alias(f"{c}_a") for c in _KEPT], *[F.lag(c).over(met).alias(f"{c}_b") for c in _KEPT])
    own = {c: F.col(c) for c in _KEPT}
    near = [F.when((F.col(f"id_{e}") < F.col("id")) & _may(own, {c: F.col(f"{c}_{e}") for c in _KEPT}, t), F.col(f"id_{e}")) for e in "ab"]
    tried = ends.withColumn("p", near[0]).withColumn("q", near[1]).where("p is not null or q is not null")
    tried = tried.select(F.col("id").alias("x"), F.explode(F.array_compact(F.array("p", "q"))).alias("y"))
    sure = store(_verified(tried, rows, docs, store, t))
    known = shared.small(sure.withColumn("sure", F.lit(True)))
    top = F.lit(1 << 62)  # marks a line that is settled, in its size

    def marked(side: DataFrame, end: str) -> DataFrame:
        side = side.join(known, "id", "left").withColumn("size", F.when(F.col("sure"), F.col("size").bitwiseOR(top)).otherwise(F.col("size")))
        return side.select("w", *[F.col(c).alias(f"{c}_{end}") for c in _KEPT])

    x, y = ({c: F.col(f"{c}_{e}") for c in _KEPT} for e in "xy")
    # x is the shorter line; the later of both is still to be decided.
    shorter = (_n(x["size"]) < _n(y["size"])) | ((_n(x["size"]) == _n(y["size"])) & (x["id"] < y["id"]))
    open_ = F.when(x["id"] < y["id"], y["size"]).otherwise(x["size"]) < top
    found = marked(short, "x").join(marked(post, "y"), "w").where((x["id"] != y["id"]) & shorter & open_ & _may(x, y, t))
    late = found.select(F.greatest("id_x", "id_y").alias("x"), F.least("id_x", "id_y").alias("y"))
    return sure.unionByName(_verified(late, rows, docs, store, t)).distinct()


def removed_lines(docs: DataFrame, t: float = 0.8, buckets: int = BUCKETS) -> DataFrame:
    """(d, th, lines): for each document the sorted numbers of lines that repeat an earlier one, equal or similar."""
    docs = docs.select(_id().alias("d"), _hash().alias("th"), "text")
    with shared.scratch(docs.sparkSession) as store:
        same = ["h1", "h2"]
        with shared.scratch(docs.sparkSession, codec="lz4", dictionary=False) as briefly:
            lines = briefly(placed_lines(docs))  # ids are fixed once written
            narrow = store(lines.drop("ws"))
            copies = store(narrow.groupBy(*same).agg(F.min("id").alias("first"), F.count("*").alias("c")).where("c > 1").drop("c"))
            lines = lines.join(shared.small(copies), same, "left").where(F.col("first").isNull() | (F.col("first") == F.col("id")))
            first = store(ranked_lines(lines.select("id", "ws"), t, buckets))
        late = store(later_matches(first, narrow, docs, store, t))
        late = narrow.join(shared.small(late), "id", "left_semi").select(*same, F.lit(True).alias("late")).distinct()
        place = F.struct(*_PLACE)
        firsts = narrow.select(F.col("id").alias("first"), place.alias("at"))
        gone = store(copies.join(firsts, "first").drop("first").join(late, same, "full"))
        lines = narrow.join(shared.small(gone, width=96), same).where(F.col("late").isNotNull() | (place != F.col("at")))
        return shared.cut(lines.groupBy("d", "th").agg(F.array_sort(F.collect_set("line_no")).alias("lines")))


def dedup_lines(docs: DataFrame, t: float = 0.8, extra: bool = False, buckets: int = BUCKETS) -> DataFrame:
    """docs with each line removed that is equal or similar by t to an earlier line of any document.

    doc_id is a whole number. Lines end at line feeds; lines without a word stay, and so do null texts and
    documents whose last line goes (their text is then empty). Rows that are equal in
    id and text are one document and keep the same lines. A null id comes before all
    others; of rows with one id and other texts that with the smaller hash. An empty table gives none. With
    ``extra``, columns n_lines and n_removed follow. Other columns stay, whatever their names.
    """
    gone = removed_lines(docs.select("doc_id", "text"), t, buckets).select(
        F.col("d").alias("__dedup_d"), F.col("th").alias("__dedup_th"), F.col("lines").alias("__dedup_gone")
    )
    gone = shared.small(gone, width=F.size("__dedup_gone") * 4 + 64)
    joined = docs.join(gone, (_id() == F.col("__dedup_d")) & (_hash() == F.col("__dedup_th")), "left")
    lost = F.col("__dedup_gone")
    # Exploded from an array of one, so that the text is cut once and not for each line that stays.
    joined = joined.withColumn("__dedup_lines", F.explode(F.array(F.when(lost.isNotNull(), F.split("text", "\n")))))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__dedup_lines") - 1), lost)
    text = F.array_join(F.transform(kept, lambda i: F.get(F.col("__dedup_lines"), i)), "\n")
    text = F.when(lost.isNull(), F.col("text")).otherwise(text)
    cols = [text.alias("text") if c == "text" else F.col(c) for c in docs.columns]
    if extra:
        n = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"))) + 1  # bytes are not counted again
        cols += [F.coalesce(n, F.lit(0)).alias("n_lines"), F.coalesce(F.size(lost), F.lit(0)).alias("n_removed")]
    return joined.select(*cols)
