"""Neighbours, phrases and repair: brute force, SQL, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from parlance.llm import mixing, neighbours, phrases, quality, queries, quotes, repair

from ..conftest import sql_differences


def cheapest(rows):
    """Brute force over all edits of (role, must go, truncated): least (cost, audit) and the repaired roles."""
    best = {"": (0, "", ())}  # roles so far by the state: "", s, u, a

    def grown(states):
        more = dict(states)
        for _ in range(2):
            for s, (c, audit, out) in list(more.items()):
                t = "a" if s == "u" else "u"
                w = (c + 2, audit + "I", (*out, (t, None)))
                if t not in more or w[:2] < more[t][:2]:
                    more[t] = w
        return more

    all_ways = [best]
    for i, (role, must, cut) in enumerate(rows):
        found = {}
        # all ways up to here are kept apart by state; insertions come right before a turn
        for s, (c, audit, out) in all_ways[-1].items():
            routes = [(s, c, audit, out)]
            for n in (1, 2, 3):
                t = "a" if routes[-1][0] == "u" else "u"
                routes.append((t, routes[-1][1] + 2, routes[-1][2] + "I", (*routes[-1][3], (t, None))))
            for s2, c2, a2, o2 in routes:
                options = [(s2, c2 + 3, a2 + "D", o2)]
                if not must:
                    if role[:1] == "s" and s2 == "":
                        options.append(("s", c2 + cut, a2 + "K", (*o2, ("s", i))))
                    t = "a" if s2 == "u" else "u"
                    if role[:1] == t:
                        options.append((t, c2 + cut, a2 + "K", (*o2, (t, i))))
                    options.append((t, c2 + cut + 2, a2 + "R", (*o2, (t, i))))
                for t, c3, a3, o3 in options:
                    if t not in found or (c3, a3) < found[t][:2]:
                        found[t] = (c3, a3, o3)
        all_ways.append(found)
    ends = []
    for s, (c, audit, out) in all_ways[-1].items():
        if s in ("", "a"):
            ends.append((c, audit, out))
        if s == "u":
            ends.append((c + 2, audit + "I", (*out, ("a", None))))
        if s == "s":
            ends.append((c + 4, audit + "II", (*out, ("u", None), ("a", None))))
    return min(ends, key=lambda e: e[:2])


def brute_repair(conversations):
    blank = lambda t: not re.search(r"[^\x20\x09-\x0D]", t)
    convs = {}
    for conv, turn, role, text in conversations:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        rows = convs.setdefault(conv, [])
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, kinds, tokens = set(), {"blank": 0, "duplicate": 0, "truncated": 0}, []
        for _, role, text in rows:
            kind = "blank" if blank(text) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?" else ""
            seen.add((role, text))
            if kind:
                kinds[kind] += 1
            tokens.append((role, kind in ("blank", "duplicate"), int(kind == "truncated")))
        cost, audit, roles = cheapest(tokens)
        lines = []
        for (name, at), edit in zip(roles, [x for x in audit if x != "D"], strict=True):
            full = {"u": "user", "a": "assistant"}
            lines.append(f"{full[name]}:" if at is None else f"{rows[at][1] if edit == 'K' else full[name]}:{rows[at][2]}")
        turns = [r[0] for r in rows if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(a[1][:1] + b[1][:1]) for a, b in zip(rows, rows[1:])]
        out.append((conv, gaps, *kinds.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_conversations(rng, n):
    rows = []
    for conv in [*range(n), None]:
        for turn in range(rng.randint(1, 12)):
            text = rng.choice(["Yes.", "No", "", " \t\n", "Why?\n", "é!", "a. b", None, f"Turn {rng.random()}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "ux"]), text))
    return rows


def test_repair_equals_brute_force(spark):
    rng = random.Random(3)
    rows = odd_conversations(rng, 150)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", F.lit("clash")).withColumn("n", F.lit(5))
    got = sorted((tuple(r) for r in repair.mended(df).collect()), key=str)
    assert got == brute_repair(rows) and len(got) == 151
    assert sorted((tuple(r) for r in repair.mended(df.repartition(5)).collect()), key=str) == got
    none = spark.createDataFrame([], "conv_id string, turn long, role string, text string")
    assert repair.mended(none).count() == 0


def test_repair_in_blocks(spark):
    """One long conversation in blocks of eight turns, and copies of one turn over many blocks."""
    rng = random.Random(4)
    rows = [("c", i, rng.choice(["user", "assistant", "system"]), rng.choice([f"t{i}.", f"t{i}", "Same.", ""])) for i in range(300)]
    rows += [("d", 1, "user", "again.")] * 40 + [("d", 2, "user", "b.")] * 3
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    figures, turns = repair.repaired(df.withColumn("n", F.lit(1)), shift=3)
    letters = {c: "".join(r.letters for r in sorted(turns.where(F.col("conv_id") == c).collect(), key=lambda r: r.place)) for c in "cd"}
    cost = {r.conv_id: r.cost for r in figures.collect()}
    for c in "cd":
        seen, tokens = set(), []
        for conv, _, role, text in rows:
            if conv == c:
                gone = not text or (role, text) in seen
                seen.add((role, text))
                tokens.append((role, gone, int(not gone and text[-1] not in ".!?")))
        assert (cost[c], letters[c]) == cheapest(tokens)[:2]


def test_repair_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in queries.op13_repair(spark, sf).collect()), key=str) == brute_repair(rows)


def brute_nearest(rows, every, k):
    """Exact nearest rows, scores summed in the order of the dimensions."""
    sound = {(i, tuple(v)) for i, v in rows if i is not None and v and None not in v and all(np.isfinite(v)) and any(v)}
    out = []
    for q, v in sound:
        if q % every == 0:
            found = []
            for i, x in sound:
                if (i, x) != (q, v) and len(x) == len(v):
                    s = 0.0
                    for a, b in zip(v, x):
                        s += a * b
                    found.append((-s, i))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out)


def odd_vectors(rng, n, dim):
    base = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(n // 3)]
    rows = [(i, [x * rng.choice([1, 1, 3]) + rng.gauss(0, 0.2) for x in rng.choice(base)]) for i in range(n)]
    rows += [(n + i, list(rows[7][1])) for i in range(60)]  # copies, of which several ask
    rows += [(5000, None), (5020, []), (5040, [0.0] * dim), (5060, [float("nan")] * dim), (5080, [float("inf")] + [0.0] * (dim - 1)), (5100, [None] * dim), (None, rows[3][1])]
    rows += [(6000, [1.0, 2.0]), (6001, [2.0, 1.0]), (6020, [-1.0, 0.5]), rows[0], rows[20], (20, rows[21][1])]
    return rows


def test_nearest_equals_brute_force_where_all_lists_are_probed(spark):
    rows = odd_vectors(random.Random(8), 700, 24)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("x", F.lit("clash")).withColumn("list", F.lit(1))
    got = neighbours.nearest(df, probes=10_000, eps=50.0, chunk=64)
    assert sorted(map(tuple, got.collect())) == brute_nearest(rows, 20, 20)
    few = neighbours.nearest(spark.createDataFrame(rows[:9], "vec_id long, embedding array<double>"), every=2, k=20)
    assert sorted(map(tuple, few.collect())) == brute_nearest(rows[:9], 2, 20)
    thin = spark.createDataFrame(rows[:60], "vec_id long, embedding array<double>")
    found = neighbours.nearest(thin, every=5, k=20, probes=1).groupBy("query_id").count().collect()
    assert {r.query_id: r["count"] for r in found} == {i: 20 for i in range(0, 60, 5)}  # the other lists fill up what one lacks
    assert neighbours.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_nearest_recall_and_scores(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op11_neighbours(spark, sf).collect()
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), dtype=float)
    at, hits, by = {i: n for n, i in enumerate(ids)}, 0, {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i in ids if i % 20 == 0}
    for q, found in by.items():
        ip = x @ x[at[q]]
        ip[at[q]] = -np.inf
        found.sort(key=lambda r: r.rank)
        assert [r.rank for r in found] == list(range(1, 21)) and len({r.vec_id for r in found}) == 20
        assert np.allclose([r.score for r in found], ip[[at[r.vec_id] for r in found]], atol=1e-12)
        assert [(-r.score, r.vec_id) for r in found] == sorted((-r.score, r.vec_id) for r in found)
        hits += sum(r.score >= np.sort(ip)[-20] - 1e-12 for r in found)
    assert hits / len(got) >= 0.9


def test_columns_are_abandoned_early():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 64))[rng.integers(0, 40, 2000)] + 0.3 * rng.standard_normal((2000, 64))
    x = x / np.sqrt((x * x).sum(1))[:, None]
    q = x[:50]
    ip = q @ x.T
    tau = np.sort(ip, axis=1)[:, -20]
    i, j, left = neighbours.surviving(q, x, tau, 2.1, 16)
    found = set(zip(i.tolist(), j.tolist()))
    best = [(a, b) for a in range(50) for b in np.flatnonzero(ip[a] >= tau[a])]
    assert sum(p in found for p in best) >= 0.98 * len(best)
    assert left == sorted(left, reverse=True) and left[0] < 0.4 * ip.size and left[1] < 0.1 * ip.size and left[-1] < 1.1 * len(best)


def test_phrases_equal_sql(spark):
    assert sql_differences(spark, queries.op12_phrases, queries.ORACLE_SQL["op12_phrases"], "/root/testdata/sf0.01") == ([], [], 0)


def odd_texts(rng):
    words = ["A", "b", "É", "c\x01", "dd", "e-e", "F"]
    texts = [rng.choice([" ", "\t", "  "]).join(rng.choice(words[: rng.choice([2, 7])]) + rng.choice(["", "", "", ".", ",", "\n", "\r"]) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    langs = [rng.choice(["en", "fr", None, "und"]) for _ in texts]
    return [*zip(langs, texts), ("en", None), (None, ""), ("de", ". ,\n"), *[("fr", "a b b a. dd e-e")] * 8, ("en", "a b " * 3000)]


def test_phrases_of_odd_texts(spark, tmp_path):
    rows = odd_texts(random.Random(2))
    df = spark.createDataFrame(rows, "lang string, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    sql = queries.ORACLE_SQL["op12_phrases"].replace(">= 100)", ">= 6)").replace("HAVING count(*) >= 100", "HAVING count(*) >= 6").replace("<= 2000", "<= 9")
    sql = sql.replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    empty = tmp_path / "none"
    empty.mkdir()
    clash = lambda s, _: df.withColumn("k", F.lit("clash")).withColumn("n", F.lit(1))
    for kind in ({}, {"words": 3}, {"pairs": 0}):  # the dictionary in blocks, and runs without a filter, change nothing
        assert sql_differences(spark, lambda s, d, kind=kind: phrases.collocations(clash(s, d), often=6, top=9, **kind), sql, str(empty)) == ([], [], 0)
    assert phrases.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0


def test_radix_order_is_lexicographic():
    keys = np.random.default_rng(3).integers(0, 1 << 32, (5000, 3), dtype=np.uint32) & np.uint32(0x10003)
    assert keys[phrases.radix_order(keys)].tolist() == sorted(keys.tolist())
    long = b"ab " * 800_000 + b"X.y"
    assert [w for words in phrases.tokens(long) for w in words] == [b"ab"] * 800_000 + [b"x", b",", b"y"]


def test_mixing_of_equal_rows(spark):
    """Equal rows are taken one by one, as many as the target asks for."""
    for equal, other in ((400, 43), (1000, 43), (399, 7)):
        rows = [(1, "a b c", "A")] * equal + [(i + 10, "w " * 21, "B") for i in range(other)] + [(None, "", "A")] * 5 + [(2, "long " * 200_000, "C")]
        got = mixing.by_source(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
        by = {}
        for r in got:
            key = "A" if r.doc_id in (1, None) else "C" if r.doc_id == 2 else "B"
            taken, target, largest = by.get(key, (0, 0, 0))
            by[key] = (taken + r.taken, r.target, max(largest, r["size"]))
        for taken, target, largest in by.values():
            assert abs(taken - target) <= largest
        assert abs(by["A"][0] - by["A"][1]) <= 3


def test_quality_scores_equal_dense_matrices(spark):
    """The discriminant from whole covariance matrices, inverted and with their determinants, without a factor."""
    rng = random.Random(12)
    words = ["alpha", "Beta", "12", "##", "long" * 6, "é", "end.", "|"]
    texts = {i: "\n".join(" ".join(rng.choice(words[: 3 + 5 * (i % 2)]) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5))) for i in range(240)}
    docs = spark.createDataFrame([*texts.items(), (900, ""), (901, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2 if rng.random() < 0.9 else 1 - i % 2) for i in texts], "doc_id long, quality int")
    truth = {r.doc_id: r.quality for r in labels.collect()}
    used = [i for i in texts if zlib.crc32(str(i).encode()) % 3 != 1]
    x = np.array([quality._statistics(texts[i]) for i in used])
    y = np.array([truth[i] for i in used])
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
    z = (x - mean) / scale
    cov = {c: np.cov(z[y == c].T, bias=True) for c in (0, 1)}
    pooled = sum(cov[c] * (y == c).mean() for c in (0, 1))

    def density(v, c):
        n = (y == c).sum()
        a = max(0.1, x.shape[1] / (x.shape[1] + n))
        m = (1 - a) * cov[c] + a * (0.9 * pooled + 0.1 * np.diag(np.diag(pooled))) + 1e-3 * np.eye(x.shape[1])
        gap = (v - mean) / scale - z[y == c].mean(axis=0)
        return np.log(n / len(y)) - 0.5 * (np.linalg.slogdet(m)[1] + gap @ np.linalg.inv(m) @ gap)

    got = {r.doc_id: r for r in quality.scored(docs, labels).collect()}
    assert len(got) == 242
    for i, r in got.items():
        v = np.array(quality._statistics(texts.get(i)))
        assert abs(r.score - 1 / (1 + np.exp(np.clip(density(v, 0) - density(v, 1), -500, 500)))) < 1e-8
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5)


def test_quotes_of_a_long_conversation(spark):
    """Replies over several chunks of turns, with a very long text."""
    rng = random.Random(13)
    n = 2 * quotes.CHUNK + 300
    parent = {0: None} | {t: rng.randrange(t) if rng.random() < 0.03 else t - 1 for t in range(1, n)}
    rows = [(9, t, "user", (f"> word{p}\n" if p is not None and p != t - 1 else "") + f"word{t}" + (" x" * 300_000 if t == 1500 else "")) for t, p in parent.items()]
    parent = {t: p if p != 1500 or t == 1501 else t - 1 for t, p in parent.items()}  # its line is no longer equal to the quote
    got = {r.turn: r for r in quotes.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).select("turn", "parent_turn", "reply_order").collect()}
    assert {t: r.parent_turn for t, r in got.items()} == parent
    children, order, stack = {}, [], [0]
    for t, p in parent.items():
        children.setdefault(p, []).append(t)
    while stack:
        t = stack.pop()
        order.append(t)
        stack += sorted(children.get(t, []), reverse=True)
    assert sorted(got, key=lambda t: got[t].reply_order) == order
