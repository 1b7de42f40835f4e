"""The other operators: brute force, round trips, held-out accuracy and odd rows."""

import base64
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from parlance.llm import decontaminate, licenses, mixing, quality, quotes, toxicity, warc

from .test_dedup import docs, noisy

SF = "/root/testdata/sf0.1"


def test_contained_equals_brute_force(spark):
    rng = random.Random(5)
    texts = [t for _, t in noisy(rng, 60)]
    items = [(i, " ".join(rng.choice(texts).split(" ")[: rng.randint(1, 30)])) for i in range(25)] + [(90, None), (91, ""), (92, "Lone"), (None, "un nulled item of seven words here")]
    rows = [(i, f"{t} {rng.choice(texts)}\n{(rng.choice(items)[1] or '').upper()}") for i, t in enumerate(texts)]
    rows += [(100, None), (101, ""), (102, "a lone word"), (102, "a lone word"), (103, "un nulled item of seven words here")]
    got = decontaminate.contained(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))

    def shingles(words, k):
        return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}

    want = set()
    for d, t in rows:
        for i, x in items:
            w = (x or "").lower().split()
            if w:
                k = min(5, len(w))
                s = shingles(w, k)
                c = len(s & shingles((t or "").lower().split(), k))
                if c >= 0.8 * len(s):
                    want.add((d, i, len(s), c))
    assert {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in got.collect()} == want
    assert got.count() == len(want)
    left = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in left.collect()) == sorted(d for d, _ in rows if d not in {w[0] for w in want})
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(docs(spark, rows), none).count() == 0 and decontaminate.decontaminate(docs(spark, []), none).count() == 0


def test_size_partitions_have_bounds_of_their_own(spark):
    items = [(1, "a lone pair"), (2, " ".join(f"w{i}" for i in range(60)))]
    whole = decontaminate.item_shingles(spark.createDataFrame(items, "item_id long, text string"))
    sketch = decontaminate.sketches(whole, 0.8)
    tops = {(r.k, r.part): r.top for r in sketch.groupBy("k", "part").agg(F.max("h").alias("top")).collect()}
    assert set(tops) == {(3, 0), (5, 5)} and sketch.where("item_id = 2").count() == 56 - 45 + 4
    five = " ".join(f"x{i}" for i in range(2000))
    docs_ = spark.createDataFrame([(7, 0, five.split())], "doc_id long, th long, w array<string>")
    small = sketch.where("item_id = 2").unionByName(spark.createDataFrame([(3, 5, 0, 2**63 - 1)], "item_id long, k int, part int, h long"))
    asked = {r.part: r.n for r in decontaminate.probes(docs_, small).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert asked[0] == 1996 and 0 < asked[5] < 0.6 * 1996  # the short item's bound does not lift that of the long one
    long = " ".join(f"w{i}" for i in range(60) if i != 30)
    got = decontaminate.contained(spark.createDataFrame([(1, f"{five} {long}"), (2, f"w1 w2 w3 w4 w5 w6 {five}")], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert [(r.doc_id, r.item_id, r.n_shared) for r in got.collect()] == [(1, 2, 51)]


def test_mixing_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), ["a", "b", "c", "d", None][min(4, int(rng.random() ** 2 * 5))]) for i in range(800)] + [(900, None, "a"), (901, "x", "a"), (901, "x", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mixing.by_source(df).collect()
    assert len(got) == len(rows) and all(r.taken <= 3 * r["size"] for r in got)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.by_source(df.repartition(3)).collect()))
    source, by = {r[0]: r[2] for r in rows}, {}
    for r in got:
        s = by.setdefault(source[r.doc_id], [0, 0, r.source_size, r.target])
        s[0] += r.taken
        s[1] += r["size"]
    for taken, size, stated, target in by.values():
        assert size == stated and target <= 3 * size + 1e-6 and abs(taken - target) <= max(2, 0.01 * target)
    assert abs(sum(s[3] for s in by.values()) - sum(s[1] for s in by.values())) < 1e-6
    assert mixing.by_source(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


def test_targets_and_flow():
    assert mixing.ranked_weights(["b", None, "a"]) == {"a": 5.0, "b": 2.0, None: 1.0}
    t = mixing.capped_targets({"a": 10, "b": 100, "c": 100}, {"a": 5.0, "b": 2.0, "c": 1.0}, 210)
    assert t == {"a": 30.0, "b": 120.0, "c": 60.0}
    flow = mixing.min_cost_flow({"p": 10, "q": 10}, {"p": ["x"], "q": ["x", "y"]}, {"x": 18, "y": 7})
    assert sum(v for (p, s), v in flow.items() if s == "x") == 18 and sum(v for (p, s), v in flow.items() if s == "y") == 7
    assert sum(v for (p, s), v in flow.items() if p == "q") in range(10, 21) and max(flow.values()) <= 30


def test_flow_is_cheapest():
    rng = random.Random(7)
    for _ in range(30):
        supply = {p: rng.randint(1, 3) for p in "pqr"}
        members = {p: rng.sample(["x", "y"], rng.randint(1, 2)) for p in supply}
        demand = {"x": rng.randint(0, 4), "y": rng.randint(0, 4)}
        flow = mixing.min_cost_flow(supply, members, demand)
        total = {p: sum(v for (a, _), v in flow.items() if a == p) for p in supply}

        def cost(n, size):
            return sum((0, 1, 3)[k] * max(0, min(size, n - k * size)) for k in range(3))

        got = (-sum(flow.values()), sum(cost(total[p], supply[p]) for p in supply))
        states = {(0, 0): 0}
        for p in supply:
            new = {}
            for (x, y), c in states.items():
                for i in range(3 * supply[p] + 1 if "x" in members[p] else 1):
                    for j in range(3 * supply[p] + 1 - i if "y" in members[p] else 1):
                        if x + i <= demand["x"] and y + j <= demand["y"]:
                            k = (x + i, y + j)
                            new[k] = min(new.get(k, 10**9), c + cost(i + j, supply[p]))
            states = new
        assert got == min((-x - y, c) for (x, y), c in states.items())


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a", "b"] if i % 2 else ["a"]) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, s array<string>")
    taken, sizes, targets, flow = mixing.mix(df, F.col("s"))
    assert sizes == {"a": 1000, "b": 500} and sum(r.taken for r in taken.collect()) == pytest.approx(sum(flow.values()), abs=10)


PAGES = "page_id long, url string, html string, sha string"


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>ü{i % 7}</p>" * (i % 5), "clash") for i in range(60)]
    rows += [(60, None, None, "c"), (61, "http://a\r\nb%0A", "x" * 300_000, "c"), (62, "u", "\r\n\r\nWARC/1.0\r\n", "c"), (None, "n", "x" * 300_000, "c")]
    index = warc.write(spark.createDataFrame(rows, PAGES))
    got = {r.page_id: r for r in warc.read(index).collect()}
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first.setdefault(h or "", i)
    for i, url, h, _ in rows:
        raw, r = (h or "").encode(), got[i]
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
        assert r.html == ((h or "") if r.record_type == "response" else None)
    some = warc.read(index.where("page_id in (3, 61)"), gap=0, most=10)
    assert sorted(r.page_id for r in some.collect()) == [3, 61]
    assert warc.round_trip(spark.createDataFrame([], PAGES)).count() == 0


def test_quality_and_toxicity_hold_out(spark):
    d, lab = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    for scored, label, least in ((quality.scored(d, lab), "quality", 0.93), (toxicity.scored(d, lab), "toxic", 0.93)):
        rows = scored.join(lab, "doc_id").where("held_out").collect()
        assert sum(r.predicted == r[label] for r in rows) / len(rows) >= least
        assert all(0 <= r.score <= 1 for r in rows) and len(rows) > 500


@pytest.mark.parametrize("module", [quality, toxicity])
def test_classifiers_odd_rows(spark, module):
    rows = [(1, "you idiot"), (2, None), (2, None), (None, ""), (3, "a fine day " * 20_000), (4, "gr\x00ß")]
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 0), (4, None, None), (1, 0, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.where("false")):
        got = module.scored(docs(spark, rows), lab).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert module.scored(docs(spark, []), labels).count() == 0


def test_grammar_composes():
    machine, seeds = toxicity.compose(toxicity.TRANSDUCERS), toxicity.seed_symbols()

    def best(text):
        return toxicity._figures(text, {}, machine, seeds)[0]

    assert best("you idiot") == best("idiot, you") > best("an idiot") > best("he said an idiot") > best("not an idiot") > best("a day") == 0
    assert best("not so. an idiot") == best("an idiot") and best("he said: an idiot") < best("he said. an idiot")
    assert best("I will kill you") > best("to kill you") and toxicity._figures("I will kill you", {}, machine, seeds)[4] > 0


def separate_machines(words, known):
    """Each transducer run by itself over each clause; scores are put together afterwards."""
    def runs(name, clause, start):
        state, before = start, []
        for w in clause:
            before.append(state)
            state = toxicity.TRANSDUCERS[name]["moves"][state][known.get(w, ("other", 0))[0]]
        return before, state

    out, clause, report = [], [], 0
    for w in [*words, "."]:
        if w not in toxicity.ENDS:
            clause.append(w)
            continue
        at = {n: runs(n, clause, report if n == "report" else 0) for n in toxicity.TRANSDUCERS}
        score = threat = plain = 0.0
        for i, x in enumerate(clause):
            symbol, weight = known.get(x, ("other", 0.0))
            share = {"insult": 1.0, "threat": 1.0 if at["threat"][0][i] else 0.6}.get(symbol)
            if share is not None:
                scaled = weight * share * (0.35 if at["negation"][0][i] else 1) * (0.5 if at["report"][0][i] else 1)
                score, threat, plain = score + scaled, threat + scaled * (symbol == "threat"), plain + weight
        aim = 1.3 if at["target"][1] else 1.0
        if plain:
            out.append((score * aim, threat * aim, plain - score))
        report, clause = (at["report"][1] if w == ":" else 0), []
    return out


def test_composed_machine_equals_the_separate_ones():
    rng, machine, seeds = random.Random(12), toxicity.compose(toxicity.TRANSDUCERS), toxicity.seed_symbols()
    vocabulary = [*rng.sample(sorted(seeds), 40), "idiot", "kill", "will", "you", "not", "said", *"abcd", "rotten", *".!:;:."]
    for _ in range(400):
        words = rng.choices(vocabulary, k=rng.randint(0, 40))
        known = toxicity.known_words(words, {"rot": 1.5, "a$": 0.5}, seeds)
        assert [pytest.approx(c) for c in toxicity.clauses(words, known, machine)] == separate_machines(words, known)
    assert toxicity.known_words(["you", "not"], {"you": 5.0, "not": 5.0}, seeds) == {"you": ("target", 0.0), "not": ("negation", 0.0)}


def test_quotes(spark):
    msgs = [
        (1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\n> How are you?\nFine.\nAnd what do you want?"),
        (1, 2, "user", ">> Hello there\n>> How are you?\n> And what do you  want?\nNothing."), (1, 3, "assistant", "> hello THERE\n> how are you?\nSecond answer"),
        (1, 4, "user", "no quote"), (1, 5, "user", "> never said\nx"), (2, 0, "user", None), (None, 0, "user", "x"), (1, None, "user", "> Fine."), (2, 0, "user", None),
    ]
    df = spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string").withColumn("path", F.lit(1))
    got = {(r.conv_id, r.turn): r for r in quotes.rebuilt(df).collect()}
    assert [got[1, t].parent_turn for t in range(6)] == [None, 0, 1, 0, 3, 4]
    assert [got[1, t].reply_order for t in (0, 1, 2, 3, 4, 5)] == [0, 1, 2, 3, 4, 5]
    assert got[1, 2].clean_text == "Nothing." and (got[1, 2].n_quotes, got[1, 2].n_linked, got[1, 2].max_depth) == (2, 2, 2)
    assert got[1, 5].n_linked == 0 and got[1, None].reply_order == 6 and got[2, 0].clean_text == ""
    assert quotes.rebuilt(df).count() == len(msgs) and quotes.rebuilt(df.where("false")).count() == 0


def test_reply_order_is_depth_first(spark):
    rng = random.Random(8)
    parent = {0: None}
    for t in range(1, 40):
        parent[t] = rng.choice([t - 1, rng.randrange(t)])
    rows = [(9, t, "user", (f"> word{p}\n" if p is not None and p != t - 1 else "") + f"word{t}") for t, p in parent.items()]
    got = {r.turn: r for r in quotes.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert {t: r.parent_turn for t, r in got.items()} == parent
    order, stack = [], [0]
    while stack:
        t = stack.pop()
        order.append(t)
        stack += sorted((c for c, p in parent.items() if p == t), reverse=True)
    assert sorted(got, key=lambda t: got[t].reply_order) == order


def test_licenses_equal_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        name = rng.choice(list(licenses.TEMPLATES))
        words = licenses.TEMPLATES[name].split(" ")
        for _ in range(rng.choice([0, 0, 1, len(words) // 8])):
            words[rng.randrange(len(words))] = rng.choice(["foo", "", "two words"])
        rows.append((i, "lorem ipsum " * rng.randint(0, 30) + " ".join(words) + "\nend of file " * rng.randint(0, 5)))
    rows += [(100, None), (101, ""), (102, "License"), (103, "RELEASED under the: mit LICENSE")]
    got = {(r.doc_id, r.license): r for r in licenses.scan(docs(spark, rows)).collect()}

    def lcs(a, b):
        line = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(line[j] + 1 if x == y else max(line[j + 1], new[j]))
            line = new
        return line[-1]

    for d, text in rows:
        words = licenses._split(text or "")
        for name, t in licenses.TEMPLATES.items():
            a = licenses._split(t)
            windows = [words[max(0, s) : s + len(a) + 4] for s in range(-4, max(1, len(words)), 4)]
            share = max(lcs(a, w) for w in windows) / len(a)
            if share >= 0.9:
                assert (d, name) in got, (d, name)
            if (d, name) in got:
                r = got[d, name]
                assert r.coverage <= lcs(a, words) / len(a) + 1e-9 and words[r.span_start] in a and words[r.span_end - 1] in a
    assert (103, "MIT-line") in got and licenses.scan(docs(spark, [])).count() == 0


def test_licenses_of_few_words_and_repeated_rows(spark):
    text = "some words then public domain and more CC0 here"
    got = licenses.scan(docs(spark, [(1, text), (1, text), (2, "domain public"), (3, "CC0")]), {"PD": "Public Domain", "CC0": "CC0", "none": "  "}).collect()
    assert sorted((r.doc_id, r.license, r.span_start, r.span_end) for r in got) == [(1, "CC0", 7, 8), (1, "PD", 3, 5), (3, "CC0", 0, 1)]


def test_licenses_find_every_copy(spark):
    mit = licenses._split(licenses.TEMPLATES["MIT"])
    quote, split, bsd = mit[: len(mit) * 65 // 100], list(mit), licenses._split(licenses.TEMPLATES["BSD-3-Clause"])
    for at in range(12, len(split), 14):
        split.insert(at, "inserted")
    line = licenses._split(licenses.TEMPLATES["MIT-line"])
    fill = [f"w{i}" for i in range(50)]
    rows = [(1, [*fill[:7], *quote, *fill, *split, *fill]), (2, [*bsd, *fill, *bsd, *bsd]), (3, line * 4), (4, [*line[:-1], *line])]
    got = licenses.scan(docs(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    spans = {i: sorted((r.span_start, r.span_end) for r in got if r.doc_id == i and r.license == x) for i, x in ((1, "MIT"), (2, "BSD-3-Clause"), (3, "MIT-line"), (4, "MIT-line"))}
    at, n, m = 7 + len(quote) + 50, len(bsd), len(line)
    assert spans[1] == [(at, at + len(split))]
    assert spans[2] == [(0, n), (n + 50, 2 * n + 50), (2 * n + 50, 3 * n + 50)]
    assert spans[3] == [(i * m, (i + 1) * m) for i in range(4)]
    assert spans[4] == [(0, m - 1), (m - 1, 2 * m - 1)]
