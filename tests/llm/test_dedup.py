"""SimHash, line dedup and embedding links against brute force, and their defined results for odd rows."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parlance.llm import embeddings, linedup, shared, simhash

DOC = "doc_id long, text string, lang string, source string, n_chars long, th string, h1 string"


def docs(spark, rows):
    """Documents with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOC)


def noisy(rng, n):
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(300)]
    rows, base = [], []
    for i in range(n):
        if base and rng.random() < 0.5:
            words = rng.choice(base).split(" ")
            for _ in range(rng.randint(0, 2)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            text = " ".join(words)
        else:
            text = " ".join(rng.choices(vocabulary, k=rng.randint(1, 80)))
            base.append(text)
        rows.append((i, text))
    return rows


def model_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    k = min(width, len(words))
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_simhash_equals_brute_force(spark):
    rows = noisy(random.Random(1), 250)
    rows += [(250, None), (251, ""), (252, " \t"), (253, "One"), (254, "one"), (255, rows[0][1]), (256, "wörd " * 3000)]
    got = {r.doc_id: r for r in simhash.near_duplicates(docs(spark, rows)).collect()}
    fps = [model_fingerprint(t) for _, t in rows]
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    assert [got[i].fingerprint for i, _ in rows] == [f"{f:016x}" for f in fps]
    assert [got[i].component_id for i, _ in rows] == want
    kept = simhash.representatives(docs(spark, rows))
    fps = [model_fingerprint(t, 5) for _, t in rows]
    want = components(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 6])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want)) and kept.columns == DOC.replace(" long", "").replace(" string", "").split(", ")


def test_simhash_small_chunks_keep_links(spark):
    rng = random.Random(2)
    fps = sorted({rng.getrandbits(6) << 3 | 1 for _ in range(60)} | {rng.getrandbits(63) for _ in range(40)})
    found = shared.connected_components(simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), chunk=5))
    root = {r.node: r.root for r in found.collect()}
    want = components(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    same = {}
    for f, w in zip(fps, want, strict=True):
        assert same.setdefault(w, root.get(f, f)) == root.get(f, f)
    assert len(set(root.get(f, f) for f in fps)) == len(set(want))


def test_simhash_odd_rows(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    rows = simhash.near_duplicates(docs(spark, [(None, "a b"), (7, "a b"), (7, "a b"), (None, "q")])).collect()
    assert sorted((r.doc_id, r.component_id) for r in rows if r.doc_id) == [(7, 7), (7, 7)]
    assert sorted(str(r.component_id) for r in rows if r.doc_id is None) == ["7", "None"]


def test_simhash_representatives_of_odd_rows(spark):
    a, b, c = ("one two three four five six", "seven eight nine ten eleven", "red green blue black white grey")
    rows = [(None, a), (None, b), (None, c), (None, c), (7, a), (7, b), (7, b), (9, a), (None, None)]
    kept = simhash.representatives(docs(spark, rows))
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == sorted([("7", a), ("7", b), ("None", c), ("None", "")])
    assert simhash.representatives(docs(spark, [])).count() == 0


def model_lines(rows, t=0.8):
    """Brute force: a line goes if an earlier one, by id, number and hash, is equal or similar."""
    first, out = {}, {}
    for d, text in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: r[0]):
        for n, line in enumerate(text.split("\n")):
            if line.split():
                first.setdefault(line, (d, n))
    order = sorted(first, key=first.get)
    sets = {x: set(x.lower().split()) for x in order}
    late = {x for i, x in enumerate(order) for y in order[:i] if len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y]) - 1e-9}
    for d, text in rows:
        if text is None:
            out[d] = None
            continue
        keep = [x for n, x in enumerate(text.split("\n")) if not x.split() or (x not in late and first[x] == (d, n))]
        out[d] = "\n".join(keep)
    return out


@pytest.fixture(autouse=True)
def small_tables(monkeypatch):
    """A small table of word counts, so that words share buckets; the answers are the same."""
    monkeypatch.setattr(linedup.removed_lines, "__defaults__", (0.8, 1 << 12))
    monkeypatch.setattr(linedup.dedup_lines, "__defaults__", (0.8, False, 1 << 12))


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(3)
    lines = [t for _, t in noisy(rng, 300)]
    rows = [(i, "\n".join(rng.choices(lines, k=rng.randint(1, 6)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, " \n"), (104, "The\nthe"), (105, rows[0][1]), (106, " ".join(f"w{i}" for i in range(5000)))]
    got = {r.doc_id: r.text for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == model_lines(rows)


def test_line_dedup_odd_rows(spark):
    assert linedup.dedup_lines(docs(spark, [])).count() == 0
    out = linedup.dedup_lines(docs(spark, [(1, "a b c\nx"), (1, "a b c\nx"), (None, "x"), (2, "a b c")]), extra=True)
    assert sorted((str(r.doc_id), r.text, r.n_removed) for r in out.collect()) == [("1", "a b c", 1), ("1", "a b c", 1), ("2", "", 1), ("None", "x", 0)]
    assert out.columns[:7] == [c.split()[0] for c in DOC.split(", ")]


def test_lines_are_normalised_without_a_regex(spark):
    rows = [(1, "A\tb\x0bC\x0cd\re\nÀ\tF"), (2, "Plain Text\nÉ"), (3, None), (4, "")]
    df = docs(spark, rows).select("doc_id", linedup._normal(F.col("text")).alias("x"))
    assert {r.doc_id: r.x for r in df.collect()} == {1: "a b c d e\nà f", 2: "plain text\né", 3: None, 4: ""}
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("rows, packed", [
    ([(9, "b a\n\nc"), (-4, "a"), (2, None), (5, "x\ny y")], True),
    ([(9, "b a\n\nc"), (9, "z"), (None, "a"), (5, "x\ny y")], False),
    ([(1 << 62, "b a\n\nc"), (-(1 << 62), "a")], False),
])
def test_texts_are_cut_into_words_once_and_lines_numbered_in_order(spark, rows, packed):
    df = docs(spark, rows).select(linedup._id().alias("d"), linedup._hash().alias("th"), "text")
    placed = linedup.placed_lines(df)
    assert ("monotonically_increasing_id" in placed._jdf.queryExecution().optimizedPlan().toString()) != packed
    got = placed.collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.d, r.th, r.line_no))] == sorted({r.id for r in got})
    assert sorted(len(r.ws) for r in got) == sorted(len(set(x.split())) for _, text in rows if text for x in text.split("\n") if x.split())
    with shared.scratch(spark, codec="lz4", dictionary=False) as store:
        ranked = linedup.ranked_lines(store(placed), 0.8, 1 << 12)
        assert "split(" not in ranked._jdf.queryExecution().optimizedPlan().toString() and ranked.count() == len(got)


def test_a_hot_group_of_lines_is_settled(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(0, " ".join(base))] + [(i, " ".join([f"new{i}", *base[1:]])) for i in range(1, 200)]
    got = linedup.dedup_lines(docs(spark, rows)).where("text <> ''")
    assert [r.doc_id for r in got.collect()] == [0]


def test_long_lines_equal_brute_force(spark):
    """Lines on both sides of LONG words, with second parities and without."""
    rng = random.Random(14)
    rows = []
    for _ in range(30):
        base = [f"v{rng.randrange(3000)}" for _ in range(rng.randint(85, 260))]
        for _ in range(3):
            words = list(base)
            for _ in range(rng.randint(0, len(base) // 7)):
                words[rng.randrange(len(words))] = f"u{rng.randrange(3000)}"
            rows.append((len(rows), "\t".join(words)))
    got = {r.doc_id: r.text for r in linedup.dedup_lines(docs(spark, rows)).collect()}
    assert got == model_lines(rows) and 20 < sum(not t for t in got.values()) < 60


VEC = "vec_id long, embedding array<float>, label int, key string"


def test_embeddings_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for b in rng.normal(size=(120, 16)):
        for _ in range(rng.integers(1, 6)):
            noise = rng.normal(size=16)
            rows.append((len(rows), [float(x) for x in b / np.linalg.norm(b) + noise / np.linalg.norm(noise) * rng.choice([0, 0.08, 0.15, 0.2])], int(rng.integers(0, 3)), "k"))
    n = len(rows)
    odd = [(n, None, 1, "k"), (n + 1, [0.0] * 16, 1, "k"), (n + 2, [float("nan")] + [1.0] * 15, 0, "k"), (n + 3, rows[0][1], None, "k"), (n + 4, [1.0], 0, "k"), (n + 5, [None] * 16, 0, "k")]
    odd += [(n + 6, rows[0][1], rows[0][2], "k"), (n + 7, [float("inf")] * 16, 0, "k"), (n + 8, [], 0, "k")]
    df = spark.createDataFrame(rows + odd, VEC)
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, chunk=50).collect()}
    use = rows + [odd[6]]
    v = np.array([np.float32(r[1]).astype(float) for r in use])
    v /= np.linalg.norm(v, axis=1)[:, None]
    label = np.array([r[2] for r in use])
    link = (v @ v.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(link, False)
    exact = sum(got[r[0]].n_links == k for r, k in zip(use, link.sum(1), strict=True))
    found = sum(got[r[0]].n_links for r in use)
    assert found >= 0.9 * link.sum() and found <= link.sum() and exact >= 0.9 * len(use)
    for r in odd[:6] + odd[7:]:
        assert (got[r[0]].n_links, got[r[0]].component_id, got[r[0]].kept) == (0, r[0], True)
    assert embeddings.near_duplicates(spark.createDataFrame([], VEC)).count() == 0


def test_embeddings_of_every_length_and_few_directions_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "RARE", 300)
    real = embeddings.fit
    monkeypatch.setattr(embeddings, "fit", lambda sample, n_lists, **kw: real(sample, 200, **kw))  # hundreds of lists
    rng = np.random.default_rng(8)
    rows = []
    for dim, n in ((64, 400), (96, 200), (8, 30)):
        few = rng.normal(size=(2, dim))
        for b in rng.normal(size=(n, dim)):
            for _ in range(2):
                shift = rng.normal(size=2) @ few
                v = b / np.linalg.norm(b) + shift / np.linalg.norm(shift) * rng.choice([0, 0.1, 0.17, 0.2, 0.25])
                rows.append((len(rows), [float(x) for x in v], 1, "k"))
    got = {r.vec_id: r.n_links for r in embeddings.near_duplicates(spark.createDataFrame(rows, VEC)).collect()}
    want = {}
    for dim in (64, 96, 8):
        ids = [r[0] for r in rows if len(r[1]) == dim]
        v = np.array([np.float32(rows[i][1]).astype(float) for i in ids])
        v /= np.linalg.norm(v, axis=1)[:, None]
        want |= dict(zip(ids, ((v @ v.T >= 0.98).sum(1) - 1).tolist(), strict=True))
    assert got == want and all(any(want[r[0]] for r in rows if len(r[1]) == dim) for dim in (64, 96, 8))


@pytest.mark.parametrize("edges, want", [([(3, 2), (2, 1), (5, 4)], {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}), ([], {}), ([(1, 1)], {}), ([(i, i + 1) for i in range(40)], {i: 0 for i in range(41)})])
def test_components(spark, edges, want):
    got = shared.connected_components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.root for r in got.collect()} == want


def test_words(spark):
    df = spark.createDataFrame([("a\tb\x0bc \n d\x1fe f", ), (None,), ("",)], "t string")
    assert [r.w for r in df.select(shared.words(F.col("t")).alias("w")).collect()] == [["a", "b", "c", "d\x1fe f"], [], []]
