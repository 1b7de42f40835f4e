"""The pipeline against a brute-force version of its stages on a small corpus."""

import random

import corpus_pipeline
from parlance.llm import mixing, toxicity

from .test_dedup import components, model_fingerprint, model_lines, noisy


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(11)
    texts = [t for _, t in noisy(rng, 150)]
    items = [(i, " ".join(rng.choices([f"bench{k}" for k in range(200)], k=20))) for i in range(4)]
    rows = []
    for i, t in enumerate(texts):
        if i % 10 == 0:
            t += " you idiot. you worthless scum"
        if i % 12 == 5:
            t += "\n" + rng.choice(items)[1]
        rows.append((i, t + "\n" + rng.choice(texts), "en", f"s{i % 3}", len(t)))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(150)], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    toxic = {r.doc_id for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    assert {i for i in range(0, 150, 10)} <= toxic and len(toxic) < 40
    left = model_lines([r[:2] for r in rows if r[0] not in toxic])
    ids = sorted(left)
    fps = [model_fingerprint(left[i], 5) for i in ids]
    near = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 6])
    kept = {ids[k] for k in range(len(ids)) if near[k] == k}

    def holds(text, item):
        def shingles(t):
            w = (t or "").lower().split()
            return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

        s = shingles(item)
        return len(s & shingles(text)) >= 0.8 * len(s)

    kept = {i for i in kept if not any(holds(left[i], x) for _, x in items)}
    assert set(got) == kept
    sizes, source = {}, {r[0]: r[3] for r in rows}
    for i in kept:
        sizes[source[i]] = sizes.get(source[i], 0) + len((left[i] or "").split())
        assert got[i]["size"] == len((left[i] or "").split()) and got[i].taken <= 3 * got[i]["size"]
    want = mixing.capped_targets(sizes, mixing.ranked_weights(list(sizes)), sum(sizes.values()))
    for s, target in want.items():
        assert abs(sum(got[i].taken for i in kept if source[i] == s) - target) <= max(5, 0.02 * target)
