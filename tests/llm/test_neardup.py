"""Near duplicates by five-word shingles, against brute force."""

import random

import corpus_pipeline
from perron.llm import neardup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def slow_set(text):
    words = [w for w in (text or "").encode().lower().split()]
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {b" ".join(words)} if words else set()


def slow_components(texts):
    sets = [slow_set(t) for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if label[i] != label[j] and 5 * len(a & b) >= 4 * len(a | b):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def edited(rng, words, cuts):
    out = list(words)
    for _ in range(cuts):
        out[rng.randrange(len(out))] = f"new{rng.randrange(10**6)}"
    return out


def edited_docs():
    rng = random.Random(8)
    texts = []
    for _ in range(40):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randint(60, 400))]
        texts.append(" ".join(words))
        for share in (0.005, 0.01, 0.02, 0.03, 0.08):
            texts.append(" ".join(edited(rng, words, max(1, round(share * len(words))))))
    rng.shuffle(texts)
    return texts + ["", None, " \n", "one", "One", "one two", texts[0].upper(), texts[1]]


def test_edited_copies_are_found(spark):
    texts = edited_docs()
    want = slow_components(texts)
    far = [(i, w) for i, w in enumerate(want) if i != w and bin(simhash.fingerprint(texts[i], 5) ^ simhash.fingerprint(texts[w], 5)).count("1") > 3]
    assert len(far) > 20  # copies that a budget of 3 bits does not link directly
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == want
    kept = {r.doc_id for r in corpus_pipeline.near_duplicate(spark, docs, "").collect()}
    assert kept == set(want)


def test_near_duplicates_of_nothing(spark, no_docs):
    assert neardup.near_duplicates(no_docs).collect() == []


def test_a_common_passage_joins_only_near_copies(spark):
    """Texts that are mostly one passage share bands; pairs of them that are near copies are still found, and no others."""
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(300)]
    texts = []
    for i in range(60):
        words = passage + [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(30, 150))]
        texts.append(" ".join(words))
        if i % 5 == 0:
            texts.append(" ".join(edited(rng, words, 3)))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs).collect()}
    assert [got[i] for i in range(len(texts))] == slow_components(texts)


def test_prefix_pairs_are_complete(spark):
    rng = random.Random(2)
    sets = []
    for i in range(30):
        base = rng.sample(range(60), rng.randint(1, 25))
        sets += [set(base), set(base) ^ set(rng.sample(range(60), min(2, len(base))))]
    sets = [s or {1} for s in sets]
    rows = [(k, len(s), sorted(s), k) for k, s in enumerate(sets)]
    got = {(r.a, r.b) for r in neardup.prefix_pairs(spark.createDataFrame(rows, "k long, n long, shingles array<long>, root long")).collect()}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near and near <= got


def test_hot_heads_are_dealt_to_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "GROUP", 7)
    sets = [(k, 10, list(range(9 if k % 3 else 5)) + [100 + k, *([] if k % 3 else range(200, 204))]) for k in range(50)]
    pairs = spark.createDataFrame([(0, k) for k in range(1, 50)] + [(1, k) for k in range(2, 50)], "a long, b long")
    got = {(r.a, r.b) for r in neardup.similar(pairs, spark.createDataFrame(sets, "k long, n long, shingles array<long>")).collect()}
    jaccard = lambda a, b: len(set(sets[a][2]) & set(sets[b][2])) / len(set(sets[a][2]) | set(sets[b][2]))
    assert got == {(a, b) for a, b in ((r.a, r.b) for r in pairs.collect()) if jaccard(a, b) >= 0.8}
