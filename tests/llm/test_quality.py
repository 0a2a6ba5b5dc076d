"""Op 3 against a plain restatement in numpy, and the pipeline against plain stages."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from test_documents import check_pieces, library_ids, slow_dedup
from test_neardup import slow_components

import corpus_pipeline
from perron.llm import mixing, pack, quality, shared

BLANK = (9, 10, 11, 12, 13, 32)


def slow_statistics(text):
    raw = list((text or "").encode())
    if not raw:
        return [0.0] * len(quality.STATISTICS)
    words, lines = bytes(raw).split(), bytes(raw).split(b"\n")
    n = max(len(words), 1)
    share = lambda some: np.sqrt(sum(b in some for b in raw) / len(raw))
    classes = [set(range(65, 91)), set(range(97, 123)), set(range(48, 58)), set(range(128, 256)), set(BLANK), {10}, set(b".,;:'\"-()?"), set(b"!"), set(b"$%&*#@^~<>=_+\\/{}[]`"), set(b"|")]
    return [
        np.log(1 + len(raw)), np.log(1 + len(words)), np.log(1 + len(raw) / n), np.log(max(len(set(words)), 1) / n) / max(1.0, np.log(1 + n)),
        np.sqrt(sum(a == b for a, b in zip(words, words[1:])) / n), np.sqrt(max((words.count(w) for w in set(words)), default=0) / n), np.sqrt(sum(w.isupper() for w in words) / n),
        len(set(lines)) / len(lines), np.log(1 + len(raw) / len(lines)), *map(share, classes),
    ]


def slow_pool(score, y):
    """Isotonic regression by repeated merging of neighbours that fall."""
    groups = [[s, 1.0, t] for s, t in zip(score, y)]
    at = 0
    while at < len(groups) - 1:
        a, b = groups[at], groups[at + 1]
        if a[2] / a[1] >= b[2] / b[1]:
            groups[at : at + 2] = [[(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]]]
            at = max(0, at - 1)
        else:
            at += 1
    p = np.array([(g[2] + 0.5) / (g[1] + 1) for g in groups])
    return np.array([g[0] for g in groups]), np.maximum.accumulate(p)


def slow_scores(rows, labels, bins=4096):
    """Scores by one process: the same features, ridge and pooling, written out."""
    x = np.array([slow_statistics(r.text) for r in rows], np.float32).astype(float)
    fold = np.array([zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows])
    known = np.array([labels.get(r.doc_id) is not None and f != 0 for r, f in zip(rows, fold)])
    y = np.array([labels.get(r.doc_id) or 0 for r in rows], float)
    mean, scale = x[known].mean(axis=0), x[known].std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    rng = np.random.default_rng(7)
    w, b = rng.standard_normal((x.shape[1], 256)) / np.sqrt(x.shape[1]), rng.uniform(0, 2 * np.pi, 256)
    phi = np.c_[np.cos(np.clip((x - mean) / scale, -8, 8) @ w + b) * np.sqrt(2 / 256), np.ones(len(x))]

    def solved(take, ridge):
        p = np.full(257, ridge)
        p[-1] = 1e-9
        return np.linalg.solve(phi[take].T @ phi[take] + np.diag(p), phi[take].T @ y[take])

    folds = [known & (fold == k) for k in range(1, 5)]
    cost = lambda r: sum(((phi[f] @ solved(known & ~f, r) - y[f]) ** 2).sum() for f in folds)
    ridge = min((10.0**e for e in range(-4, 4)), key=cost)
    unseen = np.zeros(len(x))
    for f in folds:
        unseen[f] = phi[f] @ solved(known & ~f, ridge)
    at = np.clip(np.floor((unseen[known] + 0.5) * (bins / 2)), 0, bins - 1)
    groups = sorted(set(at))
    score = [unseen[known][at == g].mean() for g in groups]
    merged = [(s, (at == g).sum(), y[known][at == g].sum()) for s, g in zip(score, groups)]
    knots = quality.isotonic(*(np.array(c, float) for c in zip(*merged)))
    assert all(np.allclose(a, c) for a, c in zip(quality.isotonic(np.arange(40.0), np.ones(40), y[known][:40]), slow_pool(np.arange(40.0), y[known][:40])))
    return np.clip(np.interp(phi @ solved(known, ridge), *knots), 0, 1)


def test_scores_equal_a_plain_restatement(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.collect()
    want = slow_scores(rows, {r.doc_id: r.quality for r in labels.collect()})
    got = {r.doc_id: r for r in quality.score_documents(docs, labels).collect()}
    assert len(got) == len(rows)
    for r, s in zip(rows, want):
        g = got[r.doc_id]
        assert abs(g.score - s) < 1e-5 and g.predicted == (g.score >= 0.3) and g.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_pipeline_equals_plain_stages(spark):
    """What run() returns, from plain versions of its stages; of the mix, its documented rule on the same posteriors."""
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.collect()
    scores = slow_scores(rows, {r.doc_id: r.quality for r in labels.collect()})
    kept = {r.doc_id: r.text for r, s in zip(rows, scores) if s >= 0.3}
    seen, lined = set(), {}
    dropped = {d: (n, k) for d, n, k, _ in slow_dedup(sorted(kept.items()))}
    for d, text in sorted(kept.items()):
        lines = (text or "").split("\n")
        keys = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r")) for x in lines]
        stay = [x for x, k in zip(lines, keys) if len(k) < 10 or k not in seen]
        assert len(lines) - len(stay) == dropped[d][1]
        seen |= {k for k in keys if len(k) >= 10}
        if stay:
            lined[d] = "\n".join(stay)
    ids = sorted(lined)
    first = slow_components([lined[d] for d in ids])
    unique = [d for i, d in enumerate(ids) if first[i] == i]
    held = shared.written(spark.createDataFrame([(d, lined[d]) for d in unique], "doc_id long, text string"), "held")
    rates = mixing.mix(held, mixing.label_domains(labels), mixing.SAFE_TARGETS, max_rate=1.0).toPandas()
    final = set(rates.doc_id[rates.copies > 0])
    assert len(final) > 100 and np.all((rates.copies == 1) | (rates.rate < 1))
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r.doc_id for r in out} == final
    want = library_ids(spark.createDataFrame([(d, lined[d]) for d in final], "doc_id long, text string").collect())
    check_pieces(out, want, pack.Limits())
