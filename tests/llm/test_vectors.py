"""Searches over vectors, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perron.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def rows(n, d=24, seed=0, spread=False):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    if spread:
        x *= np.exp(np.random.default_rng(1).standard_normal((n, 1))).astype(np.float32)
    return x


@pytest.fixture(scope="module")
def odd_vectors(spark):
    x = rows(300)
    data = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    data += [(i, x[0].tolist(), 0) for i in range(300, 330)]  # ties
    data += [(400, None, 1), (401, [], 1), (402, [None, *[1.0] * 23], 1), (403, [float("nan"), *[1.0] * 23], 1), (404, [float("inf"), *[1.0] * 23], 1), (405, [0.0] * 24, 1)]
    data += [(None, [1.0] * 24, None), (410, [1.0, 2.0], None), (20, x[20].tolist(), None)]
    return spark.createDataFrame(data, SCHEMA).withColumns({"id": F.lit("?"), "x": F.lit("?"), "rank": F.lit("?"), "score": F.lit("?"), "block": F.lit("?")})


def usable(df, zero):
    out = {}
    for r in df.select("vec_id", "embedding").collect():
        v = r.embedding
        if r.vec_id is None or not v or any(c is None or not np.isfinite(c) for c in v) or (not zero and not any(v)):
            continue
        out[r.vec_id] = np.pad(np.array(v, float), (0, 24 - len(v)))
    ids = sorted(out)
    return np.array(ids), np.array([out[i] for i in ids])


def slow(ids, x, every, k):
    want = []
    for a in np.flatnonzero(ids % every == 0):
        s = x @ x[a]
        order = [j for j in np.lexsort((ids, -s)) if j != a][:k]
        want += [(ids[a], n + 1, ids[j], s[j]) for n, j in enumerate(order)]
    return want


@pytest.mark.parametrize("spread", [False, True])
def test_exact_top_k(spark, spread):
    x = rows(1500, spread=spread)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    ints = np.floor(x.astype(float) * 1024).astype(np.int64)
    got = topk.exact_top_k(df, block=100, query_block=4, head=6).collect()
    assert sorted(map(tuple, got)) == sorted(slow(np.arange(1500), ints, 100, 10))


def test_exact_top_k_of_odd_rows(spark, odd_vectors):
    ids, x = usable(odd_vectors, True)
    got = topk.exact_top_k(odd_vectors, every=10, block=64, query_block=8).collect()
    assert sorted(map(tuple, got)) == sorted(slow(ids, np.floor(x * 1024).astype(np.int64), 10, 10))
    assert topk.exact_top_k(odd_vectors.limit(0)).collect() == []
    few = topk.exact_top_k(odd_vectors.where("vec_id in (100, 101, 102)")).collect()
    assert [(r.query_id, r.rank) for r in few] == [(100, 1), (100, 2)]


def test_nearest_recall(spark):
    x = rows(4000, 32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = ann.nearest(df).collect()
    want = {(q, v): s for q, _, v, s in slow(np.arange(4000), x.astype(float), 20, 20)}
    found = {(r.query_id, r.vec_id): r.score for r in got}
    assert len(got) == 200 * 20
    assert len(want.keys() & found.keys()) / len(want) >= 0.95
    assert all(abs(found[p] - want[p]) < 1e-12 for p in want.keys() & found.keys())
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    assert all([x[1:] for x in sorted(v)] == sorted(x[1:] for x in v) for v in by.values())


def test_nearest_of_odd_rows(spark, odd_vectors):
    ids, x = usable(odd_vectors, False)
    got = ann.nearest(odd_vectors, every=10).collect()
    want = slow(ids, x, 10, 20)
    assert len(got) == len(want)
    assert len({(r.query_id, r.vec_id) for r in got} & {(w[0], w[2]) for w in want}) / len(want) > 0.9
    assert ann.nearest(odd_vectors.limit(0)).collect() == []
    few = ann.nearest(odd_vectors.where("vec_id in (100, 101, 405)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in few] == [(100, 1, 101)]


def test_nearest_with_a_hot_group_of_copies(spark):
    """A third of all rows hold one vector, some others two or three: ids must be those of the smallest, not of any, copies."""
    x = rows(2400, 16, seed=5)
    x[np.random.default_rng(2).choice(2400, 800, replace=False)] = x[7]
    x[1000:1040:2] = x[1001:1041:2]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = {(r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).collect()}
    want = slow(np.arange(2400), x.astype(float), 20, 20)
    assert len(got) == len(want)
    assert len(got & {w[:3] for w in want}) / len(want) >= 0.95
    hot = {q for q in range(0, 2400, 20) if (x[q] == x[7]).all()}
    assert hot and {g for g in got if g[0] in hot} == {w[:3] for w in want if w[0] in hot}


def test_nearest_among_copies_only(spark):
    df = spark.createDataFrame([(i, [1.0, -2.0], 0) for i in range(50)], SCHEMA)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).collect())
    assert got == sorted((q, n + 1, v, 5.0) for q in (0, 20, 40) for n, v in enumerate([v for v in range(50) if v != q][:20]))


def test_hubs_are_dealt_to_tasks(spark):
    """Vectors of very unequal lengths: few long ones are neighbours of most, yet no part of a hub holds more than its share."""
    x = rows(3000, 16, spread=True)
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], SCHEMA)
    got = ann.nearest(df).collect()
    want = {w[:3] for w in slow(np.arange(3000), x.astype(float), 20, 20)}
    assert len({(r.query_id, r.rank, r.vec_id) for r in got} & want) / len(want) >= 0.95
    sent = spark.range(5000).select((F.col("id") % 3 * F.col("id") % 7).alias("at"), "id").union(spark.range(4000).select(F.lit(99), F.col("id")))
    held = ann.spread(sent, "at", ["id"], 200).groupBy("at", "part").count().collect()
    assert sum(r["count"] for r in held) == 9000 and max(r["count"] for r in held) < 300 and len([r for r in held if r["at"] == 99]) == 20


def test_whole_groups_of_unordered_keys():
    import pyarrow as pa

    from perron.llm.vectors import whole_groups

    keys = np.repeat([5, 1, 9, 2, 7], [3, 10, 1, 8, 2])
    batches = [pa.record_batch({"k": keys[a : a + 4]}) for a in range(0, len(keys), 4)]
    tables = [t.column("k").to_pylist() for t in whole_groups(iter(batches), "k", 5, ordered=False)]
    assert sum(tables, []) == keys.tolist() and all(a[-1] != b[0] for a, b in zip(tables, tables[1:]))
