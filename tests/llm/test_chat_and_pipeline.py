import json
import random

import duckdb
from pyspark.sql import functions as F

import corpus_pipeline
from perron.llm import chat, linededup

CALLS = "call_id string, name string, arguments string, after array<string>"
SCHEMAS = "name string, parameters array<struct<name: string, type: string, required: boolean>>"


def test_levels_and_problems(spark):
    calls = spark.createDataFrame(
        [
            ("c1", "t", '{"x":1,"y":"a"}', []), ("c2", "t", '{"x":"1"}', ["c1"]), ("c3", "u", "{}", ["c2", "zz"]), ("c4", "t", "[1]", ["c5"]), ("c5", "t", '{"x":2,"q":true}', ["c4"]),
            ("c6", "t", "bad", ["c5"]), ("d1", "t", None, ["c2", "c3"]), ("d2", "t", '{"x":null}', ["d1", "c1"]), ("d3", "t", '{"x":3}', ["d2"]), ("e1", None, "{}", None),
        ],
        CALLS,
    )
    schemas = spark.createDataFrame([("t", [("x", "integer", True), ("y", "string", False)])], SCHEMAS)
    got = {r.call_id: (r.level, r.valid, r.problems) for r in chat.topological(chat.validate(calls, schemas)).collect()}
    assert got == {
        "c1": (0, True, []), "c2": (1, False, ["type: x"]), "c3": (2, False, ["no such tool"]), "c4": (None, False, ["not an object"]), "c5": (None, False, ["unknown: q"]),
        "c6": (None, False, ["not an object"]), "d1": (3, False, ["not an object"]), "d2": (4, False, ["type: x"]), "d3": (5, True, []), "e1": (0, False, ["no such tool"]),
    }


def slow_levels(after):
    """Levels by repeated sweeps; what never gets one is on or behind a cycle."""
    level = {}
    while True:
        free = [c for c, ps in after.items() if c not in level and all(p in level for p in ps if p in after)]
        if not free:
            return {c: level.get(c) for c in after}
        level.update({c: max([level[p] + 1 for p in after[c] if p in after], default=0) for c in free})


def test_random_calls_against_brute_force(spark):
    """Calls after several others, unknown ones and themselves, in cycles, with arguments of every kind; links both ways."""
    rng = random.Random(11)
    ids = [f"c{i}" for i in range(160)]
    after = {c: [rng.choice([*ids[max(0, i - 12) : i], "gone"]) for _ in range(rng.choice([0, 1, 1, 2, 3]))] for i, c in enumerate(ids)}
    for i in (90, 140):  # cycles
        after[ids[i]].append(ids[i + 1])
        after[ids[i + 1]].append(ids[i])
    kinds = {"string": "a", "integer": 3, "number": 2.5, "boolean": True, "object": {"z": 1, "a": [None]}, "array": [1, "x"], "null": None}
    fits = lambda v, t: t == {str: "string", bool: "boolean", int: "integer", float: "number", dict: "object", list: "array", type(None): "null"}[type(v)] or (t == "number" and type(v) is int)
    schemas = {f"t{n}": [(f"p{k}", rng.choice(list(kinds)), rng.random() < 0.5) for k in range(rng.randint(0, 4))] for n in range(6)}
    rows, want = [], {}
    levels = slow_levels(after)
    for c in ids:
        name, args = rng.choice([*schemas, "t9"]), {f"p{k}": rng.choice(list(kinds.values())) for k in range(rng.randint(0, 5))}
        raw = rng.choice(["{", "[1]", None]) if rng.random() < 0.1 else json.dumps(dict(rng.sample(list(args.items()), len(args))), ensure_ascii=False)
        rows.append((c, name, raw, after[c]))
        if name not in schemas:
            problems = ["no such tool"]
        elif raw is None or raw[0] != "{" or raw == "{":
            problems = ["not an object"]
        else:
            known = {p: (t, need) for p, t, need in schemas[name]}
            problems = sorted([f"missing: {p}" for p, (_, need) in known.items() if need and p not in args] + [f"unknown: {a}" for a in args if a not in known] + [f"type: {a}" for a, v in args.items() if a in known and not fits(v, known[a][0])])
        canonical = json.dumps(args, sort_keys=True, separators=(",", ":"), ensure_ascii=False) if raw and raw[0] == "{" and raw != "{" else None
        want[c] = (levels[c], problems, canonical)
    calls = chat.topological(chat.validate(spark.createDataFrame(rows, CALLS), spark.createDataFrame(list(schemas.items()), SCHEMAS)))
    results = spark.createDataFrame([(f"c{i}", f"r{i}") for i in range(0, 200, 3)] + [(None, "r")], "call_id string, text string")
    told, linked = chat.link(calls, results)
    got = {r.call_id: r for r in told.collect()}
    assert {c: (r.level, r.problems) for c, r in got.items()} == {c: w[:2] for c, w in want.items()}
    assert all(got[c].arguments == w[2] for c, w in want.items() if w[2] is not None)
    assert {c for c, r in got.items() if r.answered} == {f"c{i}" for i in range(0, 160, 3)} and None in levels.values()
    assert sorted(r.linked for r in linked.collect()) == [False] * 14 + [True] * 54


def test_long_chain(spark):
    n = 300
    calls = spark.createDataFrame([(f"c{i}", "t", "{}", [f"c{i - 1}"]) for i in range(n)], CALLS)
    got = {r.call_id: r.level for r in chat.topological(calls).collect()}
    assert got == {f"c{i}": i for i in range(n)}


def test_canonical_json(spark):
    df = spark.createDataFrame([('{"b": 1, "a": {"z": [1, "é"], "y": null}}',), ("no",), (None,)], "j string")
    assert [r[0] for r in df.select(chat.canonical(F.col("j"))).collect()] == ['{"a":{"y":null,"z":[1,"é"]},"b":1}', None, None]


def test_conversations_match_sql(spark):
    path = "/root/testdata/sf0.001/conversations.parquet"
    got = chat.format_conversations(spark.read.parquet(path)).toPandas()
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{path}'")
    want = con.sql(chat.SQL).df()
    key = lambda df: sorted(zip(df.conv_id, df.turn, df.role, df.call_id.fillna(""), df.level.fillna(-1), df.linked, df.valid, df.json))
    assert key(got) == key(want)


def test_odd_conversations(spark):
    rows = [(1, 0, "user", 'a "q"?\n'), (1, 0, "user", "twice"), (1, 1, "assistant", None), (1, 2, "user", None), (2, 5, "assistant", "orphan"), (None, 0, "user", "x"), (3, None, "user", "x"), (3, 1, None, "x"), (4, 0, "system", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"call_id": F.lit("?"), "level": F.lit("?"), "kind": F.lit("?"), "name": F.lit("?")})
    got = chat.format_conversations(df).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn): r.linked for r in got if r.role == "assistant"} == {(1, 1): True, (2, 5): False}
    assert sorted(r.level for r in got if r.conv_id == 1) == [0, 0, 0, 1]
    assert chat.format_conversations(df.limit(0)).collect() == []


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, set()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "SimHash near-dedup", "mixing", "packing"]
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        now = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= ids and docs.count() == len(now), name
        seen.add(len(now))
        ids = now
    assert linededup.dedup_lines(docs).agg(F.sum("n_dropped")).first()[0] in (0, None)
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).collect()} == ids


def test_pipeline_stages_of_odd_rows(spark, no_docs):
    """Null ids, repeated rows, ids with two texts, clashing column names, empty tables."""
    sf, columns = "/root/testdata/sf0.01", corpus_pipeline.COLUMNS
    base, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    told = base.join(labels, "doc_id").where("toxic = 0 and lang = 'en' and length(text) > 500").orderBy("doc_id").collect()
    a, b, c = [r.text for r in told if r.quality == 1][:3]
    junk = next(r.text for r in told if r.quality == 0)
    n = 10_000_000
    rows = [(None, a), (None, a), (n, a), (n, a), (n, b), (n + 1, b), (None, c), (n + 2, junk), (None, junk), (n, junk), (n + 3, None), (None, "")]
    odd = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], base.schema)
    docs = base.where(~F.col("text").isin(a, b, c, junk) & (F.length("text") > 0)).unionByName(odd)
    docs = docs.select("*", *[F.lit("?").alias(x) for x in ("_hash", "_id", "_text", "text_hash", "k", "component", "n_lines")])
    mine = lambda df: sorted((r.doc_id or 0, r.text or "") for r in df.where(f"doc_id is null or doc_id >= {n}").collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, no_docs, sf)
        assert empty.columns == columns and empty.collect() == [], name
    scored = mine(corpus_pipeline.quality(spark, docs, sf))
    assert [x for x in scored if x[1]] == sorted([(0, a), (0, a), (n, a), (n, a), (n, b), (n + 1, b), (0, c)])
    once = mine(corpus_pipeline.near_duplicate(spark, docs, sf))
    assert once == sorted([(n, a), (n, b), (0, c), (n, junk), (n + 3, "")])
    mixed = mine(corpus_pipeline.mixture(spark, docs, sf))
    assert mixed.count((0, a)) == 2 and mixed.count((n, a)) == 2 and mixed.count((n, b)) == 1
    packed = corpus_pipeline.packed(spark, odd, sf)
    assert packed.where("doc_tokens = 1").count() == 2 and corpus_pipeline.packed(spark, no_docs, sf).collect() == []
