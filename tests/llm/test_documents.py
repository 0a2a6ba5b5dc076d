"""Operators on documents, against brute force."""

import hashlib
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.errors import PythonException
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from perron.llm import linededup, pack, quality, shared, simhash, tokencount, tokenfile
from perron.llm import tokens as tk


def library_ids(rows, literal=False):
    """(doc_id, ids) in the order of ids, by the library alone."""
    library = Tokenizer.from_file(tk.default_tokenizer())
    library.encode_special_tokens = literal
    return [(r.doc_id, np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u2")) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.fixture(scope="session")
def expected_ids(odd_docs):
    return library_ids(odd_docs.select("doc_id", "text").collect())


def slow_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps, ids):
    near = [[bin(a ^ b).count("1") <= 3 for b in fps] for a in fps]
    label = list(ids)
    while True:
        new = [min(label[j] for j in range(len(ids)) if near[i][j]) for i in range(len(ids))]
        if new == label:
            return label
        label = new


def test_simhash_matches_brute_force(odd_docs, clashing_docs):
    rows = odd_docs.collect()
    ids, fps = [r.doc_id for r in rows], [slow_fingerprint(r.text) for r in rows]
    want = sorted(zip(ids, (f"{f:016x}" for f in fps), slow_components(fps, ids)))
    for docs, leaf in ((odd_docs, None), (clashing_docs, 3)):
        got = simhash.near_duplicates(docs, leaf=leaf).collect()
        assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == want


def test_simhash_of_null_ids(spark):
    """A null id keeps its row and names no component that has another id."""
    rows = [(None, "a b c d"), (7, "A B c d"), (9, "a b c d"), (None, "quite another text here"), (None, None), (3, "")]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), leaf=1).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 3), (0, 7), (3, 3), (7, 7), (9, 7)]


def test_simhash_of_nothing(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_trie_join_finds_all_links(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 6), False))) for b in base for _ in range(8)]
    fps = np.unique(np.concatenate([base, np.array(near, np.uint64)]))
    for a, b in ((fps, None), (fps[:150], fps[150:])):
        found = set()
        for i, j in simhash.descend(a, b, 0, 0, 3, chunk=64):
            found |= set(zip(i.tolist(), j.tolist()))
        other = a if b is None else b
        want = {(i, j) for i in range(len(a)) for j in range(len(other)) if bin(int(a[i]) ^ int(other[j])).count("1") <= 3 and (b is not None or i < j)}
        assert found == want


def test_upper_trie_join_equals_all_pairs():
    rng = np.random.default_rng(5)

    def cut(fps, leaf):
        done, todo = [], [(0, 0, fps)]
        while todo:
            p, d, held = todo.pop()
            if len(held) <= leaf or d == 64:
                done += [(p, d)] * bool(len(held))
            else:
                upper = held >= np.uint64((2 * p + 1) << (63 - d))
                todo += [(2 * p, d + 1, held[~upper]), (2 * p + 1, d + 1, held[upper])]
        return sorted(done, key=lambda x: x[0] << (64 - x[1]))

    for groups in (1, 4, 50):
        base = rng.integers(0, 2**64, groups, np.uint64)  # few groups: a skewed trie
        fps = np.unique(np.r_[base, base[rng.integers(0, groups, 400)] ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64))])
        for leaf in (1, 20, 1000):
            nodes = cut(fps, leaf)
            want = []
            for i, (p, d) in enumerate(nodes):
                for j, (q, e) in list(enumerate(nodes))[i:]:
                    apart = bin((p >> (d - min(d, e))) ^ (q >> (e - min(d, e)))).count("1")
                    want += [(i, j, apart)] * (apart <= 3)
            assert list(zip(*(x.tolist() for x in simhash.node_pairs(nodes, 3)))) == want
    assert all(len(x) == 0 for x in simhash.node_pairs([], 3))


def test_trie_is_cut_by_counts(spark):
    rng = np.random.default_rng(6)
    fps = np.unique(np.r_[rng.integers(0, 2**64, 300, np.uint64), np.uint64(2**64 - 1) ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))])
    nodes = simhash.cut_trie(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), 10)
    held = [sum(p << (64 - d) <= int(x) < (p + 1) << (64 - d) for x in fps) for p, d in nodes]
    assert sum(held) == len(fps) and all(0 < n <= 10 for n in held)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + k) for k in range(1, 300)] + [(5, 5), (700, 650), (650, 700)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + k] == 100 for k in range(300)) and got[700] == 650


def slow_dedup(rows):
    holders = defaultdict(set)
    key = lambda line: re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\x0b\x0c\r"))
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(holders[key(x)]) > 1 and min(holders[key(x)]) != doc)]
        out.append((doc, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_line_dedup_matches_brute_force(odd_docs, clashing_docs, no_docs):
    want = slow_dedup([(r.doc_id, r.text) for r in odd_docs.collect()])
    for docs in (odd_docs, clashing_docs):
        got = linededup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h")).collect()
        assert sorted(map(tuple, got)) == want
    assert linededup.dedup_lines(no_docs).collect() == []


def test_keep_runs_give_back_the_kept_lines(odd_docs):
    """The runs of a document, laid over its own lines, are the lines that brute force keeps."""
    rows = odd_docs.collect()
    want = {(d, h) for d, _, _, h in slow_dedup([(r.doc_id, r.text) for r in rows])}
    texts = {(r.doc_id, r.text) for r in rows}
    runs = linededup.apply_runs(odd_docs, linededup.dropped_runs(odd_docs)).select("doc_id", "n_lines", "n_dropped", "keep_runs").collect()
    for r in runs:
        assert sum(x["count"] for x in r.keep_runs) == r.n_lines - r.n_dropped
        own = [(t or "").split("\n") for d, t in texts if d == r.doc_id]
        kept = ["\n".join(x for k in r.keep_runs for x in lines[k["from"] : k["from"] + k["count"]]) for lines in own]
        assert any((r.doc_id, hashlib.sha256(k.encode()).hexdigest()) in want for k in kept)


def test_chunked_encoding_equals_the_library(expected_ids, odd_docs):
    enc = tk.ChunkEncoder(tk.default_tokenizer(), entries=50)
    rows = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert 50256 in np.concatenate([x for _, x in expected_ids])
    awkward = ["\n", "a\n", " a", "a \nb", "\n\n b", "it's, it's! don't", "tab\tx y", "²a, b²!", "a\xa0b c", "<|endoftext|> x"]
    assert enc.encode(awkward) == enc.raw(awkward)
    for _ in range(2):
        assert enc.encode([r.text for r in rows]) == [x.tobytes() for _, x in expected_ids]


def check_pieces(rows, expected, limits, full=True):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for s in by_sequence.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(x.length for x in s[:i]) for i in range(len(s))]
        total = sum(r.length for r in s)
        assert total == limits.tokens or total & (total - 1) == 0 or not full
        assert len(s) <= limits.segments and sum(r.loss_tokens for r in s) <= limits.loss_tokens
    once = {d: x for d, x in expected}
    copies = defaultdict(int)
    for d, _ in expected:
        copies[d] += 1
    assert set(by_doc) == set(once)
    for d, pieces in by_doc.items():
        ids = np.append(once[d], 1).astype("<u4")
        assert sum(r.length for r in pieces) == len(ids) * copies[d]
        assert all(r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)


def test_packing(odd_docs, clashing_docs, expected_ids, no_docs):
    for docs, limits, run in ((odd_docs, pack.Limits(), 6_000_000), (clashing_docs, pack.Limits(512, 6, 512), 3_000)):
        check_pieces(pack.pack_documents(docs, limits=limits, run_tokens=run).collect(), expected_ids, limits)
    assert pack.pack_documents(no_docs).collect() == []


def test_packing_of_prompts(spark, odd_docs):
    """Tokens of a context come first and bear no loss; the limit of loss-bearing tokens binds."""
    docs = odd_docs.where("doc_id < 60").withColumn("prompt", F.when(F.col("doc_id") % 3 > 0, F.substring("text", 1, 150)))
    limits = pack.Limits(256, 8, 128)
    rows = pack.pack_documents(docs, context_column="prompt", limits=limits, run_tokens=4_000).collect()
    library = Tokenizer.from_file(tk.default_tokenizer())
    encode = lambda text: library.encode(text or "", add_special_tokens=False).ids
    want = {r.doc_id: (encode(r.prompt), encode(r.text)) for r in docs.collect()}
    check_pieces(rows, [(d, np.array(a + b, "<u2")) for d, (a, b) in want.items()], limits, full=False)
    loss = defaultdict(int)
    for r in rows:
        assert r.loss_tokens == min(r.length, max(0, r.start + r.length - len(want[r.doc_id][0])))
        loss[r.sequence_id] += r.loss_tokens
    assert max(loss.values()) == 128 and sum(loss.values()) == sum(len(b) + 1 for _, b in want.values())


def test_packing_holds_three_limits_without_cutting():
    rng = np.random.default_rng(2)
    lengths = rng.integers(1, 900, 400)
    contexts = (lengths * rng.random(400)).astype(int)
    limits = pack.Limits(1000, 8, 600)
    fits = lengths - contexts <= 600
    rows = pack.pack_run(lengths[fits], contexts[fits], limits, cut=False)
    assert sorted(p.example for row in rows for p in row) == list(range(fits.sum()))
    for row in rows:
        assert sum(p.length for p in row) <= 1000 and len(row) <= 8 and sum(p.loss for p in row) <= 600
    bound = max(lengths[fits].sum() / 1000, (lengths - contexts)[fits].sum() / 600, fits.sum() / 8)
    assert len(rows) <= 1.25 * bound + 2
    with pytest.raises(ValueError):
        pack.pack_run([2000], [0], limits, cut=False)


def test_token_file_round_trip(spark, odd_docs, clashing_docs, expected_ids, no_docs):
    want, start = [], 0
    for d, ids in expected_ids:
        ids = np.append(ids, 2).astype("<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    for docs, most in ((odd_docs, 64_000_000), (clashing_docs, 700)):
        folder = shared.fresh_path(spark, "t")
        shards = tokenfile.write_documents(docs, folder, length=128, rows=4, shards=3, shard_tokens=most)
        assert most > start or len(shards) > 10
        got = sorted(tokenfile.read_documents(spark, folder, shards).collect(), key=lambda r: r.start)
        assert [tuple(r) for r in got] == want
        shard = tokenfile.Shard(folder, shards[0][0])
        ids, mask = shard.sequence(1)
        assert len(ids) == len(mask) == 128 and ids.base is not None and mask.all()
        assert np.array_equal(ids, shard.tokens(128, 128))
        last, mask = shard.sequence(len(shard) - 1)
        assert mask.sum() == (shards[0][2] - 1) % 128 + 1
    empty = shared.fresh_path(spark, "t")
    assert tokenfile.read_documents(spark, empty, tokenfile.write_documents(no_docs, empty)).collect() == []


def test_operators_on_tokens_take_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b"), (None, None), (4, "x y z"), (4, "x")], "doc_id long, text string")
    folder = shared.fresh_path(spark, "t")
    got = sorted(tokenfile.read_documents(spark, folder, tokenfile.write_documents(docs, folder)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 4, 4] and sorted(r.n_tokens for r in got) == [1, 2, 3, 4]
    assert sorted((r.doc_id or 0, r.length) for r in pack.pack_documents(docs).collect() if r.start == 0 and r.length == r.doc_tokens)[:1] == [(0, 1)]
    assert sum(r.length for r in pack.pack_documents(docs).collect()) == 10
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokencount.count_documents(docs).collect()) == [(0, 1), (0, 3), (4, 2), (4, 4)]


def test_token_counts(odd_docs, clashing_docs, no_docs):
    want = sorted((d, len(x) + 1) for d, x in library_ids(odd_docs.collect(), literal=True))
    for docs, block in ((odd_docs, 4_000_000), (clashing_docs, 997)):
        assert sorted((r.doc_id, r.n_tokens) for r in tokencount.count_documents(docs, block_tokens=block).collect()) == want
    assert tokencount.count_documents(no_docs).collect() == []


def test_token_count_tables_are_written_by_tasks(odd_docs):
    """Spark's writer would start processes for each file, which share the executor's memory while they start."""
    counts = tokencount.count_documents(odd_docs, block_tokens=997)
    folders = {Path(f.removeprefix("file:")).parent for f in counts.inputFiles()}
    assert len(folders) == 1 and {p.suffix for f in folders for p in f.iterdir()} == {".parquet"}
    assert not re.search("Sort(Merge|Shuffle)|ShuffledHash", counts._jdf.queryExecution().executedPlan().toString())


def test_document_ids_by_place(spark, tmp_path):
    """Across row groups and files, in any order; places beyond a file's notes are an error."""
    ids = {"a": [7, None, 7, *range(100, 130)], "b": [None]}
    for name, of in ids.items():
        pq.write_table(pa.table({"doc_id": pa.array(of, pa.int64())}), tmp_path / f"{name}.parquet", row_group_size=4)
    notes = tokencount.Notes(str(tmp_path))
    for name, places in (("a", [0, 1, 2]), ("a", [3, 4]), ("b", [0]), ("a", [32, 0, 9, 9]), ("a", [32])):
        assert notes.ids(f"{name}.bin", np.array(places)).to_pylist() == [ids[name][k] for k in places]
    with pytest.raises(pa.ArrowInvalid):
        notes.ids("a.bin", np.array([33]))


def test_token_counts_beyond_the_broadcast(clashing_docs, monkeypatch):
    want = sorted(map(tuple, tokencount.count_documents(clashing_docs, block_tokens=997).drop("file").collect()))
    monkeypatch.setattr(tokencount, "MOST_BROADCAST", 0)
    assert sorted(map(tuple, tokencount.count_documents(clashing_docs, block_tokens=997).drop("file").collect())) == want


def test_tables_written_by_tasks_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shared, "fresh_path", lambda _, name: f"{tmp_path}/{name}")
    rows = [(None, [])] + [(k, [k, None, -k]) for k in range(3_000)]
    schema, df = "id long, x array<long>", spark.createDataFrame(rows, "id long, x array<long>").repartition(3)
    (tmp_path / "t").mkdir()
    (tmp_path / "t/part-000000.parquet.7-lost.tmp").write_bytes(b"of a lost attempt")
    big = shared.written_by_tasks(df, lambda batches: (b.slice(i, 7) for b in batches for i in range(0, b.num_rows, 7)), schema, "t")
    assert sorted(map(tuple, big.collect()), key=str) == sorted(rows, key=str)

    def fails(batches):
        yield next(batches)
        raise ValueError("no table")

    with pytest.raises(PythonException, match="no table"):
        shared.written_by_tasks(df, fails, schema, "f")
    assert not list((tmp_path / "f").iterdir())
    assert shared.written_by_tasks(df.where("id < 0"), lambda batches: (b for b in batches if b.num_rows), schema, "e").collect() == []


def test_separator_scan_of_foreign_files(spark, tmp_path):
    end = tk.END_OF_TEXT
    files = {"a.bin": [1, 2, end, end, 5, 6, 7], "b.bin": [], "c.bin": [end], "d.bin": [9] * 25, "e.bin": [*[3] * 10, end]}
    for n, ids in files.items():
        (tmp_path / n).write_bytes(np.array(ids, "<u2").tobytes())
    got = sorted(map(tuple, tokencount.count_tokens(spark, str(tmp_path), block_tokens=3).collect()))
    assert got == [("a.bin", 0, 0, 3, True), ("a.bin", 1, 3, 1, True), ("a.bin", 2, 4, 3, False), ("c.bin", 0, 0, 1, True), ("d.bin", 0, 0, 25, False), ("e.bin", 0, 0, 11, True)]
    (tmp_path / "f.bin").write_bytes(b"123")
    with pytest.raises(ValueError):
        tokencount.count_tokens(spark, str(tmp_path))


def test_quality_on_held_out_rows(spark):
    """Accuracy and order of scores on rows whose labels the fit did not see."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    assert np.mean([g > b for g in good for b in bad]) > 0.98


def test_quality_of_odd_rows(spark, odd_docs, clashing_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(None, 1, 0), (1, None, None), (2, 7, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    for docs in (odd_docs, clashing_docs):
        rows = quality.score_documents(docs, labels).collect()
        assert len(rows) == docs.count() and all(r.score is not None and 0 <= r.score <= 1 for r in rows)
    assert quality.score_documents(no_docs, labels).collect() == []
    assert {r.score for r in quality.score_documents(odd_docs, labels.limit(0)).collect()} == {0.5}


def test_isotonic_is_monotone_and_pools():
    x, p = quality.isotonic(np.arange(5.0), np.array([10, 10, 10, 10, 10.0]), np.array([0, 6, 2, 9, 10.0]))
    assert list(x) == [0, 1.5, 3, 4] and (np.diff(p) >= 0).all() and abs(p[1] - 8.5 / 21) < 1e-12
