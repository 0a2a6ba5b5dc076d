"""Op 1: SimHash near-duplicates by a binary trie self-join.

Fingerprints are computed where the texts are read. The distinct ones form a binary trie by their bits, from the
highest. The trie is joined with itself: pairs of nodes are descended together, bits on which the two sides differ are
added up, and a pair is pruned once they exceed the budget.

The trie is cut where subtrees have ``leaf`` fingerprints at most (dense regions are cut deeper, so a group of near
copies spreads over tasks). The driver descends the few levels above the cut, of which it knows counts only; the
surviving subtree pairs are dealt out to tasks by ranges of their left subtree, and each task continues the descent in
numpy over the two sorted runs, breadth first and in bounded chunks. A task returns links as
stars (each fingerprint with the smallest one it reaches there), never all pairs; components of all links follow by
alternating large-star and small-star steps on the DataFrame of links.
"""

from __future__ import annotations

import bisect
import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

BITS = 64
SEED = 42


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of the word shingles of ``text``; 0 without words.

    Bytes suffice: bytes.lower() changes A-Z only and bytes.split() splits at 0x20 and 0x09-0x0D.
    """
    hashes = shingle_hashes((text or "").encode().lower().split(), words)
    return majority(hashes) if len(hashes) else 0


def shingle_hashes(parts: list[bytes], words: int) -> np.ndarray:
    """Hashes of all shingles in order; fewer than ``words`` parts are one shingle."""
    if not parts:
        return np.zeros(0, np.uint64)
    if len(parts) < words:
        shingles = [b" ".join(parts)]
    else:
        shingles = map(b" ".join, zip(*(parts[i:] for i in range(words))))
    digest = functools.partial(xxhash.xxh64_intdigest, seed=SEED)
    return np.fromiter(map(digest, shingles), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in over half of the hashes."""
    ones, n = np.zeros(BITS, np.int64), len(hashes)
    for a in range(0, n, 65_536):
        part = hashes[a : a + 65_536]
        bits = np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long. Null texts count as empty."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], ["doc_id", "fp"])

    shared.bound_batches(docs.sparkSession)
    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return picked.mapInArrow(shared.tidy(task), "doc_id long, fp long")


def _split(a: np.ndarray, b: np.ndarray, nodes: tuple[np.ndarray, ...], depth: int, budget: int, own: bool) -> tuple[np.ndarray, ...]:
    """Pairs of children of pairs of nodes: (from, to) in a, (from, to) in b, differing bits. Over the budget is pruned."""
    alo, ahi, blo, bhi, diff = nodes
    bit = np.uint64(1 << (BITS - 1 - depth))
    low = np.uint64((1 << (BITS - 1 - depth)) - 1)
    amid = np.clip(np.searchsorted(a, (a[alo] & ~low) | bit), alo, ahi)
    bmid = np.clip(np.searchsorted(b, (b[blo] & ~low) | bit), blo, bhi)
    parts = []
    for x0, x1, y0, y1, more in ((alo, amid, blo, bmid, 0), (amid, ahi, bmid, bhi, 0), (alo, amid, bmid, bhi, 1), (amid, ahi, blo, bmid, 1)):
        keep = (x1 > x0) & (y1 > y0) & (diff + more <= budget)
        if own:
            keep &= x0 <= y0  # of a pair and its mirror image one is descended
        parts.append(tuple(v[keep] for v in (x0, x1, y0, y1)) + (diff[keep] + more,))
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(5))


def descend(a: np.ndarray, b: np.ndarray | None, depth: int, used: int, budget: int, chunk: int = 400_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i into a, j into b) of fingerprints at most ``budget`` bits apart.

    a and b are sorted and share their upper ``depth`` bits within themselves; ``used`` is how many of those differ
    between them. b None: a with itself, pairs i < j only.
    """
    own = b is None
    b = a if own else b
    first = tuple(np.array([x], np.int64) for x in (0, len(a), 0, len(b), used))
    stack = [(depth, first)]
    while stack:
        depth, nodes = stack.pop()
        if len(nodes[0]) > chunk:
            half = len(nodes[0]) // 2
            stack += [(depth, tuple(x[half:] for x in nodes)), (depth, tuple(x[:half] for x in nodes))]
            continue
        alo, ahi, blo, bhi, _ = nodes
        small = ((ahi - alo) * (bhi - blo) <= 24) | (depth == BITS)
        if small.any():
            for i, j in _compare(a, b, alo[small], ahi[small], blo[small], bhi[small], budget, chunk):
                yield (i[i < j], j[i < j]) if own else (i, j)
            nodes = tuple(x[~small] for x in nodes)
        if len(nodes[0]):
            following = _split(a, b, nodes, depth, budget, own)
            if len(following[0]):
                stack.append((depth + 1, following))


def _compare(a, b, alo, ahi, blo, bhi, budget: int, chunk: int):
    """All pairs of small nodes, tested on their whole fingerprints."""
    for s in range(0, len(alo), chunk):
        al, bl = alo[s : s + chunk], blo[s : s + chunk]
        an, bn = ahi[s : s + chunk] - al, bhi[s : s + chunk] - bl
        n = an * bn
        which = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        i, j = al[which] + k // bn[which], bl[which] + k % bn[which]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        yield i[near], j[near]


class Stars:
    """Union of links as labels: each member points to the smallest one reached."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            x, y = self.label[i], self.label[j]
            apart = x != y
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = self.label[self.label]
                if np.array_equal(up, self.label):
                    break
                self.label = up

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        member = np.flatnonzero(self.label != np.arange(len(self.label)))
        return member, self.label[member]


def cut_trie(distinct: DataFrame, leaf: int, step: int = 8) -> list[tuple[int, int]]:
    """Subtrees (prefix, depth) that hold all fingerprints, each of ``leaf`` at most unless 64 bits deep.

    Counts by prefix are summed on the executors, ``step`` bits at a time and only below subtrees that are still too
    large, so the driver sees 2^step counts at most for each large subtree. A subtree's count is a difference of their
    running sums.
    """
    done: list[tuple[int, int]] = []
    large, depth = [0], 0
    while large:
        below = min(BITS, depth + step)
        key = F.shiftrightunsigned("fp", BITS - below) if below < BITS else F.col("fp")
        within = distinct.where(F.shiftrightunsigned("fp", BITS - depth).isin(large)) if depth else distinct
        found = sorted((r.k % (1 << BITS), r.n) for r in within.groupBy(key.alias("k")).agg(F.count("*").alias("n")).collect())
        keys, sums = [k for k, _ in found], [0, *itertools.accumulate(n for _, n in found)]
        nodes, large = [(p, depth) for p in large], []
        while nodes:
            p, d = nodes.pop()
            lo, hi = (bisect.bisect_left(keys, x << (below - d)) for x in (p, p + 1))
            n = sums[hi] - sums[lo]
            if not n:
                continue
            if n <= leaf or d == BITS:
                done.append((p, d))
            elif d == below:
                large.append(p)
            else:
                nodes += [(2 * p, d + 1), (2 * p + 1, d + 1)]
        depth = below
    return sorted(done, key=lambda x: x[0] << (BITS - x[1]))


def node_pairs(nodes: list[tuple[int, int]], budget: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, differing bits) of subtrees whose common upper bits differ in ``budget`` at most, i <= j, in order.

    The trie above the subtrees is joined with itself as the lower ones are, level by level: ranges of subtrees are
    split by the next bit of both sides and pruned over the budget. A subtree that ends at this depth meets all that is
    left on the other side.
    """
    starts = np.array([p << (BITS - d) for p, d in nodes], np.uint64)
    depths = np.array([d for _, d in nodes], np.int64)
    out = []
    now = tuple(np.array([x] if nodes else [], np.int64) for x in (0, len(nodes), 0, len(nodes), 0))
    for depth in range(BITS + 1):
        alo, ahi, blo, bhi, used = now
        ends = ((ahi - alo == 1) & (depths[alo] <= depth)) | ((bhi - blo == 1) & (depths[blo] <= depth))
        n = ((ahi - alo) * (bhi - blo))[ends]
        which = np.repeat(np.flatnonzero(ends), n)
        k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        width = (bhi - blo)[which]
        i, j = alo[which] + k // np.maximum(width, 1), blo[which] + k % np.maximum(width, 1)
        out.append(np.stack([i, j, used[which]])[:, i <= j])
        now = tuple(x[~ends] for x in now)
        if not len(now[0]):
            break
        now = _split(starts, starts, now, depth, budget, True)
    found = np.concatenate(out, axis=1)
    return tuple(found[:, np.lexsort((found[1], found[0]))])


def links(distinct: DataFrame, budget: int = 3, leaf: int | None = None, most_leaves: int = 4096) -> tuple[DataFrame, str]:
    """(a, b) signed fingerprints with b reached from a, so that components of these links are those of all links."""
    spark = distinct.sparkSession
    n = distinct.count()
    nodes = cut_trie(distinct, leaf or max(4096, n // most_leaves))
    pairs = node_pairs(nodes, budget)
    folder = shared.fresh_path(spark, "trie")
    shared.make_dirs(spark, folder)
    starts = np.array([p << (BITS - d) for p, d in nodes], dtype=np.uint64)
    depths = [d for _, d in nodes]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        at = None

        def flush():
            run = np.unique(np.concatenate(held).view(np.uint64))
            with shared.atomic_output(f"{folder}/{at}.u64") as out:
                out.write(run.tobytes())

        for b in batches:
            leafs, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            edges = np.flatnonzero(np.diff(leafs)) + 1
            for x, y in zip(np.split(leafs, edges), np.split(fps, edges)):
                if len(x):
                    if at is not None and x[0] != at:
                        flush()
                        held = []
                    at = int(x[0])
                    held.append(y)
        if held:
            flush()
        yield from ()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy()
            leafs = np.searchsorted(starts, fps.view(np.uint64), side="right") - 1
            yield pa.RecordBatch.from_arrays([pa.array(leafs.astype(np.int64)), b.column(0)], ["leaf", "fp"])

    if nodes:
        dealt = distinct.select("fp").mapInArrow(shared.tidy(assign), "leaf long, fp long").repartition(shared.parallelism(spark), "leaf").sortWithinPartitions("leaf")
        dealt.mapInArrow(shared.tidy(write), "leaf long").collect()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = shared.storage(folder)

        @functools.lru_cache(8)
        def run(k: int) -> np.ndarray:
            with system.open_input_file(f"{path}/{k}.u64") as f:
                return np.frombuffer(f.read(), np.uint64)

        for batch in batches:
            for i, j, used in zip(*(c.to_pylist() for c in batch.columns)):
                a, b = run(i), (None if i == j else run(j))
                stars = Stars(len(a) + (0 if b is None else len(b)))
                for x, y in descend(a, b, min(depths[i], depths[j]), used, budget):
                    stars.add(x, y if b is None else y + len(a))
                member, head = stars.links()
                if len(member):
                    both = (a if b is None else np.concatenate([a, b])).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(both[member]), pa.array(both[head])], ["a", "b"])

    # pairs of one left subtree lie next to each other, so a task reads few files more than once
    table = spark.createDataFrame(pa.table(dict(zip(("i", "j", "used"), map(pa.array, pairs)))))
    table = table.repartitionByRange(max(1, min(len(pairs[0]), shared.parallelism(spark))), "i", "j").sortWithinPartitions("i", "j")
    return table.mapInArrow(shared.tidy(join), "a long, b long"), folder


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links ``edges`` (a, b): root is the smallest node of its component.

    Alternating large-star and small-star steps; each round is written to the shared folder. Rounds grow with the
    logarithm of the longest path. Hot nodes are minima of partial aggregates and skew joins, never collected lists.
    """
    spark = edges.sparkSession
    flat = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, mark = shared.written(flat, "links"), None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        step = shared.written(small.unionByName(small_low.select("a", F.col("m").alias("b"))).distinct(), "links")
        shared.discard(spark, now)
        now = step
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark:
            roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", words: int = 3, budget: int = 3, leaf: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest id reachable over links of at most ``budget`` differing bits, the row's own id
    included. A null text is empty; documents without words have fingerprint 0 and link like any other. Null ids take
    part but never name a component unless all ids of it are null. Repeated rows give repeated rows; an empty table
    gives none. Other columns are not read.
    """
    spark = docs.sparkSession
    fps = shared.written(fingerprints(docs, id_column=id_column, text_column=text_column, words=words), "fingerprints")
    distinct = shared.written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct-fingerprints")
    found, folder = links(distinct, budget, leaf)
    roots = components(found)
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_fp = shared.written(named.join(least, "root").select("fp", "component_id"), "components")
    shared.discard(spark, folder, distinct)
    return fps.join(of_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
