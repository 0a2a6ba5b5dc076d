"""Near duplicates by the general rule: sets of five-word shingles with a Jaccard similarity of 0.8 or more.

A bit budget that reaches similarity 0.8 (about ten of 64 bits on average) leaves the trie nothing to prune, so the
trie of ``simhash`` names candidates within its own budget only, and bands of minima of hashed shingles name the rest: a
pair at 0.8 shares none of 32 bands of 5 minima with a chance of 3 in a million. No candidate links without the exact
similarity of its shingle sets.

Rows of one text (but for A-Z and white space) are one node. Each member of a band is compared with one head, so
candidates grow with the members and not with their pairs. The head is the member that meets the most others in its
bands: of a text and its edited copies that is most likely the text itself, which is nearer to each copy than copies are
to one another. What is left are bands whose members fall into several components, be it that a common passage brought
them together. Their members are joined by prefix filter: of two sets
with a similarity of 0.8 each has a common shingle among its fifth of rarest ones, and a common passage's shingles are not
rare. Pairs left out are in one component already, so their links would change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, simhash

WORDS = 5
BANDS, ROWS = 32, 5
_rng = np.random.default_rng(20)
_A = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32) | np.uint32(1)
_B = _rng.integers(0, 2**32, BANDS * ROWS, np.uint32)
_MIX = _rng.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)
#: Members that are compared with one head in one group.
GROUP = 256


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode().lower().split())


def node(plain: bytes) -> int:
    """Signed 64-bit key of a normal text."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(plain, seed=simhash.SEED)).view(np.int64))


def minima(shingles: np.ndarray) -> np.ndarray:
    """Keys of the bands as signed longs; none for an empty set. The minima are of 32-bit mixtures of the upper halves."""
    if not len(shingles):
        return np.zeros(0, np.int64)
    upper = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, 2**32 - 1, np.uint32)
    for s in range(0, len(upper), 1024):
        part = upper[s : s + 1024][None, :] * _A[:, None]
        part += _B[:, None]
        np.minimum(least, part.min(axis=1), out=least)
    keys = least.reshape(BANDS, ROWS).astype(np.uint64) * _MIX
    keys ^= keys >> np.uint64(31)
    out = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        out = (out ^ keys[:, k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, k, fp, n, bands) of every row: xxhash64 of the text, key of the normal text, SimHash, number of
    distinct shingles, keys of the bands."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ks, fps, ns, bands = [], [], [], []
            for t in b.column(2):
                plain = normal(t.as_py())
                h = simhash.shingle_hashes(plain.split(), WORDS)
                once = np.unique(h)
                ks.append(node(plain))
                fps.append(simhash.majority(h) if len(h) else 0)
                ns.append(len(once))
                bands.append(minima(once))
            fp = np.array(fps, np.uint64).view(np.int64)
            lists = pa.array(bands, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ks, pa.int64()), pa.array(fp), pa.array(ns, pa.int64()), lists], ["doc_id", "text_hash", "k", "fp", "n", "bands"])

    shared.bound_batches(docs.sparkSession)
    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "text")
    return picked.mapInArrow(shared.tidy(task), "doc_id long, text_hash long, k long, fp long, n long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(k, n, shingles) of each text whose key is in ``wanted`` (k)."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([node(normal(t.as_py())) for t in b.column(0)], pa.int64()), b.column(0)], ["k", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(simhash.shingle_hashes(normal(t.as_py()).split(), WORDS)).view(np.int64) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["k", "n", "shingles"])

    texts = docs.select(F.col("text")).mapInArrow(shared.tidy(keyed), "k long, text string")
    return texts.join(wanted, "k", "left_semi").mapInArrow(shared.tidy(cut), "k long, n long, shingles array<long>").dropDuplicates(["k"])


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of 0.8 or more.

    Pairs are grouped by a, in groups of about ``GROUP``, so a hot a is spread and its set comes once for each group.
    """
    held = pairs.groupBy("a").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
    heads = held.join(sets.withColumnRenamed("k", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "shingles")
    dealt = pairs.join(held, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("groups")).alias("part"))
    members = dealt.join(sets.withColumnRenamed("k", "b"), "b").select("a", "part", "b", "shingles")
    both = heads.unionByName(members).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").isNotNull())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = np.zeros(0, np.int64)
        for batch in batches:
            shingles = batch.column("shingles")
            bounds, flat = shingles.offsets.to_numpy(), shingles.values.to_numpy(zero_copy_only=False)
            a, b, near = batch.column("a").to_numpy(), batch.column("b"), []
            member = b.is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                own = flat[bounds[i] : bounds[i + 1]]
                if not member[i]:
                    head = own
                    continue
                common = len(own) + len(head) - len(np.union1d(own, head))
                if 9 * common >= 4 * (len(own) + len(head)):
                    near.append(i)
            if near:
                yield pa.RecordBatch.from_arrays([pa.array(a[near]), b.take(pa.array(near))], ["a", "b"])

    return both.mapInArrow(shared.tidy(task), "a long, b long")


def prefix_pairs(sets: DataFrame) -> DataFrame:
    """Candidates (a, b) among ``sets`` (k, n, shingles, root) whose roots differ. Complete for similarity 0.8.

    Shingles are ordered by their number of holders in ``sets``, ties by the shingle. Two sets with that similarity share
    a shingle among their fifth of rarest ones; and from the first shingle that they share on, each must have as many left
    as their intersection needs. So sets that hold much of their own meet nobody, however many hold the rest.
    """
    each = sets.select("k", "n", "root", F.explode("shingles").alias("shingle"))
    holders = each.groupBy("shingle").agg(F.count("*").alias("holders")).where("holders > 1")
    # a shingle of one holder joins nothing but counts among the rarest; those come first
    known = each.join(holders, "shingle")
    place = F.row_number().over(Window.partitionBy("k").orderBy("holders", "shingle"))
    shared_ones = F.count("*").over(Window.partitionBy("k"))
    rarest = known.withColumn("place", F.col("n") - shared_ones + place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * 0.8) + 1)
    one = rarest.select("shingle", F.col("k").alias("x"), "n", "root", (F.col("n") - F.col("place") + 1).alias("left"))
    other = rarest.select("shingle", F.col("k").alias("y"), F.col("n").alias("n_y"), F.col("root").alias("root_y"), (F.col("n") - F.col("place") + 1).alias("left_y"))
    fits = (F.col("root") < F.col("root_y")) & (5 * F.least("n", "n_y") >= 4 * F.greatest("n", "n_y"))
    enough = 9 * F.least("left", "left_y") >= 4 * (F.col("n") + F.col("n_y"))
    return one.join(other, (one.shingle == other.shingle) & fits & enough).select(*_ordered("x", "y")).distinct()


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def near_duplicates(docs: DataFrame, *, budget: int = 3) -> DataFrame:
    """(doc_id, text_hash, k, component, component_id) of every row; component_id as in ``simhash.near_duplicates``.

    component is the key of the component itself, which it also has where all its ids are null.

    Null texts are empty, and texts without words are one node. Null ids name a component only if it has no others.
    Repeated rows give repeated rows, an empty table none. Columns other than doc_id and text are not read.
    """
    spark = docs.sparkSession
    rows = shared.written(sketches(docs), "sketches")
    nodes = shared.written(rows.groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bands").alias("bands")), "nodes")
    size = nodes.select("k", "n")
    exploded = nodes.select("k", "n", F.explode("bands").alias("band"))
    held = exploded.groupBy("band").agg(F.count("*").alias("size")).where("size > 1")
    bands = shared.written(exploded.join(held, "band"), "bands")
    met = bands.join(bands.groupBy("k").agg(F.sum("size").alias("meets")), "k")
    head = met.groupBy("band").agg(F.max(F.struct("meets", "k")).alias("head"))
    heads = bands.join(head, "band").select(F.col("k").alias("x"), F.col("head.k").alias("y"))
    distinct = shared.written(nodes.groupBy("fp").agg(F.min("k").alias("k")), "distinct-fingerprints")
    stars, folder = simhash.links(distinct.select("fp"), budget)
    of_fp = distinct.select("fp", "k")
    trie = stars.join(of_fp.select(F.col("fp").alias("a"), F.col("k").alias("x")), "a").join(of_fp.select(F.col("fp").alias("b"), F.col("k").alias("y")), "b").select("x", "y")
    same = nodes.join(of_fp.withColumnRenamed("k", "y"), "fp").select(F.col("k").alias("x"), "y")
    first = _sized(heads.unionByName(trie).unionByName(same).where("x <> y").select(*_ordered("x", "y")).distinct(), size)
    first = shared.written(first, "candidates")
    wanted = bands.select("k").unionByName(first.select(F.col("a").alias("k"))).unionByName(first.select(F.col("b").alias("k"))).distinct()
    sets = shared.written(shingle_sets(docs, wanted), "shingle-sets")
    found = shared.written(similar(first, sets), "similar")
    roots = shared.written(simhash.components(found), "roots")
    # members of bands that still hold several components
    named = bands.select("band", "k").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    named = shared.written(named, "named-bands")
    open_bands = named.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    left = named.join(open_bands, "band", "left_semi").select("k", "root").distinct()
    cross = shared.written(prefix_pairs(sets.join(left, "k")).join(first, ["a", "b"], "left_anti"), "cross-candidates")
    edges = shared.written(found.unionByName(similar(cross, sets)), "edges")
    roots = simhash.components(edges)
    part = nodes.select("k", "rep").join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
    least = part.groupBy("root").agg(F.min("rep").alias("component_id"))
    of_node = shared.written(part.join(least, "root").select("k", F.col("root").alias("component"), "component_id"), "components")
    shared.discard(spark, folder, distinct, nodes, bands, first, sets, found, named, cross, edges)
    return rows.join(of_node, "k").select("doc_id", "text_hash", "k", "component", "component_id")


def _sized(pairs: DataFrame, size: DataFrame) -> DataFrame:
    """Pairs whose sets are close enough in size for a similarity of 0.8."""
    a, b = (size.select(F.col("k").alias(c), F.col("n").alias(f"n_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").where(5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b")).select("a", "b")
