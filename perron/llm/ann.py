"""Op 2: approximate nearest neighbours. NN-descent builds a graph by Spark joins; queries search it greedily.

Every vector keeps a list of ``degree`` neighbours. Lists start from blocks of vectors that lie next to each other on a
few random projections. In each round of NN-descent a vector sends itself to all its neighbours, a join on the
neighbour's id; where vectors meet at a common neighbour, every two of them are compared and each keeps what improves its
list. Meetings larger than ``meet`` are dealt by a hash before the shuffle, so a hub that a third of all vectors list is
many meetings and not one. Rounds end when few list entries change. Vectors travel as 8-bit codes with a scale each.

The graph, with the codes of neighbours beside each list, is written as block files in the shared folder. A query's beam
starts from its own list; in each hop its best unexpanded entries are dealt to the blocks that hold them, compared there,
and what beats the beam comes back, until the whole beam is expanded. The best of the beam are scored with the original vectors in double precision.
"""

from __future__ import annotations

import functools
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .vectors import lists, matrix, usable, whole_groups


@dataclass(frozen=True)
class Settings:
    degree: int = 48
    projections: int = 2
    block: int = 512  # neighbours on a projection that are compared at the start
    meet: int = 96  # vectors compared at once where they meet; larger meetings are dealt into such groups
    visit: int = 20_000  # steps of queries that one task takes to one block; more are dealt to several tasks
    improve: int = 8  # best partners that a vector takes from one meeting
    rounds: int = 24  # bound; they end when the graph is settled, after a number that grows with the logarithm of the rows
    settled: float = 0.04  # share of changed entries at which rounds end
    beam: int = 384  # a search ends when all entries of its beam are expanded
    expand: int = 96  # entries of a beam that one hop expands
    hops: int = 32  # bound
    rerank: int = 96
    nodes_per_block: int = 4096
    seed: int = 11


#: Largest table of hot keys that is broadcast.
HOT_KEYS = 50_000
LISTS = "id long, code binary, scale float, nbr array<long>, sim array<float>, fresh long"


def encode(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127.0
    return np.rint(x / scale[:, None]).astype(np.int8), scale.astype(np.float32)


def codes_of(table, width: int) -> np.ndarray:
    """Vectors from the columns code and scale, as float32 rows."""
    raw = np.frombuffer(b"".join(table.column("code").to_pylist()), np.int8).reshape(-1, width)
    return raw.astype(np.float32) * table.column("scale").to_numpy()[:, None]


def best(owner: np.ndarray, ids: np.ndarray, sim: np.ndarray, old: np.ndarray, k: int):
    """For each owner the ``k`` largest sims, an id once; ties go to the smaller id. Entries marked old stay marked."""
    o = np.lexsort((~old, ids, owner))
    owner, ids, sim, old = owner[o], ids[o], sim[o], old[o]
    keep = np.ones(len(owner), bool)
    keep[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, sim, old = owner[keep], ids[keep], sim[keep], old[keep]
    o = np.lexsort((ids, -sim, owner))
    owner, ids, sim, old = owner[o], ids[o], sim[o], old[o]
    first = np.ones(len(owner), bool)
    first[1:] = owner[1:] != owner[:-1]
    rank = np.arange(len(owner)) - np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))
    keep = rank < k
    return owner[keep], ids[keep], sim[keep], old[keep]


def compare(ids: np.ndarray, x: np.ndarray, floor: np.ndarray, take: int):
    """All pairs of one meeting: for each member its ``take`` best partners above its floor."""
    sim = x @ x.T
    sim[ids[:, None] == ids[None, :]] = -np.inf
    m = min(take, len(ids) - 1)
    if m < 1:
        return None
    top = np.argpartition(-sim, m - 1, axis=1)[:, :m]
    got = np.take_along_axis(sim, top, 1)
    good = (got > floor[:, None]) & np.isfinite(got)
    return good.sum(axis=1), ids[top][good], got[good]


def _found(parts: list) -> pa.RecordBatch:
    ids, sizes, nbr, sim = (np.concatenate(c) for c in zip(*parts))
    has = sizes > 0
    return pa.RecordBatch.from_arrays([pa.array(ids[has]), lists(sizes[has], nbr), lists(sizes[has], sim.astype(np.float32))], ["id", "nbr", "sim"])


def nearby(vectors: DataFrame, width: int, s: Settings) -> DataFrame:
    """First partners: vectors in one block of a random projection."""
    found = None
    for t in range(s.projections):
        direction = np.random.default_rng(s.seed + t).standard_normal(width)

        def project(batches, direction=direction):
            for b in batches:
                p = codes_of(b, width) @ direction
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(float)), b.column("id"), b.column("code"), b.column("scale")], ["p", "id", "code", "scale"])

        def blocks(batches):
            held = []
            for b in batches:
                held.append(b)
                while sum(x.num_rows for x in held) >= 2 * s.block:
                    t = pa.Table.from_batches(held)
                    yield from meet(t.slice(0, s.block))
                    held = t.slice(s.block).to_batches()
            if held:
                yield from meet(pa.Table.from_batches(held))

        def meet(t):
            ids, x = t.column("id").to_numpy(), codes_of(t, width)
            got = compare(ids, x, np.full(len(ids), -np.inf, np.float32), s.degree // 2)
            if got:
                yield _found([(ids, *got)])

        dealt = vectors.mapInArrow(shared.tidy(project), "p double, id long, code binary, scale float").repartitionByRange("p").sortWithinPartitions("p", "id")
        part = dealt.mapInArrow(shared.tidy(blocks), "id long, nbr array<long>, sim array<float>")
        found = part if found is None else found.unionByName(part)
    return found


def merged(graph: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """Lists with what was found; fresh counts entries that are new."""
    none = found.select("id", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"), "nbr", "sim")
    both = graph.select("id", "code", "scale", "nbr", "sim").unionByName(none).repartition("id").sortWithinPartitions("id", F.col("scale").isNull())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "id"):
            t = t.combine_chunks()
            ids = t.column("id").to_numpy()
            own = np.flatnonzero(~t.column("scale").is_null().to_numpy())
            nbr, sim = (t.column(c).chunk(0) for c in ("nbr", "sim"))
            size = np.diff(nbr.offsets.to_numpy())
            base = np.isin(np.arange(len(ids)), own)
            row = np.searchsorted(ids[own], ids)
            owner, old = np.repeat(row, size), np.repeat(base, size)
            flat, value = nbr.flatten().to_numpy(zero_copy_only=False), sim.flatten().to_numpy(zero_copy_only=False)
            owner, flat, value, old = best(owner, flat, value, old, k)
            n = np.bincount(owner, minlength=len(own))
            fresh = np.bincount(owner, weights=~old, minlength=len(own)).astype(np.int64)
            head = t.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([head.column("id").combine_chunks(), head.column("code").combine_chunks(), head.column("scale").combine_chunks(), lists(n, flat), lists(n, value), pa.array(fresh)], ["id", "code", "scale", "nbr", "sim", "fresh"])

    return both.mapInArrow(shared.tidy(task), LISTS)


def spread(rows: DataFrame, key: str, by: list, most: int) -> DataFrame:
    """``rows`` with a column part: 0 where ``key`` has at most ``most`` rows, else dealt to as many parts as that takes.

    Keys with more rows are counted map-side. Up to ``HOT_KEYS`` of them are broadcast, so rows are shuffled once; more
    are joined by shuffle, in which a hot key spreads as a skewed one.
    """
    hot = rows.groupBy(key).agg(F.count("*").alias("held")).where(F.col("held") > most)
    hot = shared.written(hot.select(F.col(key).alias("_hot"), F.ceil(F.col("held") / most).alias("_parts")), "hot-keys")
    n = hot.limit(HOT_KEYS + 1).count()
    if not n:
        return rows.withColumn("part", F.lit(0))
    part = F.pmod(F.xxhash64(*by), F.coalesce("_parts", F.lit(1))).cast("int")
    return rows.join(F.broadcast(hot) if n <= HOT_KEYS else hot, rows[key] == hot["_hot"], "left").withColumn("part", part).drop("_hot", "_parts")


def descend_round(graph: DataFrame, width: int, s: Settings, number: int) -> DataFrame:
    """One round: vectors meet at their neighbours, and at themselves."""
    floor = F.when(F.size("sim") >= s.degree, F.element_at("sim", -1)).otherwise(F.lit(float("-inf")).cast("float"))
    sent = graph.select("id", "code", "scale", floor.alias("floor"), F.explode(F.concat("nbr", F.array("id"))).alias("at"))
    sent = spread(sent, "at", ["id", F.lit(number)], 2 * s.meet)
    dealt = sent.repartition("at", "part").sortWithinPartitions("at", "part", F.xxhash64("id", F.lit(number)))
    dealt = dealt.select("id", "code", "scale", "floor", F.xxhash64("at", "part").alias("at"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "at", ordered=False):
            at, ids, floor = (t.column(c).to_numpy() for c in ("at", "id", "floor"))
            x = codes_of(t, width)
            cuts = np.r_[0, np.flatnonzero(np.diff(at)) + 1, len(at)]
            parts = []
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = -(-(b - a) // s.meet)
                for j in range(k):
                    w = slice(a + j, b, k)
                    got = compare(ids[w], x[w], floor[w], s.improve)
                    if got:
                        parts.append((ids[w], *got))
            if parts:
                yield _found(parts)

    return dealt.mapInArrow(shared.tidy(task), "id long, nbr array<long>, sim array<float>")


def build(vectors: DataFrame, width: int, s: Settings) -> DataFrame:
    """The neighbour graph by ``LISTS``; ``vectors`` is (id, code, scale)."""
    spark = vectors.sparkSession
    empty = vectors.withColumns({"nbr": F.array().cast("array<long>"), "sim": F.array().cast("array<float>")})
    graph = shared.written(merged(empty, nearby(vectors, width, s), s.degree), "graph")
    for number in range(s.rounds):
        following = shared.written(merged(graph, descend_round(graph, width, s, number), s.degree), "graph")
        shared.discard(spark, graph)
        graph = following
        changed = graph.agg(F.sum("fresh") / F.sum(F.greatest(F.size("nbr"), F.lit(1)))).first()[0]
        if changed is None or changed <= s.settled:
            break
    return graph


def _block(column, blocks: int):
    return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")


def write_blocks(graph: DataFrame, folder: str, blocks: int, width: int) -> None:
    """Block files: node ids (sorted), list bounds, neighbour ids, codes and scales."""
    shared.make_dirs(graph.sparkSession, folder)
    codes = graph.select(F.col("id").alias("to"), "code", "scale")
    edges = graph.select("id", F.explode("nbr").alias("to")).join(codes, "to").select(_block("id", blocks).alias("block"), "id", "to", "code", "scale")
    dealt = edges.repartition(blocks, "block").sortWithinPartitions("block", "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "block", 1):
            block = t.column("block").to_numpy()
            for k in np.unique(block):
                part = t.filter(pa.array(block == k))
                ids, first = np.unique(part.column("id").to_numpy(), return_index=True)
                code = np.frombuffer(b"".join(part.column("code").to_pylist()), np.int8).reshape(-1, width)
                out = io.BytesIO()
                np.savez(out, ids=ids, first=np.r_[first, part.num_rows], to=part.column("to").to_numpy(), code=code, scale=part.column("scale").to_numpy())
                with shared.atomic_output(f"{folder}/{k}.npz") as f:
                    f.write(out.getbuffer())
        yield from ()

    dealt.mapInArrow(shared.tidy(task), "block int").collect()


BEAM = "q long, code binary, scale float, nbr array<long>, sim array<float>, done array<boolean>"


def search(graph: DataFrame, queries: DataFrame, width: int, s: Settings) -> DataFrame:
    """(q, nbr, sim): the beam of each query id, best first."""
    spark = graph.sparkSession
    n = graph.count()
    blocks = max(1, -(-n // s.nodes_per_block))
    folder = shared.fresh_path(spark, "graph-blocks")
    write_blocks(graph, folder, blocks, width)
    start = graph.join(queries.select("id"), "id", "left_semi")
    beams = shared.written(start.select(F.col("id").alias("q"), "code", "scale", "nbr", "sim", F.transform("nbr", lambda v: F.lit(False)).alias("done")), "beams")

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = shared.storage(folder)

        @functools.lru_cache(1)
        def load(k: int) -> dict:
            with system.open_input_file(f"{path}/{k}.npz") as f:
                return dict(np.load(io.BytesIO(f.read())))

        for t in whole_groups(batches, "block", 1):
            for k in np.unique(t.column("block").to_numpy()):
                part, g = t.filter(pa.array(t.column("block").to_numpy() == k)), load(int(k))
                q, to, floor = (part.column(c).to_numpy() for c in ("q", "to", "floor"))
                x = codes_of(part, width)
                cuts = np.r_[0, np.flatnonzero(np.diff(q)) + 1, len(q)]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    node = np.searchsorted(g["ids"], to[a:b])
                    node = node[(node < len(g["ids"]))]
                    at = np.concatenate([np.arange(g["first"][i], g["first"][i + 1]) for i in node]) if len(node) else np.zeros(0, int)
                    near, where = np.unique(g["to"][at], return_index=True)
                    at = at[where]
                    sim = (g["code"][at].astype(np.float32) @ x[a]) * g["scale"][at]
                    good = (sim > floor[a]) & (near != q[a])
                    if good.any():
                        rows.append((q[a : a + 1], np.array([good.sum()]), near[good], sim[good]))
                if rows:
                    yield _found(rows).rename_columns(["q", "nbr", "sim"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "q", 2_000):
            t = t.combine_chunks()
            q = t.column("q").to_numpy()
            own = np.flatnonzero(~t.column("scale").is_null().to_numpy())
            nbr = t.column("nbr").chunk(0)
            size = np.diff(nbr.offsets.to_numpy())
            owner = np.repeat(np.searchsorted(q[own], q), size)
            done = t.column("done").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(bool)
            sim = t.column("sim").chunk(0).flatten().to_numpy(zero_copy_only=False)
            owner, ids, sim, done = best(owner, nbr.flatten().to_numpy(zero_copy_only=False), sim, done, s.beam)
            count = np.bincount(owner, minlength=len(own))
            head = t.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([*(head.column(c).combine_chunks() for c in ("q", "code", "scale")), lists(count, ids), lists(count, sim), lists(count, done)], ["q", "code", "scale", "nbr", "sim", "done"])

    for _ in range(s.hops):
        # the places of the best unexpanded entries; they count as expanded from here on
        open_at = F.slice(F.filter(F.transform("done", lambda d, i: F.when(~d, i).otherwise(-1)), lambda i: i >= 0), 1, s.expand)
        now = beams.withColumn("open", open_at)
        floor = F.when(F.size("sim") >= s.beam, F.element_at("sim", -1)).otherwise(F.lit(float("-inf")).cast("float"))
        todo = now.select("q", "code", "scale", floor.alias("floor"), F.explode(F.transform("open", lambda i: F.get("nbr", i))).alias("to"))
        todo = spread(todo.withColumn("block", _block("to", blocks)), "block", ["q"], s.visit)
        dealt = todo.repartition("block", "part").sortWithinPartitions("block", "q")
        found = dealt.mapInArrow(shared.tidy(visit), "q long, nbr array<long>, sim array<float>")
        found = found.select("q", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("float").alias("scale"), "nbr", "sim", F.transform("nbr", lambda v: F.lit(False)).alias("done"))
        marked = now.select("q", "code", "scale", "nbr", "sim", F.transform("done", lambda d, i: d | F.array_contains("open", i)).alias("done"))
        both = marked.unionByName(found).repartition("q").sortWithinPartitions("q", F.col("scale").isNull())
        following = shared.written(both.mapInArrow(shared.tidy(gather), BEAM), "beams")
        shared.discard(spark, beams)
        beams = following
        if not beams.where(F.exists("done", lambda d: ~d)).limit(1).count():
            break
    shared.discard(spark, folder)
    return beams


def copies(exact: DataFrame, keep: int) -> tuple[DataFrame, DataFrame]:
    """Groups of equal vectors, by two hashes: their members as (id, rep, n), and each group's ``keep`` smallest ids as (rep, vec_id).

    rep is the smallest id of a group. Rows are narrow, groups are counted map-side, and the window limits them map-side.
    """
    keyed = exact.select("id", F.xxhash64("x").alias("a"), F.xxhash64(F.lit(1), "x").alias("b"))
    groups = keyed.groupBy("a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("id"))
    first = keyed.withColumn("place", place).where(F.col("place") <= keep).join(groups, ["a", "b"])
    return keyed.join(groups, ["a", "b"]).select("id", "rep", "n"), first.select("rep", F.col("id").alias("vec_id"))


def nearest(df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 20, k: int = 20, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` found with the largest inner products for each id divisible by ``every``.

    score is the inner product of the original vectors in double precision; equal scores go by the smaller id. A query
    is no candidate for itself. The graph holds each distinct vector once, so a group of copies neither fills the lists of
    its neighbours nor hides behind itself; what is found stands for all its copies, of which k + 1 can matter. Vectors
    of fewer components than the widest are filled with zeros. What takes no part is stated in ``vectors.usable``; fewer
    candidates than ``k`` give fewer rows, an empty table none.
    """
    spark = df.sparkSession
    exact = shared.written(usable(df, id_column, vector_column, zero=False), "vectors")
    width = exact.agg(F.max(F.size("x"))).first()[0] or 1
    member, first = (shared.written(t, "copies") for t in copies(exact, k + 1))
    late = member.where("n > 1 and id <> rep").select("id")
    single = shared.written(exact.join(late, "id", "left_anti"), "distinct-vectors")

    def pack(batches):
        for b in batches:
            code, scale = encode(matrix(b.column("x"), width))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(scale)], ["id", "code", "scale"])

    vectors = single.mapInArrow(shared.tidy(pack), "id long, code binary, scale float")
    graph = build(vectors, width, settings)
    asked = member.where(F.col("id") % every == 0).select(F.col("id").alias("query_id"), F.col("rep").alias("q"))
    beams = search(graph, asked.select(F.col("q").alias("id")).distinct(), width, settings)
    pairs = beams.select("q", F.explode(F.concat(F.slice("nbr", 1, settings.rerank), F.array("q"))).alias("rep"))
    pairs = pairs.join(single.select(F.col("id").alias("rep"), F.col("x").alias("vx")), "rep").join(single.select(F.col("id").alias("q"), F.col("x").alias("qx")), "q")

    def score(batches):
        for b in batches:
            v, q = matrix(b.column("vx"), width), matrix(b.column("qx"), width)
            yield pa.RecordBatch.from_arrays([b.column("q"), b.column("rep"), pa.array(np.einsum("ij,ij->i", v, q))], ["q", "rep", "score"])

    scored = pairs.select("q", "rep", "vx", "qx").mapInArrow(shared.tidy(score), "q long, rep long, score double")
    order = lambda key, name: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), name))
    leading = scored.withColumn("rank", order("q", "rep")).where(F.col("rank") <= k + 1).drop("rank")
    # what comes after k + 1 copies of strictly nearer vectors cannot matter
    held = first.groupBy("rep").agg(F.count("*").alias("held"))
    nearer = Window.partitionBy("q").orderBy(F.desc("score"))
    level = F.sum("held").over(nearer.rangeBetween(Window.unboundedPreceding, Window.currentRow)) - F.sum("held").over(Window.partitionBy("q", "score"))
    leading = leading.join(held, "rep").withColumn("before", level).where(F.col("before") <= k).drop("before", "held")
    each = leading.join(first, "rep").withColumn("rank", order("q", "vec_id")).where(F.col("rank") <= k + 1)
    found = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("found"))
    parts = asked.groupBy("q").agg(F.ceil(F.count("*") / settings.visit).alias("parts"))
    found = found.join(parts, "q").select("q", "found", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    dealt = asked.join(parts, "q").select("query_id", "q", F.pmod(F.xxhash64("query_id"), F.col("parts")).alias("part"))
    others = dealt.join(found, ["q", "part"]).select("query_id", F.slice(F.filter("found", lambda v: v["vec_id"] != F.col("query_id")), 1, k).alias("found"))
    return others.select("query_id", F.posexplode("found").alias("at", "v")).select("query_id", (F.col("at") + 1).alias("rank"), "v.vec_id", "v.score")
