"""Op 4: exact top-k inner products by norm order, rotated partial sums and Cauchy-Schwarz residual bounds.

Vectors are sorted by descending length and cut into blocks, written as files in the shared folder; each holds its integer
vectors, their first coordinates in the basis of the principal axes (SVD of the vectors' second moments) and the length of
the rest. Query blocks meet candidate blocks (a stated query set against all rows, in blocks) in rounds of descending
length: the longest block, then four times as many in each round. After a round each query's k-th score so far is its
bound. A pair of blocks is dropped where length times length cannot reach any bound of the query block, and a vector
where partial sum plus product of the residual lengths cannot. What remains is scored in exact 64-bit integers. Only
numbers of blocks and bounds are dealt to tasks, which read the blocks they need.
"""

from __future__ import annotations

import functools
import io
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .vectors import matrix, usable

BLOCK = "block long, ids array<long>, lengths array<double>"
SLACK = 1e-9
#: Growth of the number of candidate blocks from round to round.
GROWTH = 4


def _save(uri: str, **arrays: np.ndarray) -> None:
    out = io.BytesIO()
    np.savez(out, **arrays)
    with shared.atomic_output(uri) as f:
        f.write(out.getbuffer())


def _load(uri: str) -> dict[str, np.ndarray]:
    system, path = shared.storage(uri)
    with system.open_input_file(path) as f:
        return dict(np.load(io.BytesIO(f.read())))


def top(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores; ties by the smaller id."""
    if len(score) > k:
        least = -np.partition(-score, k - 1)[k - 1]
        at = np.flatnonzero(score >= least)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def meet(q: dict[str, np.ndarray], c: dict[str, np.ndarray], bound: np.ndarray, k: int):
    """Per query (place, candidate places, scores) of at most k candidates that may be among its best."""
    reach = q["length"] * c["length"].max()
    for i in np.flatnonzero(reach * (1 + SLACK) + 1 >= bound):
        n = int(np.searchsorted(-c["length"], -(bound[i] - 1) / max(q["length"][i], 1e-300) * (1 - SLACK), side="right")) if bound[i] > 1 else len(c["ids"])
        if not n:
            continue
        upper = c["head"][:n] @ q["head"][i]
        upper += c["rest"][:n] * q["rest"][i]
        upper += SLACK * q["length"][i] * c["length"][:n] + 1
        at = np.flatnonzero((upper >= bound[i]) & (c["ids"][:n] != q["ids"][i]))
        if len(at):
            score = c["x"][at] @ q["x"][i]
            good = score >= bound[i]
            at, score = at[good], score[good]
            best = top(c["ids"][at], score, k)
            yield i, at[best], score[best]


def exact_top_k(
    df: DataFrame, *, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 100, k: int = 10, scale: int = 1024, head: int = 16, block: int = 4096, query_block: int = 512
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k largest inner products of floor(scale * x) for ids divisible by ``every``.

    Equal scores go by the smaller id; a query is no candidate for itself. Zero vectors take part. Shorter vectors are
    filled with zeros. What takes no part is stated in ``vectors.usable``; fewer candidates than k give fewer rows, an
    empty table none. Scores must stay below 2^53 for the bounds (components below about 10^6).
    """
    spark = df.sparkSession
    whole = usable(df, id_column, vector_column, zero=True)
    ints = whole.select("id", F.transform("x", lambda v: F.floor(v * F.lit(float(scale))).cast("long")).alias("x"))
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    rows = shared.written(ints.withColumn("square", square), "integer-vectors")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1

    def moments(batches):
        total = np.zeros((width, width))
        for b in batches:
            x = matrix(b.column("x"), width)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    def add(batches):
        total = np.zeros((width, width))
        for b in batches:
            for m in b.column(0):
                total += np.frombuffer(m.as_buffer()).reshape(width, width)
        yield pa.RecordBatch.from_pydict({"m": [total.tobytes()]})

    parts = rows.mapInArrow(shared.tidy(moments), "m binary").repartition(8).mapInArrow(shared.tidy(add), "m binary").collect()
    axes = np.linalg.svd(sum(np.frombuffer(p.m).reshape(width, width) for p in parts))[0]
    h = min(head, width)

    def arrays(ids: np.ndarray, x: np.ndarray) -> dict[str, np.ndarray]:
        y = x.astype(float) @ axes
        return {"ids": ids, "x": x, "head": y[:, :h], "rest": np.sqrt((y[:, h:] ** 2).sum(axis=1)), "length": np.sqrt((x.astype(float) ** 2).sum(axis=1))}

    folder = shared.fresh_path(spark, "blocks")

    def cut(kind: str, size: int):
        shared.make_dirs(spark, f"{folder}/{kind}")

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            number, held, n = TaskContext.get().partitionId() << 32, [], 0

            def blocks(last: bool):
                nonlocal held, n, number
                while n >= size or (last and n):
                    t = pa.Table.from_batches(held)
                    part, left = t.slice(0, size), t.slice(size)
                    got = arrays(part.column("id").to_numpy(), matrix(part.column("x").combine_chunks(), width, np.int64))
                    _save(f"{folder}/{kind}/{number}.npz", **got)
                    lengths = got["length"] if kind == "query" else got["length"].max(keepdims=True)
                    ids = got["ids"] if kind == "query" else got["ids"][:0]
                    yield pa.RecordBatch.from_pydict({"block": [number], "ids": pa.array([ids], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.float64()))})
                    number, held, n = number + 1, left.to_batches(), left.num_rows

            for b in batches:
                held.append(b)
                n += b.num_rows
                yield from blocks(False)
            yield from blocks(True)

        return task

    def blocks_of(kind: str, vectors: DataFrame, size: int) -> DataFrame:
        dealt = vectors.select("id", "x", "square").repartitionByRange(F.desc("square")).sortWithinPartitions(F.desc("square"), "id")
        return shared.written(dealt.mapInArrow(shared.tidy(cut(kind, size)), BLOCK), f"{kind}-blocks")

    candidates = blocks_of("candidate", rows, block)
    queries = blocks_of("query", rows.where(F.col("id") % every == 0), query_block)
    # places of candidate blocks by descending length: one row a partition comes to the driver
    sizes = sorted((r.part, r.n) for r in candidates.groupBy(F.shiftrightunsigned("block", 32).alias("part")).agg(F.count("*").alias("n")).collect())
    starts = list(itertools.accumulate((n for _, n in sizes), initial=0))
    offsets = spark.createDataFrame([(p, a) for (p, _), a in zip(sizes, starts)], "part long, first long")
    within = F.col("block").bitwiseAND(0xFFFFFFFF)
    listed = candidates.withColumn("part", F.shiftrightunsigned("block", 32)).join(offsets, "part")
    listed = listed.select((F.col("first") + within).alias("place"), "block", F.get("lengths", F.lit(0)).alias("longest"))
    each = queries.select(F.col("block").alias("number"), F.posexplode(F.arrays_zip("ids", "lengths")).alias("pos", "q")).select("number", "pos", F.col("q.ids").alias("query_id"), F.col("q.lengths").alias("length"))
    best = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidate = functools.lru_cache(2)(lambda n: _load(f"{folder}/candidate/{n}.npz"))
        query = functools.lru_cache(64)(lambda n: _load(f"{folder}/query/{n}.npz"))
        for batch in batches:
            bounds = batch.column("bounds")
            for i, (number, at) in enumerate(zip(batch.column("number").to_pylist(), batch.column("block").to_pylist())):
                q, c = query(number), candidate(at)
                got = list(meet(q, c, bounds[i].values.to_numpy(zero_copy_only=False), k))
                if got:
                    ids = np.concatenate([np.full(len(at), q["ids"][i]) for i, at, _ in got])
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([c["ids"][at] for _, at, _ in got])), pa.array(np.concatenate([s for *_, s in got]))], ["query_id", "vec_id", "score"])

    lo, size = 0, 1
    while lo < starts[-1]:
        hi = min(starts[-1], lo + size)
        bound = F.coalesce(F.col("score").cast("double"), F.lit(-(2.0**62)))
        told = each.join(best.where(F.col("rank") == k).select("query_id", "score"), "query_id", "left")
        # the least length of a candidate that can still be among the best of some query of the block
        need = F.when(F.col("length") > 0, (bound - 1) / (F.col("length") * (1 + SLACK))).otherwise(F.lit(-(2.0**62)))
        asked = told.groupBy("number").agg(F.min(need).alias("need"), F.transform(F.array_sort(F.collect_list(F.struct("pos", bound.alias("bound")))), lambda x: x["bound"]).alias("bounds"))
        round_ = listed.where(F.col("place").between(lo, hi - 1))
        pairs = asked.select("number", "need", F.explode(F.sequence(F.lit(lo).cast("long"), F.lit(hi - 1).cast("long"))).alias("place"))
        pairs = pairs.join(round_, "place").where("longest >= need").select("number", "place", "block").join(asked.select("number", "bounds"), "number")
        dealt = pairs.repartitionByRange("place", "number").sortWithinPartitions("place", "number").select("number", "block", "bounds")
        found = dealt.mapInArrow(shared.tidy(work), "query_id long, vec_id long, score long")
        both = best.select("query_id", "vec_id", "score").unionByName(found)
        following = shared.written(both.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "best")
        shared.discard(spark, best)
        best, lo, size = following, hi, size * GROWTH
    shared.discard(spark, folder, rows, candidates, queries)
    return best


SQL = """
WITH v AS (
  SELECT vec_id, [floor(CAST(1024 AS DOUBLE) * CAST(x AS DOUBLE)) FOR x IN embedding] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 10
"""
