"""Op 10: documents and their token counts in flat token files that have no index.

A file is a bare run of little-endian ids in which an end-of-document id closes each document. Blocks of a file are
searched on their own, each by one vectorised comparison, and the places of their separators are written to the shared
folder. What a block cannot know, the place of the last separator before it and the number of those before it, comes
from a prefix scan over one small row for each block (its count and its last separator), joined back to the blocks.
Document ids are looked up by place in the notes of the writing tasks, so no document is shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shared
from . import tokens as tk

#: Blocks whose carried rows (a file's name and three numbers each) are broadcast; beyond that they are shuffled.
MOST_BROADCAST = 100_000


def write_flat(
    docs: DataFrame, folder: str, *, id_column: str = "doc_id", text_column: str = "text", tokenizer: str | None = None, end_id: int = tk.END_OF_TEXT
) -> DataFrame:
    """Write one flat file for each partition read; returns (file, n, doc_id): the documents of a file in order.

    The files hold ids only; the returned table is the caller's own note of which document it wrote as the n-th. The
    note of part-NNNNNN.bin is part-NNNNNN.parquet of that table.
    """
    spark, path = docs.sparkSession, tokenizer or tk.default_tokenizer()
    shared.bound_batches(spark)
    shared.make_dirs(spark, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = tk.encoder(path, literal=True), TaskContext.get().partitionId()
        end, n, first = np.asarray([end_id], enc.dtype).tobytes(), 0, next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        def rest():
            yield first
            yield from batches

        with shared.atomic_output(f"{folder}/part-{part:06d}.bin") as out:
            for batch in tk.pieces_of(rest(), 1):
                for raw in enc.encode(batch.column(1).to_pylist()):
                    out.write(raw + end)
                k = batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{part:06d}.bin"] * k), pa.array(range(n, n + k), pa.int64()), batch.column(0)], ["file", "n", "doc_id"])
                n += k

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return shared.written_by_tasks(picked, task, "file string, n long, doc_id long", "flat-notes")


def count_tokens(spark: SparkSession, folder: str, *, end_id: int = tk.END_OF_TEXT, dtype: str = "<u2", block_tokens: int = 4_000_000) -> DataFrame:
    """(file, n, start, n_tokens, terminated) for every document of every file in ``folder``.

    n counts a file's documents from 0, start is its first token's place in the file, n_tokens includes the closing
    id. Tokens after a file's last separator are one more document with terminated = false; a file without tokens has
    no documents; separators in a row are documents of one token. Bytes short of a whole id at a file's end are an
    error. Files that end in .tmp are ignored.
    """
    from pyarrow import fs

    system, path = shared.storage(folder)
    size = np.dtype(dtype).itemsize
    files = []
    for f in sorted(system.get_file_info(fs.FileSelector(path)), key=lambda f: f.base_name):
        if f.type != fs.FileType.File or f.base_name.endswith(".tmp"):
            continue
        if f.size % size:
            raise ValueError(f"{f.base_name} has {f.size} bytes, not a multiple of {size}")
        if f.size:
            files.append((f.base_name, f.size // size))
    columns = [pa.array([f[0] for f in files], pa.string()), pa.array([f[1] for f in files], pa.int64())]
    listed = spark.createDataFrame(pa.table(columns, ["file", "total"]))  # rows from Arrow need no Python workers
    each = listed.select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") - 1) / block_tokens))).alias("block"), "total")
    count = sum(-(-n // block_tokens) for _, n in files)
    blocks = each.repartition(max(1, task_count(spark, count)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = shared.storage(folder)
        for batch in batches:
            for name, k, total in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_input_file(f"{path}/{name}") as f:
                    f.seek(k * block_tokens * size)
                    ids = np.frombuffer(f.read(min(block_tokens, total - k * block_tokens) * size), dtype)
                at = np.flatnonzero(ids == end_id).astype(np.int64) + k * block_tokens
                ends = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([total], pa.int64()), ends], ["file", "block", "total", "ends"])

    found = shared.written_by_tasks(blocks, scan, "file string, block long, total long, ends array<long>", "separators")
    narrow = found.select("file", "block", F.size("ends").alias("n"), F.when(F.size("ends") > 0, F.element_at("ends", -1)).alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = narrow.select("file", "block", F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    stitched = found.join(F.broadcast(carried) if count <= MOST_BROADCAST else carried, ["file", "block"])
    last = F.when(F.size("ends") > 0, F.element_at("ends", -1)).otherwise(F.col("carry"))
    at_end = (F.col("block") + 1) * block_tokens >= F.col("total")
    open_end = at_end & (last < F.col("total") - 1)
    ends = F.when(open_end, F.concat("ends", F.array(F.col("total") - 1))).otherwise(F.col("ends"))
    each = stitched.select("file", "first", "carry", open_end.alias("open_end"), ends.alias("ends"), F.posexplode(ends).alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.element_at("ends", F.col("i"))) + 1
    return each.select(
        "file", (F.col("first") + F.col("i")).alias("n"), start.alias("start"), (F.col("stop") - start + 1).alias("n_tokens"),
        (~(F.col("open_end") & (F.col("i") == F.size("ends") - 1))).alias("terminated"),
    )


def task_count(spark: SparkSession, blocks: int) -> int:
    return min(blocks, max(4 * shared.task_slots(spark), blocks // 8))


class Notes:
    """Document ids by file and place, from tables of ``write_flat``; holds the row groups last asked for."""

    def __init__(self, folder: str):
        self.system, self.path = shared.storage(folder)
        self.file = self.held = None

    def ids(self, file: str, n: np.ndarray) -> pa.Array:
        import pyarrow.parquet as pq

        if file != self.file:
            self.source = pq.ParquetFile(self.system.open_input_file(f"{self.path}/{file.removesuffix('.bin')}.parquet"))
            meta = self.source.metadata
            self.first = np.cumsum([0, *(meta.row_group(g).num_rows for g in range(meta.num_row_groups))])
            self.file, self.held = file, None
        groups = range(np.searchsorted(self.first, n.min(), "right") - 1, np.searchsorted(self.first, n.max(), "right"))
        if groups != self.held:
            self.rows, self.held = self.source.read_row_groups(list(groups), ["doc_id"]).column(0).combine_chunks(), groups
        return self.rows.take(pa.array(n - self.first[groups[0]]))


def count_documents(docs: DataFrame, *, tokenizer: str | None = None, block_tokens: int = 4_000_000) -> DataFrame:
    """doc_id, n_tokens (with the end id), file and start of each document, from flat files written for it.

    Null texts are empty documents of one token; null and repeated ids keep a row for each document; an empty table
    gives no rows.
    """
    spark = docs.sparkSession
    folder = shared.fresh_path(spark, "flat")
    path = tokenizer or tk.default_tokenizer()
    noted = write_flat(docs, folder, tokenizer=path)._perron_path
    counts = count_tokens(spark, folder, dtype=tk.encoder(path, literal=True).dtype.str, block_tokens=block_tokens)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        notes = Notes(noted)
        for batch in batches:
            file, n, start, n_tokens = (batch.column(k) for k in ("file", "n", "start", "n_tokens"))
            of, n = file.dictionary_encode(), n.to_numpy()
            runs = [0, *(np.flatnonzero(np.diff(of.indices.to_numpy())) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(runs, runs[1:]):
                columns = [notes.ids(file[a].as_py(), n[a:b]), n_tokens[a:b], file[a:b], start[a:b]]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "file", "start"])

    return counts.mapInArrow(shared.tidy(named), "doc_id long, n_tokens long, file string, start long")
