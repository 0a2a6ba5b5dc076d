"""Op 8: equal-length token sequences and masks in Arrow stream files, read back by zero-copy random access.

A shard is two Arrow stream files in a folder that driver and executors share:

* ``shard-NNNNNN-NNNNN.arrows`` (task and number in the task): record batches of ``rows`` sequences each (the last may have fewer), with the columns
  ``ids`` fixed_size_list<uint16|uint32>[length] and ``mask`` fixed_size_list<bool>[length] (false: padding). Only the
  last sequence of a shard is padded.
* ``shard-NNNNNN-NNNNN.docs.arrows``: doc_id, start (tokens of the shard before the document), n_tokens.

Because a batch holds one contiguous buffer of rows * length ids, sequence k is row k % rows of batch k // rows, a view
of the mapped file. Shards are numbered by ascending doc_id, so the dataset is one long ordered token stream. A task
closes a shard once it holds ``shard_tokens`` tokens, so neither files nor what is kept of them grow with the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared
from . import tokens as tk


def shard_name(folder: str, shard: int, docs: bool = False) -> str:
    return f"{folder}/shard-{shard >> 20:06d}-{shard & 0xFFFFF:05d}.{'docs.' if docs else ''}arrows"


class ShardWriter:
    """Takes ids as bytes; writes whole batches as they fill, so it holds one batch at most."""

    def __init__(self, stream, dtype: np.dtype, length: int, rows: int):
        self.length, self.rows, self.dtype = length, rows, dtype
        item = pa.uint16() if dtype.itemsize == 2 else pa.uint32()
        self.schema = pa.schema([("ids", pa.list_(pa.field("item", item, False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), False), length))])
        self.out = pa.ipc.new_stream(stream, self.schema)
        self.item, self.held, self.size = item, [], 0
        self.whole = length * rows * dtype.itemsize

    def write(self, raw: bytes) -> None:
        self.held.append(raw)
        self.size += len(raw)
        if self.size >= self.whole:
            data = memoryview(b"".join(self.held))
            at = 0
            while len(data) - at >= self.whole:
                self._batch(data[at : at + self.whole])
                at += self.whole
            self.held, self.size = [bytes(data[at:])], len(data) - at

    def _batch(self, data) -> None:
        ids = np.frombuffer(data, self.dtype)
        n = -(-len(ids) // self.length)
        mask = np.ones(n * self.length, bool)
        if n * self.length != len(ids):
            mask[len(ids) :] = False
            ids = np.concatenate([ids, np.zeros(n * self.length - len(ids), self.dtype)])
        cols = [pa.FixedSizeListArray.from_arrays(pa.array(x, k), type=f.type) for x, k, f in zip((ids, mask), (self.item, pa.bool_()), self.schema)]
        self.out.write_batch(pa.RecordBatch.from_arrays(cols, schema=self.schema))

    def close(self) -> None:
        if self.size:
            self._batch(b"".join(self.held))
        self.out.close()


class Shard:
    """Random access to a shard. On a local or mounted path the file is mapped and every view is zero-copy."""

    def __init__(self, folder: str, shard: int):
        self.batches = list(pa.ipc.open_stream(self._open(shard_name(folder, shard))))
        self.docs = pa.ipc.open_stream(self._open(shard_name(folder, shard, True))).read_all()
        ids = [b.column("ids") for b in self.batches]
        self.length = ids[0].type.list_size if ids else 0
        self.rows = len(ids[0]) if ids else 0
        self.flat = [x.flatten().to_numpy(zero_copy_only=True) for x in ids]

    @staticmethod
    def _open(uri: str):
        from pyarrow import fs

        system, path = shared.storage(uri)
        return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        b, r = divmod(k, self.rows)
        mask = self.batches[b].column("mask")[r].values.to_numpy(zero_copy_only=False)
        return self.flat[b][r * self.length : (r + 1) * self.length], mask

    def tokens(self, start: int, n: int) -> np.ndarray:
        """Tokens of the shard from ``start`` on: a view within one batch, else the few views joined."""
        per, found = self.rows * self.length, []
        while n > 0:
            b, at = divmod(start, per)
            found.append(self.flat[b][at : at + n])
            start, n = start + len(found[-1]), n - len(found[-1])
        return found[0] if len(found) == 1 else np.concatenate(found) if found else np.zeros(0, np.uint16)


def write_documents(
    docs: DataFrame,
    folder: str,
    *,
    id_column: str = "doc_id",
    text_column: str = "text",
    tokenizer: str | None = None,
    end_id: int = 2,
    length: int = 2048,
    rows: int = 256,
    shards: int | None = None,
    shard_tokens: int = 64_000_000,
) -> list[tuple[int, int, int]]:
    """Write shards in ascending id order; returns (shard, documents, tokens) of each, in order.

    Documents are dealt to ``shards`` tasks (default: the shuffle partitions) by ranges of ids; a document is never cut.
    Null texts are empty (the end id alone). Null ids come first; rows with one id are ordered by a hash of their texts.
    An empty table writes nothing. Other columns are not read.
    """
    spark, path = docs.sparkSession, tokenizer or tk.default_tokenizer()
    shared.bound_batches(spark)
    shared.make_dirs(spark, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = tk.encoder(path), TaskContext.get().partitionId() << 20
        end, width = np.asarray([end_id], enc.dtype).tobytes(), enc.dtype.itemsize

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in tk.pieces_of(batches, 1):
                yield from zip(batch.column(0).to_pylist(), (raw + end for raw in enc.encode(batch.column(1).to_pylist())))

        docs_left = encoded()
        pending = next(docs_left, None)
        while pending is not None:
            ids, sizes, total = [], [], 0
            with shared.atomic_output(shard_name(folder, shard)) as stream:
                out = ShardWriter(stream, enc.dtype, length, rows)
                while pending is not None and total < shard_tokens:
                    out.write(pending[1])
                    ids.append(pending[0])
                    sizes.append(len(pending[1]) // width)
                    total += sizes[-1]
                    pending = next(docs_left, None)
                out.close()
            n = np.asarray(sizes, np.int64)
            table = pa.table({"doc_id": pa.array(ids, pa.int64()), "start": np.cumsum(n) - n, "n_tokens": n})
            with shared.atomic_output(shard_name(folder, shard, True)) as stream, pa.ipc.new_stream(stream, table.schema) as w:
                w.write_table(table, max_chunksize=65_536)
            yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(ids)], "tokens": [total]})
            shard += 1

    picked = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    dealt = picked.repartitionByRange(shards or shared.parallelism(spark), "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return sorted((r.shard, r.docs, r.tokens) for r in dealt.mapInArrow(shared.tidy(task), "shard long, docs long, tokens long").collect())


def read_documents(spark: SparkSession, folder: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (in the whole stream), n_tokens and ids_crc32 of each document, from the files."""
    tokens = np.array([n for *_, n in shards], np.int64)
    listed = pa.table({"shard": pa.array([s for s, *_ in shards], pa.int64()), "base": np.cumsum(tokens) - tokens})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, base in zip(*(c.to_pylist() for c in batch.columns)):
                shard = Shard(folder, k)
                for part in shard.docs.to_batches(max_chunksize=8_192):
                    start, n = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    crc = [tk.crc32_of(shard.tokens(a, b)) for a, b in zip(start.tolist(), n.tolist())]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(start + base), pa.array(n), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return spark.createDataFrame(listed).repartition(max(1, min(len(shards), 4096))).mapInArrow(shared.tidy(task), "doc_id long, start long, n_tokens long, ids_crc32 long")
