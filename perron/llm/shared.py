"""What the operators of this subpackage share: the folder all executors see, and tables written there."""

from __future__ import annotations

import ctypes
import functools
import itertools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, else that of setCheckpointDir.

    Where neither is set, local mode takes one temporary folder of this application; on a cluster that is an error, as
    executors would not see the driver's folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="perron-")
    return _own[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back.

    Unlike localCheckpoint the table outlives any executor.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._perron_path = path
    return table


def written_by_tasks(df: DataFrame, task: Callable[[Iterator], Iterator], schema: str, name: str) -> DataFrame:
    """``written(df.mapInArrow(task, schema), name)``, with Parquet files that the Python workers write.

    For each file of a local folder Spark's writer lets the executor's JVM start several processes (``chmod``). Until
    such a child runs its own program it shares the JVM's memory, so an executor looks twice as large as it is.
    Files appear by rename; a task without rows writes none.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    make_dirs(spark, path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.parquet as pq

        found = task(batches)
        first = next(found, None)
        if first is None:
            return
        rows, held, size = 0, [], 0
        with atomic_output(f"{path}/part-{TaskContext.get().partitionId():06d}.parquet") as out, pq.ParquetWriter(out, first.schema) as w:
            for batch in itertools.chain([first], found):
                held.append(batch)
                rows, size = rows + batch.num_rows, size + batch.nbytes
                if size >= 8 << 20:
                    w.write_table(pa.Table.from_batches(held))
                    held, size = [], 0
            if held:
                w.write_table(pa.Table.from_batches(held))
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], ["rows"])

    df.mapInArrow(tidy(write), "rows long").collect()
    table = spark.read.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path)
    table._perron_path = path
    return table


def discard(spark: SparkSession, *items: DataFrame | str | None) -> None:
    """Delete tables made by ``written`` (or folders) that no later read needs."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for item in items:
        path = item if isinstance(item, str) else getattr(item, "_perron_path", None)
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def make_dirs(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def storage(uri: str):
    """(pyarrow file system, path) for a URI or an absolute path; works on executors."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class atomic_output:
    """A binary file that appears under its final name only when it is complete.

    A retried or speculative task writes the same bytes under another temporary name, so a lost executor leaves
    at most a stale temporary file in the operator's own folder.
    """

    def __init__(self, uri: str):
        self.fs, self.path = storage(uri)
        c = TaskContext.get()
        self.tmp = f"{self.path}.{c.taskAttemptId() if c else os.getpid()}-{uuid.uuid4().hex[:8]}.tmp"

    def __enter__(self):
        self.stream = self.fs.open_output_stream(self.tmp)
        return self.stream

    def __exit__(self, kind, *_):
        self.stream.close()
        if kind is None:
            self.fs.move(self.tmp, self.path)
        else:
            self.fs.delete_file(self.tmp)


def bound_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Cut Arrow batches by bytes where the session has the default: 10 000 rows of whole texts may be far too many."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name) == "67108864b":
        spark.conf.set(name, most)


def tidy(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task for mapInArrow that gives freed memory back to the system at its end: Python workers wait for their next task
    beside the JVM, and allocators would keep what they held at their peak."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return run


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def task_slots(spark: SparkSession) -> int:
    return max(1, spark.sparkContext.defaultParallelism)
