"""Shared folder, scratch tables and batch helpers of the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session on one machine names none (tests) a folder of its own is
    made and set as the checkpoint folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found and not context.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not found:
        found = tempfile.mkdtemp(prefix="quillspar-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor loses nothing."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/scratch-{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        """Writes ``frame`` and reads it back: a cut lineage in durable storage."""
        path = f"{self.root}/{name}"
        self.names.add(name)
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
            self.names.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*(self.names - set(names)))


def rows_with(frame: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, so that extra ones cannot clash with those made here."""
    return frame.select(*columns)


def small_batches(batches: Iterator[pa.RecordBatch], column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Splits batches so that ``column`` holds at most ``limit`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
        start, total = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if row > start and total + size > limit:
                yield batch.slice(start, row - start)
                start, total = row, 0
            total += size
        yield batch.slice(start)


def runs(batches: Iterator[pa.RecordBatch], key: str = "k") -> Iterator[tuple[pa.RecordBatch, list[int]]]:
    """Whole groups of consecutive rows with equal ``key``: a batch and the groups' bounds in it."""
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        keys = np.asarray(batch.column(key))
        cuts = (np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()
        if cuts:
            yield batch.slice(0, cuts[-1]), [0, *cuts]
            batch = batch.slice(cuts[-1])
        held = batch
    if held is not None:
        yield held, [0, held.num_rows]


def fixed_width(column: pa.Array, kind: str) -> np.ndarray:
    """The values of a binary column of equally long values as rows of a matrix."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
