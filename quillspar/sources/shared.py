"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only a session on one machine that names none gets a folder made."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = context._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if context.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="quillspar-")
        context.setCheckpointDir(found)
    return found.rstrip("/")


def dealt(frame: DataFrame, rows: int, *keys: str, each: int = 1_000_000) -> DataFrame:
    """``frame`` dealt by ``keys`` to so many tasks that one gets about ``each`` of its ``rows``, and to no fewer than a shuffle has.

    What a task holds in memory then stays the same however large the tables are.
    """
    return frame.repartition(max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // each)), *keys)


class Steps:
    """Tables of a loop's steps. Unlike a checkpoint a written table tells the planner its true size, in however late a round."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.kept = spark, f"{shared_dir(spark)}/steps-{name}-{uuid.uuid4().hex}", 0

    def keep(self, frame: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.kept}"
        self.kept += 1
        frame.write.parquet(path)
        out = self.spark.read.schema(frame.schema).parquet(path)
        out._kept_at = path
        return out

    def drop(self, *frames: DataFrame | None) -> None:
        """Deletes tables that ``keep`` has returned and no later step reads."""
        jvm = self.spark._jvm
        for frame in frames:
            if frame is not None:
                path = jvm.org.apache.hadoop.fs.Path(frame._kept_at)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
