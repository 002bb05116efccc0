"""Results that are kept for as long as the files they were made of stay the same.

The signature of some tables is taken from the listing of their files (path, size,
time), which Spark makes without reading them. A result is written under the
signature it was made at and is read from there until a file changes. Where files
change while it is made it is made once more; if they change again there is no
result but ``StaleSnapshot``, as there is for a reader who asks for an older one.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.shared import shared_dir
from quillspar.sources.tables import table
from quillspar.streaming.journal import Files


class StaleSnapshot(RuntimeError):
    """The sources are changing, or the snapshot that was asked for is not the present one."""


@dataclass
class Snapshot:
    id: str
    frame: DataFrame


def signature(spark: SparkSession, paths: list[str]) -> str:
    """Changes with any file below the paths: its name, size or time, or whether it is there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("path", "length", "modificationTime")
    row = files.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")), F.lit(0)).alias("sum"))
    return row.select(F.substring(F.sha2(F.concat_ws(":", "n", "sum"), 256), 1, 20)).first()[0]


class Snapshots:
    """The snapshots of one result: ``load`` makes it of what lies below ``paths``. ``keep`` of them stay, the newest ones."""

    def __init__(self, spark: SparkSession, root: str, paths: list[str], load: Callable[[SparkSession], DataFrame], keep: int = 2) -> None:
        self.spark, self.paths, self.load, self.keep, self.files = spark, paths, load, keep, Files(spark, root)

    def current(self, wanted: str | None = None) -> Snapshot:
        """The present snapshot; StaleSnapshot if it is not the ``wanted`` one."""
        now = signature(self.spark, self.paths)
        for _ in range(2):
            if wanted and wanted != now:
                raise StaleSnapshot("the snapshot has been renewed; run the analysis again")
            if self.files.exists(f"{now}/_SUCCESS"):
                break
            made = f"making-{uuid.uuid4().hex}"
            self.load(self.spark).write.parquet(f"{self.files.root}/{made}")
            after = signature(self.spark, self.paths)
            if after == now:
                # Another session may have made the same one meanwhile.
                if self.files.exists(now) or not self.files.system.rename(self.files.path(made), self.files.path(now)):
                    self.files.delete(made)
                self._clear(now)
                break
            self.files.delete(made)
            now = after
        else:
            raise StaleSnapshot("the sources are changing; try again later")
        return Snapshot(now, self.spark.read.parquet(f"{self.files.root}/{now}"))

    def _clear(self, now: str) -> None:
        found = [(e.getModificationTime(), e.getPath().getName()) for e in self.files.system.listStatus(self.files.path("")) if not e.getPath().getName().startswith("making-")]
        for _, name in sorted(found, reverse=True)[self.keep :]:
            if name != now:
                self.files.delete(name)


@query("s08_snapshot", "SELECT lang, source, count(*) AS documents, sum(n_chars)::BIGINT AS signs FROM documents GROUP BY lang, source")
def s08_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and signs by language and source, asked for twice: the second answer is read, not made, and pinned to the first."""
    made = lambda s: table(s, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("signs"))
    snapshots = Snapshots(spark, f"{shared_dir(spark)}/snapshots-{uuid.uuid4().hex}", [f"{sf_dir}/documents.parquet"], made)
    return snapshots.current(snapshots.current().id).frame
