"""Tables that change together: generations, a journal and a pointer.

A commit writes every changed table into the folder of a new generation, seals it
(rows and a sum of their hashes, read back from the files), writes the journal and
only then replaces the pointer that readers follow. Whatever stops it, ``recover``
ends it: with a journal the commit is carried on, if the files still are what the
seals say, and without one what was staged is thrown away. Readers see the old
generation or the new one, never parts of both, and the generation before stays
for those who have begun to read it.

All files are reached through Spark's file systems; small texts are replaced by
writing them beside and renaming.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.registry import query
from quillspar.sources.shared import shared_dir
from quillspar.sources.tables import table

#: The steps of a commit, in order.
STEPS = ("locked", "staged", "journal", "pointer", "cleared")


class Locked(RuntimeError):
    """Another writer holds the store."""


class Damaged(RuntimeError):
    """Staged files are not what the journal says; the journal is kept."""


class Files:
    """Small texts and folders below a root, by the session's file systems."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.jvm, self.conf, self.root = spark._jvm, spark._jsc.hadoopConfiguration(), root.rstrip("/")
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def text(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self.system.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if it is there."""
        try:
            stream = self.system.create(self.path(name), False)
        except Exception as error:
            if "AlreadyExists" in str(error) or "already exists" in str(error):
                return False
            raise
        try:
            stream.write(bytearray(text.encode()))
            stream.hsync()
        finally:
            stream.close()
        return True

    def replace(self, name: str, text: str) -> None:
        beside = f"{name}.{uuid.uuid4().hex}"
        self.create(beside, text)
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.jvm.java.lang.reflect.Array.newInstance(kind.OVERWRITE.getClass(), 1)
        self.jvm.java.lang.reflect.Array.set(how, 0, kind.OVERWRITE)
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.path("").toUri(), self.conf).rename(self.qualified(beside), self.qualified(name), how)

    def qualified(self, name: str):
        return self.path(name).makeQualified(self.system.getUri(), self.system.getWorkingDirectory())

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def names(self) -> list[str]:
        return [entry.getPath().getName() for entry in self.system.listStatus(self.path(""))] if self.exists("") else []


class Store:
    """Named tables below a folder, committed together."""

    def __init__(self, spark: SparkSession, root: str, lease_seconds: int = 3600, after: Callable[[str], None] | None = None) -> None:
        self.spark, self.files, self.lease = spark, Files(spark, root), lease_seconds
        self.after = after or (lambda step: None)  # is told every step that is done

    def pointer(self) -> dict:
        """The number of the generation and the folder of every table."""
        return json.loads(self.files.text("_current") or '{"generation": 0, "tables": {}}')

    def read(self, name: str) -> DataFrame | None:
        """The table as of now; None before its first commit."""
        found = self.pointer()["tables"].get(name)
        return self.spark.read.parquet(f"{self.files.root}/{found}") if found else None

    def _lock(self) -> None:
        if not self.files.create("_lock", json.dumps({"until": time.time() + self.lease})):
            raise Locked(f"{self.files.root} is being written or was left by a writer; recover() it")

    def _seal(self, folder: str) -> list:
        frame = self.spark.read.parquet(f"{self.files.root}/{folder}")
        row = frame.agg(F.count("*"), F.sum(F.xxhash64(*frame.columns).cast("decimal(38,0)"))).first()
        return [row[0], str(row[1])]

    def commit(self, tables: dict[str, DataFrame]) -> int:
        """Replaces the named tables, all or none; the number of the new generation. Tables not named stay."""
        self._lock()
        self.after("locked")
        if self.files.exists("_journal"):
            self.files.delete("_lock")
            raise Damaged("an earlier commit is not done; recover() it first")
        now = self.pointer()
        number = now["generation"] + 1
        folders = {}
        try:
            for name, frame in tables.items():
                folders[name] = f"generation-{number}/{name}"
                frame.write.mode("overwrite").parquet(f"{self.files.root}/{folders[name]}")
            self.after("staged")
            journal = {"generation": number, "tables": {**now["tables"], **folders}, "seals": {folder: self._seal(folder) for folder in folders.values()}}
        except Exception:
            if not self.files.exists("_journal"):
                self.files.delete(f"generation-{number}")
                self.files.delete("_lock")
            raise
        self.files.replace("_journal", json.dumps(journal))
        self.after("journal")
        self._carry_on(journal)
        return number

    def _carry_on(self, journal: dict) -> None:
        self.files.replace("_current", json.dumps({k: journal[k] for k in ("generation", "tables")}))
        self.after("pointer")
        self.files.delete("_journal")
        self._clear()
        self.files.delete("_lock")
        self.after("cleared")

    def _clear(self) -> None:
        """Deletes generations that neither the pointer nor the one before it needs, and texts that were not renamed."""
        now = self.pointer()
        used = {folder.split("/")[0] for folder in now["tables"].values()} | {f"generation-{now['generation'] - 1}"}
        for name in self.files.names():
            if name.startswith("generation-") and name not in used or name.startswith(("_current.", "_journal.")):
                self.files.delete(name)

    def recover(self, force: bool = False) -> str:
        """Ends what a stopped writer has left: "completed", "discarded" or "clean". A lock that still runs needs ``force``."""
        lock = self.files.text("_lock")
        if lock is not None and not force and json.loads(lock or '{"until": 0}')["until"] > time.time():
            raise Locked(f"{self.files.root} may still be written")
        text = self.files.text("_journal")
        if text is not None:
            journal = json.loads(text)
            for folder, seal in journal["seals"].items():
                if not self.files.exists(folder) or self._seal(folder) != seal:
                    raise Damaged(f"{folder} is not what was staged")
            self._carry_on(journal)
            return "completed"
        staged = f"generation-{self.pointer()['generation'] + 1}"
        left = self.files.exists(staged)
        self.files.delete(staged)
        self._clear()
        self.files.delete("_lock")
        return "discarded" if left else "clean"


class Stopped(RuntimeError):
    """Raised by ``stop_after``."""


def stop_after(step: str) -> Callable[[str], None]:
    """For tests and drills: a writer that stops when ``step`` is done."""

    def told(done: str) -> None:
        if done == step:
            raise Stopped(step)

    return told


@query(
    "i03_journaled_commit",
    """SELECT o_custkey AS customer, count(*) AS orders, sum(o_orderkey)::BIGINT AS numbers, max(CASE WHEN c_acctbal < 0 THEN 'debt' ELSE c_mktsegment END) AS segment
       FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT' GROUP BY o_custkey""",
)
def i03_journaled_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables are committed, changed together by a writer that stops behind its journal, recovered and read."""
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    store = Store(spark, root)
    store.commit({"orders": orders, "customers": customers})
    fewer = store.read("orders").where("o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT'")
    debts = store.read("customers").withColumn("c_mktsegment", F.when(F.col("c_acctbal") < 0, "debt").otherwise(F.col("c_mktsegment")))
    try:
        Store(spark, root, after=stop_after("journal")).commit({"orders": fewer, "customers": debts})
    except Stopped:
        store.recover(force=True)
    sums = store.read("orders").groupBy(F.col("o_custkey").alias("customer")).agg(F.count("*").alias("orders"), F.sum("o_orderkey").alias("numbers"))
    return sums.join(store.read("customers").select(F.col("c_custkey").alias("customer"), F.col("c_mktsegment").alias("segment")), "customer")
