"""A folder as a stream of changes: files that are new, have changed or are gone.

The offset of the stream is the listing it has reported (path, size and time of
each file), kept in the query's checkpoint, so a restart goes on where it was and a
repeated batch is the difference of the same two listings. A pass reports up to
``limit`` new or changed files, in the order of their names, and all that are gone.
Rows hold no contents; ``contents`` has executors read them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, size long, modified long, change string"
#: The kinds of files that are watched.
SUFFIXES = (".pdf", ".docx", ".pptx", ".xlsx", ".txt", ".md", ".html", ".htm")
LIMIT = 10


def listing(folder: str, suffixes: tuple[str, ...]) -> dict[str, str]:
    """The state ("size:nanoseconds") of every file below a folder of a local or remote file system, by path."""
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    entries = system.get_file_info(fs.FileSelector(root, recursive=False, allow_not_found=True))
    return {e.path: f"{e.size}:{e.mtime_ns}" for e in entries if e.type == fs.FileType.File and e.path.lower().endswith(suffixes) and not e.base_name.startswith(("_", "."))}


def difference(before: dict[str, str], after: dict[str, str]) -> list[tuple]:
    """Rows of SCHEMA that lead from one listing to the other."""
    rows = [(path, None, None, "withdrawn") for path in sorted(before.keys() - after.keys())]
    for path in sorted(path for path, state in after.items() if before.get(path) != state):
        size, modified = map(int, after[path].split(":"))
        rows.append((path, size, modified, "changed" if path in before else "added"))
    return rows


def advance(before: dict[str, str], now: dict[str, str], limit: int) -> dict[str, str]:
    """The listing after a pass: without the files that are gone, with the next ``limit`` that are new or changed."""
    kept = {path: state for path, state in before.items() if path in now}
    due = sorted(path for path, state in now.items() if kept.get(path) != state)[:limit]
    return kept | {path: now[path] for path in due}


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder, self.limit = options["path"], int(options.get("limit", LIMIT))
        self.suffixes = tuple(options.get("suffixes", ",".join(SUFFIXES)).split(","))

    def initialOffset(self) -> dict:
        return {}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = advance(start, listing(self.folder, self.suffixes), self.limit)
        return iter(difference(start, end)), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return iter(difference(start, end))


class FolderChanges(DataSource):
    """Format ``folder_changes``; options path, limit and suffixes (separated by commas)."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:
        return _Reader(self.options)


def watch(spark: SparkSession, folder: str, limit: int = LIMIT, suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """The stream of a folder's changes."""
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").option("limit", str(limit)).option("suffixes", ",".join(suffixes)).load(folder)


def contents(changes: DataFrame) -> DataFrame:
    """Changes with ``content`` and ``source_id`` (digest of the bytes). Executors read the files one by one; one that has gone meanwhile, or is withdrawn, has neither."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                body = None
                if row["change"] != "withdrawn":
                    system, path = fs.FileSystem.from_uri(row["path"]) if "://" in row["path"] else (fs.LocalFileSystem(), row["path"])
                    try:
                        with system.open_input_stream(path) as stream:
                            body = stream.read()
                    except FileNotFoundError:
                        pass
                row |= {"content": body, "source_id": hashlib.sha256(body).hexdigest() if body is not None else None}
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([value], kind) for value, kind in zip(row.values(), kinds)], names=[*row])

    return changes.mapInArrow(run, f"{SCHEMA}, content binary, source_id string")


def documents_after(seen: DataFrame, changes: DataFrame) -> DataFrame:
    """(path, source_id, content) of a folder's files after a pass; ``seen`` is the table of those before.

    A source is withdrawn when no file holds its content any more: it is in ``seen`` and not in the result.
    """
    held = changes.where("change <> 'withdrawn' AND source_id IS NOT NULL").select("path", "source_id", "content")
    return seen.join(changes.select("path"), "path", "left_anti").unionByName(held)
