"""The folder stream against a plain pass over the same folder."""

import os

from quillspar.sources import watcher


def plain_pass(seen, folder, limit=10):
    """What one pass reports and the listing it leaves."""
    present = {str(f): f"{f.stat().st_size}:{f.stat().st_mtime_ns}" for f in folder.iterdir() if f.suffix in watcher.SUFFIXES}
    rows = [(p, "withdrawn") for p in sorted(seen) if p not in present]
    seen = {p: s for p, s in seen.items() if p in present}
    done = 0
    for path in sorted(present):
        if seen.get(path) != present[path] and done < limit:
            rows.append((path, "changed" if path in seen else "added"))
            seen[path], done = present[path], done + 1
    return rows, seen


def test_passes_restarts_and_withdrawals(spark, tmp_path):
    folder, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "c"
    folder.mkdir()

    def run():
        """One start of the query, which ends when nothing is left; the rows it added."""
        before = spark.read.parquet(str(out)).count() if out.exists() else 0
        stream = watcher.contents(watcher.watch(spark, str(folder)))
        stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(processingTime="200 milliseconds").start(str(out)).processAllAvailable()
        for active in spark.streams.active:
            active.stop()
        rows = spark.read.parquet(str(out))
        return before, sorted((r.path, r.change, bytes(r.content) if r.content is not None else None) for r in rows.collect())

    for k in range(23):
        (folder / f"{k:02}.md").write_text(f"text {k}")
    (folder / "skip.bin").write_text("x")
    wanted, seen = [], {}
    for _ in range(3):
        rows, seen = plain_pass(seen, folder)
        wanted += rows
    assert len(wanted) == 23
    _, got = run()
    assert [(p, c) for p, c, _ in got] == sorted(wanted) and {b for _, _, b in got} == {f"text {k}".encode() for k in range(23)}

    # Between two starts: one file changes, two go, one comes.
    (folder / "03.md").write_text("changed")
    os.utime(folder / "03.md", ns=(1, 1))
    (folder / "05.md").unlink()
    (folder / "07.md").unlink()
    (folder / "new.txt").write_text("text 1")
    rows, seen = plain_pass(seen, folder)
    assert {c for _, c in rows} == {"withdrawn", "changed", "added"}
    before, got = run()
    assert before == 23 and [(p, c) for p, c, _ in got] == sorted(wanted + rows)
    assert run() == (27, got)


def test_a_repeated_batch_is_the_same(tmp_path):
    """Replays come from the two offsets alone, whatever the folder holds by then."""
    start = {"a": "1:5", "b": "2:5"}
    end = watcher.advance(start, {"b": "2:6", "c": "3:5", "d": "4:5"}, 2)
    assert end == {"b": "2:6", "c": "3:5"}
    assert watcher.difference(start, end) == [("a", None, None, "withdrawn"), ("b", 2, 6, "changed"), ("c", 3, 5, "added")]
    reader = watcher._Reader({"path": str(tmp_path / "none")})
    assert reader.read({})[1] == {} and list(reader.readBetweenOffsets(start, end)) == watcher.difference(start, end)


def test_documents_after_a_pass(spark):
    seen = spark.createDataFrame([("a", "s1", b"1"), ("b", "s2", b"2"), ("c", "s1", b"1")], "path string, source_id string, content binary")
    changes = spark.createDataFrame(
        [("a", None, None, "withdrawn", None, None), ("b", 1, 1, "changed", b"3", "s3"), ("d", 1, 1, "added", b"4", "s4"), ("e", 1, 1, "added", None, None)],
        watcher.SCHEMA + ", content binary, source_id string",
    )
    after = watcher.documents_after(seen, changes)
    assert {(r.path, r.source_id) for r in after.collect()} == {("b", "s3"), ("c", "s1"), ("d", "s4")}
