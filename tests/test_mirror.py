"""Exports with planted faults, and history against a plain replay."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspar.streaming import mirror
from quillspar.streaming.journal import Store


def payload(i, title):
    return json.dumps({"id": i, "title": title, "url": f"https://x.org/{i}"}, sort_keys=True)


def export(spark, upstream, sent, gone, number, at):
    ids = lambda values: spark.createDataFrame([(i,) for i in values], "id long")
    rows = spark.createDataFrame([(i, payload(i, t)) for i, t in upstream.items()], "id long, payload string")
    return mirror.exported(rows, ids(sent), ids(gone), number, at)


STATES = [{1: "a", 2: "b", 3: "c"}, {1: "a", 2: "B", 4: "d"}, {1: "a", 2: "B", 3: "c", 4: "D"}, {2: "B"}, {2: "B"}]


def exports(spark):
    out, before = [], {}
    for number, state in enumerate(STATES, 1):
        out.append(export(spark, state, [i for i in state if before.get(i) != state[i]], [i for i in before if i not in state], number, f"2024-0{number}-01 00:00:00"))
        before = state
    return out


def plain_history():
    versions, held = [], {}
    for number, state in enumerate(STATES, 1):
        at = datetime(2024, number, 1)
        for i in list(held):
            if state.get(i) != held[i][0]:
                versions.append((i, payload(i, held[i][0]), held[i][1], at))
                del held[i]
        for i, title in state.items():
            held.setdefault(i, (title, at))
    return {*versions, *((i, payload(i, title), at, None) for i, (title, at) in held.items())}


def history(store):
    return {(r.id, r.payload, r.valid_from, r.valid_to) for r in store.read("history").collect()}


def test_stream_of_exports_equals_a_replay(spark, tmp_path):
    whole = exports(spark)
    for number, one in enumerate(whole):
        one.coalesce(1).write.json(str(tmp_path / "e"), mode="append")
        if number == 1:
            one.coalesce(1).write.json(str(tmp_path / "e"), mode="append")  # an export that comes again, in a file of its own
    files = sorted((tmp_path / "e").glob("*.json"), key=lambda f: f.stat().st_mtime_ns)
    assert len(files) == 6
    stream = spark.readStream.schema(mirror.EXPORT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "e"))
    query = mirror.mirror_stream(stream, str(tmp_path / "store"), str(tmp_path / "c")).start()
    query.awaitTermination(300)
    store = Store(spark, str(tmp_path / "store"))
    assert history(store) == plain_history()
    assert {(r.id, r.title) for r in store.read("articles").where("removed = 0").collect()} == {(2, "B")}
    log = [(r.export, r.total, r.inserted, r.changed, r.removed) for r in store.read("log").orderBy("export").collect()]
    assert log == [(1, 3, 3, 0, 0), (2, 3, 1, 1, 1), (3, 4, 0, 1, 0), (4, 1, 0, 0, 3), (5, 1, 0, 0, 0)]


FAULTS = {
    "record": ("CASE WHEN kind = 'record' THEN replace(body, '\"B\"', '\"X\"') ELSE body END", "body", "record checksum"),
    "record and hash": ("CASE WHEN kind = 'record' AND id = 2 THEN sha2('x', 256) ELSE hash END", "hash", "record checksum"),
    "manifest": ("CASE WHEN kind = 'manifest' AND id = 1 THEN sha2('x', 256) ELSE hash END", "hash", "manifest mismatch"),
    "total": ("CASE WHEN kind = 'head' THEN 9 ELSE n END", "n", "manifest mismatch"),
    "removed": ("CASE WHEN kind = 'removed' THEN 'ignored' ELSE kind END", "kind", "does not match upstream"),
    "missing record": ("CASE WHEN kind = 'record' AND id = 4 THEN 'ignored' ELSE kind END", "kind", "does not match upstream"),
}


def test_a_tampered_export_changes_nothing(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    first, second = (e.persist() for e in exports(spark)[:2])
    assert mirror.apply_verified(store, first)
    generation, before = store.pointer(), history(store)
    for value, column, message in FAULTS.values():
        with pytest.raises(mirror.Rejected, match=message):
            mirror.apply_verified(store, second.withColumn(column, F.expr(value)))
        assert store.pointer() == generation and history(store) == before
    with pytest.raises(mirror.Rejected, match="twice"):
        mirror.apply_verified(store, second.unionByName(second.where("kind = 'manifest' AND id = 1")))
    for broken in ('{"id": 7, "title": "", "url": "https://x.org/"}', '{"id": 7, "title": "t", "url": "javascript:x"}'):
        rows = spark.createDataFrame([(7, broken)], "id long, payload string")
        with pytest.raises(mirror.Rejected, match="invalid URL or title"):
            mirror.apply_verified(store, mirror.exported(rows, rows, rows.limit(0), 5, "2024-05-01"))
    assert store.pointer() == generation
    assert mirror.apply_verified(store, second) and not mirror.apply_verified(store, first)


def test_digest_does_not_depend_on_order(spark):
    rows = spark.range(5000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    one, two = (mirror.manifest_digest(r).first() for r in (rows.repartition(3), rows.orderBy(F.desc("id"))))
    assert one == two and one.n == 5000
    assert mirror.manifest_digest(rows.where("id <> 77")).first().digest != one.digest
    assert mirror.manifest_digest(rows.limit(0)).first().n == 0
