"""Commits that stop after each of their steps."""

import pytest

from quillspar.streaming import journal

OLD, NEW = {"a": [1, 2], "b": [10]}, {"a": [3], "b": [20, 21]}


def frames(spark, rows):
    return {name: spark.createDataFrame([(v,) for v in values], "v long") for name, values in rows.items()}


def held(store):
    return {name: sorted(r.v for r in store.read(name).collect()) for name in ("a", "b")}


@pytest.mark.parametrize("step", journal.STEPS)
def test_a_stopped_commit_is_carried_on_or_discarded(spark, tmp_path, step):
    root = str(tmp_path / "s")
    store = journal.Store(spark, root)
    store.commit(frames(spark, OLD))
    with pytest.raises(journal.Stopped):
        journal.Store(spark, root, after=journal.stop_after(step)).commit(frames(spark, NEW))
    before = held(store)
    assert before == (NEW if step in ("pointer", "cleared") else OLD)
    if step not in ("staged", "cleared"):  # a failure while staging gives the lock back
        with pytest.raises(journal.Locked):
            store.commit(frames(spark, OLD))
        with pytest.raises(journal.Locked):
            store.recover()
    ended = store.recover(force=True)
    after = held(store)
    assert (ended, after) == {
        "locked": ("clean", OLD), "staged": ("clean", OLD), "journal": ("completed", NEW), "pointer": ("completed", NEW), "cleared": ("clean", NEW)
    }[step]
    assert store.recover() == "clean" and held(store) == after
    # The store goes on, and old generations go.
    for turn in range(3):
        assert store.commit({"a": spark.createDataFrame([(turn,)], "v long")}) == store.pointer()["generation"]
    assert held(store) == {"a": [2], "b": after["b"]}
    assert not {n for n in store.files.names() if n.startswith("_")} - {"_current"}
    assert sum(n.startswith("generation-") for n in store.files.names()) <= 3


def test_a_process_that_dies_while_staging(spark, tmp_path):
    """Nothing is caught: the lock and half of the files stay."""
    store = journal.Store(spark, str(tmp_path / "s"))
    store.commit(frames(spark, OLD))
    store._lock()
    spark.range(3).write.parquet(f"{store.files.root}/generation-2/a")
    assert store.recover(force=True) == "discarded" and held(store) == OLD
    assert store.commit(frames(spark, NEW)) == 2 and held(store) == NEW


def test_damaged_files_are_not_committed(spark, tmp_path):
    store = journal.Store(spark, str(tmp_path / "s"))
    store.commit(frames(spark, OLD))
    with pytest.raises(journal.Stopped):
        journal.Store(spark, store.files.root, after=journal.stop_after("journal")).commit(frames(spark, NEW))
    spark.createDataFrame([(4,)], "v long").write.mode("overwrite").parquet(f"{store.files.root}/generation-2/a")
    with pytest.raises(journal.Damaged):
        store.recover(force=True)
    assert held(store) == OLD and store.files.exists("_journal")


def test_a_failing_table_changes_nothing(spark, tmp_path):
    store = journal.Store(spark, str(tmp_path / "s"))
    store.commit(frames(spark, OLD))
    bad = spark.range(3).selectExpr("CAST(raise_error('no') AS long) AS v")
    with pytest.raises(Exception):
        store.commit({"a": frames(spark, NEW)["a"], "b": bad})
    assert held(store) == OLD and store.recover() == "clean"


def test_an_expired_lock_needs_no_force(spark, tmp_path):
    store = journal.Store(spark, str(tmp_path / "s"), lease_seconds=-1)
    store.commit(frames(spark, OLD))
    store._lock()
    assert store.recover() == "clean" and store.read("none") is None
