"""Snapshots of files that change before, while and after they are read."""

import pytest

from quillspar.streaming.snapshots import Snapshots, StaleSnapshot


def test_protocol(spark, tmp_path):
    source = str(tmp_path / "t")
    rows = lambda n, how="append": spark.range(n).coalesce(1).write.mode(how).parquet(source)
    rows(3)
    made = []

    def load(session):
        made.append(1)
        frame = session.read.parquet(source).groupBy().count()
        while changes:
            changes.pop()()
            break
        return frame

    changes = []
    snapshots = Snapshots(spark, str(tmp_path / "s"), [source], load)
    value = lambda s: s.frame.first()[0]
    first = snapshots.current()
    assert value(first) == 3 and value(snapshots.current(first.id)) == 3 and len(made) == 1
    # Another reader of the same folder finds it; a change makes a new one and the old one cannot be asked for.
    assert value(Snapshots(spark, str(tmp_path / "s"), [source], load).current()) == 3 and len(made) == 1
    rows(2)
    with pytest.raises(StaleSnapshot):
        snapshots.current(first.id)
    second = snapshots.current()
    assert value(second) == 5 and second.id != first.id and len(made) == 2
    # A change while it is made: once more. Two changes: none.
    rows(1)
    changes.append(lambda: rows(4))
    third = snapshots.current()
    assert value(third) == 10 and len(made) == 4
    rows(1)
    changes += [lambda: rows(1), lambda: rows(1)]
    with pytest.raises(StaleSnapshot):
        snapshots.current()
    assert value(snapshots.current()) == 13
    assert len([n for n in snapshots.files.names() if not n.startswith(".")]) == 2 and value(third) == 10
