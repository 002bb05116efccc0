"""Interval joins by cells against all pairs, and how a frequent key is dealt."""

import random
from datetime import datetime, timedelta

import pytest

from quillspar.operators import joins

DAY = datetime(2024, 1, 1)


def plain(rows):
    low, high = datetime.min, datetime.max
    out = set()
    for i, k, s, e in rows:
        for j, m, t, f in rows:
            if k is not None and k == m and i < j and (s or low) < (e or high) and (t or low) < (f or high) and (s or low) < (f or high) and (t or low) < (e or high):
                out.add((i, j))
    return out


def pairs(spark, rows):
    frame = spark.createDataFrame([(i, k, s, e, "x") for i, k, s, e in rows], "id long, key string, s timestamp, e timestamp, _cell string").repartition(3)
    found = joins.interval_pairs(frame, ["key"], "id", "s", "e").selectExpr("first.id AS a", "second.id AS b")
    return found, [(r.a, r.b) for r in found.collect()]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_a_plain_join(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(260):
        start = DAY + timedelta(seconds=rnd.randrange(10**6)) if rnd.random() > 0.07 else None
        length = rnd.choice([0, 1, 1, 60, 3600, 86_400, 10**6, 10**8, -5])
        end = (start or DAY) + timedelta(seconds=length) if rnd.random() > 0.07 else None
        rows.append((i, rnd.choice(["a", "a", "b", None]), start, end))
    rows += [(1000 + k, "c", DAY, DAY + timedelta(days=1)) for k in range(12)] + [(2000, "c", DAY + timedelta(days=1), DAY + timedelta(days=2)), (2001, "c", None, None)]
    _, got = pairs(spark, rows)
    assert len(got) == len(set(got)) and set(got) == plain(rows)


def test_no_rows(spark):
    assert pairs(spark, [])[1] == [] and pairs(spark, [(1, "a", DAY, None)])[1] == []


def test_a_frequent_key_is_dealt_by_time(spark):
    """One key holds half of all rows; no cell of the join holds more than a few times the mean."""
    rnd = random.Random(3)
    rows = [(i, "hot" if i % 2 else f"k{i}", DAY + timedelta(seconds=60 * i), DAY + timedelta(seconds=60 * i + rnd.randrange(30, 400))) for i in range(4000)]
    found, got = pairs(spark, rows)
    assert len(got) == len(plain([r for r in rows if r[1] == "hot"]))
    cut = found._jdf.queryExecution().analyzed().toString()
    assert "_cell" in cut
    frame = spark.createDataFrame(rows, "id long, key string, s timestamp, e timestamp")
    cells = {}
    for i, k, s, e in rows:
        level = max(0, (int((e - s).total_seconds() * 10**6) - 1).bit_length())
        micros = int((s - datetime(1970, 1, 1)).total_seconds() * 10**6)
        for cell in {micros >> level, (micros + int((e - s).total_seconds() * 10**6) - 1) >> level}:
            cells[k, level, cell] = cells.get((k, level, cell), 0) + 1
    assert frame.count() == 4000 and max(cells.values()) <= 10
