"""Codes by Yinyang bounds against Lloyd's rounds with a full search."""

import hashlib

import numpy as np
import pytest

from quillspar.llm import yinyang
from quillspar.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, label int, code int, part int"


def plain(rows, parts=8, entries=16, rounds=6):
    """vec_id: (code, error, label_error), and the digest of the codebooks."""
    kept = [(i, np.array(v, float), label) for i, v, label in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all()]
    if not kept:
        return {}, None
    ints = np.array([np.floor(v * 4096) for _, v, _ in kept]).astype(np.int64).reshape(len(kept), parts, -1)
    books = ints[sorted(range(len(kept)), key=lambda k: kept[k][0])[:entries]].swapaxes(0, 1).copy()
    for turn in range(rounds + 1):
        apart = ((ints[:, :, None] - books[None]) ** 2).sum(-1)
        code = apart.argmin(-1)
        if turn < rounds:
            for p in range(parts):
                for k in range(books.shape[1]):
                    if (code[:, p] == k).any():
                        books[p, k] = ints[code[:, p] == k, p].sum(0) // (code[:, p] == k).sum()
    errors = apart.min(-1).sum(1)
    by_label = {}
    for (_, _, label), error in zip(kept, errors.tolist()):
        by_label[label] = by_label.get(label, 0) + error
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return {i: ("".join(f"{c:02x}" for c in each), error, by_label[label]) for (i, _, label), each, error in zip(kept, code.tolist(), errors.tolist())}, digest


def made(spark, rows, **options):
    scratch = Scratch(spark, "t")
    frame = spark.createDataFrame([(i, v, label, 1, 2) for i, v, label in rows], SCHEMA).repartition(3)
    got = yinyang.with_label_error(scratch, yinyang.codes(scratch, frame, **options)[0]).collect()
    return {r.vec_id: (r.code, r.error, r.label_error) for r in got}, {r.codebooks_sha256 for r in got}, len(got)


def random_rows(seed, n, width, grid=None):
    rng = np.random.default_rng(seed)
    values = rng.normal(size=(n, width)) if grid is None else rng.integers(-1, 2, (n, width)) * grid
    return [(int(i), v.astype(np.float32).tolist(), int(i) % 3 or None) for i, v in zip(rng.permutation(n * 3)[:n], values)]


@pytest.mark.parametrize("rows", [random_rows(1, 900, 64), random_rows(2, 500, 16, 1 / 4096), random_rows(3, 9, 8)], ids=["normal", "ties", "few"])
def test_codes_equal_a_full_search(spark, rows):
    wanted, digest = plain(rows)
    got, digests, n = made(spark, rows)
    assert got == wanted and digests == {digest} and n == len(wanted)


def test_other_sizes(spark):
    rows = random_rows(4, 700, 24)
    wanted, digest = plain(rows, parts=3, entries=40, rounds=4)
    got, digests, _ = made(spark, rows, parts=3, entries=40, rounds=4, groups=7)
    assert got == wanted and digests == {digest}


def test_defined_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(5000, None, 1), (5001, [0.5] * 7 + [None], 1), (5002, [0.5] * 7 + [nan], 1), (5003, [-inf] + [0.5] * 7, None), (5004, None, None)]
    rows = random_rows(5, 60, 8, 0.25) + bad + [(6000 + k, [0.25] * 8, None) for k in range(300)]
    wanted, digest = plain(rows)
    assert made(spark, rows) == (wanted, {digest}, 360)
    assert made(spark, bad) == ({}, set(), 0)
    assert made(spark, []) == ({}, set(), 0)
    with pytest.raises(ValueError):
        made(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)])
    with pytest.raises(Exception, match="components"):
        made(spark, [(1, [9000.0] * 8, 1)])


def test_bounds_hold_and_save_work():
    """After every move no bound exceeds a distance that it stands for, ties go to the lower index, and groups are skipped."""
    rng = np.random.default_rng(6)
    for grid in (1, 400):
        rows = rng.integers(-3, 4, (3000, 6)) * grid
        entries = rows[:32].copy()
        group = yinyang._groups(entries, 6)
        n_groups = int(group.max()) + 1
        code, lower = yinyang.search(rows, entries, group, n_groups)
        work = 0
        for _ in range(6):
            means = np.array([rows[code == k].sum(0) // (code == k).sum() if (code == k).any() else entries[k] for k in range(32)])
            moved = np.sqrt(((means - entries) ** 2).sum(1))
            entries = means
            code, lower, measured = yinyang.again(rows, entries, group, moved, code, lower)
            work += measured
            squares = ((rows[:, None] - entries[None]) ** 2).sum(-1)
            assert (code == squares.argmin(1)).all()
            distance = np.sqrt(squares)
            distance[np.arange(len(rows)), code] = np.inf
            for g in range(n_groups):
                if (group == g).any():
                    assert (lower[:, g] <= distance[:, group == g].min(1)).all()
        assert work < 0.7 * 6 * 32 * len(rows)


def test_many_labels_are_joined_by_shuffling(spark, monkeypatch):
    monkeypatch.setattr(yinyang, "LABELS", 1)
    rows = random_rows(7, 100, 8)
    assert made(spark, rows)[0] == plain(rows)[0]


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    wanted, digest = plain(rows)
    got = yinyang.op12_yinyang_codes(spark, small).collect()
    assert {r.vec_id: (r.code, r.error, r.label_error) for r in got} == wanted and {r.codebooks_sha256 for r in got} == {digest}
