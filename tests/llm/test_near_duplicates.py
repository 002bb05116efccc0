"""The LSH forest against all pairs, and connected components."""

import random
import re

import numpy as np
import pytest

from quillspar.llm import lsh_forest
from quillspar.llm.common import Scratch
from quillspar.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def plain_components(rows):
    sets = {i: plain_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    rows, n = [], 0
    for group, copies in ((200, 60), (40, 25), (7, 4), (300, 3)):
        base = rng.choices(words, k=group)
        for _ in range(copies):
            text = list(base)
            for _ in range(rng.randrange(0, max(1, group // 40) + 1)):
                text[rng.randrange(group)] = rng.choice(words)
            rows.append((n, " ".join(text)))
            n += 1
        rows += [(n, " ".join(base)), (n + 1, " ".join(base).upper())]
        n += 2
    rows += [(n + k, " ".join(rng.choices(words, k=50))) for k in range(60)]
    return rows + [(9001, None), (9002, ""), (9003, " \t\n"), (9004, "One two"), (9005, "one  TWO"), (9006, "é É"), (9007, "x" * 100_000)]


def test_against_all_pairs(spark, monkeypatch):
    rows = corpus()
    wanted = plain_components(rows)
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, digest string").repartition(3)
    for region, tile in ((2048, 1000), (8, 10)):  # small ones force longer prefixes, salting and several tiles
        monkeypatch.setattr(lsh_forest, "REGION", region)
        monkeypatch.setattr(lsh_forest, "TILE_CLASSES", tile)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(Scratch(spark, "t"), docs).collect()}
        assert {i for i in wanted if wanted[i] != got[i]} == set()


def test_nulls_repeats_and_empty_tables(spark):
    text = "a b c d e f g h"
    rows = [(None, text), (5, text), (5, text), (5, "other words are here now"), (7, "other words are here now")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, lsh_forest.near_duplicates(Scratch(spark, "t"), docs).collect()), key=str)
    assert got == sorted([(None, 4, None, True), (5, 4, 5, True), (5, 4, 5, True), (5, 1, 5, True), (7, 1, 5, False)], key=str)
    assert lsh_forest.near_duplicates(Scratch(spark, "t"), docs.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(1, k) for k in range(2, 40)] + [(300, 301), (301, 300), (5, 5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(Scratch(spark, "t"), frame, "c").collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, **{k: 1 for k in range(1, 40)}, 300: 300, 301: 300}


@pytest.mark.parametrize("share", [0.6, 0.75, 0.9])
def test_signatures_estimate_similarity(share):
    rng = np.random.default_rng(3)
    off = 0.0
    for _ in range(30):
        both = rng.integers(0, 2**63, 1000, dtype=np.uint64)
        cut = int(1000 * (1 - share) / 2)
        off += (lsh_forest.minima(both[: 1000 - cut]) == lsh_forest.minima(both[cut:])).mean() - (1000 - 2 * cut) / 1000
    assert abs(off / 30) < 0.03


def test_thousands_of_variants_of_one_text(spark, monkeypatch):
    """Every region holds more classes than REGION; its cuts must not part them."""
    monkeypatch.setattr(lsh_forest, "REGION", 64)
    monkeypatch.setattr(lsh_forest, "PART", 8, raising=False)
    rng = random.Random(7)
    base = [f"w{k}" for k in range(400)]
    rows = [(n, " ".join(base[:k] + [f"v{n}"] + base[k + 1 :])) for n, k in enumerate(rng.choices(range(400), k=2000))]
    # Farther copies (similarity 0.77 to the base) that few longer prefixes share with the rest.
    rows += [(5000 + n, " ".join(f"far{n}" if k % 40 == n % 40 else w for k, w in enumerate(base))) for n in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(Scratch(spark, "t"), docs).collect()}
    assert set(got.values()) == {0}


def test_cut_regions_keep_all_agreeing_pairs(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "REGION", 16)
    rng = np.random.default_rng(5)
    # One region: equal first minima, and 60 pairs that agree in 0.7 of the places and with nothing else.
    signatures = rng.integers(0, 2**32, (120, lsh_forest.HASHES), dtype=np.uint32)
    signatures[1::2, :90] = signatures[::2, :90]
    cut = spark.createDataFrame([(1, n, 1 / 8) for n in range(120)], "k long, doc_id long, w double")
    none = spark.createDataFrame([(n, 1) for n in range(1, 40, 2)], "node long, component long")
    tiles = {}
    for r in lsh_forest.across(Scratch(spark, "t"), "cut", cut, none).collect():
        tiles.setdefault(r.k, []).append(r.doc_id)
    found = set()
    for docs in tiles.values():
        found |= {tuple(sorted((docs[a], docs[b]))) for a, b in lsh_forest.spanning(signatures[docs])}
    assert found == {(n, n + 1) for n in range(0, 120, 2)}
    assert max(map(len, tiles.values())) < 40


def test_long_runs_are_cut_at_short_prefixes_and_overlap(monkeypatch):
    rest = np.sort(np.repeat(np.arange(9, dtype=np.int64) << 48, [5, 300, 2, 90, 120, 7, 60, 600, 1]))
    bounds = lsh_forest.cuts(rest)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(rest)
    assert all(low == high - 1 for (_, high), (low, _) in zip(bounds, bounds[1:]))
    assert all(high - low <= lsh_forest.PART + 1 for low, high in bounds)
    changes = set((np.flatnonzero(np.diff(rest)) + 1).tolist())
    assert any(high in changes for _, high in bounds[:-1])


def test_4500_texts_that_differ_in_the_last_word(spark):
    """Default constants: one component, though regions are cut."""
    base = " ".join(f"w{k}" for k in range(600))
    docs = spark.createDataFrame([(n, f"{base} last{n}") for n in range(4500)], "doc_id long, text string").repartition(8)
    got = lsh_forest.near_duplicates(Scratch(spark, "t"), docs).groupBy("component_id").count().collect()
    assert [tuple(r) for r in got] == [(0, 4500)]


@pytest.mark.parametrize("region", [8, 1024])
def test_one_to_five_changed_words_equal_the_exact_join(spark, monkeypatch, region):
    monkeypatch.setattr(lsh_forest, "REGION", region)
    monkeypatch.setattr(lsh_forest, "PART", 8)
    monkeypatch.setattr(lsh_forest, "BLOCK", 16)
    monkeypatch.setattr(lsh_forest, "TILE_CLASSES", 20)
    rng, rows = random.Random(11), []
    for group in range(6):
        base = [f"g{group}w{k}" for k in range(60 + 30 * group)]
        for changed in range(6):
            for copy in range(12):
                text = list(base)
                for at in rng.sample(range(len(text)), changed):
                    text[at] = f"x{group}-{changed}-{copy}-{at}"
                rows.append((len(rows), " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in lsh_forest.near_duplicates(Scratch(spark, "t"), docs).collect()}
    assert got == plain_components(rows)
