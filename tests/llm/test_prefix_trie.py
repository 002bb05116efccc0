"""The trie of conversation prefixes against one built turn by turn."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspar.llm import prefix_trie
from quillspar.llm.common import Scratch

SCHEMA = "conv_id long, turn long, role string, text string, digest int, depth int"


def plain(rows, rebuilt=True):
    """conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 of all nodes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns, key=lambda x: x[:3])] for c, turns in own.items()}
    told = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        told[c] = own.get(c - c % 100, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(told):
        for d in range(len(told[c]) + 1):
            members[tuple(told[c][:d])].append(c)
    below = defaultdict(list)
    for node in members:
        if node:
            below[node[:-1]].append(node)

    def sums(node):
        inner = [sums(child) for child in below[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        return sum(x for x, _ in inner) or 1, saved + sum(x for _, x in inner)

    out = set()
    for node, convs in members.items():
        ended = ",".join(str(c) for c in convs if len(told[c]) == len(node))
        leaves, saved = sums(node)
        out.add((convs[0], len(node), members[node[:-1]][0] if node else None, len(convs), len(below[node]), leaves, saved, hashlib.sha256(ended.encode()).hexdigest()))
    return out


def made(spark, rows, rebuilt=True):
    turns = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA).repartition(3)
    got = prefix_trie.prefix_trie(Scratch(spark, "t"), turns, rebuilt).drop("node").collect()
    assert len({tuple(r) for r in got}) == len(got)
    return {tuple(r) for r in got}


def few_texts(seed, convs, longest):
    rnd = random.Random(seed)
    rows = []
    for c in convs:
        for turn in range(rnd.randint(0, longest)):
            rows.append((c, turn, rnd.choice(["user", "assistant"]), rnd.choice(["a", "bé", "😀c", ""])))
    return rows


@pytest.mark.parametrize("rebuilt", [True, False])
@pytest.mark.parametrize("seed", [1, 2])
def test_few_texts(spark, seed, rebuilt):
    rows = few_texts(seed, [*range(95, 130), *range(199, 260), 1003, 70_000], 9)
    assert made(spark, rows, rebuilt) == plain(rows, rebuilt)


def test_defined_rows(spark):
    rows = [
        (100, None, None, None), (100, 0, "user", "x"), (100, 0, "assistant", "x"), (100, 1, "user", None),
        (101, 5, "user", "x"), (101, 5, "user", "x"), (101, None, "user", "y"),
        (102, 1, "us", "erx"), (103, 1, "user", "x"), (None, 1, "user", "x"), (-5, 1, "user", "z"), (-100, 0, "user", "q"),
    ]
    rows += [(c, 0, "user", "same") for c in range(300, 400)]
    assert made(spark, rows) == plain(rows)
    assert made(spark, rows, False) == plain(rows, False)
    assert made(spark, []) == set()


def test_copies_and_long_conversations(spark):
    """Half of all conversations are copies, one has 3,000 turns; each node and each digest of its ends is exact."""
    rows = [(c, t, "user", f"t{t}") for c in range(5000, 9000, 2) for t in range(2)] + [(7, t, "user", f"t{t}") for t in range(3000)]
    rows += [(8, t, "user", f"t{t}" if t < 1500 else "other") for t in range(1600)]
    got = made(spark, rows, False)
    copies = ",".join(map(str, range(5000, 9000, 2))).encode()
    by_depth = {(r[1], r[0]): r for r in got}
    assert len(got) == 3001 + 100
    assert by_depth[2, 7] == (7, 2, 7, 2002, 1, 2, sum(len(f"t{t}") for t in range(2, 1500)) + 2 * 2001, hashlib.sha256(copies).hexdigest())
    assert by_depth[1500, 7][4:6] == (2, 2) and by_depth[1501, 8][2] == 7


def test_blocks_of_ends(spark, monkeypatch):
    """The digest of a node's ends does not depend on how its numbers are cut into blocks."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 3)
    paths = spark.range(0, 1000, 7).select(F.col("id").alias("conv_id"), F.lit(1).alias("depth"), F.lit(b"n").alias("digest"), F.lit(True).alias("last")).repartition(5)
    paths = paths.union(spark.range(1).select(F.lit(-3).cast("long"), F.lit(0), F.lit(b"r"), F.lit(True)))
    got = {r.depth: r.ends_sha256 for r in prefix_trie.ends(paths).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(0, 1000, 7))).encode()).hexdigest(), 0: hashlib.sha256(b"-3").hexdigest()}


def test_query(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {tuple(r) for r in prefix_trie.op11_prefix_trie(spark, small).collect()}
    assert got == plain(rows)
