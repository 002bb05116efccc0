"""Block-max search against full scoring, and path searches against plain ones."""

import itertools
import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from quillspar.operators import paths, postings, retrieval


def test_block_max_search_finds_the_same(spark, tmp_path):
    rnd = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    shares = [1 / (k + 1) for k in range(400)]
    texts = [" ".join(rnd.choices(words, shares, k=rnd.choice([3, 8, 20, 60, 150]))) for _ in range(6000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(9001, None), (9002, ""), (9003, texts[0]), (9004, texts[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    index = postings.build(docs, str(tmp_path / "i"))
    question = [f"w{k}" for k in range(3, 240, 10)]
    assert len(question) == postings.MAX_TERMS
    wanted = retrieval.search(docs, question).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(20)
    assert postings.search(index, question, 20).collect() == wanted.collect()
    # One term, an unknown one, fewer matches than asked for, no match at all.
    for asked, k in ((["w399"], 7), (["w1", "none"], 5), ([texts[0].split()[0]], 10_000), (["none"], 3)):
        full = retrieval.search(docs, asked).select("doc_id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
        assert postings.search(index, asked, k).collect() == full.collect()


def test_search_of_many_terms_reads_under_half_of_the_blocks(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    index = postings.build(docs, str(tmp_path / "i"))
    question = list(postings._QUESTION)
    assert len(set(question)) == postings.MAX_TERMS
    read, all_rows = postings.survivors(index, question, 20)
    assert 0 < read.count() < 0.5 * all_rows.count()
    # The folders of the terms alone are opened.
    plan = all_rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "folder" in plan.split("PartitionFilters")[1][:200]


def test_an_empty_index(spark, tmp_path):
    index = postings.build(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "i"))
    assert postings.search(index, ["a"], 3).collect() == []


def plain_path(links, start, end, depth):
    """The smallest of the shortest paths of at most ``depth`` edges."""
    to_end, queue = {end: 0}, deque([end])
    back = defaultdict(set)
    for a in links:
        for b in links[a]:
            back[b].add(a)
    while queue:
        node = queue.popleft()
        for other in back[node]:
            if other not in to_end:
                to_end[other] = to_end[node] + 1
                queue.append(other)
    if to_end.get(start, depth + 1) > depth:
        return None
    path = [start]
    while path[-1] != end:
        path.append(min(n for n in links[path[-1]] if to_end.get(n, -1) == to_end[path[-1]] - 1))
    return path


@pytest.mark.parametrize("directed, depth", [(False, 5), (True, 6), (False, 2), (True, 1)])
def test_shortest_paths_equal_a_plain_search(spark, directed, depth):
    rnd = random.Random(depth)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(80)] + [(0, 1), (0, 1), (2, 2)]
    links = defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            if not directed:
                links[b].add(a)
    pairs = [(rnd.randrange(62), rnd.randrange(62)) for _ in range(70)] + [(5, 5), (61, 61), (5, 5)]
    frame = spark.createDataFrame([*pairs, (None, 1), (1, None)], "start long, end long")
    got = paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), frame, depth, directed)
    rows = {(r.start, r.end): r for r in got.collect()}
    assert len(rows) == got.count() == len(set(pairs))
    for start, end in pairs:
        path, row = plain_path(links, start, end, depth), rows[start, end]
        assert (row.path, row.hops, row.found) == (path, len(path) - 1 if path else None, path is not None)


def test_approved_paths_equal_an_enumeration(spark):
    rnd = random.Random(3)
    edges = [(f"e{k:03}", f"n{rnd.randrange(12)}", f"n{rnd.randrange(12)}", rnd.choice(["approved", "approved", "pending", None])) for k in range(40)]
    live = [(e, a, b) for e, a, b, s in edges if s == "approved"]

    def steps(node):
        return [(e, b) for e, a, b in live if a == node] + [(e, a) for e, a, b in live if b == node and a != b]

    frame = spark.createDataFrame(edges, "edge string, src string, dst string, status string")
    centre = spark.createDataFrame([("n1",), ("n1",)], "node string")
    level, wanted = [([], ["n1"])], []
    for _ in range(3):
        level = sorted((used + [e], nodes + [n]) for used, nodes in level for e, n in steps(nodes[-1]) if e not in used)
        wanted += level
    for limit in (1, 7, len(wanted) - 3, len(wanted) + 50):
        found = paths.approved_paths(frame, centre, 3, limit)
        assert [(r.edges, r.nodes) for r in found.orderBy("n", "edges", "nodes").collect()] == [tuple(p) for p in wanted[:limit]]
    nodes, used = paths.subgraph(found, frame)
    assert {r.node for r in nodes.collect()} == {*itertools.chain(*(n for _, n in wanted))}
    assert {r.edge for r in used.collect()} == {*itertools.chain(*(e for e, _ in wanted))}
    assert paths.approved_paths(frame, spark.createDataFrame([("none",)], "node string"), 2, 5).count() == 0


def test_components_equal_a_plain_search(spark):
    rnd = random.Random(5)
    edges = [(k, k + 1) for k in range(60) if k % 20 != 19] + [(rnd.randrange(100, 160), rnd.randrange(160, 190)) for _ in range(70)] + [(200, 300), (250, 300), (250, 240)]
    name = {n: n for e in edges for n in e}
    for _ in name:
        for a, b in edges:
            name[a] = name[b] = min(name[a], name[b])
    links = spark.createDataFrame(edges + [(b, a) for a, b in edges], "src long, dst long").distinct()
    got = {r.node: r.component for r in paths.components(links).collect()}
    assert len(got) == len(name) and len(set(zip(name.values(), (got[n] for n in name)))) == len(set(name.values())) == len(set(got.values()))
    assert paths.components(links.limit(0)).count() == 0


def test_pairs_of_different_components_are_not_followed(spark, monkeypatch):
    kept = []

    class Counted(paths.Steps):
        def keep(self, frame):
            out = super().keep(frame)
            kept.append(out.count() if "way" in out.columns else 0)
            return out

    monkeypatch.setattr(paths, "Steps", Counted)
    edges = [(c + a, c + b) for c in (0, 100) for a in range(30) for b in range(a)]
    pairs = [(a, 100 + b) for a in range(10) for b in range(10)] + [(7, 7), (500, 500), (500, 1), (1, 2)]
    got = paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "start long, end long"))
    assert {(r.start, r.end, r.hops) for r in got.collect() if r.found} == {(7, 7, 0), (500, 500, 0), (1, 2, 1)} and got.count() == len(pairs)
    assert sum(kept) <= 200


def test_last_level_sends_links_instead_of_ways(spark, monkeypatch):
    """Hubs give each pair thousands of ways, of which only those that close a path are made at the last level."""
    rnd, made = random.Random(12), []
    plain = paths._meeting
    monkeypatch.setattr(paths, "_meeting", lambda sides: made.extend(f.count() for f in sides.values()) or plain(sides))
    edges = [(h, 100 + h * 10 + k) for h in range(6) for k in range(10)] + [(100 + h * 10 + k, 1000 + h * 400 + k * 40 + j) for h in range(6) for k in range(10) for j in range(40)] + [(rnd.randrange(1000, 3400), rnd.randrange(1000, 3400)) for _ in range(40)]
    edges += [(leaf, leaf * 10 + t) for leaf in range(1000, 3400) for t in range(3)]
    edges += [(100, 5000), (5000, 150), (1399, 5001), (5001, 5002), (5002, 5003), (5003, 3399)]
    links = {}
    for a, b in edges:
        links.setdefault(a, set()).add(b)
        links.setdefault(b, set()).add(a)
    pairs = [(a, b) for a in range(6) for b in range(6)]
    got = {(r.start, r.end): r for r in paths.shortest_paths(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame(pairs, "start long, end long"), 5).collect()}
    for a, b in pairs:
        path = plain_path(links, a, b, 5)
        assert (got[a, b].path, got[a, b].hops) == (path, len(path) - 1 if path else None)
    assert sum(r.hops == 5 for r in got.values()) > 0 and max(made) <= 36 * (1 + 12 + 420)
