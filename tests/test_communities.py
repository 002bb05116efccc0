"""Communities against a plain sequential search of modularity."""

import random
from collections import defaultdict

import pytest

from quillspar.operators import communities


def plain_modularity(edges, label):
    w = defaultdict(float)
    for a, b, x in edges:
        if a != b:
            w[a, b] += x
            w[b, a] += x
    m, total, inner = sum(w.values()), defaultdict(float), 0.0
    for (a, b), x in w.items():
        total[label[a]] += x
        inner += x * (label[a] == label[b])
    return inner / m - sum((t / m) ** 2 for t in total.values())


def plain_louvain(edges, seed=0):
    """The textbook search: one node after another, then the graph of communities."""
    links = defaultdict(lambda: defaultdict(float))
    for a, b, x in edges:
        if a != b:
            links[a][b] += x
            links[b][a] += x
    m = sum(x for around in links.values() for x in around.values())
    found = {n: n for n in links}
    loops = defaultdict(float)
    rnd = random.Random(seed)
    while True:
        label = {n: n for n in links}
        degree = {n: sum(links[n].values()) + loops[n] for n in links}
        total, moved, any_moved = dict(degree), True, False
        while moved:
            moved = False
            order = sorted(links)
            rnd.shuffle(order)
            for n in order:
                near = defaultdict(float)
                for other, x in links[n].items():
                    near[label[other]] += x
                total[label[n]] -= degree[n]
                gain = lambda c: near[c] - degree[n] * total.get(c, 0) / m
                best = max(sorted({*near, label[n]}), key=lambda c: (gain(c), c == label[n]))
                if gain(best) > gain(label[n]) + 1e-12:
                    label[n], moved, any_moved = best, True, True
                total[label[n]] = total.get(label[n], 0) + degree[n]
        if not any_moved:
            return found
        found = {n: label[c] for n, c in found.items()}
        merged, inner = defaultdict(lambda: defaultdict(float)), defaultdict(float)
        for n, x in loops.items():
            inner[label[n]] += x
        for a, around in links.items():
            merged[label[a]]
            for b, x in around.items():
                if label[a] == label[b]:
                    inner[label[a]] += x
                else:
                    merged[label[a]][label[b]] += x
        links, loops = merged, inner


def planted(seed, groups, size, inside, between):
    rnd = random.Random(seed)
    n = groups * size
    edges = [(a, b, rnd.choice([1.0, 2.5])) for a in range(n) for b in range(a + 1, n) if rnd.random() < (inside if a // size == b // size else between)]
    rnd.shuffle(edges)
    return edges


def ring_of_cliques(cliques, size):
    edges = [(c * size + a, c * size + b, 1.0) for c in range(cliques) for a in range(size) for b in range(a)]
    return edges + [(c * size, (c + 1) % cliques * size + 1, 1.0) for c in range(cliques)]


@pytest.mark.parametrize("edges", [planted(2, 5, 40, 0.2, 0.04), ring_of_cliques(24, 5)], ids=["blurred", "ring"])
def test_modularity_is_that_of_a_sequential_search(spark, edges):
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    labels = communities.louvain(frame).cache()
    label = {r.node: r.community for r in labels.collect()}
    wanted = max(plain_modularity(edges, plain_louvain(edges, seed)) for seed in range(3))
    got = plain_modularity(edges, label)
    assert got >= 0.98 * wanted
    assert abs(communities.modularity(frame, labels) - got) < 1e-6
    assert all(min(n for n, c in label.items() if c == community) == community for community in set(label.values()))


def test_result_does_not_depend_on_partitions(spark):
    edges = planted(3, 4, 20, 0.3, 0.03)
    frame = spark.createDataFrame(edges, "src long, dst long, weight double")
    turned = spark.createDataFrame([(b, a, x) for a, b, x in reversed(edges)], "src long, dst long, weight double")
    first, second = (sorted(map(tuple, communities.louvain(f, passes=1, levels=1, rounds=6).collect())) for f in (frame.repartition(7), turned.repartition(2)))
    assert first == second


def test_edges_without_links_and_names(spark):
    assert communities.louvain(spark.createDataFrame([("a", "a")], "src string, dst string")).count() == 0
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "b"), ("x", "y"), ("y", "z"), ("x", "z"), ("q", "q")], "src string, dst string")
    labels = communities.louvain(pairs)
    assert {tuple(r) for r in labels.collect()} == {("a", "a"), ("b", "a"), ("x", "x"), ("y", "x"), ("z", "x")}
    assert {(r.community, r.members, r.links, r.density) for r in communities.cohesion(pairs, labels).collect()} == {("a", 2, 1, 1.0), ("x", 3, 3, 1.0)}
    nodes = spark.createDataFrame([("a",), ("q",), ("w",)], "node string")
    assert {r.node for r in communities.gaps(nodes, pairs).collect()} == {"q", "w"}


@pytest.mark.parametrize("unit", [1, 10**9])
def test_round_of_blocks_equals_a_plain_round(spark, monkeypatch, unit):
    """Links are no rows of a round: a block gets one row a node. Products beyond 64 bits are exact."""
    monkeypatch.setattr(communities, "EACH", 100)
    rnd = random.Random(unit)
    once = {(a, b): rnd.randrange(1, 4) * unit for a in range(40) for b in range(a) if rnd.random() < 0.4}
    links = defaultdict(dict)
    for (a, b), w in once.items():
        links[a][b] = links[b][a] = w
    label, inner = {n: rnd.choice([n, n % 7, n % 7]) for n in [*range(40), 90, 91]}, {n: rnd.randrange(3) * unit for n in [*range(40), 90, 91]}
    k = {n: sum(links[n].values()) + inner[n] for n in label}
    m, total, size = sum(k.values()), defaultdict(int), defaultdict(int)
    for n, c in label.items():
        total[c] += k[n]
        size[c] += 1
    steps = communities.Steps(spark, "t")
    frame = spark.createDataFrame([(a, b, w) for a in links for b, w in links[a].items()], "src long, dst long, w long")
    nodes = spark.createDataFrame([(n, k[n], inner[n]) for n in k], "node long, k long, inner long")
    parts = communities._blocks(steps, frame, nodes)
    assert parts[0].count() > 3 and parts[1].count() < frame.count() and parts[1].where("own").count() == len(label)
    after, _ = communities._round(steps, parts, nodes, spark.createDataFrame(list(label.items()), "node long, community long"), m, 3)
    active = {r.node for r in nodes.where(f"pmod(xxhash64(node, 3), {communities.HALVES}) = 0").collect()}
    wanted = set()
    for n, c in label.items():
        near = defaultdict(int)
        for other, w in links[n].items():
            near[label[other]] += w
        gains = [(m * w - k[n] * total[t], -t) for t, w in near.items() if t != c and not (size[c] == size[t] == 1 and t > c)]
        goes = n in active and gains and max(gains)[0] > m * near[c] - k[n] * (total[c] - k[n])
        wanted.add((n, -max(gains)[1] if goes else c, near[c] + inner[n]))
    assert {tuple(r) for r in after.collect()} == wanted and any(c != label[n] for n, c, _ in wanted)


def test_one_block_takes_all_rounds_as_many_blocks_do(spark, monkeypatch):
    """A graph of one block is searched by one task; no round of many blocks moves their links."""
    frame = spark.createDataFrame(planted(5, 3, 12, 0.5, 0.05), "src long, dst long, weight double")
    rounds, plans, plain = [], [], communities._round
    monkeypatch.setattr(communities, "_round", lambda *a: rounds.append(a) or plain(*a))
    whole = sorted(map(tuple, communities.louvain(frame, 1, 1, 5).collect()))
    assert not rounds
    keep = communities.Steps.keep
    monkeypatch.setattr(communities.Steps, "keep", lambda self, f: plans.append(f._jdf.queryExecution().executedPlan().toString()) or keep(self, f))
    monkeypatch.setattr(communities, "EACH", 60)
    assert sorted(map(tuple, communities.louvain(frame, 1, 1, 5).collect())) == whole and len(rounds) >= 3
    cogroup = next(p for p in plans if "FlatMapCoGroupsInArrow" in p)
    assert "InMemoryTableScan" in cogroup[: cogroup.index("InMemoryRelation")] and "Exchange" not in cogroup[cogroup.index("FlatMapCoGroupsInArrow") : cogroup.index("InMemoryTableScan")]
