"""Communities of weighted graphs by modularity, level by level.

Nodes move to the neighbouring community that gains most; communities then
become the nodes of a smaller graph, until nothing is gained. All nodes of a
round look at the same state, so only half of them, chosen by a hash of node and
round, may move in it: two neighbours that want each other's place do not swap
for ever. Weights are integers and gains are compared as exact decimals, ties go
to the smallest community, so the result does not depend on partitions or on the
order of rows.

Links are dealt by ranges of their nodes to blocks, once a level. A round sends
each block one row for every node that its links touch, and the block's task adds
its links up in arrays; links themselves are not rows of any round, nor moved in it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.operators.graph import _part_links
from quillspar.registry import query
from quillspar.sources.shared import Steps, dealt

#: Parts of one unit of weight, halves that take turns, and the least gain of modularity that a sweep or a level must bring.
UNIT, HALVES, LEAST = 1_000_000, 2, 1e-4
#: Links of a block, about.
EACH = 500_000


def _once(edges: DataFrame) -> DataFrame:
    """(src, dst, w), one row a pair of different nodes; weights of repeated edges are added up."""
    w = F.round(F.col("weight") * UNIT).cast("long") if "weight" in edges.columns else F.lit(UNIT).cast("long")
    once = edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy("a", "b").agg(F.sum("w").alias("w"))
    return once.where("w > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), "w")


def _both(once: DataFrame) -> DataFrame:
    return once.union(once.select("dst", "src", "w"))


def weighted(edges: DataFrame) -> DataFrame:
    """(src, dst, w) in both directions, one row a pair of different nodes; weights of repeated edges are added up."""
    return _both(_once(edges))


def modularity(edges: DataFrame, labels: DataFrame) -> float:
    """Modularity of (node, community) over an edge table; 0 for a graph without links."""
    links = weighted(edges)
    ends = links.join(labels.select(F.col("node").alias("src"), F.col("community").alias("a")), "src").join(labels.select(F.col("node").alias("dst"), F.col("community").alias("b")), "dst")
    sums = ends.groupBy("a").agg(F.sum("w").alias("total"), F.sum(F.when(F.col("a") == F.col("b"), F.col("w")).otherwise(0)).alias("inner"))
    row = sums.agg(F.sum("total").alias("m"), F.sum("inner").alias("inner"), F.sum(_wide("total") * _wide("total")).alias("squares")).first()
    return _modularity(row.inner, row.squares, row.m) if row.m else 0.0


def _wide(name: str) -> Column:
    return F.col(name).cast("decimal(19,0)")


def _modularity(inner: int, squares: Decimal, m: int) -> float:
    return inner / m - float(squares) / float(m) ** 2


def _divisor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The greatest common divisor of a task's weights."""
    found = [int(np.gcd.reduce(np.asarray(batch.column("w")))) for batch in batches if batch.num_rows]
    if found:
        yield pa.RecordBatch.from_arrays([pa.array([math.gcd(*found)], pa.int64())], names=["w"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of the links of a task: its nodes in order, which of them its links begin at, how many links those have, and the links' other ends and weights."""
    found = list(batches)
    if sum(batch.num_rows for batch in found):
        src, dst, w = (np.concatenate([np.asarray(batch.column(name)) for batch in found]) for name in ("src", "dst", "w"))
        del found
        order = np.argsort(src, kind="stable")
        own, links = np.unique(src, return_counts=True)
        nodes, place = np.unique(np.concatenate([own, dst[order]]), return_inverse=True)
        w = w[order].astype(np.min_scalar_type(int(w.max())))
        arrays = {"nodes": nodes.astype("<i8"), "own": place[: len(own)].astype("<i4"), "links": links.astype("<i4"), "place": place[len(own) :].astype("<i4"), "w": w}
        columns = [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in arrays.values())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", *arrays])


def _touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes whose state a block needs; it owns those that its links begin at."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes = np.frombuffer(row["nodes"], "<i8")
            own = np.zeros(len(nodes), bool)
            own[np.frombuffer(row["own"], "<i4")] = True
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.full(len(nodes), row["block"], np.int32)), pa.array(own)], names=["node", "block", "own"])


def _blocks(steps: Steps, links: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The links of each block as arrays, and (node, block, own, k, inner), where a node's state is needed.

    Blocks lie on the disks of the tasks that add them up, so no round moves them; a lost one is read again from the table that is kept.
    """
    n = -(-max(links.count(), nodes.count()) // EACH) or 1
    kept = steps.keep(links.select("src", "dst", "w").repartitionByRange(n, "src").mapInArrow(_pack, "block int, nodes binary, own binary, links binary, place binary, w binary"))
    touched = steps.keep(kept.mapInArrow(_touched, "node long, block int, own boolean"))
    blocks = kept
    if n > 1:
        blocks = kept.repartition(n, "block").persist(StorageLevel.DISK_ONLY)
        blocks._kept_at = kept._kept_at
        blocks.count()
    # Nodes without links to others stay; they are dealt to any block.
    rest = nodes.join(touched.where("own"), "node", "left_anti").select("node", F.pmod(F.hash("node"), F.lit(n)).cast("int").alias("block"), F.lit(True).alias("own"))
    weights = nodes.select("node", "k", "inner")
    return blocks, steps.keep(touched.union(rest).join(weights, "node"))


def _beside(block: dict, community: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, ...]:
    """The weight inside the community of each owner of a block, and (owner, community, weight) of the other communities beside active ones, in this order.

    ``community``, numbered from 0, and ``active`` are those of the block's nodes.
    """
    own, place, links = (np.frombuffer(block[name], "<i4") for name in ("own", "place", "links"))
    w = np.frombuffer(block["w"], f"<u{len(block['w']) // len(place)}")
    to, many = community[place], int(community.max()) + 1
    same = to == np.repeat(community[own], links)
    inside = np.add.reduceat(np.where(same, w, 0).astype(np.int64), np.append(0, np.cumsum(links[:-1])))
    going = np.repeat(active[own], links) & ~same
    key, w = (np.repeat(np.arange(len(links), dtype=np.int64) * many, links) + to)[going], w[going]
    if not len(key):
        return inside, key, key, key
    if w.min() == w.max():
        key, unit = np.sort(key), int(w[0])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        w = np.diff(np.append(first, len(key))) * unit
    else:
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        w = np.add.reduceat(w[order].astype(np.int64), first)
    owner = key[first] // many
    return inside, owner, key[first] - owner * many, w


def _step(m: int, block: dict | None, state: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where the own nodes of a block go, and the weight inside their present communities. ``state`` is in the order of its nodes."""
    mine = {name: column[state["own"]] for name, column in state.items()}
    names, of, community = np.unique(state["community"], return_index=True, return_inverse=True)
    total_of, size_of, w_own = state["total"][of], state["size"][of], np.zeros(len(mine["node"]), np.int64)
    row = to = w = np.empty(0, np.int64)
    if block:
        nodes = np.frombuffer(block["nodes"], "<i8")
        at = np.searchsorted(state["node"], nodes)
        owners = np.searchsorted(mine["node"], nodes[np.frombuffer(block["own"], "<i4")])
        w_own[owners], row, to, w = _beside(block, community[at], state["active"][at])
        row = owners[row]
    # Products that could leave 64 bits are made of Python's integers.
    wide = m * max(int(w.max(initial=1)), int(w_own.max(initial=1)), int(mine["k"].max(initial=1))) >= 1 << 62
    kind = object if wide else np.int64
    k, total, here = mine["k"].astype(kind), mine["total"].astype(kind), community[state["own"]]
    # Two single nodes join at the smaller one's.
    allowed = ~((mine["size"][row] == 1) & (size_of[to] == 1) & (to > here[row]))
    row, to, w = row[allowed], to[allowed], w[allowed]
    gain = w.astype(kind) * m - k[row] * total_of[to].astype(kind)
    if len(row):
        # The largest gain of each node; of equals the first, whose community is the smallest.
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        top = np.flatnonzero(gain == np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(row)))))
        top = top[np.append(True, row[top][1:] != row[top][:-1])]
        row, to, gain = row[top], to[top], gain[top]
    stays = w_own.astype(kind) * m - k * (total - k)
    goes = mine["active"][row] & (gain > stays[row]).astype(bool)
    after = mine["community"].copy()
    after[row[goes]] = names[to[goes]]
    return after, w_own + mine["inner"]


def _ordered(state: pa.Table) -> dict[str, np.ndarray]:
    order = np.argsort(state.column("node").to_numpy())
    return {name: state.column(name).to_numpy()[order] for name in state.column_names}


def _best(m: int):
    def run(links: pa.Table, state: pa.Table) -> pa.Table:
        """Where the nodes of a block go, and the weight inside their present community."""
        state = _ordered(state)
        after, inner = _step(m, next(iter(links.to_pylist()), None), state)
        return pa.table({"node": state["node"][state["own"]], "community": after, "inner": inner})

    return run


def _active(turn: int) -> Column:
    return F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(HALVES)) == 0


def _round(steps: Steps, parts: tuple[DataFrame, DataFrame], nodes: DataFrame, labels: DataFrame, m: int, turn: int) -> tuple[DataFrame, float]:
    """The labels after a round, and the modularity before it. ``nodes`` has node, k (its weight) and inner (what lies inside it)."""
    blocks, route = parts
    totals = steps.keep(labels.join(nodes, "node").groupBy("community").agg(F.sum("k").alias("total"), F.count("*").alias("size")))
    placed = labels.join(totals, "community").withColumn("active", _active(turn))
    state = placed.join(route, "node").select("block", "node", "own", "community", "k", "inner", "total", "size", "active")
    after = steps.keep(blocks.groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_best(m), "node long, community long, inner long"))
    squares = totals.agg(F.sum(_wide("total") * _wide("total")).alias("squares"))
    sums = after.agg(F.sum("inner").alias("inner")).crossJoin(squares).first()
    steps.drop(totals)
    return after, _modularity(sums.inner, sums.squares, m)


def _rounds(m: int, rounds: int):
    def run(links: pa.Table, state: pa.Table) -> pa.Table:
        """The best labels of some rounds over a graph of one block, as ``_moved`` finds them, and their modularity."""
        block, turns = next(iter(links.to_pylist()), None), state.column("turns").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, rounds)
        turns = turns[np.argsort(state.column("node").to_numpy())]
        state = _ordered(state.drop_columns(["turns"]))
        best, best_labels, sweep = -1.0, state["community"], -1.0
        for step in range(rounds):
            now = state["community"]
            _, group = np.unique(now, return_inverse=True)
            totals = np.zeros(int(group.max()) + 1, np.int64)
            np.add.at(totals, group, state["k"])
            after, inner = _step(m, block, state | {"total": totals[group], "size": np.bincount(group)[group], "active": turns[:, step]})
            before = _modularity(sum(inner.tolist()), Decimal(sum(t * t for t in totals.tolist())), m)
            if before > best:
                best, best_labels = before, now
            state["community"] = after
            if step % HALVES == 0:
                if step and before < sweep + LEAST:
                    break
                sweep = before
        return pa.table({"node": state["node"], "community": best_labels, "best": np.full(len(state["node"]), best)})

    return run


def _moved(steps: Steps, links: DataFrame, nodes: DataFrame, now: DataFrame, m: int, rounds: int, turn: int) -> tuple[DataFrame, float]:
    """The best labels of some rounds from ``now``, and their modularity."""
    best, best_labels, sweep, parts = -1.0, now, -1.0, _blocks(steps, links, nodes)
    if parts[1].select(F.max("block")).first()[0] == 0:
        # One block is one task's in every round, so it takes all of them at once.
        state = now.select("node", "community").join(parts[1], "node").withColumn("turns", F.array(*[_active(turn + step) for step in range(rounds)]))
        found = steps.keep(parts[0].groupBy("block").cogroup(state.groupBy("block")).applyInArrow(_rounds(m, rounds), "node long, community long, best double"))
        steps.drop(*parts)
        return found, found.first().best
    for step in range(rounds):
        after, before = _round(steps, parts, nodes, now.select("node", "community"), m, turn + step)
        if before > best:
            if best_labels is not now:
                steps.drop(best_labels)
            best, best_labels = before, now
        elif now is not best_labels:
            steps.drop(now)
        now = after
        # A sweep is over when every half has had its turn.
        if step % HALVES == 0:
            if step and before < sweep + LEAST:
                break
            sweep = before
    parts[0].unpersist()
    steps.drop(*parts)
    return best_labels, best


def _merged(steps: Steps, once: DataFrame, nodes: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph of the communities of a graph: its links, one row a pair, and its nodes."""
    a, b = (labels.select(F.col("node").alias(end), F.col("community").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    ends = once.join(a, "src").join(b, "dst")
    merged = steps.keep(ends.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.sum("w").alias("w")))
    sums = nodes.join(labels, "node").groupBy("community").agg(F.sum("k").alias("k"), F.sum("inner").alias("inner"))
    inside = merged.where("src = dst").select(F.col("src").alias("community"), (2 * F.col("w")).alias("more"))
    more = F.coalesce("more", F.lit(0).cast("long"))
    return merged.where("src <> dst"), steps.keep(sums.join(inside, "community", "left").select(F.col("community").alias("node"), "k", (F.col("inner") + more).alias("inner")))


def louvain(edges: DataFrame, passes: int = 3, levels: int = 10, rounds: int = 24) -> DataFrame:
    """(node, community) of all nodes with links; a community is named after its smallest node.

    ``edges`` has src, dst and, if it is there, weight; direction, loops and order do not matter. Each pass begins with
    single nodes that move between the communities of the pass before, and then merges communities level by level.
    """
    return _louvain(_once(edges), passes, levels, rounds)


def _louvain(once: DataFrame, passes: int, levels: int, rounds: int) -> DataFrame:
    steps = Steps(once.sparkSession, "louvain")
    once, names = steps.keep(once), None
    if dict(once.dtypes)["src"] != "bigint":
        # Numbers in the order of the nodes.
        names = steps.keep(_both(once).select(F.col("src").alias("name")).distinct().orderBy("name").withColumn("node", F.monotonically_increasing_id()))
        a, b = (names.select(F.col("name").alias(end), F.col("node").alias(f"{end}_node")) for end in ("src", "dst"))
        once = steps.keep(once.join(a, "src").join(b, "dst").select(F.col("src_node").alias("src"), F.col("dst_node").alias("dst"), "w"))
    # Gains compare as before when all weights are divided by the same number, and fit 64 bits.
    unit = math.gcd(*(row.w for row in once.select("w").distinct().mapInArrow(_divisor, "w long").distinct().collect())) or 1
    once = once.withColumn("w", F.expr(f"w div {unit}"))
    nodes = steps.keep(_both(once).groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("k"), F.lit(0).cast("long").alias("inner")))
    m = nodes.agg(F.sum("k")).first()[0]
    found = steps.keep(nodes.select("node", F.col("node").alias("community")))
    if not m:
        return (names.select(F.col("name").alias("node"), F.col("name").alias("community")) if names else found).limit(0)
    reached, turn = -1.0, 0
    for _ in range(passes):
        labels, best = _moved(steps, _both(once), nodes, found, m, rounds, turn)
        found, graph = steps.keep(labels.select("node", "community")), (once, nodes)
        for _ in range(levels):
            turn += rounds
            # The graph of this level's communities is made of the graph of the level before.
            graph = _merged(steps, *graph, labels.select("node", "community"))
            start = steps.keep(graph[1].select("node", F.col("node").alias("community")))
            labels, now = _moved(steps, _both(graph[0]), graph[1], start, m, rounds, turn)
            if now < best + LEAST:
                break
            best = now
            joined = labels.select(F.col("node").alias("_group"), F.col("community").alias("_to"))
            found = steps.keep(found.join(joined, found["community"] == joined["_group"]).select("node", F.col("_to").alias("community")))
        if best < reached + LEAST:
            break
        reached = best
    smallest = found.groupBy("community").agg(F.min("node").alias("name"))
    found = found.join(smallest, "community").select("node", F.col("name").alias("community"))
    if names is None:
        return found
    said = names.select(F.col("node").alias("community"), F.col("name").alias("_community"))
    return found.join(names, "node").join(said, "community").select(F.col("name").alias("node"), F.col("_community").alias("community"))


def cohesion(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(community, members, links, density): links between its nodes and their share of all pairs, 0 for a single node."""
    pairs = weighted(edges).where("src < dst")
    a, b = (labels.select(F.col("node").alias(end), F.col("community").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
    inside = pairs.join(a, "src").join(b, "dst").where("a = b").groupBy(F.col("a").alias("community")).agg(F.count("*").alias("links"))
    sizes = labels.groupBy("community").agg(F.count("*").alias("members"))
    links, n = F.coalesce("links", F.lit(0).cast("long")), F.col("members")
    density = F.when(n > 1, 2 * links / (n * (n - 1))).otherwise(0.0)
    return sizes.join(inside, "community", "left").select("community", "members", links.alias("links"), density.alias("density"))


def gaps(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes without any link to another."""
    return nodes.select("node").join(weighted(edges).select(F.col("src").alias("node")), "node", "left_anti")


@query("k18_communities")
def k18_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities of the graph of parts, by one pass; a link that exists in both directions weighs two."""
    pairs, rows = _part_links(spark, sf_dir)
    ends = pairs.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), (F.col("src") < F.col("dst")).alias("up"))
    once = dealt(ends, rows, "a", "b").groupBy("a", "b").agg(F.count_distinct("up").alias("w"))
    return _louvain(once.select(F.col("a").alias("src"), F.col("b").alias("dst"), "w"), 1, 10, 24)
