"""Paths through graphs: shortest ones with their nodes, and all short ones over approved edges up to a limit.

Searches run level by level; the frontier is joined with the edges, what has been
visited is left out by an anti join, and each level is written. A node keeps the
smallest of the equally short ways to it, so results do not depend on row order.
Pairs whose ends lie in different components are never followed: their searches
would reach all of both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.operators.graph import _EDGES, _part_links, part_edges, undirected
from quillspar.registry import query
from quillspar.sources.shared import Steps
from quillspar.sources.tables import table


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``links`` (src, dst, in both directions, without loops); a component is named after one of its nodes.

    In a round every node follows its smallest smaller neighbour down to a node that has none, by pointer jumping; these nodes and
    what still links them are the graph of the next round, which has a fraction of the nodes.
    """
    steps = Steps(links.sparkSession, "components")
    found = None
    while True:
        up = steps.keep(links.groupBy("src").agg(F.min("dst").alias("to")).select(F.col("src").alias("node"), F.least("src", "to").alias("root")))
        while True:
            further = up.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = steps.keep(up.join(further, "root").select("node", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")))
            moved, up = not jumped.where("moved").isEmpty(), jumped.drop("moved")
            if not moved:
                break
        if found is None:
            found = up.select("node", F.col("root").alias("component"))
        else:
            found = steps.keep(found.join(up.select(F.col("node").alias("component"), "root"), "component", "left").select("node", F.coalesce("root", "component").alias("component")))
        a, b = (up.select(F.col("node").alias(end), F.col("root").alias(name)) for end, name in (("src", "a"), ("dst", "b")))
        once = links.where("src < dst").join(a, "src").select("dst", "a").distinct().join(b, "dst").where("a <> b")
        once = steps.keep(once.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct())
        if once.isEmpty():
            return found
        links = once.union(once.select("dst", "src"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = 5, directed: bool = False, rows: int = 0) -> DataFrame:
    """(start, end, found, hops, path) of every distinct pair (start, end): the shortest path of at most ``depth`` edges, the smallest of equals.

    Both ends are searched from, one level of one side at a time, until the sides of a pair meet; a pair that has met
    or cannot meet any more is not followed further, and of the last level only the links that close a path are followed. A start that is
    its own end has a path of no edges. Ways are kept as arrays of at most ``depth`` + 1 nodes. ``rows`` of ``edges``, which may
    repeat, decide how many tasks share them, if stated.
    """
    steps = Steps(edges.sparkSession, "paths")
    both = steps.keep(undirected(edges.where("src <> dst"), rows))
    out = steps.keep(edges.select("src", "dst").where("src <> dst").distinct()) if directed else both
    into = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = steps.keep(pairs.select("start", "end").where("start IS NOT NULL AND end IS NOT NULL").distinct())
    part = components(both)
    ends = [part.select(F.col("node").alias(end), F.col("component").alias(f"{end}_part")) for end in ("start", "end")]
    near = pairs.join(ends[0], "start").join(ends[1], "end").where("start_part = end_part").select("start", "end")
    alive = steps.keep(near.union(pairs.where("start = end")).distinct().withColumn("pair", F.monotonically_increasing_id()))
    way = lambda side: alive.select("pair", F.col(side).alias("node"), F.array(side).alias("way"))
    seen = {"start": steps.keep(way("start")), "end": steps.keep(way("end"))}
    frontier = dict(seen)
    met = steps.keep(_meeting(seen))
    for level in range(depth):
        side = "start" if level % 2 == 0 else "end"
        links, other = (out, "end") if side == "start" else (into, "start")
        going = frontier[side].join(met.select("pair"), "pair", "left_anti")
        if level == depth - 1:
            met = steps.keep(met.unionByName(_closing(links, side, going, seen[other].join(met.select("pair"), "pair", "left_anti"))))
            break
        longer = F.concat("way", F.array("dst")) if side == "start" else F.concat(F.array("dst"), "way")
        reached = links.join(going.withColumnRenamed("node", "src"), "src").select("pair", F.col("dst").alias("node"), longer.alias("way"))
        fresh = reached.join(seen[side].select("pair", "node"), ["pair", "node"], "left_anti").groupBy("pair", "node").agg(F.min("way").alias("way"))
        before, frontier[side] = seen[side], steps.keep(fresh)
        if frontier[side].isEmpty():
            break  # none of the pairs that are left can meet
        met = steps.keep(met.unionByName(_meeting({side: frontier[side], other: seen[other]})))
        # Pairs that have met are not looked for again.
        seen[side] = steps.keep(before.unionByName(frontier[side]).join(met.select("pair"), "pair", "left_anti"))
        steps.drop(before)
    path = F.col("path")
    met = alive.join(met, "pair").select("start", "end", "path")
    return pairs.join(met, ["start", "end"], "left").select("start", "end", path.isNotNull().alias("found"), (F.size(path) - 1).alias("hops"), "path").withColumn(
        "hops", F.when(F.col("found"), F.col("hops"))
    )


def _meeting(sides: dict[str, DataFrame]) -> DataFrame:
    """(pair, path): the smallest of the ways of both sides that end in one node, joined."""
    back = sides["end"].select("pair", "node", F.col("way").alias("rest"))
    ways = sides["start"].join(back, ["pair", "node"]).select("pair", F.concat("way", F.slice("rest", F.lit(2), F.size("rest"))).alias("path"))
    return ways.groupBy("pair").agg(F.min("path").alias("path"))


def _closing(links: DataFrame, side: str, going: DataFrame, held: DataFrame) -> DataFrame:
    """(pair, path): the smallest path of each pair over a link from a way in ``going`` to one of the other side in ``held``.

    A link carries the numbers of the pairs that come to its one end, and keeps those that the other end is known to. So what is
    shuffled is a row a link, not one a pair and link, and only links that close a path meet the ways.
    """
    numbers = lambda rows, end, name: rows.groupBy(F.col("node").alias(end)).agg(F.collect_list("pair").alias(name))
    both = links.join(numbers(going, "src", "come"), "src").join(numbers(held, "dst", "known"), "dst")
    closed = both.select("src", "dst", F.explode(F.array_intersect("come", "known")).alias("pair"))
    ends = closed.join(going.select("pair", F.col("node").alias("src"), "way"), ["pair", "src"]).join(held.select("pair", F.col("node").alias("dst"), F.col("way").alias("rest")), ["pair", "dst"])
    path = F.concat("way", "rest") if side == "start" else F.concat("rest", "way")
    return ends.groupBy("pair").agg(F.min(path).alias("path"))


def approved_paths(edges: DataFrame, centre: DataFrame, hops: int = 1, limit: int = 100) -> DataFrame:
    """(n, edges, nodes): up to ``limit`` paths of 1 to ``hops`` edges from the nodes ``centre``, over approved edges in either direction.

    ``edges`` has edge, src, dst and status. A path uses an edge once, as graph patterns do. Shorter paths come first,
    equal ones in the order of their edges; a level is cut at what is left of the limit, and as longer paths are only
    sought where all shorter ones were within it, no level is larger than the limit times the edges of a node.
    """
    steps = Steps(edges.sparkSession, "approved")
    live = edges.where("status = 'approved'").select("edge", "src", "dst")
    links = steps.keep(live.union(live.where("src <> dst").select("edge", F.col("dst").alias("src"), F.col("src").alias("dst"))))
    none = F.expr("CAST(array() AS array<%s>)" % dict(live.dtypes)["edge"])
    now = steps.keep(centre.select("node").distinct().select(none.alias("edges"), F.array("node").alias("nodes"), F.col("node").alias("src")))
    found, left = now.select("edges", "nodes").limit(0), limit
    for _ in range(hops):
        longer = now.join(links, "src").where(~F.array_contains("edges", F.col("edge")))
        longer = longer.select(F.concat("edges", F.array("edge")).alias("edges"), F.concat("nodes", F.array("dst")).alias("nodes"), F.col("dst").alias("src"))
        now = steps.keep(longer.orderBy("edges", "nodes").limit(left))
        found, left = found.unionByName(now.select("edges", "nodes")), left - now.count()
        if not left:
            break
    return found.select(F.size("edges").alias("n"), "edges", "nodes")


def subgraph(paths: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and the edges of some paths, each once."""
    nodes = paths.select(F.explode("nodes").alias("node")).distinct()
    return nodes, edges.join(paths.select(F.explode("edges").alias("edge")).distinct(), "edge", "left_semi")


@query(
    "k14_path_nodes",
    f"""WITH RECURSIVE {_EDGES}, p AS (SELECT p_partkey AS s, p_partkey // 2 AS t FROM part WHERE p_partkey % 100 = 0),
         back AS (SELECT s, t, t AS node, 0 AS hops FROM p UNION SELECT s, t, e.src, hops + 1 FROM back JOIN e ON e.dst = node WHERE hops < 5),
         least AS (SELECT s, t, node, min(hops) AS hops FROM back GROUP BY s, t, node),
         walk AS (SELECT s, t, s AS node, hops AS rest, s::VARCHAR AS path FROM least WHERE node = s
           UNION ALL SELECT s, t, node, rest, path FROM (SELECT w.s, w.t, l.node, l.hops AS rest, w.path || '>' || l.node AS path, row_number() OVER (PARTITION BY w.s, w.t ORDER BY l.node) AS r
             FROM walk w JOIN e ON e.src = w.node JOIN least l ON l.s = w.s AND l.t = w.t AND l.node = e.dst AND l.hops = w.rest - 1) WHERE r = 1)
        SELECT p.s AS start, p.t AS "end", path IS NOT NULL AS found, len(string_split(path, '>'))::INT - 1 AS hops, path FROM p LEFT JOIN (SELECT * FROM walk WHERE rest = 0) w ON w.s = p.s AND w.t = p.t""",
)
def k14_path_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortest undirected paths from every hundredth part to the part of half its number."""
    pairs = table(spark, sf_dir, "part").where("p_partkey % 100 = 0").select(F.col("p_partkey").alias("start"), F.floor(F.col("p_partkey") / 2).alias("end"))
    links, rows = _part_links(spark, sf_dir)
    return shortest_paths(links, pairs, rows=rows).withColumn("path", F.array_join(F.transform("path", lambda n: n.cast("string")), ">"))


@query(
    "k13_approved_paths",
    f"""WITH {_EDGES}, a AS (SELECT src * 1000000 + dst AS edge, src, dst FROM e0 WHERE (src + dst) % 3 <> 0), l AS (SELECT edge, src, dst FROM a UNION SELECT edge, dst, src FROM a),
         one AS (SELECT edge AS e1, dst AS n1 FROM l WHERE src = 20), two AS (SELECT e1, n1, edge AS e2, dst AS n2 FROM one JOIN l ON l.src = n1 AND edge <> e1)
        SELECT n, edges, nodes FROM (SELECT 1 AS n, [e1] AS k, e1::VARCHAR AS edges, '20>' || n1 AS nodes FROM one
          UNION ALL SELECT 2, [e1, e2], e1 || '>' || e2, '20>' || n1 || '>' || n2 FROM two) ORDER BY n, k LIMIT 100""",
)
def k13_approved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred paths of up to two approved edges around one part."""
    status = F.when((F.col("src") + F.col("dst")) % 3 != 0, "approved").otherwise("pending")
    edges = part_edges(spark, sf_dir).select((F.col("src") * 1_000_000 + F.col("dst")).alias("edge"), "src", "dst", status.alias("status"))
    joined = lambda name: F.array_join(F.transform(name, lambda x: x.cast("string")), ">").alias(name)
    centre = spark.range(20, 21).select(F.col("id").alias("node"))
    return approved_paths(edges, centre, 2, 100).select("n", joined("edges"), joined("nodes"))
