"""Connected components over edge tables, in rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.llm.common import Scratch


def components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for all nodes with an edge.

    Alternates a large-star and a small-star step: each turns the edges of a
    node towards its smallest neighbour, which keeps the components and makes
    every component a star after a logarithmic number of rounds; edges that are
    stars already take none. Edges with a null end are left out. Rounds are
    written to the shared folder, so the plan stays short and a lost executor
    costs no earlier round. No node's edges meet in one group: minima are
    combined before the shuffle and joined back.
    """
    def turned(pairs: DataFrame) -> DataFrame:
        return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def stars(pairs: DataFrame) -> bool:
        """Whether every node has at most one smaller neighbour, and none if it has larger ones."""
        ends = pairs.select(F.col("a").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(pairs.select("b", F.lit(0), F.lit(1)))
        return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0").isEmpty()

    now = scratch.keep(turned(edges), f"{name}-0")
    turn = 0
    while not stars(now):
        turn += 1
        # Large star: every larger neighbour is linked to the smallest of the neighbourhood.
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # Small star: every smaller neighbour and the node itself are linked to the smallest.
        small_least = large.where("a <> b").groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small_least.select("a", F.col("m").alias("b")))
        now = scratch.keep(turned(small), f"{name}-{turn}")
        scratch.drop(f"{name}-{turn - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
