"""Fuzzy record linkage: titles compared in blocks, similarity ratios, greedy one-to-one assignment."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.operators.graph import checkpointed
from quillspar.registry import query
from quillspar.sources.tables import table


def indel_ratio(a: str, b: str) -> float:
    """100 * (1 - (insertions + deletions) / (both lengths)), from the longest common subsequence, by bit rows."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for place, sign in enumerate(a):
        masks[sign] = masks.get(sign, 0) | 1 << place
    full = (1 << len(a)) - 1
    row = full
    for sign in b:
        kept = row & masks.get(sign, 0)
        row = (row + kept | row - kept) & full
    shared = len(a) - bin(row).count("1")
    return 200.0 * shared / (len(a) + len(b))


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter text with a run of the longer that is as long, or that is cut by its ends."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    places = range(1 - len(short), len(long))
    return max(indel_ratio(short, long[max(0, k) : k + len(short)]) for k in places)


def title_ratio(a: str, b: str) -> float:
    """The best of the partial ratio, the ratio of sorted words, and that of the words' set with what only one side has."""
    x, y = sorted(a.split()), sorted(b.split())
    shared, left, right = " ".join(sorted({*x} & {*y})), " ".join(sorted({*x} - {*y})), " ".join(sorted({*y} - {*x}))
    one, two = f"{shared} {left}".strip(), f"{shared} {right}".strip()
    both = max(indel_ratio(shared, one), indel_ratio(shared, two), indel_ratio(one, two)) if shared else 0.0
    return max(partial_ratio(a, b), indel_ratio(" ".join(x), " ".join(y)), both)


#: Titles of a block: two blocks are compared by one task at a time.
BLOCK = 512


def in_reach(left: list[str], right: list[str], least: float) -> np.ndarray:
    """Pairs (i, j) that can reach ``least``: a common word, none on both sides, or enough equal signs for any alignment with the shorter text.

    No alignment pairs more signs than both texts have in common, counted with
    their number, so no pair is lost.
    """
    signs = {sign: k for k, sign in enumerate(sorted(set("".join(left)) & set("".join(right)) - {" "}))}
    sizes = [np.array([len(t) for t in side]) for side in (left, right)]
    counts = []
    for side in (left, right):
        count = np.zeros((len(signs), len(side)), np.int32)
        for place, text in enumerate(side):
            for sign in text:
                if sign in signs:
                    count[signs[sign], place] += 1
        counts.append(count)
    common = np.zeros((len(left), len(right)), np.int32)
    for x, y in zip(*counts, strict=True):
        common += np.minimum.outer(x, y)
    spaces = np.minimum.outer(*[np.array([t.count(" ") for t in side]) for side in (left, right)])
    shorter = np.maximum(1, np.minimum.outer(*sizes))
    # Runs of the longer text may be cut short, which raises a ratio to 200 s / (s + n) for s signs in common of n.
    bound = 200.0 * (common + spaces) / (common + spaces + shorter)
    words = [[set(t.split()) for t in side] for side in (left, right)]
    return np.argwhere((bound >= least) | np.array([[not x.isdisjoint(y) or not x and not y for y in words[1]] for x in words[0]]).reshape(bound.shape))


def score_titles(left: DataFrame, right: DataFrame, block: str, least: float, ratio: Callable[[str, str], float] = title_ratio) -> DataFrame:
    """(id, rid, score) of all pairs of one ``block`` value that score ``least`` or more.

    ``left`` has id and title, ``right`` rid and rtitle; both have the block column. Titles of a side are dealt into blocks of about BLOCK,
    every two blocks of a value meet in one task, and only pairs that pass come out.
    """
    blocks = [frame.groupBy(block).agg(F.ceil(F.count("*") / BLOCK).alias(name)) for frame, name in ((left, "n_left"), (right, "n_right"))]
    sizes = blocks[0].join(blocks[1], block)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = left.join(sizes, block).select(block, "id", F.coalesce("title", F.lit("")).alias("title"), F.pmod(F.xxhash64("id"), F.col("n_left")).alias("x"), every("n_right").alias("y"))
    b = right.join(sizes, block).select(block, "rid", F.coalesce("rtitle", F.lit("")).alias("rtitle"), every("n_left").alias("x"), F.pmod(F.xxhash64("rid"), F.col("n_right")).alias("y"))

    def compare(one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one) and len(two):
            titles, others = one["title"].tolist(), two["rtitle"].tolist()
            for i, j in in_reach(titles, others, least).tolist():
                score = round(ratio(titles[i], others[j]), 4)
                if score >= least:
                    out.append((one["id"].iat[i], two["rid"].iat[j], score))
        return pd.DataFrame(out, columns=["id", "rid", "score"])

    kinds = {f.name: f.dataType.simpleString() for frame in (left, right) for f in frame.schema}
    return a.groupBy(block, "x", "y").cogroup(b.groupBy(block, "x", "y")).applyInPandas(compare, f"id {kinds['id']}, rid {kinds['rid']}, score double")


def assign(scored: DataFrame, least: float = 50.0) -> DataFrame:
    """One-to-one assignment in the order (score desc, id, rid), found in rounds of mutual best pairs.

    Pairs that are best for both of their sides are what a sequential pass would
    take as well; taken rows leave, and the rest is ranked anew until no pair
    is left. Every round takes at least the best pair of all.
    """
    left = checkpointed(scored.where(F.col("score") >= least).select("id", "rid", "score"))
    taken = None
    while True:
        best = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "id", "rid"))
        mutual = checkpointed(left.withColumn("a", best("id")).withColumn("b", best("rid")).where("a = 1 AND b = 1").select("id", "rid", "score"))
        if mutual.isEmpty():
            break
        taken = mutual if taken is None else taken.unionByName(mutual)
        left = checkpointed(left.join(mutual.select("id"), "id", "left_anti").join(mutual.select("rid"), "rid", "left_anti"))
    level = F.when(F.col("score") >= 85, "high").when(F.col("score") >= 70, "medium").otherwise("low")
    return (taken if taken is not None else left.limit(0)).withColumn("level", level)


def part_titles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, str]:
    """The catalogue's titles of every part type, the same with the last sign lost, and the type's column."""
    titles = table(spark, sf_dir, "part").select("p_type", "p_name").distinct()
    key = F.concat_ws(":", "p_type", "p_name")
    left = titles.select(F.col("p_type").alias("kind"), key.alias("id"), F.col("p_name").alias("title"))
    right = titles.select(F.col("p_type").alias("kind"), key.alias("rid"), F.expr("substring(p_name, 1, length(p_name) - 1)").alias("rtitle"))
    return left, right, "kind"


@query("j10_fuzzy_assignment")
def j10_fuzzy_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(score_titles(*part_titles(spark, sf_dir), 50.0))


@query("j12_top_three")
def j12_top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("score"), "rid")
    ranked = score_titles(*part_titles(spark, sf_dir), 1.0).withColumn("rank", F.row_number().over(order))
    return ranked.where("rank <= 3").select("id", "rank", "rid", "score")
