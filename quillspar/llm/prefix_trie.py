"""The trie of conversation prefixes, by chained digests.

A node is a distinct sequence of the first turns (role and text) of
conversations; the root has none. Every prefix of a conversation has a digest
that chains the digest of the shorter prefix with that of the last turn, so rows
of one depth and digest are one node and no text is ever compared or moved:
texts become digests where they are read, and a task then only chains them, 64
bytes a turn, turn after turn, for the conversations it has got in order.

Sums over subtrees come from the ancestors' side. The smallest member of a node
owns it, and it owns the whole rest of its own path, as the members below are
fewer. So each node is counted in exactly one conversation, and a conversation
gives every node on its path, the ancestors of what it owns, the sum of what it
owns from there on. That is one row a prefix, however long the paths are, where
exploding each node to all its ancestors makes the square of the depth.

The numbers of the conversations that end at a node are digested in order. They
are sorted by ranges over all tasks, packed into blocks, and only blocks of a
node meet in one task, which reads them one after another.

Defined results: a null role or text is empty; turns are ordered by number (null
first), then role, then digest of the text; repeated rows are turns of their own;
rows with a null conv_id take no part; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspar.llm.common import Scratch, table

#: The digest of no turns, and the numbers that one block of ends holds at most.
ROOT, BLOCK = hashlib.sha256(b"").digest(), 2048
#: Conversations are rebuilt in families of so many numbers, from up to HEADS - 1 turns of the first one.
FAMILY, HEADS = 100, 6
PREFIXES = "conv_id long, depth int, digest binary, chars long, last boolean"


def turn_digests(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest and chars of every turn. Lengths part role and text, so no two turns are written alike."""
    said = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    written = F.concat(F.length(role).cast("string"), F.lit(":"), role, said)
    return turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.unhex(F.sha2(written, 256)).alias("digest"), F.length(said).cast("long").alias("chars")
    )


class _Chain:
    """Prefixes of conversations whose turns come in order, batch by batch."""

    def __init__(self, rebuilt: bool) -> None:
        self.rebuilt, self.conv, self.family = rebuilt, None, None
        self.heads: list[tuple[bytes, int]] = []
        self.rows: list[list] = []

    def step(self, turn: bytes, chars: int) -> None:
        self.digest, self.depth = hashlib.sha256(self.digest + turn).digest(), self.depth + 1
        self.rows.append([self.conv, self.depth, self.digest, chars, False])

    def begin(self, conv: int) -> None:
        self.end()
        self.conv, self.own, self.skipped, self.digest, self.depth = conv, 0, 0, ROOT, 0
        self.rows.append([conv, 0, ROOT, 0, False])
        first = conv - conv % FAMILY
        if first != self.family:
            self.family, self.heads = first, []
        if self.rebuilt and conv != first:
            self.skipped = zlib.crc32(str(conv).encode()) % HEADS
            for head in self.heads[: self.skipped]:
                self.step(*head)

    def end(self) -> None:
        if self.rows:
            self.rows[-1][-1] = True

    def turn(self, conv: int, digest: bytes, chars: int) -> None:
        if conv != self.conv:
            self.begin(conv)
        self.own += 1
        if self.own > self.skipped:
            self.step(digest, chars)
        if conv == self.family and self.own < HEADS:
            self.heads.append((digest, chars))

    def take(self, all_of_them: bool) -> pa.RecordBatch:
        """The rows so far, but for the last, which may be the end of its conversation."""
        if all_of_them:
            self.end()
        keep = len(self.rows) - (not all_of_them)
        taken, self.rows = self.rows[:keep], self.rows[keep:]
        kinds = {"conv_id": pa.int64(), "depth": pa.int32(), "digest": pa.binary(), "chars": pa.int64(), "last": pa.bool_()}
        columns = zip(*taken) if taken else [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=[*kinds])


def prefixes(turns: DataFrame, rebuilt: bool = False) -> DataFrame:
    """conv_id, depth, digest, chars of the last turn, and whether the conversation ends there: one row for every prefix.

    With ``rebuilt`` conversation c is the first h turns of conversation c - c % 100 (all if fewer, none if there is
    none) and then its own turns behind its first h, h being the unsigned crc32 of its decimal number modulo 6.
    The 100 numbers of a family are in one task, the one that gives the turns first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = _Chain(rebuilt)
        for batch in batches:
            for row in zip(batch.column("conv_id").to_pylist(), batch.column("digest").to_pylist(), batch.column("chars").to_pylist()):
                chain.turn(*row)
                if len(chain.rows) > 20_000:
                    yield chain.take(False)
        yield chain.take(True)

    dealt = F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY)) if rebuilt else F.col("conv_id")
    rows = turn_digests(turns).repartition(dealt).sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", "digest", "chars").mapInArrow(run, PREFIXES)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the numbers that follow each other at a node: the node, their first and their count, all packed."""
    packer = zstandard.ZstdCompressor(level=1)
    names = ["depth", "digest", "first", "n", "numbers"]
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
    node, numbers, blocks = None, [], []

    def close() -> None:
        if numbers:
            raw = np.diff(np.array(numbers, "<i8"), prepend=0).astype("<i8")
            halves = raw.view(np.uint8).reshape(-1, 8).T.tobytes()
            blocks.append((*node, numbers[0], len(numbers), packer.compress(halves) if len(numbers) > 8 else raw.tobytes()))
            numbers.clear()

    def taken() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*blocks) if blocks else [[]] * 5, kinds)], names=names)
        blocks.clear()
        return out

    for batch in batches:
        for depth, digest, conv in zip(batch.column("depth").to_pylist(), batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()):
            if (depth, digest) != node or len(numbers) >= BLOCK:
                close()
                node = depth, digest
            numbers.append(conv)
        if len(blocks) > 5000:
            yield taken()
    close()
    yield taken()


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for every node, of the numbers in its blocks, which come in order."""
    unpack = zstandard.ZstdDecompressor()
    node, running, done = None, None, []
    for batch in batches:
        for row in batch.to_pylist():
            raw = row["numbers"]
            if row["n"] > 8:
                raw = np.frombuffer(unpack.decompress(raw, max_output_size=8 * row["n"]), np.uint8).reshape(8, -1).T.tobytes()
            text = ",".join(map(str, np.cumsum(np.frombuffer(raw, "<i8")).tolist())).encode()
            if (row["depth"], row["digest"]) != node:
                if node:
                    done.append((*node, running.hexdigest()))
                node, running = (row["depth"], row["digest"]), hashlib.sha256(text)
            else:
                running.update(b"," + text)
        if len(done) > 5000:
            yield _digested(done)
            done.clear()
    if node:
        done.append((*node, running.hexdigest()))
    yield _digested(done)


def _digested(rows: list[tuple[int, bytes, str]]) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.binary(), pa.string()))], names=["depth", "digest", "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """depth, digest and ends_sha256 of the nodes at which conversations end."""
    order = ["depth", "digest", "conv_id"]
    blocks = (
        paths.where("last").select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, "depth int, digest binary, first long, n int, numbers binary")
    )
    return blocks.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(_digest, "depth int, digest binary, ends_sha256 string")


def prefix_trie(scratch: Scratch, turns: DataFrame, rebuilt: bool = False) -> DataFrame:
    """One row for every node.

    conv_id (its smallest member), depth, node (hexadecimal digest), parent_conv_id, n_convs (members), n_children,
    n_leaves (nodes without children in its subtree, which holds itself), saved_tokens (over its subtree, members but
    one times code points of the last text) and ends_sha256 (of the numbers of the conversations that end there).
    """
    paths = scratch.keep(prefixes(turns, rebuilt), "paths")
    nodes = paths.groupBy("depth", "digest").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n"), F.max("chars").alias("chars"), F.sum(F.col("last").cast("int")).alias("ended")
    )
    # At its smallest member a node is counted: once, and before that member's own row.
    counted = nodes.select(
        "conv_id", "depth", "digest", F.lit(0).alias("path"), (F.col("n") == F.col("ended")).cast("long").alias("leaf"), ((F.col("n") - 1) * F.col("chars")).alias("saved")
    )
    walked = paths.select("conv_id", "depth", "digest", F.lit(1).alias("path"), F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("saved"))
    up = Window.partitionBy("conv_id").orderBy(F.col("depth").desc(), "path")
    below = up.rowsBetween(Window.unboundedPreceding, 0)
    sums = (
        counted.union(walked)
        .withColumns(
            {
                "seen": F.sum("path").over(below),  # prefixes from here to the end of the conversation
                "owned": F.sum(1 - F.col("path")).over(below),  # nodes among them that it owns, the deepest ones
                "leaves": F.sum("leaf").over(below),
                "saves": F.sum("saved").over(below),
                "above": F.lead("digest").over(up),
            }
        )
        .where("path = 1")
        .groupBy("depth", "digest", "above")
        .agg(
            F.min("conv_id").alias("conv_id"),
            F.count("*").alias("n_convs"),
            F.sum(F.expr("CAST(seen > 1 AND owned >= seen - 1 AS INT)")).alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saves").alias("saved_tokens"),
        )
    )
    sums = scratch.keep(sums, "sums")
    # Many children may ask for one parent; adaptive execution splits such a key of the merge join.
    parents = sums.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    found = sums.join(parents.hint("merge"), ["depth", "above"], "left").join(ends(paths).hint("merge"), ["depth", "digest"], "left")
    return found.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(ROOT.hex())).alias("ends_sha256"),
        F.lower(F.hex("digest")).alias("node"),
    )


#: The same rows in SQL: the checksum from its table of 256 remainders, nodes by the digest of all their turns,
#: subtrees by a join of every node with the prefixes of its smallest member.
ORACLE = r"""
WITH RECURSIVE bits(n, k, x) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT n, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END FROM bits WHERE k < 8
), remainders AS (SELECT n, x FROM bits WHERE k = 8
), checks(conv_id, rest, x) AS (
  SELECT DISTINCT conv_id, conv_id::VARCHAR, 4294967295::BIGINT FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL SELECT conv_id, substr(rest, 2), xor(c.x >> 8, r.x) FROM checks c JOIN remainders r ON r.n = xor(c.x & 255, ascii(rest)) WHERE rest <> ''
), ids AS (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(x, 4294967295) % 6 AS h FROM checks WHERE rest = ''
), own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), told AS (
  SELECT i.conv_id, 0 AS part, o.n, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.base AND o.n <= i.h
  UNION ALL SELECT i.conv_id, 1, o.n, o.role, o.text FROM ids i JOIN own o ON o.conv_id = i.conv_id AND o.n > i.h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, n) AS depth, length(text) AS chars,
         sha256(length(role)::VARCHAR || ':' || role || text) AS turn
  FROM told
), paths AS (
  SELECT conv_id, depth, chars, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS node FROM turns
  UNION ALL SELECT conv_id, 0, 0, '' FROM ids
), lasts AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS last FROM paths
), nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, bool_and(last) AS leaf,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM lasts GROUP BY depth, node
), sums AS (
  SELECT p.depth, p.node, sum(n.leaf::INT) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved, sum((n.depth = p.depth + 1)::INT) AS n_children
  FROM nodes n JOIN paths p ON p.conv_id = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.node
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves,
       s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.node = n.node
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = left(n.node, 64 * (n.depth - 1)::INT)
"""


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(Scratch(spark, "op11"), table(spark, sf_dir, "conversations"), rebuilt=True).drop("node")
