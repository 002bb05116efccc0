"""Near duplicates by an LSH forest over MinHash signatures, confirmed on full sets.

A document's set holds the hashes of its distinct runs of five words. Rows with
the same set form one class and travel on as its smallest doc_id, so exact
copies, however many, cost one row.

Every class has ``HASHES`` minima. A tree of the forest is one order of them;
all classes are sorted by their minima in every tree's order, by a range
shuffle that also parts long runs of equal signatures. In a sorted order,
neighbours whose longest common prefix has ``DEPTH`` values or more are
candidates; the longest runs of such neighbours are regions. A region of more
than ``REGION`` classes is cut where the common prefix of two neighbours is
shortest, so the depth grows only where classes are dense; the parts overlap by
one neighbour. Inside a part classes are joined if their signatures agree in
``AGREE`` of the places or more, and the strongest agreements that hold the
part together (a maximum spanning forest) are kept: fewer edges than classes.
What is then still apart in a region that was cut, by its size or by the border
of a partition, is compared across the cuts, block by block, so cuts lose no
candidate.

The components of these edges hold every pair that may be similar enough. Full
sets are compared exactly, first inside tiles of bounded size that all hold the
component's representative, then, only where a component is not yet one, across
tiles. A tile returns links that join its classes, never all its pairs.
Components of these links are the result. A pair at the threshold is missed by
all ``TREES`` trees with probability 5e-6, and by the agreement filter with
3e-4, if nothing else links it.

Defined results: null and empty texts, and texts without words, have an empty
set and are linked with nothing; a null doc_id is linked with nothing, has a
null component and is kept; rows that share a doc_id count as one document
where components are formed; repeated rows are returned once each; an empty
table gives no rows; other columns are not read.

Joins whose smaller side grows with the corpus are merge joins at every size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import Scratch, fixed_width, runs, small_batches, table
from quillspar.llm.components import components
from quillspar.llm.shingles import mix, shingle_hashes, word_hashes

WORDS, SIMILAR = 5, 75
TREES, DEPTH, HASHES = 32, 4, 128
REGION, PART, BLOCK, AGREE = 1024, 256, 1024, 0.62
TILE_CLASSES, TILE_HASHES = 1000, 1_500_000

_SEEDS = np.random.default_rng(20).integers(1, 2**32, (2, HASHES), dtype=np.uint32)


def word_set(text: bytes) -> np.ndarray:
    """The sorted distinct shingle hashes of a text in UTF-8."""
    return np.unique(shingle_hashes(word_hashes(text.lower())[0], WORDS))


def minima(found: np.ndarray) -> np.ndarray:
    """The signature of a set that is not empty."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(low), 4096):
        part = (low[None, start : start + 4096] ^ _SEEDS[0][:, None]) * (_SEEDS[1][:, None] | np.uint32(1))
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(out, part.min(axis=1), out=out)
    return out


def narrow(signature: np.ndarray) -> np.ndarray:
    """Minima to 16 bits each, which is enough to count agreements."""
    return (signature * np.uint32(0x9E3779B1) >> np.uint32(16)).astype("<u2")


def orders(signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort keys [class, tree]: the tree and its first DEPTH values (14 bits each), and the next four values."""
    places = (np.arange(TREES)[:, None] * DEPTH + np.arange(2 * DEPTH)) % HASHES
    values = signatures[:, places].astype(np.uint64)
    key = np.broadcast_to(np.arange(TREES, dtype=np.uint64), values.shape[:2])
    rest = np.zeros(values.shape[:2], np.uint64)
    for k in range(DEPTH):
        key = (key << np.uint64(14)) | (values[:, :, k] >> np.uint64(2))
        rest = (rest << np.uint64(16)) | values[:, :, DEPTH + k]
    return key.view(np.int64), rest.view(np.int64)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, "text", 4 << 20):
        sizes, digests, signatures = [], [], []
        for text in batch.column("text").cast(pa.binary()).to_pylist():
            found = word_set(text or b"")
            sizes.append(len(found))
            digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
            signatures.append(narrow(minima(found)).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
            names=["doc_id", "n_shingles", "digest", "signature"],
        )


def _orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            key, rest = orders(fixed_width(batch.column("signature"), "<u2"))
            doc = np.repeat(np.asarray(batch.column("doc_id")), TREES)
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(rest.ravel()), pa.array(doc)], names=["k", "rest", "doc_id"])


def spanning(signatures: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest over agreements of AGREE or more, grown row by row."""
    n = len(signatures)
    least = AGREE * signatures.shape[1]
    best, near = np.zeros(n, np.int32), np.zeros(n, np.int64)
    left = np.ones(n, bool)
    edges, now = [], 0
    for _ in range(n - 1):
        left[now] = False
        rest = np.flatnonzero(left)
        agree = (signatures[rest] == signatures[now]).sum(axis=1, dtype=np.int32)
        better = agree > best[rest]
        best[rest[better]], near[rest[better]] = agree[better], now
        now = int(rest[np.argmax(best[rest])])
        if best[now] >= least:
            edges.append((now, int(near[now])))
    return edges


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bounds in runs(batches):
        docs, signatures = np.asarray(batch.column("doc_id")), fixed_width(batch.column("signature"), "<u2")
        pairs = [(a + start, b + start) for start, end in zip(bounds, [*bounds[1:], batch.num_rows], strict=False) if end - start > 1 for a, b in spanning(signatures[start:end])]
        if pairs:
            ends = docs[np.array(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def cuts(rest: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of parts of a sorted region, cut where neighbours share the shortest prefix; a part begins with the last row of the one before."""
    apart = rest.view(np.uint64)[1:] ^ rest.view(np.uint64)[:-1]
    common = sum((apart < np.uint64(1 << bits)).astype(np.int8) for bits in (48, 32, 16, 0))
    out, start = [], 0
    while len(rest) - start > PART:
        low = start + PART // 2
        at = low + int(np.argmin(common[low - 1 : start + PART - 1]))
        out.append((max(0, start - 1), at))
        start = at
    return [*out, (max(0, start - 1), len(rest))]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (k, part, doc_id, n, h) of the regions of a sorted partition, without classes that have no neighbour.

    ``n`` and ``h`` are size and digest of a region that is whole here; n is 0
    for parts, and for the partition's first and last run, which may go on
    beyond its borders.
    """
    number = TaskContext.get().partitionId()
    parts = 0

    def emit(pieces: list, first: bool, last: bool) -> pa.RecordBatch:
        nonlocal parts
        key, rest, doc = (np.concatenate(c) for c in zip(*pieces, strict=True))
        begin = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
        size = np.diff(np.append(begin, len(key)))
        digest = np.bitwise_xor.reduceat(mix(doc.view(np.uint64) + np.uint64(1)), begin).view(np.int64)
        open_ = size > REGION
        open_[0] |= first
        open_[-1] |= last
        row = np.flatnonzero(np.repeat((size > 1) & ~open_, size))
        run = np.repeat(np.arange(len(begin)), size)[row]
        columns = [[key[row], key[row], doc[row], size[run], digest[run]]]
        for k in np.flatnonzero(open_).tolist():
            for low, high in cuts(rest[begin[k] : begin[k] + size[k]]):
                at, parts = slice(begin[k] + low, begin[k] + high), parts + 1
                none = np.zeros(high - low, np.int64)
                columns.append([key[at], none + ((number << 32) + parts), doc[at], none, none])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*columns, strict=True)], names=["k", "part", "doc_id", "n", "h"])

    held: list = []
    first = True
    for batch in batches:
        if not batch.num_rows:
            continue
        key, rest, doc = (np.asarray(batch.column(c)) for c in ("k", "rest", "doc_id"))
        changes = np.flatnonzero(key[1:] != key[:-1]) + 1
        if not len(changes) and (not held or held[0][0][0] == key[0]):
            held.append((key, rest, doc))
            continue
        last = int(changes[-1]) if len(changes) else 0
        whole = [*held, (key[:last], rest[:last], doc[:last])] if last else held
        yield emit(whole, first, False)
        held, first = [(key[last:], rest[last:], doc[last:])], False
    if held:
        yield emit(held, first, True)


def regions(scratch: Scratch, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(part, doc_id): regions or parts of them with more than one class; (k, doc_id, w): the regions that were cut."""
    ordered = classes.mapInArrow(_orders, "k long, rest long, doc_id long").repartitionByRange("k", "rest", "doc_id").sortWithinPartitions("k", "rest", "doc_id")
    rows = scratch.keep(ordered.mapInArrow(_regions, "k long, part long, doc_id long, n long, h long"), "regions")
    # Trees that find the same classes give the same neighbours; one will do.
    once = rows.where("n > 0").groupBy("n", "h").agg(F.min("k").alias("k"))
    whole = rows.where("n > 0").join(once.select("k").hint("merge"), "k").select(F.col("k").alias("part"), "doc_id")
    parted = rows.where("n = 0").select("k", "part", "doc_id")
    sizes = parted.select("k", "doc_id").distinct().groupBy("k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("doc_id")).alias("h")).where("n > 1")
    sizes = scratch.keep(sizes.groupBy("n", "h").agg(F.min("k").alias("k")), "sizes")
    parted = parted.join(sizes.select("k", "n").hint("merge"), "k")
    parts = parted.select(F.when(F.col("n") <= REGION, F.col("k")).otherwise(-F.col("part") - 1).alias("part"), "doc_id").distinct()
    cut = parted.where(F.col("n") > REGION).select("k", "doc_id", F.lit(1.0 / BLOCK).alias("w")).distinct()
    return whole.union(parts), cut


def across(scratch: Scratch, name: str, rows: DataFrame, joined: DataFrame) -> DataFrame:
    """(k, doc_id): tiles in which all classes of a group meet that are in different components.

    ``rows`` (k, doc_id, w): classes of groups k with their share w of half a
    tile; ``joined`` (node, component). Groups that are one component are left out.
    """
    rows = rows.join(joined.hint("merge"), F.col("doc_id") == F.col("node"), "left").select("k", "doc_id", "w", F.coalesce("component", "doc_id").alias("c"))
    rows = scratch.keep(rows, f"{name}-components")
    sizes = scratch.keep(rows.groupBy("k", "c").agg(F.sum("w").alias("w")), f"{name}-sizes")
    apart = sizes.groupBy("k").agg(F.count("*").alias("parts"), F.sum(F.when(F.col("w") <= 1, F.col("w"))).alias("rest")).where("parts > 1")
    # Large components have blocks of their own; the others share blocks.
    own = F.when(F.col("w") > 1, F.col("c"))
    deal = sizes.join(apart.hint("merge"), "k").select("k", "c", own.alias("own"), F.ceil(F.when(F.col("w") > 1, F.col("w")).otherwise(F.col("rest"))).alias("blocks"))
    placed = rows.join(deal.hint("merge"), ["k", "c"]).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = scratch.keep(placed.select("k", "own", F.xxhash64("k", F.col("own").isNull(), F.coalesce("own", F.lit(0)), "part").alias("block"), "doc_id"), f"{name}-blocks")
    blocks = placed.select("k", "own", "block").distinct()
    pairs = blocks.join(blocks.select("k", F.col("own").alias("own_b"), F.col("block").alias("b")).hint("merge"), "k").where("block <= b AND (own IS NULL OR own_b IS NULL OR own <> own_b)")
    ends = pairs.select(F.xxhash64("k", "block", "b").alias("tile"), F.explode(F.array_distinct(F.array("block", "b"))).alias("block"))
    return placed.select("block", "doc_id").join(ends.hint("merge"), "block").select(F.col("tile").alias("k"), "doc_id")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full sets of the classes' texts; rows of another text under the same doc_id drop out by their digest."""
    for batch in small_batches(batches, "text", 4 << 20):
        keep, packed = [], []
        for text, digest in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("digest").to_pylist(), strict=True):
            found = word_set(text or b"").tobytes()
            keep.append(hashlib.blake2b(found, digest_size=16).digest() == digest)
            packed.append(found)
        more = [name for name in batch.schema.names if name not in ("text", "digest")]
        sets = pa.RecordBatch.from_arrays([*(batch.column(name) for name in more), pa.array(packed, pa.binary())], names=[*more, "found"])
        yield sets.filter(pa.array(keep, pa.bool_()))


def links(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Pairs that join all sets which similar pairs connect, a spanning forest of them.

    Sizes of intersections are products of rows of a 0/1 matrix, summed over
    ranges of its columns, so all of them are exact.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    shared = np.zeros((n, n), np.float32)
    _, code = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(n), size)
    repeats = np.bincount(code)
    common = np.flatnonzero(repeats > 1)
    place = np.full(len(repeats), -1)
    place[common] = np.arange(len(common))
    code = place[code]
    order = np.argsort(code, kind="stable")
    order = order[np.searchsorted(code[order], 0) :]
    code, row = code[order], row[order]
    step = max(256, (1 << 22) // n)
    for first in range(0, len(common), step):
        lo, hi = np.searchsorted(code, (first, first + step))
        matrix = np.zeros((n, min(step, len(common) - first)), np.float32)
        matrix[row[lo:hi], code[lo:hi] - first] = 1
        shared += matrix @ matrix.T
    exact = shared.astype(np.int64)
    similar = 100 * exact >= SIMILAR * (size[:, None] + size[None, :] - exact)
    group = np.full(n, -1)
    out = []
    for start in range(n):
        if group[start] >= 0:
            continue
        group[start], edge = start, [start]
        while edge:
            now = edge.pop()
            for other in np.flatnonzero(similar[now] & (group < 0)).tolist():
                group[other] = start
                out.append((now, other))
                edge.append(other)
    return out


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, bounds in runs(batches):
        docs = np.asarray(batch.column("doc_id"))
        pairs = []
        for start, end in zip(bounds, [*bounds[1:], batch.num_rows], strict=False):
            if end - start > 1:
                sets = [np.frombuffer(found, "<u8") for found in batch.column("found").slice(start, end - start).to_pylist()]
                pairs += [(a + start, b + start) for a, b in links(sets)]
        if pairs:
            ends = docs[np.array(pairs)]
            yield pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def compared(tiles: DataFrame) -> DataFrame:
    """Links (a, b) inside tiles (k, doc_id, found)."""
    return tiles.select("k", "doc_id", "found").repartition("k").sortWithinPartitions("k").mapInArrow(_links, "a long, b long")


def confirmed(scratch: Scratch, texts: DataFrame, classes: DataFrame, soft: DataFrame) -> DataFrame:
    """Links (a, b) between classes of the components ``soft`` (node, component), found on full sets."""
    share = F.greatest(F.lit(1.0 / TILE_CLASSES), F.col("n_shingles") / TILE_HASHES)
    members = scratch.keep(classes.join(soft.hint("merge"), F.col("doc_id") == F.col("node")).select("doc_id", "digest", "component", share.alias("w")), "members")
    blocks = members.groupBy("component").agg(F.ceil(F.sum("w")).alias("blocks"))
    placed = members.join(blocks.hint("merge"), "component")
    sets = (
        texts.join(placed.hint("merge"), "doc_id")
        .select("doc_id", "text", "digest", "component", "blocks")
        .mapInArrow(_sets, "doc_id long, component long, blocks long, found binary")
    )
    # The representative meets every block of its component; the others are in one block.
    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    block = F.explode(F.when(F.col("doc_id") == F.col("component"), every).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), F.col("blocks")))))
    found = scratch.keep(compared(sets.withColumn("block", block).withColumn("k", F.xxhash64("component", "block"))), "links")
    several = members.join(blocks.where("blocks > 1").hint("merge"), "component").select(F.col("component").alias("k"), "doc_id", "w")
    if several.isEmpty():
        return found
    # What is joined so far goes on as stars, from which the final components are found in fewer rounds.
    joined = components(scratch, found, "first")
    found = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    tiles = scratch.keep(across(scratch, "exact", several, joined), "tiles")
    if tiles.isEmpty():
        return found
    asked = members.select("doc_id", "digest").join(tiles.select("doc_id").distinct().hint("merge"), "doc_id")
    whole = texts.join(asked.hint("merge"), "doc_id").select("doc_id", "text", "digest").mapInArrow(_sets, "doc_id long, found binary")
    return found.union(scratch.keep(compared(whole.join(tiles.hint("merge"), "doc_id")), "links-across"))


def near_duplicates(scratch: Scratch, documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``documents`` (doc_id, text)."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = scratch.keep(texts.mapInArrow(_features, "doc_id long, n_shingles long, digest binary, signature binary"), "features")
    whole = features.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    least = scratch.keep(whole.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "least")
    classes = whole.join(least.select("digest", "least"), [whole["digest"] == least["digest"], whole["doc_id"] == least["least"]], "left_semi")
    classes = scratch.keep(classes.dropDuplicates(["doc_id", "digest"]), "classes")
    signed = classes.select("doc_id", "signature")

    def neighbours(placed: DataFrame) -> DataFrame:
        near = placed.join(signed.hint("merge"), "doc_id").select("k", "doc_id", "signature")
        return near.repartition("k").sortWithinPartitions("k").mapInArrow(_neighbours, "a long, b long")

    parts, cut = regions(scratch, signed)
    soft = scratch.keep(components(scratch, neighbours(parts.withColumnRenamed("part", "k")), "soft"), "soft")
    if not cut.isEmpty():
        edges = soft.select(F.col("node").alias("a"), F.col("component").alias("b")).union(neighbours(across(scratch, "cut", cut, soft)))
        soft = scratch.keep(components(scratch, edges, "soft-all"), "soft-all-nodes")
    found = confirmed(scratch, texts, classes, soft)
    # Rows of one doc_id with different sets are one document: their classes are linked too.
    same = whole.groupBy("doc_id").agg(F.count_distinct("digest").alias("n")).where("n > 1").select("doc_id")
    several = whole.join(same, "doc_id").join(least.where("copies > 1"), "digest").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    joined = components(scratch, found.union(several), "joined")
    copied = least.where("copies > 1").select("digest", "least")
    rows = (
        features.select("doc_id", "n_shingles", "digest")
        .join(copied, "digest", "left")
        .withColumn("node", F.coalesce("least", "doc_id"))
        .join(joined, "node", "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    )
    return rows.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op8_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op8")
    result = scratch.keep(near_duplicates(scratch, table(spark, sf_dir, "documents").select("doc_id", "text")), "result")
    scratch.drop_all_but("result")
    return result
