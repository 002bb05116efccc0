"""Benchmark passages in documents: SimHash windows, multi-index lookup, exact check.

Words are runs of letters, digits and bytes beyond ASCII, in lower case. For a
benchmark item of m words every window of m consecutive words of a document is
a candidate place. Its fingerprint has BITS bits; bit b is the majority of bit
b in the hashes of its words. Windows are looked up in BLOCKS tables of one
block of bits each: a fingerprint within RADIUS of an item's differs from it by
two bits at most in at least one block, as BLOCKS * 3 > RADIUS. A table is the
sorted list of the items' block values; a window looks up all values within two
bits of its own, so no fingerprint within the radius is missed. Pairs are made
PAIRS at a time, whatever the number of items. The fingerprint is a filter with a
recall of its own: a similar window can lie outside the radius (see README). Windows found are compared exactly: the
similarity is the sum of the smaller over the sum of the larger weights of the
shingles of five words, a shingle's weight being its number of occurrences.

Only windows over a shingle of an item of that length are fingerprinted: others
share no weight with any such item, and their similarity is zero.

The benchmark is read in slices of at most SLICE bytes of text; its index is
flat arrays of about five times that size, broadcast and not kept by the driver.
Documents are read once for every slice.

Defined results: null and empty texts hold no passage; items without words match
nothing; items of fewer than five words match the same words in a row; equal
items are all reported; a document shorter than an item is one window; repeated
rows are reported once each; rows with null ids are compared like others; other
columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import small_batches, table
from quillspar.llm.shingles import shingle_hashes, word_hashes

WORDS, SIMILAR = 5, 0.75
BITS, BLOCKS, RADIUS = 64, 8, 23
SLICE, FILTER_BITS, STRETCH, PAIRS = 16 << 20, 22, 20_000, 1 << 20
#: All changes of a byte in two bits at most.
NEAR = np.array([x for x in range(256) if x.bit_count() <= 2], np.uint8)

_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that were read, and hash, first and end byte of every word."""
    lower = text.lower()
    if len(lower) != len(text):  # keep code points where they are
        lower = "".join(a if len(a) == 1 else b for a, b in zip(map(str.lower, text), text, strict=True))
    raw = lower.encode("utf-8", "replace").translate(_PLAIN)
    return raw, *word_hashes(raw)


def signs(words: np.ndarray) -> np.ndarray:
    """+1 or -1 for every bit of the word hashes, [word, bit]."""
    bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.astype(np.int8) * 2 - 1


def fingerprints(words: np.ndarray, size: int) -> np.ndarray:
    """SimHash of every window of ``size`` words; of all words, if there are fewer."""
    size = min(size, len(words))
    sums = np.zeros((len(words) + 1, BITS), np.int32)
    np.cumsum(signs(words), axis=0, dtype=np.int32, out=sums[1:])
    return np.packbits(sums[size:] - sums[: len(sums) - size] > 0, axis=1, bitorder="little").view("<u8").ravel()


@dataclass
class Length:
    """The items of one length in words: their fingerprints, and for each block the items in the order of its values."""

    items: np.ndarray
    prints: np.ndarray
    order: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, items: list[int], prints: list[int]) -> Length:
        """bounds[block, value]: the first place of the value in the block's order; one more for the end."""
        prints_ = np.array(prints, "<u8")
        parts = prints_.view(np.uint8).reshape(-1, BLOCKS).T
        order = np.argsort(parts, axis=1, kind="stable").astype(np.int32)
        values = np.take_along_axis(parts, order, axis=1)
        bounds = np.array([np.searchsorted(row, np.arange(257)) for row in values.astype(np.int16)], np.int32)
        return cls(np.array(items), prints_, order, bounds)

    def lookup(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window, item, distance) of all pairs within the radius."""
        step = max(1, PAIRS // (BLOCKS * max(1, len(self.items))))
        parts = [self._probe(found[first : first + step], first) for first in range(0, len(found), step)]
        return tuple(np.concatenate(c) for c in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3

    def _probe(self, found: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values = (found.astype("<u8").view(np.uint8).reshape(-1, BLOCKS)[:, :, None] ^ NEAR).astype(np.int64)
        block = np.arange(BLOCKS)[None, :, None]
        low, high = self.bounds[block, values], self.bounds[block, values + 1]
        count = (high - low).ravel()
        probe = np.flatnonzero(count)
        count, low = count[probe].astype(np.int64), low.ravel()[probe]
        at = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        window, table = np.divmod(probe, BLOCKS * len(NEAR))
        item = self.order[np.repeat(table // len(NEAR), count), at]
        pair = np.unique(np.repeat(window, count) * len(self.items) + item)
        window, item = np.divmod(pair, len(self.items))
        distance = np.bitwise_count(found[window] ^ self.prints[item])
        close = distance <= RADIUS
        return window[close] + first, item[close], distance[close]


class Index:
    """A slice of the benchmark: its shingles with their weights, and fingerprints."""

    def __init__(self, rows: list[tuple[int | None, str]]) -> None:
        self.ids, self.sizes = [], []
        prints, shingle, weight = [], [], []
        for item_id, text in rows:
            _, words, _, _ = words_of(text or "")
            if not len(words):
                continue
            keys, counts = np.unique(shingle_hashes(words, WORDS), return_counts=True)
            shingle.append(keys)
            weight.append(counts.astype(np.int32))
            self.ids.append(item_id)
            self.sizes.append(len(words))
            prints.append(int(fingerprints(words, len(words))[0]))
        self.sizes_ = np.array(self.sizes, np.int64)
        #: The shingles of item k are shingles[ends[k]:ends[k + 1]], sorted.
        self.ends = np.cumsum([0, *map(len, shingle)])
        self.shingles = np.concatenate([*shingle, np.empty(0, np.uint64)])
        self.weights = np.concatenate([*weight, np.empty(0, np.int32)])
        order = np.argsort(self.shingles, kind="stable")
        self.keys, self.owner = self.shingles[order], np.repeat(np.arange(len(shingle), dtype=np.int32), np.diff(self.ends))[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.keys & np.uint64((1 << FILTER_BITS) - 1)] = True
        by_size: dict[int, list[int]] = defaultdict(list)
        for item, size in enumerate(self.sizes):
            by_size[size].append(item)
        self.lengths = {size: Length.of(items, [prints[i] for i in items]) for size, items in by_size.items()}
        # Items shorter than a shingle are known by shingles of their own length.
        self.orders = sorted({min(WORDS, size) for size in by_size})

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Smaller over larger weights of the shingles of an item and of a window's words."""
        keys, counts = np.unique(shingle_hashes(window, WORDS), return_counts=True)
        part = slice(self.ends[item], self.ends[item + 1])
        mine, weights = self.shingles[part], self.weights[part]
        at = np.minimum(np.searchsorted(mine, keys), len(mine) - 1)
        shared = int(np.where(mine[at] == keys, np.minimum(weights[at], counts), 0).sum())
        return shared / (int(counts.sum()) + int(weights.sum()) - shared)

    def hits(self, words: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(length, places): where a shingle of an item of that length begins."""
        places, items = [], []
        orders = sorted({*self.orders, min(WORDS, len(words))})
        for order in orders:
            if order > len(words):
                continue
            found = shingle_hashes(words, order)
            at = np.flatnonzero(self.filter[found & np.uint64((1 << FILTER_BITS) - 1)])
            low, high = np.searchsorted(self.keys, found[at], "left"), np.searchsorted(self.keys, found[at], "right")
            count = high - low
            places.append(np.repeat(at, count))
            items.append(self.owner[np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)])
        if places and (place := np.concatenate(places)).size:
            size = self.sizes_[np.concatenate(items)]
            for length in np.unique(size).tolist():
                yield length, np.unique(place[size == length])

    def matches(self, words: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """For every similar item: similarity, first word and distance of its best window."""
        best: dict[int, tuple[float, int, int]] = {}
        for length, places in self.hits(words):
            size = min(length, len(words))
            last = len(words) - size
            low, high = np.clip(places - size + 1, 0, last), np.clip(places, 0, last)
            # Runs of window starts, cut into stretches of bounded length.
            breaks = np.flatnonzero(low[1:] > np.maximum.accumulate(high)[:-1] + 1) + 1
            for start, end in zip(low[np.append(0, breaks)], np.maximum.accumulate(high)[np.append(breaks - 1, len(high) - 1)], strict=True):
                for first in range(int(start), int(end) + 1, STRETCH):
                    stop = min(int(end) + 1, first + STRETCH)
                    windows, items, distances = self.lengths[length].lookup(fingerprints(words[first : stop - 1 + size], size))
                    self._compare(words, first, size, windows, self.lengths[length].items[items], distances, best)
        return best

    def _compare(self, words, first, size, windows, items, distances, best) -> None:
        order = np.lexsort((windows, distances))
        for window, item, distance in zip(windows[order].tolist(), items[order].tolist(), distances[order].tolist(), strict=True):
            if best.get(item, (0.0,))[0] == 1.0:
                continue
            similarity = self.similarity(item, words[first + window : first + window + size])
            if similarity >= SIMILAR and similarity > best.get(item, (0.0,))[0]:
                best[item] = (similarity, first + window, distance)


def slices(benchmark: DataFrame, limit: int = SLICE) -> Iterator[list[tuple[int | None, str]]]:
    """The benchmark's rows in slices of about ``limit`` bytes; each is all that the driver holds."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // limit))
    for k in range(n):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).toArrow()
        yield list(zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True))


def indexes(benchmark: DataFrame):
    """A broadcast index of every slice; the driver keeps none of them."""
    for rows in slices(benchmark):
        yield benchmark.sparkSession.sparkContext.broadcast(Index(rows))


def find_passages(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, distance and place (code points) of the best window of every item found."""
    found = None
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in small_batches(batches, "text", 8 << 20):
                out = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    raw, words, first, end = words_of(text or "")
                    for item, (similarity, start, distance) in index.matches(words).items():
                        stop = min(start + index.sizes[item], len(words)) - 1
                        place = len(raw[: first[start]].decode()), len(raw[: end[stop]].decode())
                        out.append((doc_id, index.ids[item], similarity, distance, *place))
                if out:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "item_id", "similarity", "distance", "start", "end"])

        rows_ = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        part = rows_.mapInArrow(run, "doc_id long, item_id long, similarity double, distance int, start long, end long")
        found = part if found is None else found.unionByName(part)
    return found


def keep_uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark passage."""
    for shared in indexes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in small_batches(batches, "text", 8 << 20):
                yield batch.filter(pa.array([not index.matches(words_of(text or "")[1]) for text in batch.column("text").to_pylist()], pa.bool_()))

        documents = documents.mapInArrow(run, documents.schema)
    return documents


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
