"""Approximate nearest neighbours by inner product, with cross-polytope hashing.

In each of some tables a vector is turned by three rounds of random signs and
a Walsh-Hadamard transform, and hashed to the signed axis nearest to it. A query
is turned alike and probes the axes nearest to it in every table. How many tables
and probes that takes depends on the dimension and on how the vectors lie; it is
measured: ASKED of the queries are compared with all rows, and the plan with the
fewest visits is taken that finds TARGET of their nearest. One table with all axes
visits everything, so no plan costs more than that.

Neighbouring buckets travel together, GROUP axes at a time: a vector once a
table, a query once for every group that it probes, with the set of its axes
there. Vectors and queries of a group are both cut into blocks of at most TILE
bytes, dealt by a hash of their ids, and every two of them meet in one tile. In
a tile each bucket's vectors are multiplied with the queries that probe it, and
candidates near a query's best are scored again in double precision before the
best are kept. Values are shipped as wide as the column has them, so nothing is
lost. Merging tiles leaves each query's nearest.

Where norms differ, the largest inner product is not the smallest angle. Vectors
are therefore hashed by direction in bands of nearly equal norm (a factor of
2 ** 0.25), and queries probe every band; unit vectors make one band. The sizes
of groups are collected: a sixteenth of the dimension values a table and band.

Queries that found fewer than ``k`` although there are more candidates are
compared with all rows, in blocks.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components take no part, neither do rows with a null id; vectors of another
dimension than the query's are no candidates; rows that share an id count once,
with their best score; ties go to the smaller id; with k candidates or fewer all
are returned; an empty table gives no rows; other columns are not read. Vectors of
more than 4,095 components are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from quillspar.llm.common import Scratch, fixed_width, runs, table
from quillspar.llm.shingles import mix

#: Tables at most, axes that travel together, bytes of a block.
TABLES, GROUP, TILE = 4, 32, 8 << 20
#: Queries that a plan is measured on, the recall it must have there, and what a table costs beside its visits, in shares of all.
ASKED, TARGET, OVERHEAD = 64, 0.945, 0.02
SEED = 64
NEAR = "query_id long, vec_id long, score double"


def hadamard(x: np.ndarray) -> np.ndarray:
    """The orthonormal Walsh-Hadamard transform of every row; the width is a power of two."""
    n, width = x.shape
    half = 1
    while half < width:
        x = x.reshape(n, -1, 2, half)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2)
        half *= 2
    return x.reshape(n, width) / np.sqrt(width)


def rotate(x: np.ndarray, number: int) -> np.ndarray:
    """The pseudo-rotation of one table."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    rng = np.random.default_rng([SEED, number, width])
    for _ in range(3):
        x = hadamard(x * rng.choice([-1.0, 1.0], width))
    return x


def signed(x: np.ndarray, number: int) -> np.ndarray:
    """How far every row reaches along every signed axis: axis a is 2a, its opposite 2a + 1."""
    turned = rotate(x, number)
    return np.stack([turned, -turned], axis=2).reshape(len(x), -1)


def axes(x: np.ndarray, number: int, probes: int) -> np.ndarray:
    """The signed axes nearest to every row, nearest first."""
    both = signed(x, number)
    probes = min(probes, both.shape[1])
    best = np.argpartition(-both, probes - 1, axis=1)[:, :probes]
    return np.take_along_axis(best, np.argsort(-np.take_along_axis(both, best, axis=1), axis=1, kind="stable"), axis=1)


def plan(queries: np.ndarray, near: np.ndarray) -> tuple[int, int]:
    """Tables and probes that find TARGET of some pairs of a query and one of its nearest with the fewest visits."""
    unit = lambda x: (y := x / np.abs(x).max(axis=1, keepdims=True)) / np.sqrt((y**2).sum(axis=1, keepdims=True))
    width = 2 << max(0, int(queries.shape[1] - 1).bit_length())
    queries, near, places = unit(queries), unit(near), []
    for number in range(TABLES):
        reach = signed(queries, number)
        places.append((reach > np.take_along_axis(reach, axes(near, number, 1), axis=1)).sum(axis=1))
    plans = [(1 + OVERHEAD, 1, width)]
    for tables in range(1, TABLES + 1):
        due = np.sort(np.min(places[:tables], axis=0))
        probes = int(due[min(len(due) - 1, int(np.ceil(TARGET * len(due))))]) + 1
        plans.append((tables * probes / width + OVERHEAD * tables, tables, probes))
    return min(plans)[1:]


def _planned(rows: DataFrame, asked: DataFrame, kind: str, k: int) -> dict[int, tuple[int, int]]:
    """A plan for the dimensions of ASKED queries, chosen by a hash of their ids and compared with all rows; others visit all.

    The queries go to the rows, as there are few of them; each task gives the best it has, and no vector is shuffled.
    """
    few = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(ASKED).toArrow()
    queries = {size: found for batch in few.combine_chunks().to_batches() for size, *found in _groups(batch)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                for size, ids, vectors in _groups(whole.slice(first, 4096)):
                    if size in queries:
                        numbers, values = queries[size]
                        every = np.ones(len(numbers), np.int64), np.ones(len(ids), np.int64)
                        for found in nearest(numbers, every[0], values.astype(kind), ids, every[1], vectors.astype(kind), k):
                            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    exact = ranked(rows.mapInArrow(run, NEAR), k).select("query_id", "vec_id")
    pairs = rows.join(F.broadcast(exact), "vec_id").groupBy("query_id", "vec_id").agg(F.min("vector").alias("vector")).collect()  # ASKED times k rows at most
    asked_for = {(size, number): value for size, (numbers, values) in queries.items() for number, value in zip(numbers.tolist(), values)}
    found: dict[int, tuple[list, list]] = {}
    for row in pairs:
        value = asked_for.get((len(row.vector), row.query_id))
        if value is not None:
            for side, vector in zip(found.setdefault(len(row.vector), ([], [])), (value, row.vector)):
                side.append(vector)
    return {size: plan(*map(np.array, sides)) for size, sides in found.items()}


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors) of a batch's rows."""
    sizes = np.asarray(pc.list_value_length(batch.column("vector")))
    for size in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == size)
        part = batch.take(pa.array(at))
        yield size, np.asarray(part.column("vec_id")), np.asarray(part.column("vector").flatten(), np.float64).reshape(-1, size)


def _key(size: int, number: int, band: np.ndarray, axis: np.ndarray) -> np.ndarray:
    """A group of buckets: 12 bits of dimension, 3 of table, 14 of norm band, 8 of axes."""
    if size >= 1 << 12:
        raise ValueError("vectors may have 4095 components")
    return ((np.int64(size) * 8 + number) * (1 << 14) + band + (1 << 13)) * (1 << 8) + axis // GROUP


def _band_of(key: int) -> tuple[int, int]:
    """Dimension and norm band of a group."""
    return key >> 25, ((key >> 8) & ((1 << 14) - 1)) - (1 << 13)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(dimension, ids, vectors, unit vectors, bands) of slices of the rows."""
    for whole in batches:
        for first in range(0, whole.num_rows, 2048):
            for size, ids, vectors in _groups(whole.slice(first, 2048)):
                top = np.abs(vectors).max(axis=1, keepdims=True)
                norm = np.sqrt(((vectors / top) ** 2).sum(axis=1, keepdims=True))
                yield size, ids, vectors, vectors / top / norm, np.round(4 * (np.log2(top) + np.log2(norm))[:, 0]).astype(np.int64)


def _hashed(plans: dict[int, tuple[int, int]]):
    """(group, axis as a set, ids, vectors) of every vector, table by table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for size, ids, vectors, unit, band in _parts(batches):
            for number in range(plans.get(size, (1, 0))[0]):
                axis = axes(unit, number, 1)[:, 0]
                yield _key(size, number, band, axis), np.int64(1) << (axis % GROUP), ids, vectors

    return run


def _probed(bands: dict[int, set[int]], plans: dict[int, tuple[int, int]]):
    """(group, axes as a set, ids, vectors) of every query for every group that it probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        for size, ids, vectors, unit, _ in _parts(batches):
            tables, probes = plans.get(size, (1, 1 << 13))
            for number in range(tables):
                axis = axes(unit, number, probes)
                sets = np.zeros((len(ids), -(-int(axis.max(initial=0) + 1) // GROUP)), np.int64)
                np.bitwise_or.at(sets, (np.arange(len(ids))[:, None], axis // GROUP), np.int64(1) << (axis % GROUP))
                row, group = np.nonzero(sets)
                for band in sorted(bands.get(size, ())):
                    yield _key(size, number, np.int64(band), group * GROUP), sets[row, group], ids[row], vectors[row]

    return run


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """All vectors of a dimension as one bucket."""
    for whole in batches:
        for size, ids, vectors in _groups(whole):
            yield np.full(len(ids), size, np.int64), np.ones(len(ids), np.int64), ids, vectors


def _counted(rows: DataFrame, hashed) -> dict[int, tuple[int, int]]:
    """Rows and components of a vector by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, _, _, vectors in hashed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.full(len(key), vectors.shape[1]))], names=["k", "size"])

    return {row["k"]: (row["n"], row["size"]) for row in rows.mapInArrow(run, "k long, size long").groupBy("k").agg(F.count("*").alias("n"), F.max("size").alias("size")).collect()}


def _dealt(rows: DataFrame, hashed, side: int, own: dict[int, int], others: dict[int, int], kind: str) -> DataFrame:
    """Rows (k, side, axes, vec_id, values): each in its own block of its group, once for every block of the other side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sets, ids, vectors in hashed(batches):
            mine, other = (np.fromiter((blocks.get(k, 0) for k in key.tolist()), np.int64, len(key)) for blocks in (own, others))
            block = (mix(ids.view(np.uint64)) % np.maximum(mine, 1).astype(np.uint64)).astype(np.int64)
            at = np.repeat(np.arange(len(key)), other)
            more = np.arange(len(at)) - np.repeat(np.cumsum(other) - other, other)
            first, second = (block[at], more) if side else (more, block[at])
            tile = mix(mix(mix(key[at].view(np.uint64)) + first.view(np.uint64)) + second.view(np.uint64)).view(np.int64)
            packed = np.array([v.tobytes() for v in vectors.astype(kind)], object)
            columns = [pa.array(tile), pa.array(np.full(len(at), side, np.int32)), pa.array(sets[at]), pa.array(ids[at]), pa.array(packed[at], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "side", "axes", "vec_id", "values"])

    return rows.mapInArrow(run, "k long, side int, axes long, vec_id long, values binary")


def _met(rows: DataFrame, asked: DataFrame, hashed, probed, kind: str, k: int, row_counts: dict | None = None) -> DataFrame:
    """The best pairs of every tile."""
    width = np.dtype(kind).itemsize
    counted = (_counted(rows, hashed) if row_counts is None else row_counts), _counted(asked, probed)
    row_blocks, query_blocks = ({key: -(-n // max(1, TILE // (size * width))) for key, (n, size) in side.items()} for side in counted)
    both = _dealt(rows, hashed, 1, row_blocks, query_blocks, kind).union(_dealt(asked, probed, 0, query_blocks, row_blocks, kind))
    return both.repartition("k").sortWithinPartitions("k", "side").mapInArrow(_search(k, kind), NEAR)


def nearest(ids: np.ndarray, probes: np.ndarray, queries: np.ndarray, others: np.ndarray, axis: np.ndarray, vectors: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per query of a tile: query ids, vector ids and scores of its k best (more where they tie), without itself."""
    order = np.argsort(axis, kind="stable")
    axis, others, vectors = axis[order], others[order], vectors[order]
    starts = np.flatnonzero(np.append(True, axis[1:] != axis[:-1]))
    # Single precision is rough enough unless products could leave its range.
    rough_kind = np.float32 if max(np.abs(queries).max(), np.abs(vectors).max()) < 1e15 and vectors.dtype == np.float32 else np.float64
    rough_vectors = vectors.astype(rough_kind, copy=False)
    error = 4 * np.finfo(rough_kind).eps * vectors.shape[1] * np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1).max())
    by_id = np.argsort(others, kind="stable")
    sorted_ids = others[by_id]
    step = max(1, (4 << 20) // len(others))
    for first in range(0, len(ids), step):
        some = slice(first, first + step)
        rough = np.full((len(ids[some]), len(others)), -np.inf, rough_kind)
        asked = queries[some].astype(rough_kind, copy=False)
        for start, end in zip(starts, [*starts[1:], len(axis)], strict=False):
            rows = np.flatnonzero(probes[some] & axis[start])
            rough[rows, start:end] = asked[rows] @ rough_vectors[start:end].T
        low, high = np.searchsorted(sorted_ids, ids[some], "left"), np.searchsorted(sorted_ids, ids[some], "right")
        for row in np.flatnonzero(high > low).tolist():
            rough[row, by_id[low[row] : high[row]]] = -np.inf
        floor = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k] if rough.shape[1] > k else np.full(len(rough), -np.inf)
        slack = error * np.sqrt((queries[some].astype(np.float64) ** 2).sum(axis=1))
        row, at = np.nonzero((rough >= (floor - slack)[:, None]) & (rough > -np.inf))
        exact = (vectors[at].astype(np.float64) * queries[some][row].astype(np.float64)).sum(axis=1)
        best = np.lexsort((others[at], -exact, row))
        row, at, exact = row[best], at[best], exact[best]
        rank = np.arange(len(row)) - np.searchsorted(row, row, "left")
        yield ids[some][row[rank < k]], others[at[rank < k]], exact[rank < k]


def _search(k: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, bounds in runs(batches):
            side, ids, sets = (np.asarray(batch.column(c)) for c in ("side", "vec_id", "axes"))
            for start, end in zip(bounds, [*bounds[1:], batch.num_rows], strict=False):
                asked = start + int((side[start:end] == 0).sum())
                if start == asked or asked == end:
                    continue
                values = batch.column("values")
                queries, vectors = fixed_width(values.slice(start, asked - start), kind), fixed_width(values.slice(asked, end - asked), kind)
                for found in nearest(ids[start:asked], sets[start:asked], queries, ids[asked:end], sets[asked:end], vectors, k):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part."""
    vector = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id IS NOT NULL AND size(vector) > 0")
    return rows.where(F.coalesce(finite, F.lit(False))).where(F.exists("vector", lambda x: x != 0))


def search(scratch: Scratch, vectors: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found for every row of ``queries`` (vec_id, embedding)."""
    rows, asked = usable(vectors), usable(queries)
    element = vectors.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, FloatType) else "<f8"
    bands: dict[int, set[int]] = {}
    plans = _planned(rows, asked, kind, k)
    hashed = _hashed(plans)
    counts = _counted(rows, hashed)
    for key in counts:
        size, band = _band_of(key)
        bands.setdefault(size, set()).add(band)
    pairs = _met(rows, asked, hashed, _probed(bands, plans), kind, k, counts)
    found = scratch.keep(ranked(pairs, k), "found")
    total = rows.select("vec_id").distinct().count()
    enough = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= min(k, total - 1))
    short = asked.join(enough, asked["vec_id"] == enough["query_id"], "left_anti")
    if not short.isEmpty():
        found = found.join(short.select(F.col("vec_id").alias("query_id")), "query_id", "left_anti")
        found = found.unionByName(ranked(_met(rows, short, _whole, _whole, kind, k), k))
    return found


def ranked(pairs: DataFrame, k: int) -> DataFrame:
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return search(Scratch(spark, "op2"), vectors, vectors.where("vec_id % 20 = 0"))
