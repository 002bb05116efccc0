"""Product codes of vectors: Lloyd's rounds with Yinyang bounds, in integers.

Vectors become integers, floor(4096 * x), and fall into equal parts; every part
position has a codebook. Each round assigns every part to its nearest entry and
moves each entry to the floor of its parts' mean.

The entries of a codebook are clustered into groups once. A part keeps, beside
its entry, one lower bound a group: no entry of the group but its own is nearer.
When entries move, a bound shrinks by the longest way that an entry of its group
has moved; as long as it stays above the exact distance to the own entry, the
group holds nothing nearer and is not looked at. Groups whose bound fails are
scanned with exact integer distances, and equal distances go to the lower index,
so the codes are those of a full search. Bounds are floating-point numbers that
are rounded down by more than their error.

A round is one narrow pass over a table in the shared folder: vectors, codes and
bounds stay in their rows and no vector is shuffled. Each task adds one row with
its sums and counts per entry, as large as the codebooks; those are added up and
give the next codebooks, which alone pass through the driver.

Defined results: rows whose vector is null or holds null or non-finite components
are left out; the first entries are the rows with the smallest vec_id (null last),
equal ones in the order of their bytes; with fewer rows there are fewer
entries; an empty table gives no rows; null labels are one label; other columns
are not read. Vectors of different widths, widths that the parts do not divide
(no components at all included) and components of 2 ** 13 or more are errors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import Scratch, table

#: Integers for one unit, and the magnitude of components that keeps every sum of squares exact.
SCALE, LARGEST = 4096, 1 << 13
#: Labels whose sums are broadcast; more are joined by shuffling.
LABELS = 100_000
#: Relative error that covers all rounding of a bound.
SLACK = 1e-9
STATE = "vec_id long, label string, part binary, code binary, lower binary, sums binary"


@dataclass
class Codebooks:
    """Entries (parts x entries x width, int64), the group of every entry, and how far each has moved last."""

    entries: np.ndarray
    group: np.ndarray
    moved: np.ndarray

    @classmethod
    def start(cls, vectors: np.ndarray, parts: int, groups: int) -> Codebooks:
        entries = vectors.reshape(len(vectors), parts, -1).swapaxes(0, 1).copy()
        group = np.array([_groups(each, groups) for each in entries])
        return cls(entries, group, np.zeros(entries.shape[:2]))

    def update(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Every entry at the floor of its parts' mean; one without parts stays."""
        means = sums // np.maximum(counts, 1)[..., None]
        entries = np.where(counts[..., None] > 0, means, self.entries)
        return Codebooks(entries, self.group, np.sqrt(((entries - self.entries) ** 2).sum(-1)))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def _groups(entries: np.ndarray, groups: int) -> np.ndarray:
    """A few rounds of plain Lloyd's over the entries themselves, from entries evenly spaced in their order."""
    centres = entries[np.linspace(0, len(entries) - 1, min(groups, len(entries))).astype(int)].astype(float)
    for _ in range(5):
        near = ((entries[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        for g in range(len(centres)):
            if (near == g).any():
                centres[g] = entries[near == g].mean(0)
    return near


def _squares(rows: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances, rows x entries."""
    return ((rows[:, None, :] - entries[None]) ** 2).sum(-1)


def _below(distance: np.ndarray) -> np.ndarray:
    return distance * (1 - SLACK)


def search(rows: np.ndarray, entries: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries of all rows by a full search, and a lower bound for every group without the nearest."""
    squares = _squares(rows, entries)
    code = squares.argmin(1)
    distance = np.sqrt(squares)
    distance[np.arange(len(rows)), code] = np.inf
    lower = np.full((len(rows), n_groups), np.inf)
    for g in range(n_groups):
        if (group == g).any():
            lower[:, g] = _below(distance[:, group == g].min(1))
    return code, lower


def again(rows: np.ndarray, entries: np.ndarray, group: np.ndarray, moved: np.ndarray, code: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest entries after the entries have moved, the new bounds, and how many distances beside the own were measured."""
    n_groups = lower.shape[1]
    drift = np.array([moved[group == g].max(initial=0) for g in range(n_groups)])
    lower = _below(lower) - drift * (1 + SLACK)
    own = ((rows - entries[code]) ** 2).sum(1)
    reach = np.sqrt(own) * (1 + SLACK)
    failed = lower <= reach[:, None]
    best, at, measured = own.copy(), code.copy(), 0
    scans = []
    for g in range(n_groups):
        members, hit = np.flatnonzero(group == g), np.flatnonzero(failed[:, g])
        if not len(members) or not len(hit):
            continue
        squares = _squares(rows[hit], entries[members])
        measured += squares.size
        pick = squares.argmin(1)
        least, entry = squares[np.arange(len(hit)), pick], members[pick]
        better = (least < best[hit]) | ((least == best[hit]) & (entry < at[hit]))
        best[hit[better]], at[hit[better]] = least[better], entry[better]
        scans.append((g, members, hit, squares))
    # Bounds leave out the entry that is the row's own now; the one it has left counts in its group.
    left = np.flatnonzero(at != code)
    was = group[code[left]]
    lower[left, was] = np.minimum(lower[left, was], _below(np.sqrt(own[left])))
    for g, members, hit, squares in scans:
        distance = np.sqrt(squares)
        distance[members[None] == at[hit][:, None]] = np.inf
        lower[hit, g] = _below(distance.min(1))
    return at, lower, measured


def _state(vec_ids: pa.Array, labels: pa.Array, vectors: np.ndarray, codes: np.ndarray, lower: np.ndarray) -> pa.RecordBatch:
    def flat(rows: np.ndarray, kind: str) -> pa.Array:
        raw = rows.reshape(len(vec_ids), -1).astype(kind)
        return pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1] * raw.itemsize), len(raw), [None, pa.py_buffer(raw.tobytes())]).cast(pa.binary())

    columns = [vec_ids, labels, flat(vectors, "<i4"), flat(codes, "u1"), flat(lower, "<f8"), pa.nulls(len(vec_ids), pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "part", "code", "lower", "sums"])


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _assigned(books: Codebooks, first: bool):
    """One round over a task's rows; a last row holds its sums and counts per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, width = books.entries.shape
        n_groups = int(books.group.max()) + 1
        sums, counts = np.zeros(books.entries.shape, np.int64), np.zeros((parts, size), np.int64)
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                vectors = _matrix(batch.column("part"), "<i4").astype(np.int64).reshape(-1, parts, width)
                codes, bounds = np.zeros((len(vectors), parts), np.int64), np.zeros((len(vectors), parts, n_groups))
                if not first:
                    codes[:] = _matrix(batch.column("code"), "u1")
                    bounds[:] = _matrix(batch.column("lower"), "<f8").reshape(bounds.shape)
                for p in range(parts):
                    rows, entries, group = vectors[:, p], books.entries[p], books.group[p]
                    if first:
                        codes[:, p], bounds[:, p] = search(rows, entries, group, n_groups)
                    else:
                        codes[:, p], bounds[:, p], _ = again(rows, entries, group, books.moved[p], codes[:, p], bounds[:, p])
                    sums[p] += (codes[:, p] == np.arange(size)[:, None]).astype(np.int64) @ rows
                    counts[p] += np.bincount(codes[:, p], minlength=size)
                yield _state(batch.column("vec_id"), batch.column("label"), vectors, codes, bounds)
        total = pa.array([np.concatenate([sums.ravel(), counts.ravel()]).astype("<i8").tobytes()], pa.binary())
        empty = [pa.nulls(1, kind) for kind in (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, total], names=["vec_id", "label", "part", "code", "lower", "sums"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for raw in batch.column("sums").to_pylist():
            each = np.frombuffer(raw, "<i8")
            total = each if total is None else total + each
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], names=["at", "n"])


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kept vectors as integers, in the order of the table."""
    for batch in batches:
        vectors = batch.column("vector")
        sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0))
        ends = np.cumsum(sizes)
        values = np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), np.nan))
        finite = np.isfinite(values)
        bad = np.diff(np.cumsum(np.append(0, ~finite))[np.append(0, ends)])
        keep = np.flatnonzero(np.asarray(vectors.is_valid()) & (bad == 0))
        values = np.where(finite, values, 0)
        large = np.diff(np.cumsum(np.append(0, np.abs(values) >= LARGEST))[np.append(0, ends)])
        if large[keep].any():
            raise ValueError(f"components must be below {LARGEST}")
        values = np.floor(np.clip(values, -LARGEST, LARGEST) * SCALE).astype("<i4")
        rows = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(np.append(0, 4 * ends).astype("<i4")), pa.py_buffer(values)])
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("label").take(at), rows.take(at)], names=["vec_id", "label", "part"])


CODES = "vec_id long, label string, code string, error long, codebooks_sha256 string"


def codes(scratch: Scratch, vectors: DataFrame, vector: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error and codebooks_sha256 of every kept vector, and the codebooks (parts x entries x width).

    ``code`` has two hexadecimal digits for each part, so ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col(vector).alias("vector"))
    now = scratch.keep(rows.mapInArrow(_integers, "vec_id long, label string, part binary"), "integers")
    widths = now.agg(F.min(F.length("part")).alias("least"), F.max(F.length("part")).alias("most")).first()
    if widths.least is None:
        return now.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit("").alias("codebooks_sha256")), np.zeros((parts, 0, 0), np.int64)
    if widths.least != widths.most or not widths.least or widths.least // 4 % parts:
        raise ValueError(f"vectors of {widths.least // 4} to {widths.most // 4} components do not fall into {parts} equal parts")
    width = widths.least // 4
    smallest = now.orderBy(F.col("vec_id").asc_nulls_last(), "part").limit(entries).collect()
    books = Codebooks.start(np.array([np.frombuffer(row.part, "<i4") for row in smallest], np.int64), parts, groups)
    for turn in range(rounds + 1):
        before, now = now, scratch.keep(now.mapInArrow(_assigned(books, turn == 0), STATE), f"state-{turn}")
        scratch.drop(f"state-{turn - 1}" if turn else "integers")
        if turn < rounds:
            totals = now.where("sums IS NOT NULL").select("sums").mapInArrow(_add, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
            flat = np.zeros(books.entries.size + books.entries.shape[0] * books.entries.shape[1], np.int64)
            flat[np.asarray(totals.column("at"))] = np.asarray(totals.column("n"))
            books = books.update(flat[: books.entries.size].reshape(books.entries.shape), flat[books.entries.size :].reshape(books.entries.shape[:2]))
        now = now.where("sums IS NULL").select("vec_id", "label", "part", "code", "lower")
    digest = books.digest()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = _matrix(batch.column("code"), "u1")
            nearest = books.entries[np.arange(parts), found]
            apart = _matrix(batch.column("part"), "<i4").astype(np.int64).reshape(-1, parts, width // parts) - nearest
            columns = [batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes().hex() for row in found]), pa.array((apart**2).sum((1, 2)))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([digest] * len(found))], names=["vec_id", "label", "code", "error", "codebooks_sha256"])

    return now.select("vec_id", "label", "part", "code").mapInArrow(coded, CODES), books.entries


def with_label_error(scratch: Scratch, coded: DataFrame) -> DataFrame:
    """Adds label_error, the errors of all rows with the same label added up.

    Errors are combined before they are shuffled. The sums of up to LABELS labels are broadcast; more are joined by
    label, where adaptive execution splits a frequent one.
    """
    coded = scratch.keep(coded, "coded")
    sums = scratch.keep(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"), "labels")
    sums = F.broadcast(sums) if sums.count() <= LABELS else sums.hint("merge")
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def oracle(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The same rows in SQL, by full search: one pair of steps for every round."""
    steps = f"""
WITH kept AS (
  SELECT vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND (SELECT bool_and(x IS NOT NULL AND isfinite(x)) FROM (SELECT unnest(embedding) AS x))
), v AS MATERIALIZED (
  SELECT vec_id, (i - 1) // (n // {parts}) AS part, (i - 1) % (n // {parts}) AS pos, floor(4096 * embedding[i]::DOUBLE)::BIGINT AS x
  FROM (SELECT vec_id, embedding, len(embedding) AS n, unnest(range(1, len(embedding) + 1)) AS i FROM kept)
), first_ones AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM kept ORDER BY vec_id LIMIT {entries}
), e0 AS MATERIALIZED (SELECT part, k, pos, x FROM v JOIN first_ones USING (vec_id))"""
    for turn in range(rounds + 1):
        steps += f""", a{turn} AS MATERIALIZED (
  SELECT vec_id, part, min(apart * {entries} + k) AS best FROM (
    SELECT v.vec_id, v.part, e.k, sum((v.x - e.x) * (v.x - e.x))::BIGINT AS apart FROM v JOIN e{turn} e ON e.part = v.part AND e.pos = v.pos GROUP BY v.vec_id, v.part, e.k
  ) GROUP BY vec_id, part
)"""
        if turn < rounds:
            steps += f""", e{turn + 1} AS MATERIALIZED (
  SELECT e.part, e.k, e.pos, coalesce(m.x, e.x) AS x FROM e{turn} e LEFT JOIN (
    SELECT v.part, a.best % {entries} AS k, v.pos, floor(sum(v.x)::DOUBLE / count(*))::BIGINT AS x
    FROM v JOIN a{turn} a ON a.vec_id = v.vec_id AND a.part = v.part GROUP BY v.part, a.best % {entries}, v.pos
  ) m ON m.part = e.part AND m.k = e.k AND m.pos = e.pos
)"""
    return f"""{steps}, coded AS (
  SELECT vec_id, string_agg(printf('%02x', (best % {entries})::INT), '' ORDER BY part) AS code, sum(best // {entries})::BIGINT AS error FROM a{rounds} GROUP BY vec_id
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(x::VARCHAR, ',' ORDER BY part, k, pos)) FROM e{rounds}) AS codebooks_sha256
FROM coded JOIN kept USING (vec_id)
"""


def op12_yinyang_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op12")
    found = with_label_error(scratch, codes(scratch, table(spark, sf_dir, "embeddings"))[0])
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
