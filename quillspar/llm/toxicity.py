"""Toxicity by a character n-gram linear classifier over naive Bayes log-count ratios.

Features are the distinct hashed character n-grams of the lower-cased whole
text. The ratio r = log(p) - log(q) compares the smoothed shares of toxic and
of clean training texts that hold an n-gram; the classifier is a logistic
regression on the features scaled by r, so its weights start where naive Bayes
stands and are corrected by the labels. N-grams whose shares differ by less
than ``least_z`` standard errors carry no weight: over a long text thousands of
them would add up to noise. All others do; the fit holds only the places that
the sample's texts fill, so it grows with them and not with texts x features.

Counts, features and scores are made by tasks over whole texts. The driver
receives counts by feature number (2**bits at most) and, of a training sample
of bounded size, the numbers of the weighted features.

Defined results: a null text counts as empty; an empty text gets the score of
the bias alone; a null doc_id is not held out; null labels are not read, and of
several labels of a document the largest holds; repeated rows are scored row by
row; without labels of both classes every score is the share of toxic labels
(0 without any). Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspar.llm.common import small_batches, table
from quillspar.llm.shingles import U64, mix


@dataclass(frozen=True)
class Settings:
    """``max_train`` bounds the labelled rows of the fit, drawn by a hash of their id."""

    orders: tuple[int, ...] = (3, 4, 5, 6)
    bits: int = 18
    alpha: float = 0.5
    least_z: float = 4.0
    max_train: int = 6000
    ridge: float = 1e-3
    rounds: int = 300


@dataclass
class Model:
    """``slot[feature]`` is the feature's place in ``weights``, or -1."""

    settings: Settings
    slot: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str) -> float:
        found = np.unique(weighted(text, self.settings, self.slot))
        margin = float(self.weights[found].sum()) + self.bias
        return float(1 / (1 + np.exp(-np.clip(margin, -40, 40))))


def grams(text: str, settings: Settings) -> Iterator[np.ndarray]:
    """For each order, the feature numbers of all n-grams of the text, repeats included."""
    plain = " " + " ".join(text.lower().split()) + " "
    codes = np.frombuffer(plain.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    spread, run, size = mix(codes + U64(1)), np.zeros(len(codes), np.uint64), 0
    shift = U64(64 - settings.bits)
    for n in settings.orders:
        for size in range(size, n):
            keep = max(0, len(codes) - size)
            run = run[:keep] * U64(0x100000001B3) + spread[size:]
        size = n
        yield ((run ^ (run >> U64(29))) * U64(0x9E3779B97F4A7C15 + 2 * n) >> shift).astype(np.int64)


def weighted(text: str, settings: Settings, slot: np.ndarray) -> np.ndarray:
    """Places of the weighted features of the text, repeats included."""
    found = [places[places >= 0] for places in (slot[numbers] for numbers in grams(text, settings))]
    return np.concatenate(found) if found else np.empty(0, slot.dtype)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [text or "" for text in batch.column("text").to_pylist()]


def training_rows(documents: DataFrame, labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """(text, label) of the sample. Its size is bounded, so its ids are broadcast."""
    marked = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.max(F.col(label)).cast("int").alias("label"))
    )
    rows = marked.count()
    if rows > settings.max_train:
        share = F.lit(settings.max_train / rows)
        marked = marked.where((F.xxhash64("doc_id", F.lit("sample")) / F.lit(2.0**64) + 0.5) < share)
    return documents.select("doc_id", "text").join(F.broadcast(marked), "doc_id").select("text", "label")


def _count(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << settings.bits), np.int64)
        sizes = np.zeros(2, np.int64)
        seen = np.zeros(1 << settings.bits, bool)
        for batch in small_batches(batches, "text", 4 << 20):
            for text, label in zip(_texts(batch), batch.column("label").to_pylist(), strict=True):
                for numbers in grams(text, settings):
                    seen[numbers] = True
                found = np.flatnonzero(seen)
                seen[found] = False
                counts[int(label > 0)][found] += 1
                sizes[int(label > 0)] += 1
        found = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(found, -1)), pa.array(np.append(counts[1][found], sizes[1])), pa.array(np.append(counts[0][found], sizes[0]))],
            names=["feature", "toxic", "clean"],
        )

    return run


def _features(settings: Settings, slot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 4 << 20):
            packed = [np.unique(weighted(text, settings, slot)).astype("<u4").tobytes() for text in _texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "features"])

    return run


def fit(documents: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings()) -> Model:
    """Fits the classifier to the labelled rows outside the held-out fold."""
    train = training_rows(documents, labels, label, settings)
    counted = (
        train.mapInArrow(_count(settings), "feature long, toxic long, clean long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .toArrow()
    )
    feature, toxic, clean = (np.asarray(counted.column(c)).astype(np.int64) for c in ("feature", "toxic", "clean"))
    n_toxic, n_clean = (int(side[feature == -1].sum()) for side in (toxic, clean))
    slot = np.full(1 << settings.bits, -1, np.int32)
    prior = n_toxic / max(1, n_toxic + n_clean)
    bias = float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9)))
    if not n_toxic or not n_clean:
        return Model(settings, slot, np.zeros(0), bias)
    held = feature >= 0
    feature, toxic, clean = feature[held], toxic[held], clean[held]
    ratio = np.log((toxic + settings.alpha) / (n_toxic + 2 * settings.alpha)) - np.log((clean + settings.alpha) / (n_clean + 2 * settings.alpha))
    share = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    z = np.abs(toxic / n_toxic - clean / n_clean) / np.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    order = np.lexsort((feature, -z))
    order = order[z[order] >= settings.least_z]
    slot[feature[order]] = np.arange(len(order), dtype=np.int32)
    packed = train.mapInArrow(_features(settings, slot), "label int, features binary").toArrow()
    truth = (np.asarray(packed.column("label")) > 0).astype(np.float64)
    found = [np.frombuffer(row, "<u4").astype(np.int32) for row in packed.column("features").to_pylist()]
    rows = np.repeat(np.arange(len(found), dtype=np.int32), [len(row) for row in found])
    weights, bias = regress(rows, np.concatenate(found), ratio[order], truth, settings, bias)
    return Model(settings, slot, weights * ratio[order], bias)


def regress(rows: np.ndarray, places: np.ndarray, ratio: np.ndarray, truth: np.ndarray, settings: Settings, bias: float) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by accelerated gradient steps; each class has weight by the root of its size.

    Row ``rows[k]`` has the feature ``places[k]`` with the value
    ``ratio[places[k]]``; all others are zero.
    """
    n, width = len(truth), len(ratio)
    value = ratio[places]

    def times(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, value * x[places], n)

    def back(y: np.ndarray) -> np.ndarray:
        return np.bincount(places, value * y[rows], width)

    positive = max(1.0, float(truth.sum()))
    each = np.where(truth > 0, positive**-0.5, max(1.0, n - positive) ** -0.5)
    each /= each.sum()
    top, size = np.ones(width), 0.0
    for _ in range(20 if width else 0):
        top = back(each * times(top))
        size = float(np.linalg.norm(top)) or 1.0
        top /= size
    step = 1 / (0.3 * size + settings.ridge + 0.25)
    weights = ahead = np.zeros(width)
    bias_ahead, pace = bias, 1.0
    for _ in range(settings.rounds):
        error = each * (1 / (1 + np.exp(-np.clip(times(ahead) + bias_ahead, -40, 40))) - truth)
        moved = ahead - step * (back(error) + settings.ridge * ahead)
        moved_bias = bias_ahead - step * float(error.sum())
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = moved + (pace - 1) / faster * (moved - weights)
        bias_ahead = moved_bias + (pace - 1) / faster * (moved_bias - bias)
        weights, bias, pace = moved, moved_bias, faster
    return weights, float(bias)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8 << 20):
            score = np.array([model.score(text) for text in _texts(batch)], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    return run


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(_score(model), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, with all their columns, that the classifier does not call toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text", 8 << 20):
            yield batch.filter(pa.array([model.score(text) < 0.5 for text in _texts(batch)], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_documents(documents, fit(documents, table(spark, sf_dir, "labels")))
