"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated.

1. Every text becomes STATISTICS numbers in one narrow pass.
2. Standardised statistics pass through FEATURES random cosines, which approximate a Gaussian kernel; the
   statistics themselves and a constant are kept beside them.
3. Each partition of labelled rows sums its normal equations, separately for FOLDS folds by doc_id. The sums
   are all that reaches the driver, which solves the ridge system for all folds and for all but each one.
4. Each row is scored by the system that left its fold out; isotonic regression (pooling adjacent violators)
   turns those scores into shares of label 1. Between its steps the curve is linear.

The labelled rows that are learned from are bounded: MOST_LABELLED, taken evenly by a hash of doc_id. Rows
whose crc32 of doc_id is 0 mod 5 are never learned from. Labels, lang, source and doc_id are no inputs.

Edge cases: null and empty texts have statistics of zero and get a score like any other. Rows with a null
doc_id are scored, and not held out. A document with several labels counts once for each. Without any label,
or with one class only, every score is the share of label 1 (0.5 if there is none). An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportloom.llm.quality_rules import repeated_words
from reportloom.llm.runtime import as_bytes, materialize

FEATURES = 256
FOLDS = 4
MOST_LABELLED = 200_000
# Partitions of labelled rows, each of which sends one set of sums to the driver.
SUMS = 16
RIDGE = 1.0
SEED = 5
THRESHOLD = 0.3
# Share of the score that keeps the order within steps of the calibration.
ORDER = 0.001

_UPPER, _LOWER, _DIGIT = slice(65, 91), slice(97, 123), slice(48, 58)
STATISTICS = 22


def statistics(text: bytes | None) -> list[float]:
    """STATISTICS numbers about a UTF-8 text."""
    if not text:
        return [0.0] * STATISTICS
    n = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    w, b = max(1, len(words)), len(text)
    letters = int(n[_UPPER].sum() + n[_LOWER].sum())
    lines = text.split(b"\n")
    p = n[n > 0] / b
    top = len(max(words, key=len)) if words else 0
    different = set(words)
    return [
        np.log1p(b), np.log1p(len(words)), float(lengths.mean()), float(lengths.std()), np.log1p(top),
        len(different) / w, repeated_words(words) / w, n[_UPPER].sum() / max(1, letters), n[_DIGIT].sum() / b,
        n[33] / w, n[63] / w, (n[46] + n[44]) / w, n[124] / w, n[[35, 36, 37, 38, 42]].sum() / w, n[[60, 62, 123, 125, 91, 93]].sum() / w,
        n[128:].sum() / b, n[[32, 9, 10, 13]].sum() / b, float(-(p * np.log2(p)).sum()),
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(b / len(lines)), n[[34, 39, 40, 41, 58, 59, 45, 95, 61, 64]].sum() / w,
    ]


def measured(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and stats of every row."""

    def run(batches):
        for batch in batches:
            stats = np.array([statistics(t) for t in as_bytes(batch.column(1))], np.float64).reshape(-1, STATISTICS)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, stats.size + 1, STATISTICS, dtype=np.int32)), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["doc_id", "stats"])

    return materialize(docs.select(F.col(doc_id).cast("long").alias("doc_id"), text).mapInArrow(run, "doc_id long, stats array<double>"), "statistics")


def remainder(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def expand(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """A constant, the standardised statistics and FEATURES random cosines for each row."""
    rng = np.random.default_rng(SEED)
    x = np.clip((stats - mean) / scale, -6, 6)
    width = 1 / np.sqrt(2 * stats.shape[1])
    z = np.cos(x @ rng.normal(0, width, (stats.shape[1], FEATURES)) + rng.uniform(0, 2 * np.pi, FEATURES)) * np.sqrt(2 / FEATURES)
    return np.hstack([np.ones((len(x), 1)), x, z])


def _rows(batch: pa.RecordBatch, column: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (place, share of label 1) of the increasing curve closest to y over x."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for a, b in zip(x[order].tolist(), y[order].tolist(), strict=True):
        blocks.append([b, 1, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


class Model:
    """mean, scale: of the statistics. weights: of all folds. steps: the calibration."""

    def __init__(self, mean, scale, weights, steps, share):
        self.mean, self.scale, self.weights, self.steps, self.share = mean, scale, weights, steps, share

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), self.share)
        raw = expand(stats, self.mean, self.scale) @ self.weights
        return np.clip((1 - ORDER) * np.interp(raw, *self.steps) + ORDER / (1 + np.exp(-np.clip(8 * (raw - 0.5), -50, 50))), 0, 1)


def fit(stats: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """The model of all labelled rows that aren't held out."""
    known = labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("double").alias("y")).filter("y is not null")
    rows = stats.join(known, F.col("doc_id") == F.col("__id")).filter(remainder(F.col("doc_id")) != 0)
    rows = materialize(rows.select("doc_id", "stats", "y", (remainder(F.col("doc_id")) - 1).cast("int").alias("fold")), "labelled")
    n, share, low, high = rows.agg(F.count(F.lit(1)), F.avg("y"), F.min("y"), F.max("y")).first()
    if not n or low == high:
        return Model(None, None, None, None, 0.5 if share is None else float(share))
    if n > MOST_LABELLED:
        rows = rows.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1_000_000)) < int(1_000_000 * MOST_LABELLED / n))
    rows = rows.coalesce(SUMS)
    each = [F.col("stats")[k] for k in range(STATISTICS)]
    moments = rows.agg(*[F.avg(c) for c in each], *[F.stddev_pop(c) for c in each]).first()
    mean, scale = np.array(moments[:STATISTICS]), np.array(moments[STATISTICS:])
    scale = np.where(scale > 1e-9, scale, 1.0)
    size = 1 + STATISTICS + FEATURES

    def sums(batches):
        a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
        for batch in batches:
            z, y, fold = expand(_rows(batch, 1), mean, scale), batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for k in range(FOLDS):
                own = z[fold == k]
                a[k] += own.T @ own
                b[k] += own.T @ y[fold == k]
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes() + b.tobytes()], pa.binary())], names=["sums"])

    a, b = np.zeros((FOLDS, size, size)), np.zeros((FOLDS, size))
    for row in rows.mapInArrow(sums, "sums binary").toLocalIterator():
        part = np.frombuffer(bytes(row[0]))
        a += part[: a.size].reshape(a.shape)
        b += part[a.size :].reshape(b.shape)
    penalty = RIDGE * np.eye(size)
    penalty[0, 0] = 1e-6
    solve = lambda use: np.linalg.solve(a[use].sum(0) + penalty, b[use].sum(0))
    others = np.array([solve([j for j in range(FOLDS) if j != k]) for k in range(FOLDS)])

    def left_out(batches):
        for batch in batches:
            z, fold = expand(_rows(batch, 1), mean, scale), batch.column(3).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array((z * others[fold]).sum(1)), batch.column(2)], names=["raw", "y"])

    # bounded by MOST_LABELLED
    scored = rows.mapInArrow(left_out, "raw double, y double").toPandas()
    return Model(mean, scale, solve(list(range(FOLDS))), isotonic(scored["raw"].to_numpy(), scored["y"].to_numpy()), float(share))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    stats = measured(docs, text, doc_id)
    model = fit(stats, labels, label)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_rows(batch, 1)))], names=["doc_id", "score"])

    scored = stats.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
