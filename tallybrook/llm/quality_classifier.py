"""Operator 2: a kernel classifier of document quality.

Random Fourier features approximate a Gaussian kernel over statistics of the whole text. Each task
sums its part of the normal equations; the sums are added in a tree, and the ridge weights
solved from one small matrix. Isotonic regression over a fixed number of score bins makes
the scores probabilities of label 1.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybrook.llm.common import bytes_of, crc_mod, documents, saved, tree_sum, with_row_id

FEATURES = 256
RIDGE = 1e-3
BINS = 1024
SEED = 20
THRESHOLD = 0.3

_SYMBOLS, _UPPER, _DIGITS, _LOWER = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(97, 123))
_PAUSE, _STOP, _OTHER, _HIGH = b",;:", b".", b"!?@/\\=+~^_{}[]()\"'-", bytes(range(128, 256))
STATISTICS = 20


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text: sizes as logarithms, the rest as shares; all 0 for an empty one."""
    size = len(text)
    words = text.split()
    if not words:
        return [0.0] * STATISTICS
    share = lambda kind: (size - len(text.translate(None, kind))) / size
    lines = [x for x in text.split(b"\n") if x.strip()]
    counts = Counter(words)
    n = len(words)
    top = counts.most_common(1)[0][1]
    pairs = len(set(zip(words, words[1:], strict=False)))
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    return [
        np.log1p(n), np.log1p(len(lines)), np.log1p(n / len(lines)), lengths.mean(), lengths.std(),
        share(_SYMBOLS), share(_UPPER), share(_DIGITS), share(_LOWER), share(_PAUSE), share(_STOP), share(_OTHER), share(_HIGH),
        len(counts) / n, top / n, 1 - len(set(lines)) / len(lines), 1 - pairs / max(1, n - 1) if n > 1 else 0.0, 1 - triples / max(1, n - 2) if n > 2 else 0.0,
        np.log(len(counts)) / np.log(n + 1), 1.0,
    ]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.asarray([statistics(t) for t in bytes_of(batch)], dtype=np.float64).reshape(batch.num_rows, STATISTICS)
        values = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), STATISTICS).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("held_out"), values], ["row", "doc_id", "held_out", "stats"])


class KernelMap:
    """Standardised statistics to random Fourier features of a Gaussian kernel, and a constant."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int = SEED, width: float | None = None):
        draw = np.random.default_rng(seed)
        width = width or np.sqrt(2.0 * len(mean))
        self.mean, self.scale = mean, scale
        self.directions, self.shifts = draw.normal(size=(len(mean), features)) / width, draw.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.sqrt(2.0 / len(self.shifts)) * np.cos(z @ self.directions + self.shifts)
        return np.hstack([waves, np.ones((len(z), 1))])


def _stats(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, STATISTICS)


def isotonic(means: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the closest non-decreasing values."""
    pools: list[list[float]] = []
    for m, w in zip(means, weights, strict=True):
        pools.append([m, w, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            m2, w2, n2 = pools.pop()
            m1, w1, n1 = pools[-1]
            pools[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.concatenate([np.full(n, m) for m, _, n in pools])


class Scorer:
    def __init__(self, kernel: KernelMap, weights: np.ndarray, knots: np.ndarray, values: np.ndarray):
        self.kernel, self.weights, self.knots, self.values = kernel, weights, knots, values

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        raw = self.kernel(stats) @ self.weights
        # calibrated, with a trace of the raw score so that order is kept within a pool
        return np.clip(np.interp(raw, self.knots, self.values) * (1 - 1e-3) + 1e-3 * np.clip((raw + 0.5) / 2, 0, 1), 0.0, 1.0)


def fit(train: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Scorer:
    """From rows of stats and quality (0 or 1). Without any row, every score is 0.5."""
    first = tree_sum(train, lambda b: np.concatenate([[b.num_rows], _stats(b).sum(axis=0), (_stats(b) ** 2).sum(axis=0)]), 2 * STATISTICS + 1)
    n = max(first[0], 1.0)
    mean = first[1 : STATISTICS + 1] / n
    scale = np.sqrt(np.maximum(first[STATISTICS + 1 :] / n - mean**2, 0))
    kernel = KernelMap(mean, np.where(scale > 1e-9, scale, 1.0), features, seed)
    m = features + 1

    def equations(batch: pa.RecordBatch) -> np.ndarray:
        x, y = kernel(_stats(batch)), batch.column("quality").to_numpy().astype(np.float64)
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    sums = tree_sum(train, equations, m * m + m)
    penalty = np.full(m, ridge * n)
    penalty[-1] = 1e-9
    weights = np.linalg.solve(sums[: m * m].reshape(m, m) + np.diag(penalty + 1e-12), sums[m * m :])
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        raw, y = kernel(_stats(batch)) @ weights, batch.column("quality").to_numpy().astype(np.float64)
        at = np.clip(np.searchsorted(edges, raw) - 1, 0, BINS - 1)
        return np.concatenate([np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS), np.bincount(at, weights=raw, minlength=BINS)])

    count, good, total = tree_sum(train, binned, 3 * BINS).reshape(3, BINS)
    used = count > 0
    if not used.any():
        return Scorer(kernel, weights, np.array([0.0]), np.array([0.5]))
    return Scorer(kernel, weights, total[used] / count[used], isotonic(good[used] / count[used], count[used]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, folds: int = 5) -> DataFrame:
    """row, doc_id, held_out, score and predicted of every row of `docs`, which has to be a table scan.

    Learns from labelled rows whose crc32(doc_id as text) modulo `folds` is not 0. Null and empty texts
    get the score of zero statistics. Rows with null ids are scored, but have no label; a document with
    several labels is learnt from once for each, null labels are left out. Repeated rows are scored
    each for itself. An empty table gives no rows; without labels every score is near 0.5. Only doc_id and
    text are read. `row` numbers the rows as with_row_id() does.
    """
    docs = with_row_id(docs, "row", ["doc_id", "text"]).select("row", "doc_id", "text", (crc_mod("doc_id", folds) == 0).alias("held_out"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    measured = saved(docs.mapInArrow(_measure, f"row long, doc_id {kind}, held_out boolean, stats array<double>"), "statistics")
    marked = labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where("quality is not null and doc_id is not null")
    train = saved(measured.where(~F.col("held_out")).join(marked, "doc_id").select("stats", "quality"), "labelled")
    sent = docs.sparkSession.sparkContext.broadcast(fit(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # rounded, so that the order in which sums were added does not show
            score = np.round(sent.value(_stats(batch)), 9) if batch.num_rows else np.zeros(0)
            predicted = pa.array((score >= threshold).astype(np.int32))
            columns = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(score), predicted]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "score", "predicted"])

    return measured.mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, score double, predicted int")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("row")
