"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

A pass over the texts makes a dozen statistics of each (shares under a square root, counts under a logarithm, both
smoothed so that short texts don't look extreme). Class means and covariances are sums, so Spark aggregates them over
all labelled rows outside the held-out fold; nothing is sampled. Covariances are shrunk towards the pooled one and then
towards a multiple of the identity. The score is the posterior from the difference of the two Gaussian log-densities,
whose Mahalanobis terms come from Cholesky factors made once.

Nulls and edges: a null text is empty; empty texts get the score of their statistics; a null id has no label; without
labels of both classes every score is the share of label 1 (1 without any); classes with equal statistics give that share
too. Extra columns are ignored or, in `keep_good`, kept; repeated rows are scored each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import tokens
from tessera.llm.common import Scratch, held_out, training_labels

#: Shrinkage towards the pooled covariance, then towards a multiple of the identity, and a least part of it, which keeps
#: classes without any variance (all texts equal or empty) apart from singular.
POOLED, RIDGE, LEAST = 0.4, 0.1, 1e-4
THRESHOLD = 0.7

FEATURES = (
    "log_words", "word_length", "upper", "digits", "symbols", "exclamations", "full_stops",
    "commas", "variety", "repeated_lines", "line_length", "short_words", "pair_variety",
)


def _bytes_in(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars.encode())] = 1
    return out


_UPPER = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _UPPER + _bytes_in("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _bytes_in("0123456789")
_SYMBOL = _bytes_in("#$%&*+/<=>@[\\]^_`{|}~")
_SPACE = _bytes_in(" \t\n\v\f\r")


def statistics(text: str) -> list[float]:
    """The transformed statistics of one whole text, in the order of FEATURES."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    # In UTF-8 each letter from U+00C0 to U+00FF is byte 0xC3 and a second one, capitals below 0x9F.
    accented, capitals = int(count[0xC3]), sum(raw.count(bytes((0xC3, b))) for b in range(0x80, 0x9F)) if count[0xC3] else 0
    words = raw.lower().split()
    n, letters = len(words), int(count @ _LETTER) + accented
    chars = len(text) - int(count @ _SPACE)
    lines = [x for x in (y.strip() for y in raw.split(b"\n")) if x]
    pairs = len(set(zip(words, words[1:])))
    share = lambda part, of, prior, weight: math.sqrt((part + prior * weight) / (of + weight))
    return [
        math.log1p(n),
        math.log((chars + 50) / (n + 10)),
        share(int(count @ _UPPER) + capitals, letters, 0.02, 100),
        share(int(count @ _DIGIT), chars, 0.002, 100),
        share(int(count @ _SYMBOL), chars, 0.002, 100),
        share(int(count[0x21]), n, 0.005, 20),
        share(int(count[0x2E]), n, 0.1, 20),
        share(int(count[0x2C]), n, 0.08, 20),
        math.log((len(set(words)) + 10) / (n + 10)),
        share(len(lines) - len(set(lines)), len(lines), 0.0, 20),
        math.log((n + 10) / (len(lines) + 1)),
        share(sum(len(w) <= 3 for w in words), n, 0.3, 20),
        math.log((pairs + 20) / (max(n - 1, 0) + 20)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x array<double>) of every row."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            x = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(measure, "doc_id long, x array<double>")


@dataclass
class Model:
    """Two Gaussians over standardised statistics; `factors` are the inverse Cholesky factors of their covariances."""

    centre: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    factors: list[np.ndarray]
    offsets: list[float]  # log prior less half the log determinant
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None or not len(x):
            return np.full(len(x), self.constant if self.constant is not None else 0.0)
        z = (x - self.centre) / self.scale
        low, high = (o - 0.5 * (((z - m) @ f.T) ** 2).sum(1) for m, f, o in zip(self.means, self.factors, self.offsets))
        return 1 / (1 + np.exp(np.clip(low - high, -700, 700)))


def fit(x: DataFrame, labels: DataFrame, column: str = "quality") -> Model:
    """From (doc_id, x) and labels: one aggregate, two rows of sums to the driver."""
    p = len(FEATURES)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    at = [F.col("x")[i] for i in range(p)]
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(at[i]).alias(f"s{i}") for i in range(p)], *[F.sum(at[i] * at[j]).alias(f"s{i}_{j}") for i, j in pairs]]
    rows = {r["label"]: r for r in x.join(training_labels(labels, column), "doc_id").groupBy("label").agg(*sums).collect()}
    n = [rows[k]["n"] if k in rows else 0 for k in (0, 1)]
    if min(n) < 2:
        return Model(np.zeros(p), np.ones(p), [], [], [], n[1] / sum(n) if sum(n) else 1.0)
    mean, cov = [], []
    for k in (0, 1):
        m = np.array([rows[k][f"s{i}"] for i in range(p)]) / n[k]
        s = np.zeros((p, p))
        for i, j in pairs:
            s[i, j] = s[j, i] = rows[k][f"s{i}_{j}"] / n[k] - m[i] * m[j]
        mean.append(m)
        cov.append(s)
    total = sum(n)
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / total
    scale = np.sqrt(np.maximum(np.diag(pooled), 1e-8))
    centre = (n[0] * mean[0] + n[1] * mean[1]) / total
    unit = np.outer(scale, scale)
    means, factors, offsets = [], [], []
    for k in (0, 1):
        s = ((1 - POOLED) * cov[k] + POOLED * pooled) / unit
        s = (1 - RIDGE) * s + (RIDGE * np.trace(s) / p + LEAST) * np.eye(p)
        root = np.linalg.cholesky(s)
        means.append((mean[k] - centre) / scale)
        factors.append(np.linalg.inv(root))
        offsets.append(math.log(n[k] / total) - float(np.log(np.diag(root)).sum()))
    return Model(centre, scale, means, factors, offsets)


def scored(x: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) from (doc_id, x)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(flat))], names=["doc_id", "score"])

    return x.mapInArrow(run, "doc_id long, score double")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    with Scratch(docs.sparkSession) as s:
        x = s.out(features(docs), "quality-features")
        model = fit(x, labels)
    return scored(x, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier accepts, columns as they are."""
    with Scratch(docs.sparkSession) as s:
        model = fit(s.write(features(docs), "quality-features"), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens.forget()
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column("text")]).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
