"""A quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a few statistics (shares of capitals, symbols, repeated words and so on), as logarithms of
smoothed ratios, which makes them roughly normal and short texts unremarkable. Each class is a normal distribution
with its own mean and covariance; the covariance is shrunk towards a multiple of the identity (by the
oracle-approximating amount, ``LEAST_SHRINKAGE`` at least), so that a statistic that never varies in a class, or a class
with few documents, gives no degenerate density. The score is the logistic function of the difference of the log
densities, each a Mahalanobis distance through the inverse Cholesky factor that the model keeps, and of the classes' shares.

The fit takes all labelled rows: counts, sums and sums of products are gathered in each task, and a row for each class
and pair of statistics reaches the driver. Statistics are fixed-point numbers and their sums exact, so that the same
rows give the same model in any order and partitioning.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Statistics are whole multiples of 1 / UNIT.
UNIT = 1 << 12

#: Covariances are shrunk by this share at least.
LEAST_SHRINKAGE = 0.05

#: From this score on a document is predicted to have label 1.
THRESHOLD = 0.3

UPPER, DIGITS, SYMBOLS, MARKS, ENDS = common.UPPER.encode(), b"0123456789", b"#$%&*|<>{}[]\\^~_=+@/", b".,;:!?'\"-()", b".!?"
LETTERS = UPPER + UPPER.lower() + bytes(range(128, 256))
BEYOND = bytes(range(128, 256))

STATISTICS = ("words", "word_length", "distinct", "capitals", "digits", "symbols", "marks", "beyond_ascii", "again", "lines_again", "ends")


def odds(some: int, of: int, smooth: float) -> float:
    return math.log((some + 0.5) / (of - some + 0.5 + smooth))


def statistics(text: str) -> list[int]:
    """The statistics of a text, in ``UNIT``s, in the order of ``STATISTICS``. Whole texts, in time linear in their length."""
    data = text.encode()
    n, words = len(data), data.split()
    k = len(words)

    def share(chars: bytes, of: int) -> float:
        return odds(n - len(data.translate(None, chars)), of, 30)

    lines = [line for line in data.split(b"\n") if line.strip()]
    values = (
        math.log1p(k),
        math.log((n + 60) / (k + 10)),
        math.log((len(set(words)) + 20) / (k + 20)),
        share(UPPER, n - len(data.translate(None, LETTERS))),
        share(DIGITS, n),
        share(SYMBOLS, n),
        share(MARKS, n),
        share(BEYOND, n),
        odds(sum(map(bytes.__eq__, words, words[1:])), max(0, k - 1), 8),
        odds(len(lines) - len(set(lines)), len(lines), 4),
        math.log((n - len(data.translate(None, ENDS)) + 2) / (k + 20)),
    )
    return [round(v * UNIT) for v in values]


def with_statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and stats of each document; null text counts as empty. Texts stay where they are."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = [statistics(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.int32()))], ["id", "stats"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, stats array<int>")


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.int64)


def moments(rows: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """Label to (count, sums, sums of products) of ``rows`` (label, stats), exactly."""
    d = len(STATISTICS)
    upper = np.triu_indices(d)

    def run(batches):
        for batch in batches:
            labels, x = batch.column(0).to_numpy(), matrix(batch.column(1))
            out = []
            for label in np.unique(labels).tolist():
                own = x[labels == label]
                sums = np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own)[upper]])
                out += [(label, k, int(s)) for k, s in enumerate(sums)]
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], ["label", "k", "s"])

    parts = rows.select(F.col("label").cast("int"), "stats").mapInArrow(run, "label int, k int, s long")
    found: dict[int, dict[int, int]] = {}
    for label, k, s in parts.groupBy("label", "k").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(label, {})[k] = int(s)
    out = {}
    for label, own in found.items():
        products = [[0] * d for _ in range(d)]
        for k, (i, j) in enumerate(zip(*(u.tolist() for u in upper), strict=True)):
            products[i][j] = products[j][i] = own[1 + d + k]
        out[label] = (own[0], [own[1 + i] for i in range(d)], products)
    return out


def covariance(count: int, sums: list[int], products: list[list[int]]) -> np.ndarray:
    d = len(sums)
    return np.array([[(products[i][j] * count - sums[i] * sums[j]) / (count * count * UNIT * UNIT) for j in range(d)] for i in range(d)])


def shrinkage(s: np.ndarray, n: int) -> float:
    """The oracle-approximating amount by which a covariance of ``n`` rows is shrunk."""
    p, square, trace = len(s), float((s * s).sum()), float(np.trace(s))
    above = (1 - 2 / p) * square + trace * trace
    below = (n + 1 - 2 / p) * (square - trace * trace / p)
    return 1.0 if below <= 0 else min(1.0, above / below)


@dataclass
class Gaussian:
    mean: np.ndarray
    whiten: np.ndarray  # the inverse of the Cholesky factor of the covariance
    constant: float  # log of the class's share, less the log of the factor's determinant

    def log_density(self, z: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * (((z - self.mean) @ self.whiten.T) ** 2).sum(axis=1)


@dataclass
class Model:
    """Two classes, or the share of label 1 where the rows have fewer."""

    centre: np.ndarray
    scale: np.ndarray
    classes: dict[int, Gaussian]
    share: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(stats), self.share)
        z = (stats / UNIT - self.centre) / self.scale
        log_odds = self.classes[1].log_density(z) - self.classes[0].log_density(z)
        return 1.0 / (1.0 + np.exp(-np.clip(log_odds, -500.0, 500.0)))


def fit(rows: DataFrame) -> Model:
    """A model of all ``rows`` (label 0 or 1, stats). With rows of one label only, it always says that one; without
    any, 0.5."""
    found = {k: v for k, v in moments(rows).items() if k in (0, 1)}
    total, d = sum(n for n, _, _ in found.values()), len(STATISTICS)
    if len(found) < 2:
        return Model(np.zeros(d), np.ones(d), {}, 0.5 if not found else float(next(iter(found))))
    sums = [sum(s[i] for _, s, _ in found.values()) for i in range(d)]
    products = [[sum(p[i][j] for _, _, p in found.values()) for j in range(d)] for i in range(d)]
    centre = np.array([s / (total * UNIT) for s in sums])
    scale = np.sqrt(np.maximum(np.diag(covariance(total, sums, products)), 0.0)) + 1e-3
    classes = {}
    for label, (n, own, squares) in found.items():
        s = covariance(n, own, squares) / np.outer(scale, scale)
        amount = max(LEAST_SHRINKAGE, shrinkage(s, n))
        # A class of equal rows has no variance of its own; it gets that of all rows.
        s = (1 - amount) * s + amount * (np.trace(s) / d or 1.0) * np.eye(d)
        factor = np.linalg.cholesky(s)
        mean = (np.array([x / (n * UNIT) for x in own]) - centre) / scale
        classes[label] = Gaussian(mean, np.linalg.inv(factor), math.log(n / total) - float(np.log(np.diag(factor)).sum()))
    return Model(centre, scale, classes, found[1][0] / total)


def predict(stats: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``stats`` (id, stats) with score and predicted instead of the statistics."""
    kind = stats.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            score = model.score(matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    return stats.select("id", "stats").mapInArrow(run, f"id {kind}, score double, predicted int")


def held_out(id_column: Column) -> Column:
    """Whether the crc32 of the id as text is divisible by 5. A null id is not held out."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """``id_col``, held_out, score (0 to 1) and predicted (1 from ``threshold`` on) of every document.

    Learned from the documents with a label 0 or 1 in ``labels`` (``id_col``, ``label_col``) that aren't held out; each row
    of ``docs`` with such an id counts, and ids with both labels count for both. Other labels, null labels and null ids teach nothing.
    Null text counts as empty; empty texts get the score of their statistics. Rows of equal text get equal scores.
    A text of any length is one row of statistics. One label alone: its value for all; none: 0.5. No rows: none out.
    Other columns are not read.
    """
    stats = common.cut_lineage(with_statistics(docs, id_col=id_col, text_col=text_col))
    said = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label")).where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
    model = fit(stats.join(said.distinct().hint("merge"), "id"))
    out = predict(stats, model, threshold)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", "predicted")
