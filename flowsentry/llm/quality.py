"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class is a normal density with its own mean and a covariance shrunk towards the pooled covariance and towards its
own diagonal. A score is the probability of label 1 from the difference of the log densities, whose Mahalanobis
distances come from Cholesky factors computed once after the fit. The moments of both classes are sums over rows, so
the fit uses every labelled row and moves a few hundred numbers per task.

Defined results: null text is the empty text and is scored like any other. Labels without a document are unused.
Rows repeated under one id are each scored, and each count in the fit. With no labelled row of a class, the prior
decides alone: the other class gets all rows (0.5 with no labels at all). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.batches import map_chunks
from flowsentry.llm.folds import held_out, training_labels
from flowsentry.llm.words import encoded

THRESHOLD = 0.3
POOLED, DIAGONAL = 0.02, 0.02
# Log-density differences are divided by this before they become a probability: statistics of one text are far from
# independent, and undivided differences are all but 0 and 1.
TEMPER = 4.0

_KIND = np.zeros(256, np.int64)  # 0 other ASCII signs, 1 upper, 2 lower, 3 digit, 4 white space, 5 sentence signs, 6 above ASCII
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 1, 2, 3, 6
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:?'\"-()"]] = 5

NAMES = ("signs", "upper", "digits", "spaces", "stops", "beyond", "log_words", "word_length", "distinct", "repeats",
         "distinct_lines", "line_length", "longest_word")


def statistics(texts: list[str | None]) -> np.ndarray:
    """One row of transformed statistics per text: log-odds of shares, logs of counts and lengths."""
    out = np.empty((len(texts), len(NAMES)))
    for i, text in enumerate(texts):
        raw = encoded(text)
        signs, upper, lower, digits, spaces, stops, beyond = np.bincount(
            _KIND, weights=np.bincount(np.frombuffer(raw, np.uint8), minlength=256), minlength=7)
        words, lines = raw.split(), raw.split(b"\n")
        n, size = len(words), len(raw)
        repeats = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
        out[i] = (
            np.log((signs + 0.2) / (size + 20)), np.log((upper + 1) / (lower + beyond + upper + 20)),
            np.log((digits + 0.2) / (size + 20)), np.log((spaces + 1) / (size + 8)),
            np.log((stops + 0.5) / (size + 20)), np.log((beyond + 1) / (size + 20)), np.log(n + 1.0),
            np.log((size + 8) / (n + 1)), np.log((len(set(words)) + 3) / (n + 3)), np.log((repeats + 0.1) / (n + 5)),
            np.log((len(set(lines)) + 1) / (len(lines) + 1)), np.log((size + 40) / (len(lines) + 1)),
            np.log(max(map(len, words), default=0) + 2.0))
    return out


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log prior + log determinant terms of both classes."""

    mean: np.ndarray
    inverse: np.ndarray
    constant: np.ndarray

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, squares: np.ndarray, pooled: float = POOLED,
            diagonal: float = DIAGONAL) -> Discriminant:
        """From each class's row count, sum and sum of outer products."""
        size = total.shape[1]
        safe = np.maximum(count, 1)[:, None]
        mean = total / safe
        own = squares / safe[:, :, None] - mean[:, :, None] * mean[:, None, :]
        both = (own * count[:, None, None]).sum(axis=0) / max(count.sum(), 1)
        inverse, constant = [], []
        for c in range(2):
            blend = (1 - pooled) * own[c] + pooled * both
            # few rows of a class: lean on the pooled matrix as well
            blend = (count[c] * blend + size * both) / (count[c] + size)
            blend = (1 - diagonal) * blend + diagonal * np.diag(np.diag(blend)) + 1e-4 * np.eye(size)
            factor = np.linalg.cholesky(blend)
            inverse.append(np.linalg.inv(factor))
            constant.append(np.log((count[c] + 1e-9) / (count.sum() + 2e-9)) - np.log(np.diag(factor)).sum()
                            if count[c] else -1e9 if count.sum() else 0.0)
        return cls(mean, np.array(inverse), np.array(constant))

    def score(self, rows: np.ndarray, temper: float = TEMPER) -> np.ndarray:
        """The probability of label 1."""
        density = [self.constant[c] - 0.5 * np.square((rows - self.mean[c]) @ self.inverse[c].T).sum(axis=1)
                   for c in range(2)]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / temper, -36, 36)))


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_column: str = "doc_id",
                text_column: str = "text") -> Discriminant:
    """Learn from all labelled rows that aren't held out."""
    def measure(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "x": statistics(batch.column("text").to_pylist()).tolist()}

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    measured = map_chunks(rows.filter(~held_out("doc_id")), "text", f"doc_id {kind}, x array<double>", measure)
    known = measured.join(training_labels(labels, label, id_column), "doc_id")
    size = len(NAMES)

    def moments(batches):
        count, total, squares = np.zeros(2), np.zeros((2, size)), np.zeros((2, size, size))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, size)
            y = batch.column("label").to_numpy() > 0
            for c, mine in enumerate((x[~y], x[y])):
                count[c] += len(mine)
                total[c] += mine.sum(axis=0)
                squares[c] += mine.T @ mine
        flat = np.concatenate([count, total.ravel(), squares.ravel()])
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(len(flat)), pa.int64()), "value": pa.array(flat)})

    found = known.select("x", "label").mapInArrow(moments, "place bigint, value double") \
        .groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()
    flat = np.array([r["value"] for r in found]) if found else np.zeros(2 + 2 * size + 2 * size * size)
    return Discriminant.fit(flat[:2], flat[2:2 + 2 * size].reshape(2, size), flat[2 + 2 * size:].reshape(2, size, size))


def score_quality(docs: DataFrame, model: Discriminant, id_column: str = "doc_id", text_column: str = "text",
                  threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score >= threshold) of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def judge(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": model.score(statistics(batch.column("text").to_pylist()))}

    return map_chunks(rows, "text", f"doc_id {kind}, score double", judge).select(
        F.col("doc_id").alias(id_column), held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Discriminant, text_column: str = "text",
              threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model doesn't reject, unchanged."""
    def judge(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array(model.score(statistics(batch.column(text_column).to_pylist())) >= threshold))
        return {name: kept.column(name) for name in kept.schema.names}

    return map_chunks(docs, text_column, docs.schema, judge)
