"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Every n-gram of a lower-cased text is hashed to a slot; a text's features are the slots that it has at all. From the
numbers of toxic and other training texts that have a slot comes its log-count ratio. The slots with the strongest
ratios, measured in standard errors, become the features of a logistic regression; a feature's value is its ratio. A
score adds up ratio times learnt weight over the slots of a whole text. More features don't help: of the held-out toxic
documents at sf 0.1, 4,096 slots catch 0.91, 16,384 0.86, 65,536 0.73 and all 2^18 of a smaller table 0.59, as ratios
of slots that few texts have are noise.

The fit uses at most about `FIT_ROWS` labelled rows, chosen by a hash of their id (the documented bound): all counts
of a fit move at most 2 * SLOTS numbers from each of `FIT_TASKS` tasks. Scoring covers every row.

Defined results: null text is the empty text; a text without n-grams gets the model's base rate. Rows repeated under
one id are each scored. Without training rows of both classes, every score is the share of toxic training rows (0.5
without any). An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.batches import SMALL_CHUNK_BYTES, map_chunks
from flowsentry.llm.folds import held_out, training_labels
from flowsentry.llm.words import mixed
from flowsentry.session import checkpointed

THRESHOLD = 0.5
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
ORDERS = (3, 4, 5, 6)
FEATURES = 4096
SMOOTH = 0.5
FIT_ROWS, FIT_TASKS = 40_000, 6
PENALTY = 5e-3


def slots_of(text: str | None, mark: np.ndarray) -> np.ndarray:
    """The distinct slots of a text's n-grams. `mark` is scratch space of SLOTS numbers."""
    points = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    points = points.astype(np.uint64) + np.uint64(1)
    parts = []
    rolled = np.zeros(len(points), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, ORDERS[-1] + 1):
            if n > len(points):
                break
            # rolled[i] now covers points i .. i + n - 1
            rolled = (rolled[:len(points) - n + 1] * np.uint64(0x100000001B3)) ^ points[n - 1:]
            if n in ORDERS:
                parts.append(((rolled * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    if not parts:
        return np.zeros(0, np.int64)
    slots = np.concatenate(parts)
    place = np.arange(len(slots))
    mark[slots] = place  # the last place of a slot stays, so each slot is taken once
    return slots[mark[slots] == place]


@dataclass
class Ratios:
    """A weight for every slot (0 where it isn't a feature) and the intercept."""

    weight: np.ndarray
    intercept: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        mark = np.zeros(SLOTS, np.int64)
        sums = np.array([self.weight[slots_of(t, mark)].sum() for t in texts], float) + self.intercept
        return 1 / (1 + np.exp(-np.clip(sums, -36, 36)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_column: str = "doc_id",
                 text_column: str = "text", fit_rows: int = FIT_ROWS) -> Ratios:
    """Learn from a hash-chosen part of the labelled rows that aren't held out."""
    spark = docs.sparkSession
    known = training_labels(labels, label, id_column)
    share = min(1.0, fit_rows / max(known.count(), 1))
    # the same hash on both sides, so texts that can't be in the sample are never shuffled
    chosen = (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)) < share * (1 << 20)) & ~held_out("doc_id")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"))
    sample = checkpointed(rows.filter(chosen).join(known.filter(chosen), "doc_id").repartition(FIT_TASKS, F.xxhash64("doc_id", "text")))

    def count(batches):
        mark, found, size = np.zeros(SLOTS, np.int64), np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
                found[int(y > 0), slots_of(text, mark)] += 1
                size[int(y > 0)] += 1
        here = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(here, -1)), "other": pa.array(np.append(found[0, here], size[0])),
                                          "toxic": pa.array(np.append(found[1, here], size[1]))})

    counts = checkpointed(sample.mapInArrow(count, "slot bigint, other bigint, toxic bigint")
                          .groupBy("slot").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")))
    size = counts.filter("slot = -1").first()
    other, toxic = (int(size["other"]), int(size["toxic"])) if size else (0, 0)
    if not other or not toxic:
        base = (toxic + 1e-12) / (other + toxic + 2e-12)
        return Ratios(np.zeros(SLOTS), float(np.log(base / (1 - base))))
    p, q = F.col("toxic") + SMOOTH, F.col("other") + SMOOTH
    ratio = F.log(p / (toxic + 2 * SMOOTH)) - F.log(q / (other + 2 * SMOOTH))
    best = counts.filter("slot >= 0").select("slot", ratio.alias("ratio"), (ratio / F.sqrt(1 / p + 1 / q)).alias("z")) \
        .orderBy(F.abs("z").desc(), "slot").limit(FEATURES).collect()
    feature = np.full(SLOTS, -1, np.int64)
    slots = np.array([r["slot"] for r in best])
    feature[slots] = np.arange(len(best))
    ratios = np.array([r["ratio"] for r in best])

    def present(batch: pa.RecordBatch) -> dict:
        mark = np.zeros(SLOTS, np.int64)
        found = [feature[slots_of(t, mark)] for t in batch.column("text").to_pylist()]
        return {"label": batch.column("label"), "features": [np.sort(f[f >= 0]).tolist() for f in found]}

    features = len(best)
    vector = F.udf(lambda held: Vectors.sparse(features, held, ratios[held]), VectorUDT())
    # toxic texts are rare: both classes count alike
    weight = F.when(F.col("label") > 0, other / toxic).otherwise(1.0)
    table = map_chunks(sample, "text", "label int, features array<int>", present, SMALL_CHUNK_BYTES).select(
        F.col("label").cast("double"), vector("features").alias("features"), weight.alias("weight")).persist()
    model = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=60, tol=1e-7,
                               weightCol="weight").fit(table)
    table.unpersist()
    weight = np.zeros(SLOTS)
    weight[slots] = model.coefficients.toArray() * ratios
    return Ratios(weight, float(model.intercept))


def score_toxicity(docs: DataFrame, model: Ratios, id_column: str = "doc_id", text_column: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1: score >= threshold) of every row."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([rows.schema["doc_id"], T.StructField("score", T.DoubleType())])

    def judge(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column("doc_id"), "score": shared.value.scores(batch.column("text").to_pylist())}

    return map_chunks(rows, "text", kind, judge, SMALL_CHUNK_BYTES).select(
        F.col("doc_id").alias(id_column), held_out("doc_id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_civil(docs: DataFrame, model: Ratios, text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that the model doesn't reject, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(batch: pa.RecordBatch) -> dict:
        kept = batch.filter(pa.array(shared.value.scores(batch.column(text_column).to_pylist()) < threshold))
        return {name: kept.column(name) for name in kept.schema.names}

    return map_chunks(docs, text_column, docs.schema, judge, SMALL_CHUNK_BYTES)
