"""Linear machines on kernel features, one per class against the rest, fitted together.

The kernel features, some hundreds of numbers a row, are made anew in each pass and never stored: a pass reads the rows
once, and every task adds up loss and slope of all classes' hinge losses over its Arrow batches. The driver holds
weights only and takes the steps of a limited-memory BFGS per class.
"""

from __future__ import annotations

import uuid
from collections.abc import Generator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LinearSVCModel
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.ml.fourier import RandomFourierFeatures

BLOCK = 4096  # rows whose kernel features are held at a time
MEMORY, BACK, TOLERANCE = 10, 10, 1e-6

Step = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def kernel_of(lifted: RandomFourierFeatures):
    """The drawn features as a function from matrix to matrix."""
    offsets = np.array(lifted.getOrDefault(lifted.offsets))
    weights = np.array(lifted.getOrDefault(lifted.weights)).reshape(-1, len(offsets))
    return lambda x: np.sqrt(2.0 / len(offsets)) * np.cos(x @ weights + offsets)


def descent(start: np.ndarray, turns: int) -> Step:
    """Limited-memory BFGS with halved steps: yields points, is sent their value and slope, returns the best point. Ends
    when `BACK` turns gain less than a millionth."""
    point, past, values = start, [], []
    value, slope = yield point
    for _ in range(turns):
        values.append(value)
        if len(values) > BACK and values[-BACK - 1] - value <= TOLERANCE * abs(value) or not slope.any():
            break
        way, kept = -slope, []
        for moved, turned in reversed(past):
            kept.append(moved @ way / (moved @ turned))
            way = way - kept[-1] * turned
        if past:
            moved, turned = past[-1]
            way = way * (moved @ turned) / (turned @ turned)
        for (moved, turned), share in zip(past, reversed(kept)):
            way = way + (share - turned @ way / (moved @ turned)) * moved
        if way @ slope >= 0:
            way, past = -slope, []
        length = 1.0 if past else 1 / np.linalg.norm(way)
        while True:
            trial = point + length * way
            new, its = yield trial
            if new <= value + 1e-4 * length * (way @ slope):
                break
            length /= 2
            if length < 1e-9:
                return point
        moved, turned = trial - point, its - slope
        if moved @ turned > 1e-12 * (turned @ turned):
            past = [*past, (moved, turned)][-MEMORY:]
        point, value, slope = trial, new, its
    return point


def hinge_sums(rows: DataFrame, work) -> np.ndarray:
    """What `work` (features, target) gives, added up over all rows."""
    def run(batches):
        total = None
        for b in batches:
            x = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, 0))
            target = b.column("target").to_numpy()
            for at in range(0, len(x), BLOCK):
                here = work(x[at:at + BLOCK], target[at:at + BLOCK])
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "sums binary").toArrow().column("sums").to_pylist()
    return np.sum([np.frombuffer(p) for p in parts], axis=0)


def fit_machines(rows: DataFrame, label: str, vectors: str, lifted: RandomFourierFeatures, classes: int,
                 turns: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x classes) and heights of the machines with the smallest mean hinge loss. Kernel features are
    brought to one deviation while fitting."""
    ready = rows.select(vector_to_array(vectors).alias("features"), F.col(label).cast("int").alias("target"))
    kernel = kernel_of(lifted)

    def moments(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        k = kernel(x)
        return np.concatenate([[len(k)], k.sum(axis=0), (k * k).sum(axis=0)])

    found = hinge_sums(ready, moments)
    many, (first, second) = found[0], found[1:].reshape(2, -1) / found[0]
    spread = np.sqrt(np.maximum(second - first ** 2, 0) * many / max(many - 1, 1))
    scale = np.where(spread > 0, 1 / np.where(spread > 0, spread, 1.0), 0.0)
    size = len(scale)

    def losses(points: dict[int, np.ndarray]) -> dict[int, tuple[float, np.ndarray]]:
        asked, both = np.array(list(points)), np.stack(list(points.values()), axis=1)

        def work(x: np.ndarray, target: np.ndarray) -> np.ndarray:
            z = kernel(x) * scale
            side = np.where(target[:, None] == asked, 1.0, -1.0)
            miss = 1 - side * (z @ both[:size] + both[size])
            push = np.where(miss > 0, -side, 0.0)
            return np.concatenate([np.maximum(miss, 0).sum(axis=0)[None], z.T @ push, push.sum(axis=0)[None]]).ravel()

        sums = hinge_sums(ready, work).reshape(size + 2, len(asked)) / many
        return {k: (float(sums[0, i]), sums[1:, i]) for i, k in enumerate(points)}

    runs = {k: descent(np.zeros(size + 1), turns) for k in range(classes)}
    points, ends = {k: next(run) for k, run in runs.items()}, {}
    while points:
        told = losses(points)
        for k, what in told.items():
            try:
                points[k] = runs[k].send(what)
            except StopIteration as end:
                ends[k] = end.value
                del points[k]
    both = np.stack([ends[k] for k in range(classes)], axis=1)
    return both[:size] * scale[:, None], both[size]


def machine(spark: SparkSession, weights: np.ndarray, height: float, features: str, prediction: str, margin: str) -> LinearSVCModel:
    """Weights and height as the model that Spark fits."""
    coefficients = _py2java(spark.sparkContext, Vectors.dense(weights))
    made = spark._jvm.org.apache.spark.ml.classification.LinearSVCModel(f"LinearSVC_{uuid.uuid4().hex[:12]}", coefficients, float(height))
    return LinearSVCModel(made).setFeaturesCol(features).setPredictionCol(prediction).setRawPredictionCol(margin)
