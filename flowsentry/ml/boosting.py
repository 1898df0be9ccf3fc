"""Gradient-boosted trees for several classes at once: soft-max gradients, histograms of quantile bins, level by level.

A round grows one tree per class. For each level one job adds up, over all rows, the gradients and curvatures per class,
node, feature and bin; from these sums the driver picks the split of every node of every class. Rows carry their scores
from round to round. A part of the rows, chosen by a hash of their values, is held back, and rounds end early when they
stop helping there.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.ml.matrices import by_batch, with_chances
from flowsentry.ml.network import softmax
from flowsentry.session import checkpointed

BLOCK = 4096  # rows that go through a tree together
ROWS = 100_000  # rows of a task
MET = 16  # tasks whose histograms meet in one place


@dataclass
class Boosting:
    """`patience` rounds without a better held-back loss end the fit; 0 makes all rounds on all rows."""

    rounds: int = 100
    depth: int = 6
    rate: float = 0.3
    ridge: float = 1.0
    least: float = 1.0  # curvature that a child must have
    bins: int = 64
    held_back: float = 0.15
    patience: int = 5
    tasks: int = 4


@dataclass
class Trees:
    """Per round and class a tree in heap order (node 1 is the root, 2n and 2n + 1 its children): the feature asked (-1
    at a leaf), the bin that still goes left, and a leaf's value. `edges`: each feature's upper bin ends."""

    edges: list[np.ndarray]
    classes: int
    feature: list[np.ndarray] = field(default_factory=list)
    split: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(self.edges)], axis=1) \
            if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def added(self, bins: np.ndarray, turn: int) -> np.ndarray:
        """What a round's trees add to the score of each class."""
        out = np.empty((len(bins), self.classes))
        for k in range(self.classes):
            node = places(bins, self.feature[turn][k], self.split[turn][k])
            out[:, k] = self.value[turn][k][node]
        return out

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.classes))
        if not self.feature:
            return out
        feature, split, value = (np.stack(t) for t in (self.feature, self.split, self.value))
        levels = feature.shape[-1].bit_length() - 2
        for node in range(1, 1 << levels):  # below a leaf all is as in it, so that every row goes down all levels
            leaf = feature[..., node] < 0
            value[..., 2 * node:2 * node + 2] = np.where(leaf[..., None], value[..., node, None], value[..., 2 * node:2 * node + 2])
            feature[..., 2 * node:2 * node + 2] = np.where(leaf[..., None], -1, feature[..., 2 * node:2 * node + 2])
        feature = np.maximum(feature, 0)
        for at in range(0, len(x), BLOCK):
            bins = self.binned(x[at:at + BLOCK])
            flat, first = bins.ravel(), np.arange(len(bins)) * bins.shape[1]
            for turn in range(len(feature)):
                for k in range(self.classes):
                    asked, ends, node = feature[turn, k], split[turn, k], np.ones(len(bins), np.int64)
                    for _ in range(levels):
                        node = 2 * node + (flat.take(first + asked.take(node)) > ends.take(node))
                    out[at:at + BLOCK, k] += value[turn, k].take(node)
        return out


def places(bins: np.ndarray, feature: np.ndarray, split: np.ndarray) -> np.ndarray:
    """The node in which each row ends, as far as the tree has grown."""
    node = np.ones(len(bins), np.int64)
    row = np.arange(len(bins))
    while True:
        asked = feature[node]
        on = asked >= 0
        if not on.any():
            return node
        right = bins[row, np.maximum(asked, 0)] > split[node]
        node = np.where(on, 2 * node + right, node)


def slopes(scores: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients and curvatures of the soft-max loss, per row and class."""
    chances = softmax(scores)
    truth = np.zeros_like(chances)
    truth[np.arange(len(target)), target] = 1
    return chances - truth, np.maximum(2 * chances * (1 - chances), 1e-6)


def best_splits(grad: np.ndarray, curve: np.ndarray, b: Boosting):
    """Of sums (..., features, bins): feature and bin of the best split, its gain, and the node's leaf value."""
    left_g, left_h = np.cumsum(grad, axis=-1), np.cumsum(curve, axis=-1)
    all_g, all_h = left_g[..., :1, -1:], left_h[..., :1, -1:]
    right_g, right_h = all_g - left_g, all_h - left_h
    gain = left_g ** 2 / (left_h + b.ridge) + right_g ** 2 / (right_h + b.ridge) - all_g ** 2 / (all_h + b.ridge)
    gain = np.where((left_h >= b.least) & (right_h >= b.least), gain, -np.inf)
    flat = gain.reshape(*gain.shape[:-2], -1)
    best = flat.argmax(axis=-1)
    top = np.take_along_axis(flat, best[..., None], axis=-1)[..., 0]
    return best // grad.shape[-1], best % grad.shape[-1], top, -b.rate * (all_g / (all_h + b.ridge))[..., 0, 0]


_ROWS = "bins binary, scores binary, target int, held boolean"


def fit_boosting(rows: DataFrame, classes: int, features: int, effort: Boosting | None = None) -> Trees:
    """Fit on rows of features (array) and target (class number)."""
    b = effort or Boosting()
    spread = [F.percentile_approx(F.col("features")[f], [i / b.bins for i in range(1, b.bins)], 10_000).alias(f"f{f}")
              for f in range(features)]
    ends = rows.agg(*spread).first()
    trees = Trees([np.unique(np.array(e or [], float)) for e in ends], classes)
    share = int(b.held_back * (1 << 20)) if b.patience else 0
    place = F.xxhash64("features", "target")
    tasks = max(b.tasks, math.ceil(rows.count() / ROWS))
    state = rows.select("features", F.col("target").cast("int").alias("target"), place.alias("place"),
                        (F.pmod(place, F.lit(1 << 20)) < share).alias("held")) \
        .repartition(tasks, "place").sortWithinPartitions("place").drop("place")
    schema = pa.schema([("bins", pa.binary()), ("scores", pa.binary()), ("target", pa.int32()), ("held", pa.bool_())])

    def start(batches):
        for batch in batches:
            x = np.asarray(batch.column("features").flatten(), float).reshape(batch.num_rows, -1)
            bins = trees.binned(x).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([_packed(bins), _packed(np.zeros((len(x), classes))), batch.column("target"), batch.column("held")], schema=schema)

    state = state.mapInArrow(start, _ROWS).persist(StorageLevel.MEMORY_AND_DISK)
    best, waited = np.inf, 0
    for turn in range(b.rounds):
        grown = _tree_of_round(state, trees, b, tasks)
        if grown is None:
            break
        for kept, new in zip((trees.feature, trees.split, trees.value), grown):
            kept.append(new)
        last = state
        state = _moved_on(last, trees, turn, schema)
        state = checkpointed(state) if turn % 10 == 9 else state.persist(StorageLevel.MEMORY_AND_DISK)
        if share:
            loss = _held_loss(state, classes)
            waited = 0 if loss < best - 1e-4 else waited + 1
            best = min(best, loss)
            if waited >= b.patience:
                break
        last.unpersist()
    state.unpersist()
    keep = len(trees.feature) - waited  # up to the best round
    trees.feature, trees.split, trees.value = trees.feature[:keep], trees.split[:keep], trees.value[:keep]
    return trees


def _packed(matrix: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    ends = np.arange(len(matrix) + 1, dtype=np.int32) * (matrix.shape[1] * matrix.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(matrix), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(matrix))])


def _unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The matrix whose rows a column without nulls holds."""
    if not len(column):
        return np.zeros(0, kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]].view(kind)


def _read(batch: pa.RecordBatch, classes: int):
    bins = _unpacked(batch.column("bins"), np.uint8).reshape(batch.num_rows, -1 if batch.num_rows else 0)
    scores = _unpacked(batch.column("scores"), np.float64).reshape(batch.num_rows, classes)
    return bins, scores, batch.column("target").to_numpy()


def _tree_of_round(state: DataFrame, trees: Trees, b: Boosting, tasks: int):
    """(feature, split, value) of one tree per class; None if there are no rows."""
    classes, features, size = trees.classes, len(trees.edges), 1 << (b.depth + 1)
    feature, split = np.full((classes, size), -1), np.zeros((classes, size), np.int64)
    value, open_nodes = np.zeros((classes, size)), np.zeros((classes, size), bool)
    open_nodes[:, 1] = True
    taught = state.filter("NOT held")
    for level in range(b.depth + 1):
        low = 1 << level
        if not open_nodes[:, low:2 * low].any():
            break

        def sums(batches):
            total = np.zeros((2, classes, low, features, b.bins))
            for batch in batches:
                bins, scores, target = _read(batch, classes)
                grad, curve = slopes(scores, target)
                for k in range(classes):
                    node = places(bins, feature[k], split[k])
                    here = np.flatnonzero((node >= low) & open_nodes[k, node])
                    for f in range(features):
                        cell = (node[here] - low) * b.bins + bins[here, f]
                        for i, w in enumerate((grad, curve)):
                            total[i, k, :, f] += np.bincount(cell, weights=w[here, k], minlength=low * b.bins).reshape(low, b.bins)
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

        total = _added(taught.mapInArrow(sums, "sums binary"), tasks)
        if total is None:
            return None
        total = total.reshape(2, classes, low, features, b.bins)
        asked, at, gain, leaf = best_splits(total[0], total[1], b)
        seen = open_nodes[:, low:2 * low]
        value[:, low:2 * low] = np.where(seen, leaf, 0.0)
        for k, i in zip(*np.nonzero(seen & (gain > 1e-9))) if level < b.depth else ():
            feature[k, low + i], split[k, low + i] = asked[k, i], at[k, i]
            open_nodes[k, 2 * (low + i):2 * (low + i) + 2] = True
    return feature, split, value


def _added(sums: DataFrame, tasks: int) -> np.ndarray | None:
    """Tasks' sums added up, in a tree where there are many tasks."""
    def add(batches):
        total = None
        for batch in batches:
            for part in batch.column("sums"):
                here = np.frombuffer(part.as_buffer())
                total = here if total is None else total + here
        if total is not None:
            yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary())})

    while tasks > MET:
        tasks = math.ceil(tasks / MET)
        sums = sums.repartition(tasks).mapInArrow(add, "sums binary")
    parts = sums.toArrow().column("sums").to_pylist()
    return np.sum([np.frombuffer(p) for p in parts], axis=0) if parts else None


def _moved_on(state: DataFrame, trees: Trees, turn: int, schema: pa.Schema) -> DataFrame:
    grown = Trees(trees.edges, trees.classes, [trees.feature[turn]], [trees.split[turn]], [trees.value[turn]])

    def add(batches):
        for batch in batches:
            bins, scores, _ = _read(batch, grown.classes)
            new = scores + grown.added(bins, 0)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), _packed(new), batch.column("target"), batch.column("held")], schema=schema)

    return state.mapInArrow(add, _ROWS)


def _held_loss(state: DataFrame, classes: int) -> float:
    def losses(batches):
        for batch in batches:
            _, scores, target = _read(batch, classes)
            chance = softmax(scores)[np.arange(len(target)), target] if len(target) else np.ones(1)
            yield pa.RecordBatch.from_pydict({"loss": [float(-np.log(np.maximum(chance, 1e-300)).sum())], "rows": [len(target)]})

    found = state.filter("held").mapInArrow(losses, "loss double, rows bigint").agg(F.sum("loss").alias("loss"), F.sum("rows").alias("rows")).first()
    return found["loss"] / found["rows"] if found["rows"] else np.inf


class BoostedModel(Transformer, HasInputCol, HasOutputCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds class probabilities and the number of the likeliest class."""

    trees = Param(Params._dummy(), "trees", "edges, and features, splits and values of all trees, as JSON", TypeConverters.toString)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None, predictionCol: str | None = None):
        super().__init__()
        if inputCol and outputCol and predictionCol:
            self._set(inputCol=inputCol, outputCol=outputCol, predictionCol=predictionCol)

    def holding(self, trees: Trees) -> BoostedModel:
        self._set(trees=json.dumps({"edges": [e.tolist() for e in trees.edges], "classes": trees.classes, **{
            n: [t.tolist() for t in getattr(trees, n)] for n in ("feature", "split", "value")}}))
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        held = json.loads(self.getOrDefault(self.trees))
        trees = Trees([np.array(e, float) for e in held["edges"]], held["classes"],
                      *[[np.array(t) for t in held[n]] for n in ("feature", "split", "value")])

        chances = by_batch(lambda x: softmax(trees.scores(x)), self.getInputCol())
        return with_chances(dataset, chances, self.getOutputCol(), self.getPredictionCol())
