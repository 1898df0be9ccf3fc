"""Small neural networks: layers as matrix products over Arrow batches, trained in steps of Spark jobs.

In a step every task runs the rows of the step's mini-batch that it holds forward and backward and returns the summed
gradient; the sums are added up (in a tree, where there are many tasks) and the driver, which holds only the weights,
takes one Adam step. Batch normalisation uses a task's own rows while training; their moments are merged, weighted by
rows, into the running ones that scoring uses. Which rows form a mini-batch, and which are held back to tell when to
stop, is decided by a hash of their values, and tasks hold rows by the same hash, so a lost task is repeated with the
same result.

An epoch of many mini-batches is one job, which reads each row once: every task takes its own Adam steps through its rows
from where the epoch began, and what the tasks arrive at is averaged, weighted by rows.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.ml.matrices import by_batch, with_chances

NORM_FLOOR, NORM_MOMENTUM = 1e-3, 0.9
BLOCK = 256  # rows scored together, whose layers stay in the processor's cache
ROWS = 100_000  # rows of a task
STEPS = 16  # mini-batches of an epoch up to which each is a job


def convolution_layers(inputs: int, classes: int) -> list[list]:
    """Two convolutions over the row of features, pooled where there is something to pool, then a dense layer."""
    first, second = [["pool"]] * (inputs > 1), [["pool"]] * (inputs > 3)
    return [["conv", 32], ["relu"], *first, ["conv", 64], ["relu"], *second, ["flat"],
            ["dense", 64], ["relu"], ["drop", 0.5], ["dense", classes]]


def autoencoder_layers(inputs: int, code: int = 16) -> list[list]:
    """inputs-64-32-code-32-64-inputs with batch normalisation."""
    return [["dense", 64], ["relu"], ["norm"], ["drop", 0.2], ["dense", 32], ["relu"], ["norm"], ["drop", 0.2],
            ["dense", code], ["relu"], ["dense", 32], ["relu"], ["norm"], ["dense", 64], ["relu"], ["norm"], ["dense", inputs]]


class Network:
    """The arithmetic of a list of layers on rows of `inputs` numbers. Weights and running moments are flat arrays."""

    def __init__(self, layers: list[list], inputs: int):
        self.layers, self.inputs = layers, inputs
        self.shapes: list[list[tuple[int, ...]]] = []
        self.moments = 0
        length, channels = inputs, 1
        flat = not any(layer[0] == "flat" for layer in layers)
        width = inputs if flat else 0
        for kind, *size in layers:
            shapes = []
            if kind == "conv":
                shapes, channels = [(3 * channels, size[0]), (size[0],)], size[0]
            elif kind == "pool":
                length //= 2
            elif kind == "flat":
                width = length * channels
            elif kind == "dense":
                shapes, width = [(width, size[0]), (size[0],)], size[0]
            elif kind == "norm":
                shapes = [(width,), (width,)]
                self.moments += 2 * width
            self.shapes.append(shapes)
        self.outputs = width
        self.size = sum(int(np.prod(s)) for shapes in self.shapes for s in shapes)

    def start(self, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """First weights (even within the Glorot bound, offsets 0, scales 1) and moments (means 0, variances 1)."""
        random, parts, moments = np.random.default_rng(seed), [], []
        for (kind, *_), shapes in zip(self.layers, self.shapes):
            if kind in ("dense", "conv"):
                bound = np.sqrt(6 / (shapes[0][0] + shapes[0][1] * (3 if kind == "conv" else 1)))
                parts += [random.uniform(-bound, bound, shapes[0]).ravel(), np.zeros(shapes[1])]
            elif kind == "norm":
                parts += [np.ones(shapes[0]), np.zeros(shapes[1])]
                moments += [np.zeros(shapes[0]), np.ones(shapes[0])]
        return np.concatenate(parts), np.concatenate(moments) if moments else np.zeros(0)

    def _split(self, weights: np.ndarray) -> list[list[np.ndarray]]:
        out, at = [], 0
        for shapes in self.shapes:
            here = []
            for shape in shapes:
                size = int(np.prod(shape))
                here.append(weights[at:at + size].reshape(shape))
                at += size
            out.append(here)
        return out

    def forward(self, weights: np.ndarray, moments: np.ndarray, x: np.ndarray, random: np.random.Generator | None = None,
                until: int | None = None):
        """The output of (the first `until`) layers, what the way back needs, and a batch's own moments. With `random`
        as in training: batch moments, and dropout."""
        convolves = any(layer[0] == "conv" for layer in self.layers)
        h = x[:, :, None] if convolves else x
        tape, own, at = [], [], 0
        for (kind, *size), parts in list(zip(self.layers, self._split(weights)))[:until]:
            if kind == "conv":
                wide = np.pad(h, ((0, 0), (1, 1), (0, 0)))
                columns = np.concatenate([wide[:, :-2], wide[:, 1:-1], wide[:, 2:]], axis=2)
                tape.append(columns)
                h = columns @ parts[0] + parts[1]
            elif kind == "dense":
                tape.append(h)
                h = h @ parts[0] + parts[1]
            elif kind == "relu":
                tape.append(h > 0)
                h = np.maximum(h, 0)
            elif kind == "pool":
                n, length, channels = h.shape
                pairs = h[:, :length // 2 * 2].reshape(n, length // 2, 2, channels)
                tape.append((h.shape, pairs[:, :, 0] >= pairs[:, :, 1]))
                h = pairs.max(axis=2)
            elif kind == "flat":
                tape.append(h.shape)
                h = h.reshape(len(h), -1)
            elif kind == "drop":
                mask = (random.random(h.shape) >= size[0]) / (1 - size[0]) if random is not None else None
                tape.append(mask)
                h = h if mask is None else h * mask
            elif kind == "norm":
                width = len(parts[0])
                mean, spread = moments[at:at + width], moments[at + width:at + 2 * width]
                if random is not None:
                    mean, spread = h.mean(axis=0), h.var(axis=0)
                    own += [mean, spread]
                at += 2 * width
                scale = 1 / np.sqrt(spread + NORM_FLOOR)
                z = (h - mean) * scale
                tape.append((z, scale))
                h = z * parts[0] + parts[1]
        return h, tape, np.concatenate(own) if own else np.zeros(0)

    def output(self, weights: np.ndarray, moments: np.ndarray, x: np.ndarray, until: int | None = None) -> np.ndarray:
        """What `forward` puts out, without what only the way back needs: one product per layer, in the space of a block."""
        h = x[:, :, None] if any(layer[0] == "conv" for layer in self.layers) else x
        at = 0
        for (kind, *_), parts in list(zip(self.layers, self._split(weights)))[:until]:
            if kind == "conv":
                n, length, channels = h.shape
                wide = np.zeros((n, length + 2, channels))
                wide[:, 1:-1] = h
                three = np.lib.stride_tricks.as_strided(wide, (n, length, 3 * channels), wide.strides, writeable=False)
                h = (three.reshape(-1, 3 * channels) @ parts[0]).reshape(n, length, -1)
                h += parts[1]
            elif kind == "dense":
                h = h @ parts[0]
                h += parts[1]
            elif kind == "relu":
                h = np.maximum(h, 0)
            elif kind == "pool":
                half = h.shape[1] // 2 * 2
                h = np.maximum(h[:, 0:half:2], h[:, 1:half:2])
            elif kind == "flat":
                h = h.reshape(len(h), -1)
            elif kind == "norm":
                width = len(parts[0])
                mean, spread = moments[at:at + width], moments[at + width:at + 2 * width]
                at += 2 * width
                h = (h - mean) * (1 / np.sqrt(spread + NORM_FLOOR)) * parts[0] + parts[1]
        return h

    def backward(self, weights: np.ndarray, tape: list, d: np.ndarray) -> np.ndarray:
        """The gradient of all weights, given that of the output."""
        grown: list[np.ndarray] = []
        for (kind, *_), parts, kept in reversed(list(zip(self.layers, self._split(weights), tape))):
            if kind in ("dense", "conv"):
                wide, rows = kept.reshape(-1, kept.shape[-1]), d.reshape(-1, d.shape[-1])
                grown += [rows.sum(axis=0), (wide.T @ rows).ravel()]
                d = d @ parts[0].T
                if kind == "conv":
                    channels = d.shape[2] // 3
                    n, length = d.shape[:2]
                    back = np.zeros((n, length + 2, channels))
                    for k in range(3):
                        back[:, k:k + length] += d[:, :, k * channels:(k + 1) * channels]
                    d = back[:, 1:-1]
            elif kind == "relu":
                d = d * kept
            elif kind == "pool":
                (n, length, channels), first = kept
                back = np.zeros((n, length, channels))
                back[:, :length // 2 * 2:2] = d * first
                back[:, 1:length // 2 * 2:2] = d * ~first
                d = back
            elif kind == "flat":
                d = d.reshape(kept)
            elif kind == "drop":
                d = d if kept is None else d * kept
            elif kind == "norm":
                z, scale = kept
                grown += [d.sum(axis=0), (d * z).sum(axis=0)]
                d = d * parts[0]
                d = scale * (d - d.mean(axis=0) - z * (d * z).mean(axis=0))
        return np.concatenate(grown[::-1]) if grown else np.zeros(0)

    def loss(self, out: np.ndarray, target: np.ndarray) -> tuple[float, np.ndarray]:
        """Summed loss and its gradient: cross-entropy for class numbers, mean squared error for rows."""
        if target.ndim == 1:
            chances = softmax(out)
            at = np.arange(len(out)), target.astype(int)
            d = chances.copy()
            d[at] -= 1
            return float(-np.log(np.maximum(chances[at], 1e-300)).sum()), d
        miss = out - target
        return float((miss ** 2).mean(axis=1).sum()), 2 * miss / miss.shape[1]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass
class Effort:
    """How a network is trained. `batch` rows make a step. The held-back rows are judged up to 20 times; `patience` times
    without a better loss end it."""

    epochs: int = 40
    batch: int = 1024
    rate: float = 0.003
    held_back: float = 0.2
    patience: int = 8
    seed: int = 42
    tasks: int = 4


@dataclass
class Fitted:
    network: Network
    weights: np.ndarray
    moments: np.ndarray
    losses: list[float] = field(default_factory=list)
    held_losses: list[float] = field(default_factory=list)


def _matrix(column: pa.ListArray, rows: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(rows, -1)


_STEP = "rows bigint, loss double, gradient binary, moments binary"


def _added(parts: list[dict]) -> dict:
    """Sums of gradients and losses; moments merged as those of one set of rows (means, then variances, by width)."""
    rows = sum(p["rows"] for p in parts)
    return {"rows": rows, "loss": sum(p["loss"] for p in parts),
            "gradient": np.sum([p["gradient"] for p in parts], axis=0),
            "moments": np.sum([p["rows"] * p["moments"] for p in parts], axis=0) / max(rows, 1)}


def _read(batch: pa.RecordBatch) -> list[dict]:
    return [{**row, "gradient": np.frombuffer(row["gradient"]), "moments": np.frombuffer(row["moments"])} for row in batch.to_pylist()]


def _written(part: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([{**part, "gradient": part["gradient"].tobytes(), "moments": part["moments"].tobytes()}], schema=pa.schema(
        [("rows", pa.int64()), ("loss", pa.float64()), ("gradient", pa.binary()), ("moments", pa.binary())]))


def _squared(network: Network, moments: np.ndarray, back: bool = False) -> np.ndarray:
    """Variances of normalised layers as mean squares, which can be averaged, or back."""
    out, at = moments.copy(), 0
    for (kind, *_), shapes in zip(network.layers, network.shapes):
        if kind == "norm":
            width = shapes[0][0]
            square = out[at:at + width] ** 2
            out[at + width:at + 2 * width] += -square if back else square
            at += 2 * width
    return out


def _target(batch: pa.RecordBatch, x: np.ndarray) -> np.ndarray:
    """Class numbers, or the rows themselves where there are none."""
    column = batch.column("target")
    return x if pa.types.is_null(column.type) or column.null_count else column.to_numpy()


def _whole(sums: DataFrame, tasks: int) -> dict | None:
    """Tasks' sums added up, in a tree where there are many tasks."""
    def add(batches):
        parts = [p for b in batches for p in _read(b)]
        if parts:
            yield _written(_added(parts))

    while tasks > 64:
        tasks //= 16
        sums = sums.repartition(tasks).mapInArrow(add, _STEP)
    parts = [p for b in sums.toArrow().to_batches() for p in _read(b)]
    return _added(parts) if parts else None


def _adam(state: tuple[np.ndarray, ...], gradient: np.ndarray, step: int, rate: float) -> tuple[np.ndarray, ...]:
    """Weights and the running means of gradients and their squares after a step."""
    weights, first, second = state
    first = 0.9 * first + 0.1 * gradient
    second = 0.999 * second + 0.001 * gradient ** 2
    weights = weights - rate * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-7)
    return weights, first, second


def step_sums(rows: DataFrame, network: Network, weights: np.ndarray, moments: np.ndarray, step: int | None, seed: int) -> dict | None:
    """Loss, gradient and moments of the rows (features, target), added up over tasks; without `step` only the loss."""
    shared = rows.sparkSession.sparkContext.broadcast((network, weights, moments))

    def work(batches):
        net, w, m = shared.value
        if step is None:
            rows, loss = 0, 0.0
            for b in batches:
                x = _matrix(b.column("features"), b.num_rows) if b.num_rows else np.zeros((0, net.inputs))
                target = _target(b, x)
                for at in range(0, len(x), BLOCK):
                    loss += net.loss(net.output(w, m, x[at:at + BLOCK]), target[at:at + BLOCK])[0]
                rows += len(x)
            if rows:
                yield _written({"rows": rows, "loss": loss, "gradient": np.zeros(0), "moments": np.zeros(0)})
            return
        got = [(_matrix(b.column("features"), b.num_rows), b) for b in batches if b.num_rows]
        if not got:
            return
        x, target = np.concatenate([x for x, _ in got]), np.concatenate([_target(b, x) for x, b in got])
        random = np.random.default_rng([seed, step, TaskContext.get().partitionId()])
        out, tape, own = net.forward(w, m, x, random)
        loss, d = net.loss(out, target)
        yield _written({"rows": len(x), "loss": loss, "gradient": net.backward(w, tape, d), "moments": _squared(net, own) if len(own) else own})

    sums = rows.select("features", "target").mapInArrow(work, _STEP)
    found = _whole(sums, rows.rdd.getNumPartitions() if step is None else 0)
    shared.destroy()
    return found


def epoch_sums(rows: DataFrame, network: Network, state: tuple[np.ndarray, ...], moments: np.ndarray, step: int, effort: Effort) -> dict | None:
    """An epoch in which every task takes its own steps through its rows: the sums, weighted by rows, of the weights and
    Adam's means (one array, as `gradient`) that the tasks arrive at, their moments, and the loss on the way. Only an Arrow
    batch of rows is held at a time."""
    shared = rows.sparkSession.sparkContext.broadcast((network, state, moments))

    def work(batches):
        net, own, m = shared.value
        random = np.random.default_rng([effort.seed, step, TaskContext.get().partitionId()])
        seen, loss, at = 0, 0.0, step
        for b in batches:
            x = _matrix(b.column("features"), b.num_rows) if b.num_rows else np.zeros((0, net.inputs))
            target = _target(b, x)
            for part in np.array_split(random.permutation(len(x)), max(1, round(len(x) / effort.batch))):
                if not len(part):
                    continue
                out, tape, batch_moments = net.forward(own[0], m, x[part], random)
                more, d = net.loss(out, target[part])
                at += 1
                own = _adam(own, net.backward(own[0], tape, d) / len(part), at, effort.rate)
                if net.moments:
                    m = NORM_MOMENTUM * m + (1 - NORM_MOMENTUM) * batch_moments
                seen, loss = seen + len(part), loss + more
        if seen:
            yield _written({"rows": seen, "loss": loss, "gradient": seen * np.concatenate(own), "moments": _squared(net, m)})

    found = _whole(rows.select("features", "target").mapInArrow(work, _STEP), rows.rdd.getNumPartitions())
    shared.destroy()
    return found


def fit_network(rows: DataFrame, layers: list[list], inputs: int, effort: Effort | None = None) -> Fitted:
    """Train on rows of features (array) and target (class number, or null: the features themselves). The weights with
    the smallest loss on the held-back rows are kept."""
    effort = effort or Effort()
    network = Network(layers, inputs)
    weights, moments = network.start(effort.seed)
    fitted = Fitted(network, weights, moments)
    place = F.xxhash64("features", "target")
    share = F.pmod(place, F.lit(1 << 20)) < int(effort.held_back * (1 << 20))
    tasks = max(effort.tasks, math.ceil(rows.count() / ROWS))
    ready = rows.select("features", "target", place.alias("place"), share.alias("held")) \
        .repartition(tasks, "place").sortWithinPartitions("place").persist(StorageLevel.MEMORY_AND_DISK)
    sizes = {r["held"]: r["n"] for r in ready.groupBy("held").agg(F.count("*").alias("n")).collect()}
    taught = sizes.get(False, 0)
    if not taught:
        ready.unpersist()
        return fitted
    steps = max(1, round(taught / effort.batch))
    turn = F.pmod(F.shiftright("place", 24), F.lit(steps))
    first, second = np.zeros(network.size), np.zeros(network.size)
    best, waited, step = np.inf, 0, 0
    held, every = ready.filter("held"), max(1, effort.epochs // 20)
    for epoch in range(effort.epochs):
        total, seen = 0.0, 0
        if steps > STEPS:
            found = epoch_sums(ready.filter("NOT held"), network, (weights, first, second), moments, step, effort)
            step += max(1, steps // tasks)
            total, seen = found["loss"], found["rows"]
            weights, first, second = np.split(found["gradient"] / seen, 3)
            if network.moments:
                moments = _squared(network, found["moments"], back=True)
        for part in range(steps if steps <= STEPS else 0):
            batch = ready.filter(~F.col("held") & (turn == part)) if steps > 1 else ready.filter("NOT held")
            found = step_sums(batch, network, weights, moments, step, effort.seed)
            step += 1
            if found is None:
                continue
            total, seen = total + found["loss"], seen + found["rows"]
            weights, first, second = _adam((weights, first, second), found["gradient"] / found["rows"], step, effort.rate)
            if network.moments:
                own = _squared(network, found["moments"], back=True)
                moments = NORM_MOMENTUM * moments + (1 - NORM_MOMENTUM) * own
        fitted.losses.append(total / max(seen, 1))
        if (epoch + 1) % every and epoch + 1 < effort.epochs:
            continue
        judged = step_sums(held, network, weights, moments, None, effort.seed) if sizes.get(True) else None
        now = judged["loss"] / judged["rows"] if judged else fitted.losses[-1]
        fitted.held_losses.append(now)
        if now < best - 1e-5:
            best, waited = now, 0
            fitted.weights, fitted.moments = weights, moments
        else:
            waited += 1
            if waited >= effort.patience:
                break
    ready.unpersist()
    return fitted


class NetworkModel(Transformer, HasInputCol, HasOutputCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the output of a fitted network (or of its first `until` layers) to every row, one matrix product per layer
    and Arrow batch. With `classes` the output is class probabilities, and the prediction column names the largest."""

    layers = Param(Params._dummy(), "layers", "the layers, as JSON", TypeConverters.toString)
    inputs = Param(Params._dummy(), "inputs", "number of features", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "all weights", TypeConverters.toListFloat)
    moments = Param(Params._dummy(), "moments", "running means and variances", TypeConverters.toListFloat)
    until = Param(Params._dummy(), "until", "number of layers to run, 0 for all", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "whether the output is class probabilities", TypeConverters.toBoolean)

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._setDefault(until=0, classes=False)
        if inputCol and outputCol:
            self._set(inputCol=inputCol, outputCol=outputCol)

    def holding(self, fitted: Fitted, predictionCol: str | None = None, until: int = 0) -> NetworkModel:
        self._set(layers=json.dumps(fitted.network.layers), inputs=fitted.network.inputs, weights=fitted.weights.tolist(),
                  moments=fitted.moments.tolist(), until=until)
        if predictionCol:
            self._set(predictionCol=predictionCol, classes=True)
        return self

    def _transform(self, dataset: DataFrame) -> DataFrame:
        network = Network(json.loads(self.getOrDefault(self.layers)), self.getOrDefault(self.inputs))
        weights, moments = np.array(self.getOrDefault(self.weights)), np.array(self.getOrDefault(self.moments))
        until, classes = self.getOrDefault(self.until) or None, self.getOrDefault(self.classes)

        def work(x: np.ndarray) -> np.ndarray:
            parts = [network.output(weights, moments, x[at:at + BLOCK], until) for at in range(0, len(x), BLOCK)]
            out = np.concatenate(parts)
            return softmax(out) if classes else out

        made = by_batch(work, self.getInputCol())
        if not classes:
            return dataset.withColumn(self.getOutputCol(), array_to_vector(made))
        return with_chances(dataset, made, self.getOutputCol(), self.getPredictionCol())
