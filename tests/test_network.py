"""Networks: forward passes against plain loops, gradients against finite differences, training on small tables."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from flowsentry.ml import anomaly as MA
from flowsentry.ml import network as MN
from flowsentry.ml import persist as MP

NETS = [MN.convolution_layers(19, 3), MN.autoencoder_layers(7, 3), [["conv", 2], ["relu"], ["pool"], ["flat"], ["dense", 3]]]


def plain_forward(net, weights, moments, row):
    """One row, one number at a time."""
    parts, at, seen = net._split(weights), 0, 0
    h = [[v] for v in row] if any(k[0] == "conv" for k in net.layers) else list(row)
    for (kind, *size), p in zip(net.layers, parts):
        if kind == "conv":
            wide = [[0.0] * len(h[0])] + h + [[0.0] * len(h[0])]
            h = [[p[1][f] + sum(wide[i + k][c] * p[0][k * len(h[0]) + c][f] for k in range(3) for c in range(len(h[0])))
                  for f in range(size[0])] for i in range(len(h))]
        elif kind == "dense":
            h = [p[1][j] + sum(v * p[0][i][j] for i, v in enumerate(h)) for j in range(size[0])]
        elif kind == "relu":
            h = [[max(v, 0) for v in r] if isinstance(r, list) else max(r, 0) for r in h]
        elif kind == "pool":
            h = [[max(a, b) for a, b in zip(h[2 * i], h[2 * i + 1])] for i in range(len(h) // 2)]
        elif kind == "flat":
            h = [v for r in h for v in r]
        elif kind == "norm":
            width = len(p[0])
            mean, spread = moments[seen:seen + width], moments[seen + width:seen + 2 * width]
            h = [(v - mean[i]) / np.sqrt(spread[i] + MN.NORM_FLOOR) * p[0][i] + p[1][i] for i, v in enumerate(h)]
            seen += 2 * width
    return h


@pytest.mark.parametrize("layers, inputs", [(NETS[0], 19), (NETS[1], 7), (NETS[2], 9)])
def test_forward_equals_plain_loops(layers, inputs):
    net = MN.Network(layers, inputs)
    rng = np.random.default_rng(1)
    weights, moments = rng.normal(size=net.size), rng.uniform(0.5, 2, net.moments)
    x = rng.normal(size=(4, inputs))
    out, _, _ = net.forward(weights, moments, x)
    assert out == pytest.approx(np.array([plain_forward(net, weights, moments, r) for r in x]), rel=1e-9)
    assert net.outputs == out.shape[1]


@pytest.mark.parametrize("layers, inputs, classes", [(NETS[0], 19, 3), (NETS[1], 7, None), (NETS[2], 9, 3)])
def test_gradients_equal_finite_differences(layers, inputs, classes):
    layers = [layer for layer in layers if layer[0] != "drop"]
    net = MN.Network(layers, inputs)
    rng = np.random.default_rng(2)
    weights, moments = net.start(3)
    weights = weights + rng.normal(scale=0.05, size=net.size)
    x = rng.normal(size=(12, inputs))
    target = rng.integers(0, classes, 12).astype(float) if classes else x

    def loss(w):
        return net.loss(net.forward(w, moments, x, np.random.default_rng(0))[0], target)[0]

    out, tape, _ = net.forward(weights, moments, x, np.random.default_rng(0))
    gradient = net.backward(weights, tape, net.loss(out, target)[1])
    assert gradient.shape == (net.size,)
    off = 0
    for i in rng.choice(net.size, min(80, net.size), replace=False):
        step = np.zeros(net.size)
        step[i] = 1e-6
        off += gradient[i] != pytest.approx((loss(weights + step) - loss(weights - step)) / 2e-6, abs=2e-4)
    assert off <= 2  # a step may cross the kink of a rectifier


def test_sums_over_tasks_equal_those_of_one(spark):
    net = MN.Network([["dense", 4], ["relu"], ["norm"], ["dense", 2]], 3)
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(rng.normal(size=3).tolist(), float(i % 2)) for i in range(40)], "features array<double>, target double")
    weights, moments = net.start(1)
    one, many = (MN.step_sums(rows.repartition(n), net, weights, moments, None, 0) for n in (1, 200))
    assert one["rows"] == many["rows"] == 40 and one["loss"] == pytest.approx(many["loss"])
    x, own = np.array([r.features for r in rows.collect()]), MN.step_sums(rows.coalesce(1), net, weights, moments, 0, 0)
    hidden = np.maximum(x @ net._split(weights)[0][0], 0)
    merged = MN._squared(net, own["moments"], back=True)
    assert merged[:4] == pytest.approx(hidden.mean(0)) and merged[4:] == pytest.approx(hidden.var(0))


def test_a_network_learns_and_is_saved(spark, tmp_path):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 8))
    y = (x[:, 2] * x[:, 3] > 0).astype(float)  # no straight line tells them apart
    rows = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, features array<double>, target double")
    effort = MN.Effort(epochs=60, batch=240, rate=0.01, tasks=2)
    fitted = MN.fit_network(rows, MN.convolution_layers(8, 2), 8, effort)
    assert fitted.losses[-1] < 0.6 * fitted.losses[0] and 20 >= len(fitted.held_losses) > 3
    again = MN.fit_network(rows.repartition(3), MN.convolution_layers(8, 2), 8, MN.Effort(epochs=2, batch=160, tasks=2))
    assert np.allclose(again.weights, MN.fit_network(rows, MN.convolution_layers(8, 2), 8, MN.Effort(epochs=2, batch=160, tasks=2)).weights)
    from pyspark.ml.functions import array_to_vector
    ready = rows.withColumn("v", array_to_vector("features"))
    model = MN.NetworkModel("v", "p").holding(fitted, predictionCol="says")
    said = model.transform(ready)
    assert said.filter("says = target").count() > 540
    model.write().overwrite().save(str(tmp_path / "net"))
    loaded = MN.NetworkModel.load(str(tmp_path / "net")).transform(ready)
    assert said.select("id", "p", "says").exceptAll(loaded.select("id", "p", "says")).count() == 0
    empty = MN.fit_network(rows.limit(0), MN.convolution_layers(8, 2), 8, effort)
    assert empty.losses == [] and empty.weights.shape == fitted.weights.shape


def test_autoencoder_beats_its_linear_form(spark, tmp_path):
    rng = np.random.default_rng(6)
    t = rng.uniform(-2, 2, (900, 2))
    data = np.stack([t[:, 0], t[:, 0] ** 2, np.sin(2 * t[:, 0]), t[:, 1], t[:, 1] ** 2, np.cos(2 * t[:, 1])], axis=1)
    frame = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "id int, a double, b double, c double, d double, e double, f double")
    rows = VectorAssembler(inputCols=list("abcdef"), outputCol="features").transform(frame)
    seen, fresh = rows.filter("id < 700"), rows.filter("id >= 700")
    effort = MN.Effort(epochs=150, batch=600, rate=0.008, patience=20, tasks=2)
    deep, flat = MA.fit_autoencoder(seen, size=2, effort=effort), MA.fit_anomaly_detector(seen, size=2)
    error = {k: MA.anomaly_scores(d, fresh, []).agg(F.avg("anomaly_score")).first()[0] for k, d in (("deep", deep), ("flat", flat))}
    assert error["deep"] < 0.8 * error["flat"]
    assert deep.threshold == pytest.approx(deep.mean_error + 2 * deep.std_error)
    odd = VectorAssembler(inputCols=list("abcdef"), outputCol="features").transform(
        spark.createDataFrame([(1, 2.0, -9.0, 9.0, -2.0, -9.0, 9.0)], "id int, a double, b double, c double, d double, e double, f double"))
    verdict = MA.anomaly_verdicts(deep, odd, ["id"]).first()
    assert verdict.is_anomaly and verdict.confidence == 1.0
    assert len(MA.encoded_features(deep, odd, ["id"]).first().code) == 2
    MP.save_anomaly_detector(deep, spark, str(tmp_path))
    again = MA.anomaly_scores(MP.load_anomaly_detector(spark, str(tmp_path)), odd, []).first()
    assert again.anomaly_score == pytest.approx(verdict.anomaly_score)


def test_an_epoch_of_many_batches_is_one_job_with_the_same_result_in_any_layout(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 6))
    rows = spark.createDataFrame([(r.tolist(), float(r[0] * r[1] > 0)) for r in x], "features array<double>, target double")
    layers = [["dense", 16], ["relu"], ["norm"], ["dense", 2]]
    steps = []
    step_sums = MN.step_sums
    monkeypatch.setattr(MN, "step_sums", lambda *a: steps.append(a[4]) or step_sums(*a))
    effort = MN.Effort(epochs=12, batch=20, rate=0.01, tasks=3)
    one = MN.fit_network(rows, layers, 6, effort)
    assert set(steps) == {None} and len(steps) == len(one.held_losses)  # only the held-back rows are judged apart
    assert one.losses[-1] < 0.6 * one.losses[0] and min(one.held_losses) < 0.5
    again = MN.fit_network(rows.repartition(5), layers, 6, effort)
    assert np.allclose(one.weights, again.weights) and np.allclose(one.moments, again.moments)
