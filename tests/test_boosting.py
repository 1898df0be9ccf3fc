"""Joint boosting: splits against brute force, scores against a plain walk, training on small tables."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from flowsentry.ml.boosting import BoostedModel, Boosting, Trees, best_splits, fit_boosting, slopes


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    scores, target = rng.normal(size=(6, 3)), rng.integers(0, 3, 6)

    def loss(s):
        return -(s[np.arange(6), target] - np.log(np.exp(s).sum(axis=1))).sum()

    grad, _ = slopes(scores, target)
    for i in range(6):
        for k in range(3):
            step = np.zeros_like(scores)
            step[i, k] = 1e-6
            assert grad[i, k] == pytest.approx((loss(scores + step) - loss(scores - step)) / 2e-6, abs=1e-6)


def test_best_split_equals_brute_force():
    rng = np.random.default_rng(2)
    grad, curve = rng.normal(size=(2, 4, 5, 9)), rng.uniform(0.1, 1, (2, 4, 5, 9))
    # every feature splits the same rows
    grad[..., -1] += grad[..., :1, :].sum(-1) - grad.sum(-1)
    curve[..., -1] += curve[..., :1, :].sum(-1) - curve.sum(-1) + 3
    curve[..., 0, -1] += 0
    curve[..., -1] += curve.sum(-1).max(-1, keepdims=True) - curve.sum(-1)
    b = Boosting()
    feature, at, gain, leaf = best_splits(grad, curve, b)
    for k in range(2):
        for n in range(4):
            G, H = grad[k, n, 0].sum(), curve[k, n, 0].sum()
            def worth(f, i):
                g, h = grad[k, n, f, :i + 1].sum(), curve[k, n, f, :i + 1].sum()
                if h < 1 or H - h < 1:
                    return -np.inf
                return g * g / (h + 1) + (G - g) ** 2 / (H - h + 1) - G * G / (H + 1)
            best = max(worth(f, i) for f in range(5) for i in range(9))
            assert gain[k, n] == pytest.approx(best) and worth(feature[k, n], at[k, n]) == pytest.approx(best)
            assert leaf[k, n] == pytest.approx(-0.3 * G / (H + 1))


def test_boosted_trees_learn_all_classes_and_are_saved(spark, tmp_path):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(700, 4))
    y = (x[:, 0] > 0).astype(int) + 2 * (x[:, 1] * x[:, 2] > 0)
    rows = spark.createDataFrame([(i, r.tolist(), float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, features array<double>, target double")
    effort = Boosting(rounds=11, depth=4, patience=0, tasks=2)
    trees = fit_boosting(rows, 4, 4, effort)
    assert len(trees.feature) == 11 and (trees.scores(x).argmax(axis=1) == y).mean() > 0.9
    # the same rows in another layout grow the same trees
    again = fit_boosting(rows.repartition(3), 4, 4, Boosting(rounds=2, depth=4, patience=0, tasks=2))
    assert all((a == c).all() for a, c in zip(again.feature, trees.feature)) and np.allclose(again.value[1], trees.value[1])
    for row in x[:20]:
        plain = np.zeros(4)
        for turn in range(11):
            for k in range(4):
                node = 1
                while trees.feature[turn][k][node] >= 0:
                    f, s = trees.feature[turn][k][node], trees.split[turn][k][node]
                    node = 2 * node + (s < len(trees.edges[f]) and row[f] > trees.edges[f][s])
                plain[k] += trees.value[turn][k][node]
        assert trees.scores(row[None])[0] == pytest.approx(plain)
    ready = rows.withColumn("v", array_to_vector("features"))
    model = BoostedModel("v", "p", "says").holding(trees)
    said = model.transform(ready)
    assert said.filter("says = target").count() > 630
    model.write().overwrite().save(str(tmp_path / "trees"))
    assert said.select("id", "p", "says").exceptAll(BoostedModel.load(str(tmp_path / "trees")).transform(ready).select("id", "p", "says")).count() == 0


def test_rounds_end_when_they_stop_helping(spark):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(rng.normal(size=2).tolist(), float(rng.integers(0, 2))) for _ in range(300)], "features array<double>, target double")
    trees = fit_boosting(rows, 2, 2, Boosting(rounds=30, depth=3, patience=2, tasks=1))
    assert len(trees.feature) < 15
    empty = fit_boosting(rows.limit(0), 2, 2, Boosting(rounds=2))
    assert empty.scores(np.zeros((1, 2))).tolist() == [[0.0, 0.0]] and isinstance(empty, Trees)


def test_many_tasks_grow_the_same_trees(spark, monkeypatch):
    from flowsentry.ml import boosting as MB

    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 3))
    rows = spark.createDataFrame([(r.tolist(), float((r[0] > 0) + (r[1] > 0.5))) for r in x], "features array<double>, target double")
    few = fit_boosting(rows, 3, 3, Boosting(rounds=2, depth=3, patience=0, tasks=2))
    monkeypatch.setattr(MB, "ROWS", 30)  # 20 tasks, more than meet in one place
    many = fit_boosting(rows, 3, 3, Boosting(rounds=2, depth=3, patience=0, tasks=2))
    assert all((a == c).all() for a, c in zip(few.feature, many.feature)) and np.allclose(few.value, many.value)
    matrix = rng.normal(size=(7, 3))
    assert (MB._unpacked(MB._packed(matrix).slice(2, 4), np.float64).reshape(4, 3) == matrix[2:6]).all()
