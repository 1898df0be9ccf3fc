import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm.folds import held_out, training_labels
from flowsentry.llm.quality import Discriminant, fit_quality, keep_good, score_quality, statistics
from flowsentry.llm.toxicity import SLOTS, Ratios, fit_toxicity, keep_civil, score_toxicity, slots_of

from .conftest import ODD

FOLDER = "/root/testdata/sf0.01"


def measured(scored, labels, label):
    rows = scored.filter("held_out").join(labels, "doc_id").select("predicted", label).collect()
    return sum(r.predicted == r[label] for r in rows) / len(rows), len(rows)


def test_folds(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in rows)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, y int")
    found = {r.doc_id: r.label for r in training_labels(labels, "y").collect()}
    assert found == ({1: 1} if zlib.crc32(b"1") % 5 else {})


def test_densities_equal_the_textbook_formula():
    rng = np.random.default_rng(1)
    parts = [rng.normal(size=(300, 3)), rng.normal(1, 2, size=(500, 3))]
    model = Discriminant.fit(np.array([300.0, 500.0]), np.array([p.sum(0) for p in parts]),
                             np.array([p.T @ p for p in parts]), 0, 0)
    rows = rng.normal(size=(20, 3))
    logs = []
    for k, p in enumerate(parts):
        both = (300 * np.cov(parts[0].T, bias=True) + 500 * np.cov(parts[1].T, bias=True)) / 800
        cov = (len(p) * np.cov(p.T, bias=True) + 3 * both) / (len(p) + 3) + 1e-4 * np.eye(3)
        d = rows - p.mean(0)
        logs.append(np.log(len(p) / 800) - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * (d @ np.linalg.inv(cov) * d).sum(1))
    assert np.allclose(model.score(rows, 1.0), 1 / (1 + np.exp(logs[0] - logs[1])))


def test_quality_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    model = fit_quality(docs, labels)
    accuracy, rows = measured(score_quality(docs, model), labels, "quality")
    assert rows > 50 and accuracy > 0.97
    kept = keep_good(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == score_quality(docs, model).filter("predicted = 1").count() > 0


def test_toxicity_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    model = fit_toxicity(docs, labels)
    rows = score_toxicity(docs, model).filter("held_out").join(labels, "doc_id").collect()
    caught = [r.predicted for r in rows if r.toxic == 1]
    wrong = [r.predicted for r in rows if r.toxic == 0]
    assert sum(caught) / len(caught) >= 0.9 and sum(caught) / (sum(caught) + sum(wrong)) >= 0.9
    assert keep_civil(docs, model).count() == score_toxicity(docs, model).filter("predicted = 0").count()


def test_ratios_equal_a_recount(spark, monkeypatch):
    """Features and their weights follow from how many toxic and other texts have each slot."""
    texts = [(i, ("awful stupid " if i % 4 == 0 else "kind gentle ") + f"word{i % 7} and more", int(i % 4 == 0)) for i in range(300)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, toxic int")
    kept = [(t, y) for i, t, y in texts if zlib.crc32(str(i).encode()) % 5]
    mark, found = np.zeros(SLOTS, np.int64), np.zeros((2, SLOTS))
    for t, y in kept:
        found[y, slots_of(t, mark)] += 1
    size = [sum(y == k for _, y in kept) for k in (0, 1)]
    p, q = found[1] + 0.5, found[0] + 0.5
    ratio = np.log(p / (size[1] + 1)) - np.log(q / (size[0] + 1))
    strong = np.argsort(-np.abs(ratio / np.sqrt(1 / p + 1 / q)) - (found.sum(0) > 0) * 1e-9, kind="stable")[:20]
    monkeypatch.setattr("flowsentry.llm.toxicity.FEATURES", 20)
    model = fit_toxicity(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    used = np.flatnonzero(model.weight)
    assert len(used) <= 20 and (found[:, used].sum(0) > 0).all()
    assert np.abs(ratio[used]).min() >= np.abs(ratio[strong]).min() - 1e-9
    assert (np.sign(model.weight[used]) == np.sign(ratio[used])).all()


def test_slots_are_distinct_and_stable():
    mark = np.zeros(SLOTS, np.int64)
    once, again = slots_of("Some text, some text", mark), slots_of("some TEXT, some text", mark)
    assert len(set(once)) == len(once) and set(once) == set(again)
    assert set(slots_of(None, mark)) == set(slots_of("", mark))


@pytest.mark.parametrize("labels", [[], [(3, 1, 0), (4, 1, 0)], [(3, 1, 1), (4, 0, 0), (5, 1, 1), (1, 0, 1), (None, 1, 1), (99, 0, 1)]])
def test_odd_rows_and_labels(docs, spark, labels):
    odd = docs(*ODD)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for scored in (score_quality(odd, fit_quality(odd, known)), score_toxicity(odd, fit_toxicity(odd, known))):
        rows = scored.collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 and r.held_out is not None for r in rows)
    empty = odd.limit(0)
    assert score_quality(empty, fit_quality(empty, known)).count() == 0
    assert score_toxicity(empty, fit_toxicity(empty, known)).count() == 0
    assert keep_civil(odd, Ratios(np.zeros(SLOTS), -1.0)).count() == len(ODD)
    assert keep_good(odd, fit_quality(odd, known)).columns == odd.columns
    assert statistics([None, ""]).shape[0] == 2 and np.isfinite(statistics([t for _, t in ODD])).all()


def test_a_bound_on_the_fit_is_kept(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic"))
    assert 0 < score_toxicity(docs, fit_toxicity(docs, labels, fit_rows=100)).first().score < 1
