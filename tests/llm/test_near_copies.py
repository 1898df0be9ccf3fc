import random

import numpy as np
import pytest

from flowsentry.llm.bagminhash import signatures
from flowsentry.llm.components import components
from flowsentry.llm.nearcopies import _across, _prefixes, _unsettled, near_copies
from flowsentry.llm.words import FOLD, encoded

from .conftest import ODD


def bag(text):
    words = encoded(text).translate(FOLD).split()
    run = min(5, len(words))
    out = {}
    for i in range(len(words) - run + 1 if words else 0):
        key = tuple(words[i:i + run])
        out[key] = out.get(key, 0) + 1
    return out


def likeness(a, b):
    shared = sum(min(n, b.get(k, 0)) for k, n in a.items())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def brute(rows):
    """Smallest id per class of texts that are equal or similar enough."""
    texts = sorted({t or "" for _, t in rows})
    bags = [bag(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if bags[i] and bags[j] and likeness(bags[i], bags[j]) >= 0.8:
                root[find(i)] = find(j)
    place = {t: find(i) for i, t in enumerate(texts)}
    least = {}
    for i, t in rows:
        if i is not None:
            c = place[t or ""]
            least[c] = min(least.get(c, i), i)
    return sorted((str(i), str(least.get(place[t or ""]))) for i, t in rows)


def got(found):
    return sorted((str(r.doc_id), str(r.class_id)) for r in found.collect())


def test_signatures_are_unbiased():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, 300).astype(float)
    b = np.where(rng.random(300) < 0.7, a, rng.integers(0, 9, 300)).astype(float)
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    elements = rng.integers(1, 1 << 62, 300).astype(np.uint64)
    made = signatures(np.concatenate([elements[a > 0], elements[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]),
                      np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()]), 2, 8192)
    assert abs((made[0] == made[1]).mean() - truth) < 0.02


def test_small_bags_fill_every_slot():
    made = signatures(np.array([5, 9], np.uint64), np.array([1.0, 4000.0]), np.array([0, 2]), 3, 96)
    assert (made[0] != 0).all() and (made[1] == 0).all() and (made[2] != 0).all()


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a int, b int")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in range(100, 120)} == {100}
    assert found[201] == 200 and len(found) == 41 + 20 + 2
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_classes_equal_brute_force_on_documents(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    assert got(near_copies(table("documents"))) == brute(rows)


def test_a_crowd_of_edited_copies(docs):
    """Copies at all distances from each other, where a bucket's hub alone doesn't settle everything."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(120)]
    rows = []
    for n in range(90):
        own = list(words)
        for _ in range(rng.randrange(0, 6)):
            own[rng.randrange(120)] = f"x{n}_{rng.randrange(9)}"
        rows.append((n, " ".join(own)))
    rows += [(1000 + n, t) for n, (_, t) in enumerate(rows[:30])]
    assert got(near_copies(docs(*rows))) == brute(rows)


def test_odd_rows(docs, spark):
    assert got(near_copies(docs(*ODD))) == brute(ODD)
    assert near_copies(docs(*ODD).limit(0)).count() == 0
    same = near_copies(docs(*[(i, "one text that all of them have") for i in range(50)]))
    assert {r.class_id for r in same.collect()} == {0}
    assert near_copies(spark.createDataFrame([], "doc_id long, text string")).columns == ["doc_id", "class_id", "copy_of"]


def test_small_loops_are_not_compiled_and_the_setting_comes_back(spark):
    from flowsentry.llm.components import components, interpreted

    name = "spark.sql.codegen.wholeStage"
    before = spark.conf.get(name, "true")
    links = spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9)], "a long, b long")
    with interpreted(spark, small=True):
        assert spark.conf.get(name) == "false"
    assert {tuple(r) for r in components(links).collect()} == {(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)}
    assert spark.conf.get(name) == before


def test_slices_hold_at_most_the_limit(spark):
    from flowsentry.llm.batches import map_chunks

    docs = spark.createDataFrame([("x" * 300,)] * 10 + [(None,), ("y" * 5000,)], "text string").coalesce(1)
    sizes = map_chunks(docs, "text", "rows long", lambda batch: {"rows": [batch.num_rows]}, 1000)
    assert [r.rows for r in sizes.collect()] == [3, 3, 3, 2, 1]


def test_a_small_link_table_takes_few_jobs_and_a_large_one_gives_the_same(spark, monkeypatch):
    from flowsentry.llm import components as module

    rng = random.Random(8)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(350)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (5, None)]
    frame = spark.createDataFrame([(f"n{a:04}".encode() if a is not None else None, f"n{b:04}".encode() if b is not None else None)
                                   for a, b in links], "a binary, b binary")
    over = list(range(2000))
    for _ in range(70):
        for a, b in links:
            if a is not None and b is not None:
                over[a] = over[b] = min(over[a], over[b])
    ends = {x for a, b in links if a is not None and b is not None and a != b for x in (a, b)}
    truth = {(f"n{x:04}".encode(), f"n{over[x]:04}".encode()) for x in ends}

    def found():
        return [(bytes(r.node), bytes(r.component)) for r in components(frame).collect()]

    spark.sparkContext.setJobGroup("small links", "")
    small = found()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("small links")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    monkeypatch.setattr(module, "ROWS_A_TASK", 40)
    large = found()
    assert set(small) == set(large) == truth and len(small) == len(large) == len(truth)
    assert len(jobs) <= 12


def test_steps_that_read_a_table_twice_are_planned_once(spark):
    active = spark.sql("select * from values (x'01', 1L, x'01'), (x'02', 1L, x'01'), (x'03', 1L, x'01') t(key, bucket, hub)")
    compared = spark.sql("select * from values (x'01', x'02', 8, 10), (x'01', x'03', 7, 10) t(a, b, shared, joint)")
    classes = spark.sql("select * from values (x'01', x'01'), (x'02', x'01') t(node, component)")
    bags = spark.sql("select key, array(1L, 2L, 3L, 4L, 5L) as items from values (x'01'), (x'02'), (x'03') t(key)")
    rare = _prefixes(bags.join(_unsettled(active, compared, classes, 0.8), "key", "left_semi"), 0.8)
    pairs = _across(rare, classes, 8, 0.8)
    for made in (rare, pairs):
        assert made._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 8
    assert {bytes(r.key) for r in rare.collect()} == {b"\x02", b"\x03"}
    assert [(bytes(r.a), bytes(r.b)) for r in pairs.collect()] == [(b"\x02", b"\x03")]
