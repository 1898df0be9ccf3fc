import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowsentry.llm import decontaminate as DC
from flowsentry.llm.fmindex import FMIndex, WaveletTree

from .conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(rows, items, window=10):
    windows = {}
    for name, text in items:
        w = words(text)
        n = min(window, len(w))
        if name is not None and n:
            for a in range(len(w) - n + 1):
                windows.setdefault(tuple(w[a:a + n]), set()).add(str(name))
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((str(i), len(w), len(hit), sorted(found)))
    return sorted(out)


def got(found):
    return sorted((str(r.doc_id), r.n_words, sum(s["past"] - s["first"] for s in r.spans), list(r["items"])) for r in found.collect())


def test_ranks_and_access():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 37, 500)
    tree = WaveletTree(text)
    assert (tree.access(np.arange(500)) == text).all()
    for c in range(40):
        at = rng.integers(0, 501, 20)
        assert tree.rank(np.full(20, c), at).tolist() == [(text[:p] == c).sum() for p in at] if c < 37 else True


@pytest.mark.parametrize("seed", range(6))
def test_the_index_finds_every_occurrence(seed):
    rng = np.random.default_rng(seed)
    text = rng.integers(0, 4, int(rng.integers(0, 200)))
    index = FMIndex(text)
    for length in (1, 2, 4, 7):
        phrases = rng.integers(1, 6, (15, length))
        which, place = index.find(phrases)
        want = [(i, j) for i in range(15) for j in range(len(text) - length + 1) if (text[j:j + length] == phrases[i]).all()]
        assert sorted(zip(which.tolist(), place.tolist())) == sorted(want)


def test_hits_equal_brute_force_on_documents(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    items = [(r.item_id, r.text) for r in table("benchmark").collect()]
    found = DC.find_hits(table("documents"), table("benchmark"))
    assert got(found) == brute(rows, items) and found.filter("size(spans) > 0").count() > 0


ITEMS = [(1, "Short item"), (2, None), (None, "no name but words"), (3, ""), (4, "..."), (5, " ".join(f"q{i}" for i in range(14))),
         (5, "short ITEM"), (6, "solo")]
TEXTS = ODD + [(20, "x SHORT-item y short item"), (21, " ".join(f"q{i}" for i in range(14)) + " solo"),
               (22, " ".join(f"q{i}" for i in range(9))), (23, "q0 " * 30), (24, "short short item item")]


@pytest.mark.parametrize("slice_bytes", [1, 40, 1 << 20])
def test_odd_rows_and_slices(docs, spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(DC, "SLICE_BYTES", slice_bytes)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("spans", F.lit(1))
    assert got(DC.find_hits(docs(*TEXTS), bench)) == brute(TEXTS, ITEMS)
    cut = DC.remove_hits(docs(*TEXTS), bench)
    assert cut.columns == docs(*TEXTS).columns and cut.count() == len(TEXTS)
    left = [(r.doc_id, r.text) for r in cut.collect()]
    assert all(n == 0 for _, _, n, _ in brute(left, ITEMS))
    clean = {str(i) for i, _, n, _ in brute(TEXTS, ITEMS) if n == 0}
    assert sorted(str(x) for x in left if str(x[0]) in clean) == sorted(str(x) for x in TEXTS if str(x[0]) in clean)
    assert got(DC.find_hits(docs(*TEXTS), bench.limit(0))) == brute(TEXTS, [])
    assert DC.find_hits(docs(*TEXTS).limit(0), bench).count() == 0
