"""Spelling variants against a comparison of all words; the trie against the definition of one edit."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowsentry.llm.spelling import Trie, _verified, near_pairs, one_edit, reachable, spelling_variants, vector


def plain_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def some_words(seed, count, letters="abcqrx", sizes=(4, 8)):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))) for _ in range(count)})


def plain(rows):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = {w: [x for x in n if plain_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: x for w, x in best.items() if n[x] >= 5 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return sorted(out)


def test_one_edit():
    words = some_words(3, 300, "ab", (1, 5))
    for a in words:
        for b in words:
            assert one_edit(a, b) == (plain_edit(a, b) and len(a) <= len(b))


@pytest.mark.parametrize("cells", [None, 0])
def test_budget_reaches_every_longer_or_equal_neighbour_once(monkeypatch, cells):
    words = some_words(4, 400)
    assert cells is None or not monkeypatch.setattr("flowsentry.llm.spelling._CELLS", cells)
    found = list(Trie(words, 0).near(words, np.full(len(words), 2)))
    assert len(found) == len(set(found)) == len({frozenset(x) for x in found})
    assert {frozenset(x) for x in found} == {frozenset((a, b)) for a in words for b in words if plain_edit(a, b)}


def test_first_counts_within_reach():
    a, b = vector("abc"), vector("abcz")
    assert b in list(reachable(a)) and a not in list(reachable(b))
    assert len({tuple(x) for x in reachable([2, 1, 3, 0])}) == len(list(reachable([2, 1, 3, 0])))


def test_long_lists_at_a_leaf():
    around = ["z" * 64, "z" * 65, "z" * 63, *some_words(1, 400)]
    assert {p for p in _verified(around[:3], around) if "z" in p[0]} == {("z" * 63, "z" * 64), ("z" * 64, "z" * 65)}
    assert ('x' * 90_000, 'x' * 90_001) in set(_verified(['x' * 90_000] * 2, ['x' * 90_001, *some_words(1, 400)]))
    words = some_words(5, 3000, "ab", (9, 10))
    pairs = {(a, b) for a, b in _verified(words, words)}
    sample = words[::40]
    assert {p for p in pairs if p[0] in set(sample)} == {(a, b) for a in sample for b in words if one_edit(a, b)}


@pytest.mark.parametrize("group_words", [3, 20_000])
def test_pairs_of_split_groups(spark, group_words):
    words = some_words(6, 500)
    rows = near_pairs(spark.createDataFrame([(w,) for w in words], "word string"), group_words=group_words).collect()
    assert len(rows) == len({frozenset(r) for r in rows})
    assert {frozenset(r) for r in rows} == {frozenset((a, b)) for a in words for b in words if plain_edit(a, b)}


def test_variants_of_documents(spark):
    rng = random.Random(8)
    words = some_words(7, 400, "abcdeé", (6, 7)) + ["x" * 70_000, "y" * 300, "y" * 301]
    weights = [1 / (1 + i % 40) ** 2 for i in range(len(words))]
    rows = [(i, " ".join(rng.choices(words[:-3], weights[:-3], k=60)) + ".") for i in range(400)]
    rows += [(i, "chains " * 60 + "chainz " * 8 + "chaizz ") for i in range(8)]
    rows += [(i, " ".join(words[-3:]).upper()) for i in range(6)] + [(3, rows[3][1])] * 3 + [(None, rows[5][1]), (9, None), (10, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'q' AS word", "1 AS n", "2 AS key")
    made = sorted(tuple(r) for r in spelling_variants(docs).collect())
    assert made == plain(rows) and any(r[1] for r in made) and any(r[2] != (r[1] or r[0]) for r in made)


def test_no_words(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling_variants(docs).collect() == []
