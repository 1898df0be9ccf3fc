"""Periodic runs against a direct search over all periods; the transform against plain sums."""

import hashlib
import zlib

import numpy as np
import pytest

from flowsentry.llm.ntt import matches
from flowsentry.llm.periodicity import periodic_runs, planted, run_digests, runs_of


def plain_runs(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1)
    return sorted((a, b, q) for (a, b), q in found.items())


@pytest.mark.parametrize("width, size, top", [(2, 8, 181), (8, 32, 90), (64, 256, 32), (1024, 4096, 8)])
def test_blocks_match_exactly_where_no_word_differs(width, size, top):
    rng = np.random.default_rng(width)
    windows = rng.integers(1, min(top, 3) + 1, (6, size)).astype(float)
    blocks = windows[:, 3:3 + width].copy()
    blocks[1, 0] = top if blocks[1, 0] != top else 1
    row, shift = matches(blocks, windows)
    expected = {(r, s) for r in range(6) for s in range(size - width + 1) if (windows[r, s:s + width] == blocks[r]).all()}
    assert set(zip(row.tolist(), shift.tolist())) == expected and (0, 3) in expected


def test_runs_equal_a_direct_search():
    rng = np.random.default_rng(5)
    for trial in range(300):
        letters, n = rng.integers(1, 5), rng.integers(0, 200)
        ids = rng.integers(0, letters, n)
        for _ in range(rng.integers(0, 3)):
            if n > 20:
                a, p = rng.integers(0, n - 10), rng.integers(1, 40)
                ids[a:] = ids[a + np.arange(n - a) % p % max(n - a, 1)] if a + p <= n else ids[a:]
        assert runs_of(ids.astype(np.int64)) == plain_runs(ids.tolist()), ids.tolist()


def test_sturmian_and_one_word_sequences():
    a, b = [0], [0, 1]
    while len(b) < 900:
        a, b = b, b + a
    assert runs_of(np.array(b[:900])) == plain_runs(b[:900])
    assert runs_of(np.zeros(70_000, np.int64)) == [(0, 70_000, 1)]


def test_periods_longer_than_a_transform():
    rng = np.random.default_rng(1)
    part = rng.integers(0, 50_000, 90_000)
    ids = np.concatenate([[60_000], part, part, part[:17], [60_001]])
    assert runs_of(ids) == [(1, 180_018, 90_000)]


def test_documents_with_planted_endings(spark):
    rng = np.random.default_rng(9)
    texts = {i: " ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(0, 300))) for i in range(60)}
    texts[60] = "no no no no no no no no no no no no\tno no yes"
    rows = [(i, t) for i, t in texts.items()] + [(7, "x y " * 12), (8, None), (9, ""), (None, "a " * 12), (10, " \n\t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' AS key", "1 AS id", "2 AS runs")
    made = sorted(map(tuple, run_digests(periodic_runs(docs, change=planted)).collect()), key=str)
    expected = []
    for i, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = [(a, b - a, q) for a, b, q in plain_runs(words)]
        gone = {k for a, size, q in runs for k in range(a + q, a + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        expected.append((i, len(runs), *best, best[1] and 1000 * best[1] // best[2],
                         hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest(),
                         hashlib.sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    assert made == sorted(expected, key=str)
    assert sum(r[1] for r in expected) > 5


def test_no_rows(spark):
    assert periodic_runs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
