"""Language-model scores: exact counts, coding that adds up to one, sums that don't depend on the other texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from flowsentry.llm import contextmix, lmscore
from flowsentry.llm.contextmix import SLOTS, bit_counts, coded, fixed_mix, log_odds, tree_counts
from flowsentry.llm.lmscore import before, cell_of, distinct_before, letter_contexts, lm_scores, numbered, token_contexts


def texts(seed, count, words):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(words, [1 / (1 + k) for k in range(len(words))], k=rng.randint(0, 80)))) for i in range(count)]


WORDS = ["The", "of", "a", "word", "words", "seldom", "Ärger", "ÄRGER", "été", "x y", "1 2"] + [f"rare{i}" for i in range(200)]


def small_tables(symbols, one, two):
    pairs = np.bincount(one * 256 + symbols, minlength=1 << 16).reshape(256, 256)
    alone, after = log_odds(tree_counts(pairs.sum(axis=0, keepdims=True))), log_odds(tree_counts(pairs))
    return [(one * 0, alone), (one, after)], log_odds(bit_counts(symbols, [two]))[0]


def test_counts_of_nodes_from_counts_of_symbols():
    rng = np.random.default_rng(1)
    symbols = rng.integers(0, 256, 500)
    tree = tree_counts(np.bincount(symbols, minlength=256)[None])[0]
    for depth in range(8):
        for node in range(1 << depth, 2 << depth):
            bits = [s >> (7 - depth) & 1 for s in symbols if (1 << depth | s >> (8 - depth)) == node]
            assert tree[node].tolist() == [bits.count(0), bits.count(1)]


def test_symbols_share_all_probability():
    rng = np.random.default_rng(2)
    learnt = rng.integers(0, 256, 4000) // rng.integers(1, 9, 4000)
    one, two = token_contexts(learnt, np.arange(4000) % 50 == 0)
    small, table = small_tables(learnt, one, two)
    past = learnt[:40]

    def log_chance(lane):
        one, two = token_contexts(lane, np.arange(len(lane)) == 0)
        numbers = [(one * 0, small[0][1]), (one, small[1][1])]
        return coded(lane, numbers, two, table, np.array([0]), np.array([len(lane)]))[0]

    sums = np.array([log_chance(np.append(past, last)) for last in range(256)])
    assert math.isclose(np.exp(sums - log_chance(past)).sum(), 1, abs_tol=1e-4)


def test_letters_share_all_probability():
    words = [bytes([97 + i % 7, 98, 99]) for i in range(50)]
    cells = np.array([cell_of(w) for w in words])
    letters, contexts, _ = letter_contexts(words, cells)
    tables = log_odds(bit_counts(letters, contexts))
    assert math.isclose(np.exp(fixed_mix(np.arange(256), [np.repeat(c[5], 256) for c in contexts], tables)).sum(), 1, abs_tol=1e-6)


def test_lanes_do_not_depend_on_each_other(monkeypatch):
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 90)
    symbols = rng.integers(0, 8, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    first = np.isin(np.arange(len(symbols)), starts)
    one, two = token_contexts(symbols, first)
    small, table = small_tables(symbols, one, two)
    whole = coded(symbols, small, two, table, starts, sizes)
    alone = [coded(symbols, small, two, table, starts[i:i + 1], sizes[i:i + 1])[0] for i in range(90)]
    monkeypatch.setattr(contextmix, "LANES", 7)
    assert np.allclose(whole, alone, rtol=1e-5) and np.allclose(whole, coded(symbols, small, two, table, starts, sizes), rtol=1e-5)
    assert (whole < 0).all() and -whole.sum() / np.log(2) / len(symbols) < 3.4


def test_earlier_elements():
    rng = np.random.default_rng(4)
    key, new = rng.integers(0, 5, 60), rng.random(60) < 0.5
    assert before(key).tolist() == [int((key[:i] == key[i]).sum()) for i in range(60)]
    assert distinct_before(key, new)[0].tolist() == before(key).tolist()
    assert distinct_before(key, new)[1].tolist() == [int((new[:i] & (key[:i] == key[i])).sum()) for i in range(60)]


def test_tokens_are_numbered_by_frequency():
    texts = ["  b a\tb \n", "", "", "a\x0bb \x0c", "É \x1c a\u00a0"]
    sizes, tokens, words = numbered([t.encode() for t in texts])
    assert sizes.tolist() == [4, 1, 1, 3, 4] and words[0] == b""
    assert [words[t] for t in tokens] == [b"b", b"a", b"b", b"", b"", b"", b"a", b"b", b"", "É".encode(), b"\x1c", "a\u00a0".encode(), b""]
    assert words[1] == b"b"


def plain_counts(rows):
    docs = [(i, bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()).split() + [b""]) for i, t in rows]
    def out(i):
        return i is None or zlib.crc32(str(i).encode()) % 7 == 2
    n = Counter(w for i, d in docs if not out(i) for w in d)
    total = sum(n.values())
    return [(i, out(i), len(d), sum(n[w] > 0 for w in d), total, sum(math.log10((n[w] + 1) / (total + len(n) + 1)) for w in d))
            for i, d in docs]


@pytest.mark.parametrize("slice_bytes", [200, lmscore.SLICE_BYTES])
def test_counts_and_base_scores(spark, monkeypatch, slice_bytes):
    monkeypatch.setattr(lmscore, "SLICE_BYTES", slice_bytes)
    rows = texts(1, 120, WORDS) + [(3, "again and again"), (3, "again and again"), (500, None), (501, ""), (None, "The of"), (502, " \n\t\x0b"),
                                   (503, "The " * 3000), (504, "y" * 40_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'a' AS words", "1 AS slice", "2 AS n")
    made = lm_scores(docs).collect()
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in made), key=str)
    assert got == sorted(((*x[:-1], round(x[-1], 6)) for x in plain_counts(rows)), key=str)
    assert all(r.score < 0 and math.isfinite(r.score) for r in made)
    assert all((r.bits_per_byte is None) == (not (dict(rows)[r.doc_id])) for r in made if r.doc_id != 3)


def test_better_than_counts_on_held_out_texts_of_the_table(spark, table):
    rows = lm_scores(table("documents")).collect()
    held = [r for r in rows if r.held_out]
    known = [r for r in held if r.n_known >= 0.8 * r.n_tokens and r.n_tokens > 50]
    assert known and sum(r.score for r in known) > sum(r.base_score for r in known)


def test_shuffled_words_and_noise_cost_more(spark):
    rng = random.Random(6)
    words = ["the", "cat", "sat", "on", "a", "mat", "and", "then", "it", "ran"]
    plain = [(i, " ".join(words * rng.randint(2, 6))) for i in range(300)]
    made = {}
    for i, text in [(1000, " ".join(words * 4)), (1001, " ".join(rng.sample(words * 4, 40))), (1002, " ".join("qz%d" % k for k in range(40)))]:
        rows = lm_scores(spark.createDataFrame(plain + [(i, text)], "doc_id long, text string")).filter(f"doc_id = {i}").first()
        made[i] = rows.score / rows.n_tokens
    assert made[1000] > made[1001] > made[1002]


def test_no_rows_and_no_training_rows(spark):
    assert lm_scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    row = lm_scores(spark.createDataFrame([(None, "two words")], "doc_id long, text string")).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 3, 0, 0, 0.0) and row.score < 0
    assert SLOTS == 1 << contextmix.SLOT_BITS


def test_codes_are_whole_and_shortest():
    rng = np.random.default_rng(7)
    weights = rng.integers(1, 900, 60)
    sizes, begin, path, counts = contextmix.code_of(weights)
    paths = [tuple(path[b:b + n].tolist()) for b, n in zip(begin, sizes)]
    assert sum(2.0 ** -n for n in sizes.tolist()) == 1 and len(set(paths)) == 60 and len(counts) == 59
    assert all(p[0] >> 1 == 58 for p in paths) and counts[58].sum() == weights.sum()
    for node in range(59):
        assert counts[node].tolist() == [sum(w for w, p in zip(weights.tolist(), paths) if node * 2 + k in p) for k in (0, 1)]
    entropy = -(weights / weights.sum() * np.log2(weights / weights.sum())).sum()
    assert entropy <= (weights * sizes).sum() / weights.sum() < entropy + 0.1


def test_the_whole_word_follows_its_context(spark):
    """Two words of one cell, equally frequent: the word before tells which of them comes, and no words are alike in score."""
    assert cell_of(b"cabat") == cell_of(b"cobat") and cell_of(b"reddish") != cell_of(b"blue")
    taught = [(i, " ".join(["reddish cabat"] * 6 if i % 2 else ["blue cobat"] * 6)) for i in range(400)]
    even = [r for r in taught if zlib.crc32(str(r[0]).encode()) % 7 != 2]
    count = min(sum(r[0] % 2 for r in even), sum(1 - r[0] % 2 for r in even))
    even = [r for k in (0, 1) for r in [x for x in even if x[0] % 2 == k][:count]]
    out = [i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 7 == 2][:4]
    asked = list(zip(out, ["reddish cabat", "reddish cobat", "blue cobat", "blue cabat"]))
    made = {r.doc_id: r for r in lm_scores(spark.createDataFrame(even + asked, "doc_id long, text string")).collect()}
    assert made[out[0]].base_score == made[out[1]].base_score
    assert made[out[0]].score > made[out[1]].score + 0.3 and made[out[2]].score > made[out[3]].score + 0.3


def test_all_next_words_share_all_probability(spark):
    from flowsentry.llm.lmscore import ESCAPE, fit_mix, token_slices

    docs = spark.createDataFrame(texts(5, 60, WORDS), "doc_id long, text string")
    words = Counter(w for _, _, d in [(i, 0, t.lower().encode().split()) for i, t in texts(5, 60, WORDS) if zlib.crc32(str(i).encode()) % 7 != 2] for w in d)
    counts = spark.createDataFrame([*words.items(), (b"", 50)], "word binary, n long")
    model = fit_mix(token_slices(docs, "doc_id", "text"), counts)
    assert 0 < len(model.code.known) < len(words)

    def chance(*text):
        own = list(dict.fromkeys(text))
        return model.log10(own, np.array([own.index(w) for w in text]), np.array([len(text)]))[0]

    past = [b"the", b"word", b"of"]
    spelt = [b"qqq"]
    some = [10 ** (chance(*past, w) - chance(*past)) for w in [b"", *model.code.known]]
    assert 0.5 < sum(some) < 1 and sum(some) + 10 ** (chance(*past, *spelt) - chance(*past)) < 1
    assert model.code.symbols([b"qqq", b"the", b""]).tolist() == [ESCAPE, model.code.known[b"the"], 0]
