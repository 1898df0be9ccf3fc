import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from flowsentry.llm.packing import GATHERED, Mixer, pack
from flowsentry.llm.queries import TOKENIZER
from flowsentry.llm.sharding import SHARDS, shard, walk
from flowsentry.llm.tokens import Encoder

from .conftest import ODD

PATH = public_tokenizers.path(TOKENIZER)


def ids_of(texts):
    return [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(pieces, rows):
    """Every id lies in one piece, and sequences have no gaps. Returns the lengths of sequences."""
    want = sorted((str(i), tuple(x)) for (i, _), x in zip(rows, ids_of([t for _, t in rows])))
    sequences, lengths = {}, {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
        lengths.setdefault(str(p.doc_id), []).append(p)
    filled = []
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert 0 < at <= 4096
        filled.append(at)
    for name in {n for n, _ in want}:
        twins = [x for n, x in want if n == name]
        own = sorted(lengths[name], key=lambda p: (p.doc_tokens, p.start))
        assert sum(p.length for p in own) == sum(map(len, twins))
        for p in own:
            assert any(p.doc_tokens == len(x) and zlib.crc32(np.array(x[p.start:p.start + p.length], "<u4").tobytes())
                       == p.ids_crc32 for x in twins)
        if len(twins) == 1:
            starts = [p.start for p in own]
            assert starts == [0, *np.cumsum([p.length for p in own])[:-1].tolist()]
    return filled


def test_ids_are_the_tokenizers():
    texts = [t or "" for _, t in ODD] + ["Can't we'll I'M\tit's  A.B--c\r\n\u2028x", "ΣΑΣ İ e\u0301", "\n\n", "a" * 300]
    assert [x.tolist() for x in Encoder(PATH).encode(texts, 2)] == ids_of(texts)
    assert Encoder(PATH).encode([]) == []


def test_a_word_is_encoded_once_however_it_is_written():
    encoder = Encoder(PATH)
    texts = ["And, and. AND! (and) --and", "and\nAnd;and", "H\u0331and", "<|ENDOFTEXT|> <|endoftext|>And."]
    assert [x.tolist() for x in encoder.encode(texts[:2], 2)] == ids_of(texts[:2])
    assert sum(b"and" in w.lower() for w in encoder.known) == 1
    assert [x.tolist() for x in encoder.encode(texts, 2)] == ids_of(texts)


def test_whole_corpus_in_full_windows(table):
    docs = table("documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    filled = check(pack(docs, PATH).collect(), rows)
    assert sum(f < 4096 for f in filled) <= 1
    # one window of every GATHERED tasks may stay open
    filled = check(pack(docs.repartition(9), PATH).collect(), rows)
    assert sum(f < 4096 for f in filled) <= -(-9 // GATHERED)


def test_odd_rows(docs):
    check(pack(docs(*ODD), PATH).collect(), ODD)
    assert pack(docs(*ODD).limit(0), PATH).count() == 0


def test_windows_follow_the_targets():
    mixer = Mixer({1: 0.7, 2: 0.2, 3: 0.1})
    rng = np.random.default_rng(2)
    for n in range(3000):
        q = 1 + n % 3
        mixer.add(q, str(q), n, 0, np.zeros(int(rng.integers(1, 3000)), np.uint32), 1)
    shares = []
    for _ in range(50):
        window = list(mixer.window())
        assert sum(len(p[2]) for p in window) == 4096
        shares.append([sum(len(p[2]) for p in window if p[4] == s) / 4096 for s in "123"])
    assert np.abs(np.array(shares) - [0.7, 0.2, 0.1]).max() < 0.05
    assert np.abs(np.mean(shares, axis=0) - [0.7, 0.2, 0.1]).max() < 0.005


def test_shares_of_a_table_sorted_by_source(spark):
    rows = [(n, "some words of a text " * (10 + n % 50), source) for source in "abc" for n in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2)
    for frame in (docs, docs.coalesce(1)):
        windows = {}
        for p in pack(frame, PATH, capacity=256).collect():
            windows.setdefault(p.sequence_id, dict.fromkeys("abc", 0))[p.source] += p.length
        shares = np.array([[w[s] / 256 for s in "abc"] for w in windows.values() if sum(w.values()) == 256])
        assert len(shares) > 200 and np.abs(shares - 1 / 3).mean() < 0.05


def test_credit_of_absent_sources_moves_on():
    mixer = Mixer({1: 0.5, 2: 0.5})
    mixer.add(1, "1", "a", 0, np.zeros(20_000, np.uint32), 20_000)
    for _ in range(3):
        list(mixer.window())
    rest = [(p[1], p[5]) for p in mixer.rest() if p[5] is not None]
    assert sorted(rest) == [(1, -3 * 2048.0), (2, 3 * 2048.0)]


def test_credit_is_carried():
    mixer = Mixer({1: 0.5, 2: 0.5})
    mixer.add(1, "1", "a", 0, np.zeros(20_000, np.uint32), 20_000)
    list(mixer.window())  # the second source has nothing to send yet
    mixer.add(2, "2", "b", 0, np.zeros(20_000, np.uint32), 20_000)
    second = [sum(len(p[2]) for p in mixer.window() if p[4] == "2") for _ in range(3)]
    assert second[0] > 2048 or mixer.credit[1] <= mixer.credit[2]
    assert sum(len(p[2]) for p in mixer.drain(0)) + mixer.waiting >= 0 and mixer.waiting == 0


def placed(found, rows):
    got = sorted((str(r.doc_id), r.size, r.text_crc32) for r in found)
    assert got == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    for s in {r.shard for r in found}:
        assert 0 <= s < SHARDS and sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_shards_are_even_and_gapless(table):
    rows = [(r.doc_id, r.text) for r in table("documents").collect()]
    found = shard(table("documents")).collect()
    placed(found, rows)
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(SHARDS)]
    largest = max(len(t.encode()) for _, t in rows) + 1
    assert max(sizes) <= 1.001 * sum(sizes) / SHARDS + largest + 1


def test_one_text_in_a_third_of_all_rows(docs):
    rows = [(i, "the same text again and again" if i % 3 else f"text number {i} " * (i % 7)) for i in range(3000)]
    found = shard(docs(*rows)).collect()
    placed(found, rows)
    sizes = [sum(r.size for r in found if r.shard == s) for s in range(SHARDS)]
    assert max(sizes) < 1.05 * min(sizes)


def test_a_new_shard_moves_little(docs):
    rows = [(i, f"text {i} " * 5) for i in range(4000)]
    before = {r.doc_id: r.shard for r in shard(docs(*rows), 16).collect()}
    after = {r.doc_id: r.shard for r in shard(docs(*rows), 17).collect()}
    assert sum(before[i] != after[i] for i in before) < 0.35 * len(rows)


def test_odd_rows_of_shards(docs):
    placed(shard(docs(*ODD)).collect(), ODD)
    assert shard(docs(*ODD).limit(0)).count() == 0


def test_the_walk_keeps_to_the_bound():
    rng = np.random.default_rng(0)
    loads, owner = rng.integers(0, 1000, 64), rng.integers(0, 4, 64)
    loads[5] = 40_000
    room = np.zeros(4, int)
    for cut, load in zip(walk(loads, owner, 4, 0.01), loads):
        ends = [p for p, _ in cut]
        assert ends == sorted(ends) and ends[-1] == load
        for (past, s), first in zip(cut, [0, *ends]):
            room[s] += past - first
    assert room.sum() == loads.sum() and room.max() <= 1.01 * loads.sum() / 4 + 1
