"""Benchmark decontamination: a full-text index per training shard, searched for the benchmark's windows of words.

A window is a run of `window` words of an item; an item of fewer words is one window. A document word is hit if any
occurrence of a window covers it. A shard is a slice of a task's rows. Only stretches of a shard whose adjacent
words are adjacent in some benchmark item can hold a window, so the index is built over those and leaves out the rest.

The windows travel to the tasks in slices of a fixed size; a benchmark of several slices takes as many passes over
the rows, and the hits of the passes are joined. An item is never cut, so a slice holds at least one item.

Defined results: null text has no words and no hits; null or empty items have no windows; a null item id is
left out of the items. Items repeated under one id count once. Repeated rows and ids are each treated for
themselves. An empty table gives an empty result, an empty benchmark no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.batches import fresh, map_chunks
from flowsentry.llm.fmindex import FMIndex
from flowsentry.llm.words import FOLD, encoded, word_places
from flowsentry.session import checkpointed

WINDOW = 10
# Benchmark text that one pass takes to every task.
SLICE_BYTES = 2 << 20


def split_words(text: str | None) -> list[bytes]:
    return encoded(text).translate(FOLD).split()


class Windows:
    """The distinct windows of some items, as rows of word numbers grouped by length."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.words: dict[bytes, int] = {}
        holders: dict[int, dict[tuple, set]] = {}
        for name, text in items:
            ids = [self.words.setdefault(w, len(self.words) + 1) for w in split_words(text)]
            length = min(window, len(ids))
            for at in range(len(ids) - length + 1 if ids else 0):
                holders.setdefault(length, {}).setdefault(tuple(ids[at:at + length]), set()).add(name)
        self.phrases = {n: np.array(list(found), np.int64) for n, found in holders.items()}
        self.items = {n: [frozenset(x) for x in found.values()] for n, found in holders.items()}
        self.shortest = min(holders, default=0)
        rows = [p for n, p in self.phrases.items() if n > 1]
        pairs = [np.stack([p[:, :-1].ravel(), p[:, 1:].ravel()]) for p in rows]
        both = np.concatenate(pairs, axis=1) if pairs else np.zeros((2, 0), np.int64)
        self.pairs = np.unique(both[0] * (len(self.words) + 1) + both[1])

    def hits(self, texts: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """Merged spans of hit words and the items found, for each text."""
        spans, items = [[] for _ in texts], [set() for _ in texts]
        get = self.words.get
        # a divider before each text and one at the end
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(sizes) - sizes + 1
        ids = np.zeros(int(sizes.sum()) + 1, np.int64)
        for start, words in zip(starts, texts):
            ids[start:start + len(words)] = [get(w, 0) for w in words]
        kept = self._stretches(ids)
        if not len(kept):
            return spans, items
        # stretches stay apart in the index
        gaps = np.flatnonzero(np.diff(kept) > 1) + 1
        body, origin = np.insert(ids[kept], gaps, 0), np.insert(kept, gaps, -1)
        index = FMIndex(body)
        cover = np.zeros(len(ids) + 1, np.int64)
        for length, phrases in self.phrases.items():
            which, place = index.find(phrases)
            place = origin[place]
            np.add.at(cover, place, 1)
            np.add.at(cover, place + length, -1)
            owner = np.searchsorted(starts, place, side="right") - 1
            for document, phrase in np.unique(np.stack([owner, which]), axis=1).T:
                items[document] |= self.items[length][phrase]
        hit = np.concatenate([[False], np.cumsum(cover) > 0, [False]])
        edges = np.flatnonzero(hit[1:] != hit[:-1])
        for begin, end in zip(edges[::2], edges[1::2]):
            document = int(np.searchsorted(starts, begin, side="right")) - 1
            spans[document].append((int(begin - starts[document]), int(end - starts[document])))
        return spans, items

    def _stretches(self, ids: np.ndarray) -> np.ndarray:
        """Positions in runs of at least as many words as the shortest window, each pair a benchmark pair."""
        if not self.shortest:
            return np.zeros(0, np.int64)
        known = ids > 0
        if self.shortest == 1:
            return np.flatnonzero(known)
        key = ids[:-1] * (len(self.words) + 1) + ids[1:]
        both = np.flatnonzero(known[:-1] & known[1:])
        at = np.minimum(np.searchsorted(self.pairs, key[both]), len(self.pairs) - 1)
        good = np.zeros(len(ids) + 1, bool)  # good[i]: words i - 1 and i belong together
        good[both[self.pairs[at] == key[both]] + 1] = True
        edges = np.flatnonzero(good[1:] != good[:-1])
        begin, end = edges[::2], edges[1::2] + 1  # from the word before the first good pair to past its last word
        long_enough = end - begin >= self.shortest
        length = (end - begin)[long_enough]
        first = np.repeat(begin[long_enough] - (np.cumsum(length) - length), length)
        return first + np.arange(int(length.sum()))


def slices(benchmark: DataFrame, item_column: str, text_column: str) -> Iterator[list[tuple[str, str]]]:
    """Whole items, up to SLICE_BYTES of text at a time, read one slice after another."""
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).alias("text")) \
        .filter("item is not null and text is not null")
    held, size = [], 0
    for row in rows.toLocalIterator():
        length = len(encoded(row["text"]))
        if held and size + length > SLICE_BYTES:
            yield held
            held, size = [], 0
        held.append((row["item"], row["text"]))
        size += length
    if held:
        yield held


def with_more(parts: Iterator) -> Iterator[tuple]:
    """Each part and whether another follows; nothing at all becomes one empty part."""
    held = next(parts, [])
    for part in parts:
        yield held, True
        held = part
    yield held, False


HITS = "text string, n_words bigint, spans array<struct<first:bigint,past:bigint>>, items array<string>"


def find_hits(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
              item_column: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, the merged spans of hit words (first, past) and the items found, in order."""
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text")).withColumns({
        "n_words": F.lit(None).cast("bigint"),
        "spans": F.array().cast("array<struct<first:bigint,past:bigint>>"), "items": F.array().cast("array<string>")})
    kind = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(HITS)])
    for part, more in with_more(slices(benchmark, item_column, item_text)):
        shared = docs.sparkSession.sparkContext.broadcast(part)
        rows = map_chunks(rows, "text", kind, _pass(shared, window, more))
        if more:  # one slice at a time: else every task would hold the workers and windows of all of them
            rows = checkpointed(rows)
            shared.unpersist()
    return rows.drop("text")


def _pass(shared, window: int, keep_text: bool):
    made: list[Windows] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Windows(shared.value, window))
        texts = batch.column("text").to_pylist()
        words = [split_words(t) for t in texts]
        spans, items = made[0].hits(words)
        spans = [merged([(s["first"], s["past"]) for s in old] + new)
                 for old, new in zip(batch.column("spans").to_pylist(), spans)]
        return {"doc_id": batch.column("doc_id"), "text": texts if keep_text else [None] * len(texts),
                "n_words": [len(w) for w in words],
                "spans": [[{"first": a, "past": b} for a, b in s] for s in spans],
                "items": [sorted(new.union(old)) for old, new in zip(batch.column("items").to_pylist(), items)]}

    return work


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, past in sorted(spans):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(past, out[-1][1]))
        else:
            out.append((first, past))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of some spans and what stands between them."""
    raw = encoded(text)
    begin, end = word_places(np.frombuffer(raw.translate(FOLD), np.uint8))
    kept, at = [], 0
    for first, past in spans:
        kept.append(raw[at:begin[first]])
        at = int(end[past - 1])
    return b"".join([*kept, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_hits(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
                item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows with every hit span cut out of their texts, all other columns as they are.

    Cutting may bring words together that form a window again; a text is searched and cut until none is left. With a
    benchmark of several slices that takes further rounds over the rows until no text changes any more.
    """
    mark = fresh(docs, "cut")
    rows = docs.withColumn(mark, F.lit(False))
    while True:
        rows, several = rows.withColumn(mark, F.lit(False)), False
        for part, more in with_more(slices(benchmark, item_column, item_text)):
            several = several or more
            shared = docs.sparkSession.sparkContext.broadcast(part)
            rows = map_chunks(rows, text_column, rows.schema, _cut(shared, window, text_column, mark))
            if more:
                rows = checkpointed(rows)
                shared.unpersist()
        if not several:
            return rows.drop(mark)
        rows = checkpointed(rows)
        if rows.filter(mark).limit(1).count() == 0:
            return rows.drop(mark)


def _cut(shared, window: int, text_column: str, mark: str):
    made: list[Windows] = []

    def work(batch: pa.RecordBatch) -> dict:
        if not made:
            made.append(Windows(shared.value, window))
        texts, cut = batch.column(text_column).to_pylist(), batch.column(mark).to_pylist()
        open_rows = [i for i, t in enumerate(texts) if t]
        while open_rows:
            spans = made[0].hits([split_words(texts[i]) for i in open_rows])[0]
            open_rows = [i for i, found in zip(open_rows, spans) if found]
            for i, found in zip(open_rows, filter(None, spans)):
                texts[i], cut[i] = without(texts[i], found), True
        return {**{name: batch.column(name) for name in batch.schema.names}, text_column: texts, mark: cut}

    return work
