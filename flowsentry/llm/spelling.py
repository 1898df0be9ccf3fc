"""Spelling variants: words one edit apart by a trie of letter-group counts, searched with a budget.

A word's frequency vector counts its letters per group; the trie arranges words by these counts, one group a level. Two
words one edit apart have vectors that differ by one surplus letter (inserted), or by nothing or one surplus and one
deficit (replaced). A depth-first search walks the trie with all words that can still reach a node, each holding a budget
of one surplus and one deficit; at a leaf the words themselves are compared. Of two words of equal length the one that
finds the surplus first looks for the other, so each pair is found once.

The first levels of the trie are the key that Spark shuffles by: a task holds whole tries of some first counts, and a
word is sent to the few first counts that its budget reaches. The number of levels follows from the number of words.
First counts that more than GROUP_WORDS words share are split: each part of the words has its own trie, and what looks
for them is sent to each part. Words and their numbers come from whole texts, counted in slices before the shuffle.

Defined results: null and empty texts have no words; a null id deletes no letter. Rows repeated under one id count
each. Without words the result is empty. Other columns of the input are never looked at.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.llm.batches import chunks
from flowsentry.session import checkpointed

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SHORTEST, RAREST, TIMES = 6, 5, 5
GROUPS = 16
# Code points are grouped by their remainder; groups of common letters come first, so that first levels differ.
COMMON = (5, 1, 14, 9, 2, 4, 3, 15, 12, 8, 7, 13, 0, 6, 11, 10)
LEVELS = [COMMON.index(group) for group in range(GROUPS)]
GROUP_WORDS = 20_000
_DIRECT, _PLAIN = 256, 64
_CELLS = 1 << 14
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def vector(word: str) -> list[int]:
    """How many letters of each group the word has."""
    counts = [0] * GROUPS
    for c in word:
        counts[LEVELS[ord(c) % GROUPS]] += 1
    return counts


def misspelt(run: str, prefix_crc: int, every: int = 199) -> str:
    """The run without the letter that its crc32 after the prefix names, if `every` divides that."""
    h = zlib.crc32(run.encode(), prefix_crc)
    if h % every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shortest: int = SHORTEST,
                rarest: int = RAREST) -> DataFrame:
    """(word, n) of the words of all texts, after letters were deleted by `misspelt`."""
    rows = docs.select(F.col(id_column).cast("string").alias("key"), F.col(text_column).alias("text"))

    def count(batches):
        for batch in batches:
            for part in chunks(batch, "text"):
                total = Counter()
                for key, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist()):
                    found = Counter(RUN.findall((text or "").translate(LOWER)))
                    if key is None:
                        total.update(found)
                        continue
                    prefix = zlib.crc32(f"{key}:".encode())
                    for run, n in found.items():
                        total[misspelt(run, prefix)] += n
                words = [w for w in total if len(w) >= shortest]
                yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()),
                                                  "n": pa.array([total[w] for w in words], pa.int64())})

    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= rarest)


def reachable(first: list[int]) -> Iterator[list[int]]:
    """The first counts that a budget of one surplus, then one deficit reaches, or a deficit to be made up for before."""
    yield first
    for i in range(len(first)):
        more = first[:i] + [first[i] + 1] + first[i + 1:]
        yield more
        for j in range(i + 1, len(first)):
            if first[j]:
                yield more[:j] + [first[j] - 1] + more[j + 1:]


def one_edit(a: str, b: str) -> bool:
    """Whether b is a with exactly one letter inserted or replaced."""
    if not 0 <= len(b) - len(a) <= 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i:] == b[i + 1:] if len(a) < len(b) else a[i + 1:] == b[i + 1:]


def _shortened(word: str) -> list:
    """The word without each of its letters, and the whole word; hashes of them for long words."""
    if len(word) <= _PLAIN:
        return [word[:i] + word[i + 1:] for i in range(len(word))] + [word]
    ends, power = [0], 1
    for c in reversed(word):
        ends.append((ends[-1] + ord(c) * power) % _PRIME)
        power = power * _BASE % _PRIME
    out, begin, power, step = [], 0, pow(_BASE, len(word) - 2, _PRIME), pow(_BASE, _PRIME - 2, _PRIME)
    for i, c in enumerate(word):
        out.append((begin + ends[len(word) - 1 - i]) % _PRIME)
        begin = (begin + ord(c) * power) % _PRIME
        power = power * step % _PRIME
    return out + [ends[-1]]


def _verified(seek: list[str], leaf: list[str]) -> Iterator[tuple[str, str]]:
    """Pairs one edit apart of two lists. Long lists meet by what is left when a letter is deleted."""
    if len(seek) * len(leaf) <= _DIRECT:
        yield from ((a, b) for a in seek for b in leaf if one_edit(a, b))
        return
    meeting = defaultdict(set)
    for b in leaf:
        *holes, _ = _shortened(b)
        for i, short in enumerate(holes):
            meeting[len(b), i, short].add(b)
            meeting[len(b), -1, short].add(b)
    for a in seek:
        *holes, whole = _shortened(a)
        if len(a) == _PLAIN:  # longer words are met by hashes
            whole = _shortened(a + " ")[-2]
        keys = [(len(a), i, short) for i, short in enumerate(holes)] + [(len(a) + 1, -1, whole)]
        yield from ((a, b) for key in keys for b in meeting.get(key, ()) if one_edit(a, b))


class Trie:
    """The words of one group by their counts from a level on; a node is a stretch of the sorted vectors."""

    def __init__(self, words: list[str], level: int):
        counts = np.array([vector(w) for w in words], np.int32)
        order = np.lexsort(counts.T[::-1])
        self.words = [words[i] for i in order.tolist()]
        self.counts, self.level = counts[order], level

    def near(self, seek: list[str], spare: np.ndarray) -> Iterator[tuple[str, str]]:
        """Pairs (a of seek, b of the trie) one edit apart. spare: what is left of each word's budget: 2 nothing spent,
        1 a surplus spent, 0 both spent."""
        wanted = np.array([vector(w) for w in seek], np.int32)
        todo = [(0, len(self.words), self.level, np.arange(len(seek)), spare)]
        while todo:
            low, high, level, at, spare = todo.pop()
            if (high - low) * len(at) <= _CELLS and level < GROUPS:
                # few words: all that is left of their vectors at once
                step = self.counts[None, low:high, level:] - wanted[at, None, level:]
                more, less = np.maximum(step, 0).sum(axis=2), np.maximum(-step, 0).sum(axis=2)
                left = spare[:, None]
                fits = np.where(left == 2, (more <= 1) & (less <= more) & ((less == 0) | (step.argmax(axis=2) < step.argmin(axis=2))),
                                (more == 0) & (less <= left))
                both_ways = (spare[:, None] == 2) & (more == 0)  # equal vectors: found from both sides
                rows, columns = np.nonzero(fits)
                asking = [seek[i] for i in at.tolist()]
                for i, j, twice in zip(rows.tolist(), columns.tolist(), both_ways[rows, columns].tolist()):
                    a, b = asking[i], self.words[low + j]
                    half = len(a) // 2  # the edit leaves one half as it is
                    if (a[:half] == b[:half] or a[half:] == b[len(b) - len(a) + half:]) and (not twice or a < b) and one_edit(a, b):
                        yield a, b
                continue
            if level == GROUPS:
                leaf = self.words[low:high]
                same = spare == 2  # equal vectors: found from both sides
                for a, b in _verified([seek[i] for i in at[~same].tolist()], leaf):
                    yield a, b
                for a, b in _verified([seek[i] for i in at[same].tolist()], leaf):
                    if a < b:
                        yield a, b
                continue
            here = self.counts[low:high, level]
            edges = np.flatnonzero(np.diff(here)) + 1
            asked = wanted[at, level]
            for start, past in zip([0, *edges.tolist()], [*edges.tolist(), len(here)]):
                step = here[start] - asked
                left = np.where(step == 0, spare, np.where((step == 1) & (spare == 2), 1, np.where((step == -1) & (spare == 1), 0, -1)))
                go = left >= 0
                if go.any():
                    todo.append((low + start, low + past, level + 1, at[go], left[go]))


def near_pairs(words: DataFrame, word_column: str = "word", group_words: int = GROUP_WORDS) -> DataFrame:
    """(a, b) of every two words one edit apart, once; a is the shorter one, or finds a surplus before a deficit."""
    spark = words.sparkSession
    rows = words.select(F.col(word_column).alias("word"))
    count = rows.count()
    # four levels up to a million words, one more for every doubling beyond
    levels = int(np.clip(4 + np.log2(max(count, 1) / 1_000_000), 4, 10))

    def send(batches):
        for batch in batches:
            made = {"first": [], "word": [], "held": [], "spare": []}
            for word in batch.column("word").to_pylist():
                first = vector(word)[:levels]
                ways = [(first, True, 2)]
                for other in reachable(first):
                    ways.append((other, False, 2 if other == first else sum(other) - sum(first)))
                for counts, own, left in ways:
                    made["first"].append(",".join(map(str, counts)))
                    made["word"].append(word)
                    made["held"].append(own)
                    made["spare"].append(left)
            yield pa.RecordBatch.from_pydict({"first": pa.array(made["first"], pa.string()), "word": pa.array(made["word"], pa.string()),
                                              "held": pa.array(made["held"]), "spare": pa.array(made["spare"], pa.int32())})

    sent = rows.mapInArrow(send, "first string, word string, held boolean, spare int")
    parts = sent.filter("held").groupBy("first").agg(F.ceil(F.count("*") / group_words).cast("int").alias("parts"))
    # a word of the trie lies in one part; a word that looks for others goes to all parts
    part = F.when(F.col("held"), F.array(F.pmod(F.xxhash64("word"), "parts").cast("int"))) \
        .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))
    dealt = sent.join(parts, "first").select("first", F.explode(part).alias("part"), "word", "held", "spare")
    tasks = max(4 * spark.sparkContext.defaultParallelism, count // group_words)
    sliced = dealt.repartition(tasks, "first", "part").sortWithinPartitions("first", "part", F.col("held").desc())

    def search(batches):
        for held, seek, spare in _groups(batches):
            found = list(Trie(held, levels).near(seek, spare))
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in found[at:at + 10_000]], pa.string()),
                                                  "b": pa.array([b for _, b in found[at:at + 10_000]], pa.string())})

    return checkpointed(sliced.mapInArrow(search, "a string, b string"))


def _groups(batches) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """The trie's words and up to GROUP_WORDS of those that look for them, of each stretch of rows of one part."""
    key, held, seek, spare = None, [], [], []
    for batch in batches:
        for first, part, word, own, left in zip(*(batch.column(c).to_pylist() for c in ("first", "part", "word", "held", "spare"))):
            if (first, part) != key:
                if held and seek:
                    yield held, seek, np.array(spare)
                key, held, seek, spare = (first, part), [], [], []
            if own:
                held.append(word)
                continue
            seek.append(word)
            spare.append(left)
            if len(seek) == GROUP_WORDS:
                if held:
                    yield held, seek, np.array(spare)
                seek, spare = [], []
    if held and seek:
        yield held, seek, np.array(spare)


def variants(counts: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of every (word, n): the most frequent near word, if `times` as frequent, and
    where following forms ends."""
    counts = checkpointed(counts.select("word", "n"))
    pairs = near_pairs(counts)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    numbered = both.join(counts.select(F.col("word").alias("b"), F.col("n").alias("of")), "b")
    best = numbered.groupBy(F.col("a").alias("word")).agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("of")).alias("less"), "b")).alias("best"))
    known = counts.join(best, "word", "left").withColumn("fits", -F.col("best.less") >= times * F.col("n"))
    known = checkpointed(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(F.col("fits"), F.col("best.b")).alias("form"), F.when(F.col("fits"), -F.col("best.less")).alias("form_n")))
    # follow forms by doubling: n grows by `times` with every step, so chains are short
    jumps = known.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        onward = jumps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = checkpointed(jumps.join(onward, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        jumps = further.select("word", "root")
        if further.filter("moved").limit(1).count() == 0:
            break
    return known.join(jumps, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                      counted: Callable[..., DataFrame] = word_counts) -> DataFrame:
    """The spelling variants among the words of all texts."""
    return variants(counted(docs, id_column, text_column))
