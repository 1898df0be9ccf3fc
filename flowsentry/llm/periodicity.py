"""Periodic runs of words: block convolution finds where blocks come again, their distances seed extensions.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(SHORTEST, 2q) words that
can't be extended. At scale B = 2, 4, 8 ... the words are cut into blocks of B; periods from 2B - 1 to 4B - 2 belong
to the scale (2 also serves 1 and 2). Any stretch of 2B - 1 words holds a whole block, and a run of such a period holds
that many words whose copies q further on are in it too, so at least one block of every run comes again q words later.
A transform modulo a prime (`ntt.matches`) sums squared differences of word codes between each block and every place
of its following window; where the sum is 0 and the words really agree, the distance is a seed. Seeds are extended to
both sides, small distances first, so a stretch that is known with a smaller period is told apart by its ends.

A block is left out only where it can't come again: when one of its words doesn't occur again within the scale's
reach. Blocks longer than BLOCK words are represented by their first BLOCK, windows are cut to what a transform holds,
and no length, period or number of runs is bounded. The documents of a slice are one sequence; words of different
documents never are equal.

Defined results: null and empty texts and texts of separators have no words and no runs; both digests are then those
of the empty text. Every row gives one row, rows repeated under one id and null ids too. An empty table gives an empty
result. Other columns of the input are never looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.batches import map_chunks
from flowsentry.llm.ntt import LONGEST, matches
from flowsentry.llm.words import encoded, mixed

SHORTEST = 12
BLOCK = LONGEST // 4
_CELLS = 1 << 19  # numbers in one array of a transform
_NEVER = np.int64(1) << 40


def next_distance(ids: np.ndarray) -> np.ndarray:
    """How far each word's next occurrence is."""
    out = np.full(len(ids), _NEVER)
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order[1:]] == ids[order[:-1]])
    out[order[same]] = order[same + 1] - order[same]
    return out


def scale_matches(ids: np.ndarray, starts: np.ndarray, width: int, low: int, high: int):
    """(start, distance) of every block ids[start:start + width] that comes again low to high words later."""
    top = int(np.sqrt((1 << 16) // width))
    code = np.zeros(len(ids) + high + LONGEST)  # 0, which no word has, beyond the end
    code[:len(ids)] = mixed(ids) % np.uint64(top) + np.uint64(1)
    size = min(LONGEST, 1 << int(high - low + width - 1).bit_length())
    reach = size - width + 1
    found = []
    for begin in range(low, high + 1, reach):
        for at in range(0, len(starts), max(1, _CELLS // size)):
            rows = starts[at:at + max(1, _CELLS // size)]
            blocks = code[rows[:, None] + np.arange(width)]
            row, shift = matches(blocks, code[(rows + begin)[:, None] + np.arange(size)])
            distance = begin + shift
            within = (distance <= high) & (rows[row] + distance + width <= len(ids))
            found.append((rows[row[within]], distance[within]))
    start, distance = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2
    return start, distance


def _agreeing(ids: np.ndarray, start: np.ndarray, distance: np.ndarray, width: int) -> np.ndarray:
    """Whether the words of a block really equal those of its match; codes only say so with high probability."""
    kept = np.ones(len(start), bool)
    for at in range(0, len(start), max(1, _CELLS // width)):
        part = slice(at, at + max(1, _CELLS // width))
        place = start[part, None] + np.arange(width)
        kept[part] = (ids[place] == ids[place + distance[part, None]]).all(axis=1)
    return kept


def _reach(ids: np.ndarray, left: int, right: int, step: int) -> int:
    """How many words on (or back, with step -1) ids[left...] and ids[right...] agree."""
    room = len(ids) - right if step > 0 else left + 1
    done, size = 0, 16
    while done < room:
        take = min(size, room - done)
        if step > 0:
            equal = ids[left + done:left + done + take] == ids[right + done:right + done + take]
        else:
            equal = (ids[left - done - take + 1:left - done + 1] == ids[right - done - take + 1:right - done + 1])[::-1]
        if not equal.all():
            return done + int(equal.argmin())
        done, size = done + take, size * 2
    return done


def _short(ids: np.ndarray, start: np.ndarray, distance: np.ndarray, width: int, steps: int = 8) -> np.ndarray:
    """Whether a match ends within `steps` words on both sides and so is too short for a run."""
    n = len(ids)
    going, backs = np.ones(len(start), bool), np.ones(len(start), bool)
    length = np.full(len(start), width)
    for k in range(steps):
        right, left = start + width + k, start - 1 - k
        going &= (right + distance < n) & (ids[np.minimum(right, n - 1)] == ids[np.minimum(right + distance, n - 1)])
        backs &= (left >= 0) & (ids[np.maximum(left, 0)] == ids[np.maximum(left + distance, 0)])
        length = length + going + backs
    return ~going & ~backs & (length < np.maximum(distance, SHORTEST - distance))


def runs_of(ids: np.ndarray, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(start, end, smallest period) of every run of a sequence, in order of start and period. `longest` is a bound
    on the length of stretches that words can be equal in (that of the longest document)."""
    n = len(ids)
    longest = n if longest is None else longest
    coming = next_distance(ids)
    ends: dict[tuple[int, int], int] = {}
    scale, low, high = 2, 1, 6
    while low * 2 <= longest:
        high = min(high, longest // 2)
        coming = coming[:len(coming) // 2 * 2].reshape(-1, 2).max(axis=1)  # of each block of this scale
        width = min(scale, BLOCK)
        starts = np.flatnonzero(coming <= high) * scale
        start, distance = scale_matches(ids, starts, width, low, high)
        inside = np.zeros(n + 1, np.int64)
        for (a, b), period in ends.items():
            if period <= width:
                inside[a] = max(inside[a], b)
        known = np.maximum.accumulate(inside)[start] >= start + distance + width
        start, distance = start[~known], distance[~known]
        kept = _agreeing(ids, start, distance, width)
        start, distance = start[kept], distance[kept]
        kept = ~_short(ids, start, distance, width)
        start, distance = start[kept], distance[kept]
        order = np.lexsort((start, distance))
        last, past = 0, 0
        for s, q in zip(start[order].tolist(), distance[order].tolist()):
            if q == last and s < past:
                continue
            first = s - _reach(ids, s - 1, s - 1 + q, -1)
            last, past = q, s + _reach(ids, s, s + q, 1)
            if past - first >= max(q, SHORTEST - q):
                ends.setdefault((first, past + q), q)
        scale, low, high = scale * 2, 4 * scale - 1, 8 * scale - 2
    return sorted((a, b, q) for (a, b), q in ends.items())


def planted(words: list[bytes], key: str | None) -> list[bytes]:
    """The words with the periodic ending that the id of a tenth of the documents asks for."""
    h = zlib.crc32(key.encode()) if key is not None else 1
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    return words[:begin] + [words[begin + i % period] for i in range(n - begin)]


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                  change: Callable[[list[bytes], str | None], list[bytes]] | None = None) -> DataFrame:
    """One row per row: id, its runs (start, length, period) in order of start and period, and the text's words
    without those that any run repeats (joined by one space). `change` edits the words first."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(id_column).cast("string").alias("key"),
                       F.col(text_column).alias("text"))
    kind = T.StructType([
        T.StructField("id", rows.schema["id"].dataType),
        T.StructField("runs", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("start", "length", "period")]))),
        T.StructField("collapsed", T.BinaryType())])

    def find(batch: pa.RecordBatch) -> dict:
        words = [encoded(t).split() for t in batch.column("text").to_pylist()]
        if change is not None:
            words = [change(w, k) for w, k in zip(words, batch.column("key").to_pylist())]
        sizes = np.array([len(w) for w in words], np.int64)
        edges = np.concatenate([[0], np.cumsum(sizes)])
        ids, held = np.empty(int(edges[-1]), np.int64), 0
        for w, at in zip(words, edges.tolist()):
            number = dict(zip(dict.fromkeys(w), range(held, held + len(w))))
            ids[at:at + len(w)] = [number[x] for x in w]
            held += len(number)
        found = [[] for _ in words]
        dropped = np.zeros(len(ids), bool)
        runs = runs_of(ids, int(sizes.max(initial=0)))
        owner = np.searchsorted(edges, [a for a, _, _ in runs], side="right") - 1
        for (a, b, q), i in zip(runs, owner.tolist()):
            found[i].append({"start": a - int(edges[i]), "length": b - a, "period": q})
            dropped[a + q:b] = True
        kept = []
        for i, w in enumerate(words):
            if found[i]:
                w = [w[k] for k in np.flatnonzero(~dropped[edges[i]:edges[i + 1]]).tolist()]
            kept.append(b" ".join(w))
        return {"id": batch.column("id"), "runs": found, "collapsed": kept}

    return map_chunks(rows, "text", kind, find).withColumnRenamed("id", id_column)


def run_digests(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The number of runs, the longest (ties: first, then shorter period) and digests of all and of the kept words."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("finer"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumns({"n_runs": F.size("runs").cast("bigint"), "best": longest}).select(
        id_column, "n_runs", (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.finer")).alias("period"), F.expr("1000 * best.length div -best.finer").alias("exponent_milli"),
        F.sha2(F.when(F.col("n_runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))
