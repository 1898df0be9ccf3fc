"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token shares.

Documents are dealt evenly over the tasks and mixed there, however the table lies. Each task keeps one queue of tokenised
documents per source. A window gives every source its share of the capacity as
credit; each source then has one turn to spend it, cutting documents freely, and where short queues leave room the
source with the most credit goes into debt. What a source got too little or too much stays for later windows. When a task runs out of documents, its
short queues and the credit of all sources move on to a second round, in which one task serves the rest of many first-round
tasks, so only one window of each of those groups is not full.

Defined results: null text is the empty text, a null source is the source ''. A document without tokens still has the
closing id. Rows repeated under one id are packed each for itself. Other columns of the input are never looked at.
Sources are dealt to 65536 queues by hash, so the table of shares has a fixed bound however many sources there are.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.llm.batches import SMALL_CHUNK_BYTES, chunks
from flowsentry.llm.tokens import Encoder
from flowsentry.session import checkpointed

CAPACITY, CLOSING_ID = 4096, 2
QUEUES = 65536
# Windows' worth of tokens that wait in a task (4 MB), so that every source has documents when its turn comes, even
# behind long documents of rare sources.
WAITING = 256
# Credit that a turn takes: a rarer source saves it up over windows and isn't cut into slivers.
TURN = 64
# First-round tasks whose rests meet in one second-round task: at most GATHERED * WAITING windows of tokens.
GATHERED = 8

PIECES = ("doc_id {id}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
          "offset bigint, source string, rest binary, credit double")


class Mixer:
    """Source queues with credit. Pieces come out as (document, start, ids, total, source, window, offset)."""

    def __init__(self, shares: dict[int, float], capacity: int = CAPACITY):
        self.shares, self.capacity = shares, capacity
        self.queues: dict[int, deque] = {}
        self.credit: dict[int, float] = {}
        self.due: dict[int, int] = {}  # windows whose share a queue's credit has
        self.whole = sum(shares.values()) or 1.0
        self.waiting = self.windows = 0

    def add(self, queue: int, source: str, document, start: int, ids: np.ndarray, total: int) -> None:
        self.queues.setdefault(queue, deque()).append((document, start, ids, total, source))
        self.waiting += len(ids)

    def lend(self, queue: int, credit: float) -> None:
        self.credit[queue] = self.credit.get(queue, 0.0) + credit

    def window(self) -> Iterator[tuple]:
        """Fill one window: every source with credit has one turn, then the one with most credit fills what is left."""
        for q in self.queues:
            self._accrue(q, self.windows + 1)
        filled = 0
        for q in sorted(self.queues, key=self.credit.__getitem__, reverse=True):
            turn = int(self.credit[q])
            if turn < TURN:
                break
            for piece in self._serve(q, min(turn, self.capacity - filled)):
                yield *piece, self.windows, filled
                filled += len(piece[2])
        while filled < self.capacity and self.queues:
            for piece in self._serve(max(self.queues, key=self.credit.__getitem__), self.capacity - filled):
                yield *piece, self.windows, filled
                filled += len(piece[2])
        self.windows += 1

    def _accrue(self, q: int, windows: int) -> None:
        """A source earns its share of every window, also of those for which it had nothing to send."""
        earned = self.capacity * self.shares.get(q, 0.0) / self.whole * (windows - self.due.get(q, 0))
        self.credit[q] = self.credit.get(q, 0.0) + earned
        self.due[q] = windows

    def _serve(self, q: int, ids_left: int) -> Iterator[tuple]:
        """Up to so many ids from the front of a queue; the last document is cut."""
        queue = self.queues[q]
        while ids_left and queue:
            document, start, ids, total, source = queue.popleft()
            take = min(len(ids), ids_left)
            if take < len(ids):
                queue.appendleft((document, start + take, ids[take:], total, source))
            self.credit[q] -= take
            self.waiting -= take
            ids_left -= take
            yield document, start, ids[:take], total, source
        if not queue:
            del self.queues[q]

    def drain(self, waiting: int) -> Iterator[tuple]:
        """Fill windows while more than `waiting` ids wait."""
        while self.waiting > waiting:
            yield from self.window()

    def rest(self) -> Iterator[tuple]:
        """What waits, then the credit of every source as (None, queue, no ids, 0, None, credit)."""
        for queue in self.queues.values():
            for document, start, ids, total, source in queue:
                yield document, start, ids, total, source, None
        for q in self.shares.keys() | self.credit.keys():
            self._accrue(q, self.windows)
            if self.credit[q]:
                yield None, q, np.zeros(0, np.uint32), 0, None, self.credit[q]


def queue_of(source: str) -> int:
    return zlib.crc32(source.encode("utf-8", "surrogatepass")) % QUEUES


def source_shares(docs: DataFrame, text_column: str, source_column: str) -> dict[int, float]:
    """Each queue's part of all text bytes: at most QUEUES numbers."""
    found = docs.groupBy((F.crc32(F.coalesce(F.col(source_column).cast("string"), F.lit(""))) % QUEUES).alias("queue")) \
        .agg(F.sum(F.coalesce(F.octet_length(text_column), F.lit(0)) + 1).alias("bytes")).collect()
    total = sum(r["bytes"] for r in found) or 1
    return {int(r["queue"]): r["bytes"] / total for r in found}


def pack(docs: DataFrame, tokenizer_file: str, targets: dict[str, float] | None = None, id_column: str = "doc_id",
         text_column: str = "text", source_column: str = "source", capacity: int = CAPACITY) -> DataFrame:
    """Pieces of documents with their place in the packed sequences.

    `targets` are the wanted token shares by source; without them, the sources' parts of the corpus. A source that
    `targets` doesn't name fills up what the others leave.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"),
                       F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"))
    shares = ({queue_of(s): float(v) for s, v in targets.items()} if targets is not None
              else source_shares(docs, text_column, source_column))
    kind = T.StructType.fromDDL(PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()))

    def first_round(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, mixer = Encoder(tokenizer_file), Mixer(shares, capacity)
        base = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in chunks(batch, "text"):
                out = []
                for small in chunks(part, "text", SMALL_CHUNK_BYTES):
                    ids = encoder.encode(small.column("text").to_pylist(), CLOSING_ID)
                    for document, source, own in zip(small.column("doc_id").to_pylist(),
                                                     small.column("source").to_pylist(), ids):
                        mixer.add(queue_of(source), source, document, 0, own, len(own))
                out.extend(_row(base, piece) for piece in mixer.drain(WAITING * capacity))
                if out:
                    yield _batch(out, kind)
        out = [(document, start, len(ids), None, total, base, None, source, ids.astype("<u4").tobytes(), credit)
               for document, start, ids, total, source, credit in mixer.rest()]
        if out:
            yield _batch(out, kind)

    def second_round(key, table):
        mixer = Mixer(shares, capacity)
        base = (1 << 62) + (int(key[0].as_py()) << 32)
        table = table.sort_by([("sequence_id", "ascending")])  # the order of tasks; rows of a task keep theirs
        for row in table.to_pylist():
            if row["credit"] is not None:
                mixer.lend(row["start"], row["credit"])
            else:
                mixer.add(queue_of(row["source"]), row["source"], row["doc_id"], row["start"],
                          np.frombuffer(row["rest"], "<u4"), row["doc_tokens"])
        return pa.Table.from_batches([_batch([_row(base, piece) for piece in mixer.drain(0)], kind)])

    # dealt in turn, so neither a source nor a repeated row is hot; then in the order of a hash, so sources alternate
    rows = rows.repartition(max(rows.rdd.getNumPartitions(), 1)).sortWithinPartitions(F.xxhash64("doc_id", "source", "text"))
    made = checkpointed(rows.mapInArrow(first_round, kind))
    rests = made.filter("rest is not null")
    task = F.shiftright("sequence_id", 32)
    last = rests.groupBy((task / GATHERED).cast("bigint").alias("group")).applyInArrow(second_round, kind)
    return made.filter("rest is null").union(last).drop("rest", "credit").withColumnRenamed("doc_id", id_column)


def _row(base: int, piece: tuple) -> tuple:
    document, start, ids, total, source, window, offset = piece
    return (document, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + window, offset, source,
            None, None)


def _batch(rows: list[tuple], kind: T.StructType) -> pa.RecordBatch:
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(kind)
    columns = list(zip(*rows)) if rows else [[] for _ in arrow]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)
