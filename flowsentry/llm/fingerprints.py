"""Lempel-Ziv phrase fingerprints: the hashed phrase set of a text's parse, kept as its smallest hashes.

A text's bytes are parsed from left to right into phrases, each the shortest run that is no phrase yet. Two texts that
compress well together share many phrases, so the overlap of their phrase sets tells their likeness; it is estimated
from the `SIZE` smallest hashes of both sets (exactly, for sets that are smaller).

Next documents follow in ascending id (ties by text), and the first follows the last. Rows are dealt to tasks by
ranges of ids, and each range also gets the first row of the next one, so no task sees more than its range.

Defined results: null text is the empty text, whose fingerprint is the empty string; two empty texts are alike (1),
an empty and another text are not (0). Null ids come before all others. Repeated rows follow each other. A single row
is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from flowsentry.llm.batches import chunks
from flowsentry.llm.words import encoded, mixed

SIZE = 128


class Parse:
    """A parse that can be continued with different texts."""

    def __init__(self, phrases: set[bytes] | None = None, tail: bytes = b""):
        self.phrases, self.tail = phrases or set(), tail

    def extended(self, raw: bytes) -> Parse:
        phrases, start, data = self.phrases.copy(), 0, self.tail + raw
        known, add = phrases.__contains__, phrases.add
        for end in range(len(self.tail) + 1, len(data) + 1):
            phrase = data[start:end]
            if not known(phrase):
                add(phrase)
                start = end
        return Parse(phrases, data[start:])

    def signature(self) -> np.ndarray:
        """The smallest hashes of the phrases, and of an unfinished last one, in order."""
        found = list(self.phrases) + ([self.tail] if self.tail and not self.phrases else [])
        hashes = np.fromiter(map(zlib.crc32, found), np.uint64, len(found))
        hashes = np.unique(mixed(hashes + np.uint64(1)) >> np.uint64(32)).astype(">u4")
        return hashes[:SIZE]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The overlap of two phrase sets, from their signatures."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    joint = np.union1d(a, b)[:SIZE]
    # beyond a full signature's largest hash nothing is known of its set
    for x in (a, b):
        if len(x) == SIZE:
            joint = joint[joint <= x[-1]]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), joint, assume_unique=True)) / len(joint)


KIND = ("n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double")


class Row:
    """A document with the parse of the half that editing keeps, and its signature."""

    def __init__(self, document, text: str):
        self.document, self.text = document, text
        self.changed = len(text) // 2
        self.head = text[:len(text) - self.changed]
        self.parse = Parse().extended(encoded(self.head))
        self.own = self.parse.extended(encoded(text[len(self.head):])).signature()

    def followed_by(self, following: Row) -> tuple:
        """The result columns, once the next document is known."""
        other = following.text[:self.changed]
        edited = self.parse.extended(encoded(other)).signature()
        return (self.document, len(self.text), hashlib.sha256(encoded(self.head + other)).hexdigest(),
                self.own.tobytes().hex(), edited.tobytes().hex(), likeness(self.own, edited),
                likeness(self.own, following.own))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 ranges: int | None = None) -> DataFrame:
    """Each row's fingerprint, that of its edited text, and how alike they and the next document's are."""
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(text_column, F.lit("")).alias("text"),
                       F.coalesce(F.col(id_column).cast("bigint"), F.lit(-(1 << 63))).alias("place"))
    ids = rows.select("place")
    bounds = ids.agg(F.percentile_approx("place", [k / ranges for k in range(1, ranges)] or [0.5], 100 * ranges)
                     .alias("b")).first()["b"] or []
    bounds = np.unique(np.array(bounds, np.int64)) if ranges > 1 else np.zeros(0, np.int64)
    part_of = F.pandas_udf(lambda x: pd.Series(np.searchsorted(bounds, x.to_numpy(), side="right")), "int")
    firsts = {r["part"]: r["least"] for r in ids.groupBy(part_of("place").alias("part"))
              .agg(F.min("place").alias("least")).collect()}
    used = sorted(firsts)
    # the first row of each range is also the row after the last one of the range before it
    before = {firsts[p]: used[i - 1] for i, p in enumerate(used)}
    copies = F.pandas_udf(lambda x: pd.Series([[p] if v not in before else [p, -1 - before[v]] for p, v in zip(
        np.searchsorted(bounds, x.to_numpy(), side="right").tolist(), x.tolist())]), "array<int>")
    dealt = rows.withColumn("part", F.explode(copies("place"))) \
        .withColumn("extra", F.col("part") < 0) \
        .withColumn("part", F.when(F.col("part") < 0, -1 - F.col("part")).otherwise(F.col("part")))
    dealt = dealt.repartitionById(max(len(bounds) + 1, 1), "part").sortWithinPartitions("part", "extra", "place", "text")
    kind = T.StructType([rows.schema["doc_id"], *T.StructType.fromDDL(KIND)])

    def walk(batches):
        arrow = to_arrow_schema(kind)
        held, part = None, None
        for batch in batches:
            for piece in chunks(batch, "text"):
                out = []
                for row in piece.to_pylist():
                    if part != row["part"]:
                        held, part = None, row["part"]
                    elif held is None:
                        continue  # more rows with the id of the next range's first row
                    now = Row(row["doc_id"], row["text"])
                    if held is not None:
                        out.append(held.followed_by(now))
                    held = None if row["extra"] else now
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)],
                                                     schema=arrow)

    made = dealt.select("doc_id", "text", "part", "extra").mapInArrow(walk, kind)
    return made.withColumnRenamed("doc_id", id_column)
