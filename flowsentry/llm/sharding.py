"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `NODES` places on a ring. A text's hash is its place, and the next shard place clockwise takes it, as
long as that shard holds less than its bound of (1 + `SLACK`) times the mean size; what doesn't fit goes on clockwise to
the next shard with room. Adding a shard moves what falls to its places and what the changed bounds push on.

The ring has shards * NODES arcs, a number that doesn't grow with the data. Sizes are summed per arc first, the walk
round the ring decides how much of each arc goes to which shard, and only then rows are dealt: by their place in their
arc, which comes from sums over `CELLS` cells of the arc and a running sum inside each cell. So one text that makes up
a third of all rows is still spread over cells, and where it exceeds a shard's bound, over shards.

Defined results: null text has no bytes (size 1) and the checksum of the empty text. Equal texts stay together unless
a bound divides them. Null ids and repeated rows are placed like any other. An empty table gives an empty result. On
a small table a text larger than a bound puts its shard over it: a text is never divided.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowsentry.llm.words import mixed
from flowsentry.session import checkpointed

SHARDS, NODES, CELLS = 16, 128, 256
SLACK = 0.001


def ring(shards: int, nodes: int = NODES) -> tuple[np.ndarray, np.ndarray]:
    """Sorted places on the ring (64-bit) and the shard that owns each."""
    owner = np.repeat(np.arange(shards), nodes)
    number = np.tile(np.arange(nodes), shards)
    place = mixed((owner.astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64) + np.uint64(1)).view(np.int64)
    order = np.argsort(place, kind="stable")
    return place[order], owner[order]


def walk(loads: np.ndarray, owner: np.ndarray, shards: int, slack: float) -> list[list[tuple[int, int]]]:
    """For each arc, in ring order, the (size up to which, shard) parts that its load is cut into."""
    bound = math.ceil((1 + slack) * float(loads.sum()) / shards)
    room = np.full(shards, bound, np.int64)
    parts = []
    for arc, load in enumerate(loads.tolist()):
        cut, past, at = [], 0, arc
        while load > 0 or not cut:
            shard = int(owner[at % len(owner)])
            take = min(load, int(room[shard]))
            if take or not load:
                past += take
                load -= take
                room[shard] -= take
                cut.append((past, shard))
            at += 1
        parts.append(cut)
    return parts


def shard(docs: DataFrame, shards: int = SHARDS, nodes: int = NODES, slack: float = SLACK, id_column: str = "doc_id",
          text_column: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row."""
    text = F.coalesce(text_column, F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("place"))
    places, owner = ring(shards, nodes)
    arc_of = F.pandas_udf(lambda x: pd.Series(np.searchsorted(places, x.to_numpy()) % len(places)), "int")
    rows = rows.withColumn("arc", arc_of("place")) \
        .withColumn("cell", F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "place"), F.lit(CELLS)).cast("int")) \
        .drop("place")
    rows = checkpointed(rows)

    cells = rows.groupBy("arc", "cell").agg(F.sum("size").alias("held"))
    loads = np.zeros(len(places), np.int64)
    for r in cells.groupBy("arc").agg(F.sum("held").alias("held")).collect():
        loads[r["arc"]] = r["held"]
    parts = [(arc, [(int(p), s) for p, s in cut]) for arc, cut in enumerate(walk(loads, owner, shards, slack))]
    plan = docs.sparkSession.createDataFrame(parts, "arc int, parts array<struct<past:bigint,shard:int>>")

    before = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    # at most shards * (nodes + 1) parts in all, whatever the size of the data
    starts = starts.join(F.broadcast(plan), "arc")
    inside = Window.partitionBy("arc", "cell").orderBy("doc_id", "text_crc32", "size") \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a row lies where its first byte lies
    at = rows.withColumn("past", F.sum("size").over(inside)).join(starts, ["arc", "cell"]) \
        .withColumn("first", F.col("start") + F.col("past") - F.col("size"))
    placed = checkpointed(at.select("doc_id", "size", "text_crc32", "arc", "cell", "first",
                                    F.expr("filter(parts, p -> first < p.past)[0].shard").alias("shard")))

    held = placed.groupBy("shard", "arc", "cell").count()
    earlier = Window.partitionBy("shard").orderBy("arc", "cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("shard", "arc", "cell", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("base"))
    order = Window.partitionBy("arc", "cell", "shard").orderBy("first", "doc_id")
    return placed.withColumn("number", F.row_number().over(order)).join(offsets, ["shard", "arc", "cell"]).select(
        F.col("doc_id").alias(id_column), "size", "text_crc32", "shard",
        (F.col("base") + F.col("number") - 1).alias("slot"))
