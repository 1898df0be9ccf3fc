"""Newest-first lists. A limit of 0 or None means all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(df: DataFrame, limit: int | None = None, ts: str = "ts", tie: str = "id") -> DataFrame:
    """Newest rows first; equal times keep insertion order, which `tie` stands for."""
    ordered = df.orderBy(F.col(ts).desc(), F.col(tie).asc())
    return ordered.limit(limit) if limit else ordered


def packet_tail(packets: DataFrame, count: int | None = None, ts: str = "ts",
                tie: str = "packet_id") -> DataFrame:
    """The last `count` packets, in arrival order."""
    if count:
        packets = packets.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(count)
    return packets.orderBy(ts, tie)


def recent_per_group(df: DataFrame, keep: int, group: list[str], ts: str = "ts",
                     tie: str = "packet_id", spread: int = 64) -> DataFrame:
    """The newest `keep` rows of every group.

    Rows of a group are first ranked inside `spread` hashed shares of it, so that a group holding much
    of the table is cut down by many tasks before its survivors meet in one.
    """
    order = [F.col(ts).desc(), F.col(tie).desc()]
    shared = df.withColumn("_share", F.pmod(F.xxhash64(tie), F.lit(spread)))
    by_share = Window.partitionBy(*group, "_share").orderBy(*order)
    survivors = (shared.withColumn("_place", F.row_number().over(by_share))
                 .filter(F.col("_place") <= keep).drop("_place", "_share"))
    by_group = Window.partitionBy(*group).orderBy(*order)
    return (survivors.withColumn("place", F.row_number().over(by_group))
            .filter(F.col("place") <= keep))
