"""Positions and neighbours in one total order, without a single-task window.

Rows are range-partitioned and sorted, each row gets its slice number and its place in the slice, and the
result is checkpointed so that both stay fixed. What the slices must know about each other is one small row
per slice (and group). A group holding most of the table is simply cut into many slices. The order has to be
unique, or nearly so, for the slices to be even.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.functions.clock import micros
from flowsentry.operators.joins import keys_apart
from flowsentry.session import checkpointed

# Layout of monotonically_increasing_id(): partition number above, row number below these bits.
_ROW_BITS = 33


def sorted_slices(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df` with `_slice`, rising along the order, and `_row`, the place inside the slice."""
    sliced = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn("_pos", F.monotonically_increasing_id()))
    fixed = checkpointed(sliced)
    return fixed.select(
        *df.columns,
        F.shiftright("_pos", _ROW_BITS).alias("_slice"),
        F.col("_pos").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)).alias("_row"),
    )


def rank_rows(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Number the rows 1, 2, … along the order. One shuffle; the offsets are one row per slice."""
    sliced = sorted_slices(df, order)
    sizes = sliced.groupBy("_slice").agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    return (sliced.join(F.broadcast(offsets), "_slice")
            .withColumn(name, F.col("_before") + F.col("_row") + 1)
            .drop("_slice", "_row", "_before"))


def rank_in_group(df: DataFrame, group: list[str], order: list[Column], name: str = "rank",
                  size: str | None = None) -> DataFrame:
    """Number the rows of each group 1, 2, …; optionally add the group's size.

    One small row per slice and group tells where the group begins in the slice, how many of its rows earlier slices
    hold, and how many there are in all.
    """
    sliced = sorted_slices(df, [F.col(g) for g in group] + order)
    parts = sliced.groupBy("_slice", *group).agg(F.min("_row").alias("_from"), F.count("*").alias("_n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_slice").alias("_part"), *group, F.sum("_n").over(whole).alias("_members"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from") + 1).alias("_shift"))
    parts, match, names = keys_apart(parts, group)
    wanted = {name: F.col("_row") + F.col("_shift")}
    if size:
        wanted[size] = F.col("_members")
    return (sliced.join(parts, match & (F.col("_slice") == F.col("_part"))).withColumns(wanted)
            .drop("_slice", "_row", "_part", "_shift", "_members", *names))


def previous_time(df: DataFrame, group: list[str], tie: str, ts: str = "ts", name: str = "previous",
                  slot_seconds: int = 3600) -> DataFrame:
    """The time of the preceding row of the same group, null for the first.

    Rows meet in slots of time, so a group that holds most of the table is cut into many. The last time of a group's
    previous slot, one small row each, is put in front of its rows as a marker.
    """
    slotted = df.withColumns({"_slot": F.floor(micros(ts) / (slot_seconds * 1_000_000)),
                              "_mark": F.lit(1)})
    ends = slotted.groupBy(*group, "_slot").agg(F.max(ts).alias("_last"))
    across = Window.partitionBy(*group).orderBy("_slot")
    markers = (ends.withColumn(ts, F.lag("_last").over(across)).drop("_last").filter(F.col(ts).isNotNull())
               .withColumn("_mark", F.lit(0)))
    inside = Window.partitionBy(*group, "_slot").orderBy("_mark", ts, tie)
    return (slotted.unionByName(markers, allowMissingColumns=True).withColumn(name, F.lag(ts).over(inside))
            .filter("_mark = 1").drop("_slot", "_mark"))
