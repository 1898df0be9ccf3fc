"""Connected components of a link table: forests of blocks of links, then alternating large and small stars between them."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowsentry.session import checkpointed, shuffles_removed

_BROADCASTS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
_COMPILED = "spark.sql.codegen.wholeStage"
ROWS_A_TASK = 200_000


@contextmanager
def no_broadcasts(spark: SparkSession):
    """Queries made and run in this block join by shuffles only: the driver builds no hash tables, of which a loop of
    small joins would leave dozens behind, each of a page of memory or more."""
    before = {name: spark.conf.get(name, None) for name in _BROADCASTS}
    try:
        for name in _BROADCASTS:
            spark.conf.set(name, "-1")
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


@contextmanager
def interpreted(spark: SparkSession, small: bool):
    """Queries made and run in this block are not compiled, if the tables are small: a loop of dozens of joins would leave
    the driver with classes for every one of them."""
    before = spark.conf.get(_COMPILED, "true")
    try:
        if small:
            spark.conf.set(_COMPILED, "false")
        yield
    finally:
        spark.conf.set(_COMPILED, before)


def few_tasks(df: DataFrame) -> DataFrame:
    """A checkpointed table in as many partitions as its rows ask for, so that a small one read in a loop of jobs doesn't
    start a task for each of many nearly empty partitions."""
    parts = df.rdd.getNumPartitions()
    if parts <= 1:
        return df
    with shuffles_removed(df.sparkSession):
        return df.coalesce(min(parts, df.count() // ROWS_A_TASK + 1))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its smallest node.

    Null ends and self links name no component of their own. An empty table gives an empty result.
    """
    spark = links.sparkSession
    # every link as (larger, smaller); finished when no node points to two others and no target points on
    edges = few_tasks(checkpointed(links.filter("a < b or b < a").select(
        F.greatest("a", "b").alias("node"), F.least("a", "b").alias("to")).distinct()))
    while True:
        with shuffles_removed(spark):
            # the links of one block are a whole forest, of which no star is left to tie
            single = edges.rdd.getNumPartitions() <= 1 and edges.limit(ROWS_A_TASK + 1).count() <= ROWS_A_TASK
        edges = checkpointed(edges.mapInArrow(_forests, edges.schema))
        if single:
            break
        large = _star(edges.union(edges.select(F.col("to").alias("node"), F.col("node").alias("to"))), larger=True)
        edges = few_tasks(checkpointed(_star(large, larger=False)))
        doubled = edges.groupBy("node").agg(F.count("*").alias("n")).filter("n > 1")
        onward = edges.select("to").distinct().join(edges.select(F.col("node").alias("to")), "to", "left_semi")
        with shuffles_removed(spark):
            if doubled.select(F.lit(1)).union(onward.select(F.lit(1))).limit(1).count() == 0:
                break
    roots = edges.select("to").distinct().select(F.col("to").alias("node"), F.col("to").alias("component"))
    return edges.select("node", F.col("to").alias("component")).union(roots)


def _forests(batches):
    """Blocks of at most ROWS_A_TASK links (node, to) as links of each node to the smallest one it is tied to there."""
    waiting, held = [], 0
    for batch in batches:
        while batch.num_rows:
            part = batch.slice(0, ROWS_A_TASK - held)
            waiting.append(part)
            held, batch = held + part.num_rows, batch.slice(part.num_rows)
            if held == ROWS_A_TASK:
                yield from _forest(pa.Table.from_batches(waiting))
                waiting, held = [], 0
    if held:
        yield from _forest(pa.Table.from_batches(waiting))


def _forest(links: pa.Table) -> list[pa.RecordBatch]:
    import pyarrow.compute as pc

    names = pc.unique(pa.chunked_array(links.column("node").chunks + links.column("to").chunks))
    names = names.take(pc.array_sort_indices(names))
    over = list(range(len(names)))  # never a larger node than the node itself

    def top(node: int) -> int:
        while over[node] != node:
            over[node] = node = over[over[node]]
        return node

    for x, y in zip(*(pc.index_in(links.column(c), names).to_pylist() for c in ("node", "to"))):
        x, y = top(x), top(y)
        over[max(x, y)] = min(x, y)
    tied = [(node, top(node)) for node in range(len(over)) if over[node] != node]
    columns = [names.take(pa.array([t[i] for t in tied], pa.int64())) for i in range(2)]
    return pa.Table.from_arrays(columns, schema=links.schema).combine_chunks().to_batches()


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Tie the larger (or the smaller and the node itself) neighbours of each node to its smallest neighbour."""
    least = edges.groupBy("node").agg(F.min("to").alias("low"))
    if larger:
        least = least.select("node", F.least("node", "low").alias("low"))
        moved = edges.join(least, "node").filter("`to` > node").select(F.col("to").alias("node"), F.col("low").alias("to"))
        return moved.filter("node != `to`").distinct()
    moved = edges.join(least, "node").filter("`to` != low").select(F.col("to").alias("node"), F.col("low").alias("to"))
    return moved.union(least.select("node", F.col("low").alias("to"))).filter("node != `to`").distinct()
