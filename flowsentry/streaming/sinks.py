"""Where streams end: appended files, and a result table kept as one folder per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from flowsentry.sources.files import exists

ONCE = {"availableNow": True}
_EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"


def append_files(stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Rows that will not change any more, appended exactly once."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or ONCE)).start())


def write_batch(df: DataFrame, folder: str, batch_id: int) -> None:
    """A micro-batch in a folder of its own. A batch that is run again replaces what it wrote."""
    df.write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")


def keep_updates(stream: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """The rows each micro-batch changed.

    A batch without new rows changes none: there all state is read only to drop what the watermark has passed. The next
    batch with rows does that as well.
    """
    conf = stream.sparkSession.conf
    before = conf.get(_EMPTY_BATCHES, "true")
    conf.set(_EMPTY_BATCHES, "false")  # read when a stream starts
    try:
        return each_batch(stream, lambda df, batch_id: write_batch(df, f"{folder}/data", batch_id),
                          folder, "update", trigger)
    finally:
        conf.set(_EMPTY_BATCHES, before)


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], folder: str,
               mode: str = "append", trigger: dict | None = None) -> StreamingQuery:
    return (stream.writeStream.outputMode(mode).foreachBatch(handle)
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(**(trigger or ONCE)).start())


def _newest_base(spark: SparkSession, folder: str) -> tuple[DataFrame | None, int]:
    """The latest compacted rows and the batch they reach up to; none and -1 before any compaction."""
    if not exists(spark, f"{folder}/base"):
        return None, -1
    bases = spark.read.parquet(f"{folder}/base")
    upto = bases.agg(F.max("upto")).first()[0]
    return bases.filter(F.col("upto") == upto).withColumnRenamed("upto", "batch_id"), upto


def current_rows(spark: SparkSession, folder: str, key: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The newest version of every key, from the latest compacted rows and the updates since. With the rows' schema,
    a stream that hasn't had a batch yet gives an empty table."""
    if schema and not exists(spark, f"{folder}/data"):
        return spark.createDataFrame([], schema)
    base, upto = _newest_base(spark, folder)
    updates = spark.read.parquet(f"{folder}/data").filter(F.col("batch_id") > upto)
    versions = updates if base is None else base.unionByName(updates)
    values = [c for c in versions.columns if c not in (*key, "batch_id")]
    newest = versions.groupBy(*key).agg(F.max_by(F.struct(*values), "batch_id").alias("_row"))
    return newest.select(*key, "_row.*")


def compact(spark: SparkSession, folder: str, key: list[str]) -> int:
    """Write the current rows as the new starting point for readers. Returns the batch it reaches up to;
    folders of batches up to it are not read any more and may be removed."""
    newest = spark.read.parquet(f"{folder}/data").agg(F.max("batch_id")).first()[0]
    current_rows(spark, folder, key).write.mode("overwrite").parquet(f"{folder}/base/upto={newest}")
    return newest


def appended_rows(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All appended rows. With their schema, a stream that hasn't written anything gives an empty table."""
    if schema:
        if not exists(spark, f"{folder}/data"):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(f"{folder}/data")
    return spark.read.parquet(f"{folder}/data")
