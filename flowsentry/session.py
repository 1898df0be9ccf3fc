"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Instants are read as UTC. Generated methods above 8000 bytes would run uncompiled on HotSpot; below this
# limit Spark splits wide projections into methods small enough to be compiled.
RUNTIME_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # a count of all state rows, which nothing asks for, would look up every key once more
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
}

SESSION_SETTINGS = {
    **RUNTIME_SETTINGS,
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(app: str = "flowsentry", master: str | None = None,
                  **settings: str) -> SparkSession:
    """A session with the settings the operators assume; `settings` override them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in {**SESSION_SETTINGS, **settings}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session made elsewhere."""
    for name, value in RUNTIME_SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach. Only in-process local mode may fall back to a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    made = tempfile.mkdtemp(prefix="flowsentry-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Actions in this block remove their shuffle files when they end. For results that nothing reads again: written
    ones, and single numbers."""
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise `df` on shared storage, so that row positions survive the loss of an executor. The shuffle
    files written on the way are removed at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    with shuffles_removed(spark):
        return df.select("*").checkpoint()  # a new query: the setting is read when a query is made
