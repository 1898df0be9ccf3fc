"""Writers: CSV exports, JSON snapshots and training splits."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.operators.toplists import latest
from flowsentry.sources.files import names, put_once, read_text

_NESTED = (T.StructType, T.MapType, T.ArrayType)


def _flat(df: DataFrame) -> DataFrame:
    """CSV cannot hold nested columns, so they become JSON text."""
    return df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, _NESTED)
                       else F.col(f.name) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    _flat(df).write.mode("overwrite").option("header", True).option("quoteAll", quote_all) \
        .option("escape", '"').csv(path)


def write_capture(packets: DataFrame, path: str) -> str | None:
    """Captured packets as CSV; nothing is written for an empty capture."""
    if packets.isEmpty():
        return None
    write_csv(packets, path)
    return path


def export_tables(tables: dict[str, DataFrame], folder: str) -> list[str]:
    """One CSV folder per non-empty table; returns the names written."""
    written = []
    for name, df in tables.items():
        if not df.isEmpty():
            write_csv(df, f"{folder}/{name}.csv")
            written.append(name)
    return written


def save_snapshot(tables: dict[str, DataFrame], folder: str) -> int:
    """Every table as JSON lines, and a manifest that names them, written last. Returns the snapshot's number.

    Readers take the newest manifest, so tables of a snapshot that broke off are never seen, nor mixed with others.
    """
    if not tables:
        raise ValueError("a snapshot needs a table")
    spark = next(iter(tables.values())).sparkSession
    part = f"data/{uuid.uuid4()}"
    for name, df in tables.items():
        df.write.json(f"{folder}/{part}/{name}")
    manifest = json.dumps({name: f"{part}/{name}" for name in tables})
    while True:
        number = max(snapshots(spark, folder), default=0) + 1
        if put_once(spark, f"{folder}/snapshots/{number:012d}.json", manifest):
            return number


def snapshots(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete snapshots of a folder."""
    return [int(n[:-5]) for n in names(spark, f"{folder}/snapshots") if n.endswith(".json")]


def load_snapshot(spark: SparkSession, folder: str, schemas: dict[str, T.StructType],
                  bounds: dict[str, int] | None = None, ts: str = "ts", number: int | None = None) -> dict[str, DataFrame]:
    """Tables of the newest complete snapshot, or of an earlier one. `bounds` cuts those that it names to their newest
    rows; 0 keeps all."""
    number = max(snapshots(spark, folder)) if number is None else number
    places = json.loads(read_text(spark, f"{folder}/snapshots/{number:012d}.json"))
    loaded = {}
    for name, schema in schemas.items():
        df = spark.read.schema(schema).json(f"{folder}/{places[name]}")
        bound = (bounds or {}).get(name, 0)
        loaded[name] = latest(df, bound, ts, tie=schema.fieldNames()[0]) if bound else df
    return loaded


def write_splits(split: DataFrame, path: str) -> None:
    """Training and test rows in folders of their own."""
    split.write.mode("overwrite").partitionBy("split").parquet(path)
