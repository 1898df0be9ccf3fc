"""Questions to the file store, in whatever store a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _store(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    store, place = _store(spark, path)
    return store.exists(place) and store.getFileStatus(place).isDirectory()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or a folder with all that is in it; nothing happens if it isn't there."""
    store, place = _store(spark, path)
    store.delete(place, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none if it isn't there."""
    store, place = _store(spark, path)
    return sorted(s.getPath().getName() for s in store.listStatus(place)) if store.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    store, place = _store(spark, path)
    stream = store.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def put_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file under a name that isn't taken; false if it is. Whoever lists the folder sees the file whole or
    not at all: it is written beside, then renamed."""
    store, place = _store(spark, path)
    draft = place.suffix(f".{uuid.uuid4()}.draft")
    stream = store.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    done = not store.exists(place) and store.rename(draft, place)
    if not done:
        store.delete(draft, False)
    return done
