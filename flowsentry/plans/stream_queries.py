"""Registered streaming queries: each drains the event file as a stream and returns what it left behind."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.operators.alerts import alerts_from_stream
from flowsentry.operators.blocklist import auto_blocklist
from flowsentry.plans.registry import Tables, register, stream_scored
from flowsentry.schemas import CONNECTION_KEY
from flowsentry.session import checkpointed, shared_dir
from flowsentry.sources import derived as D
from flowsentry.sources.files import is_folder, remove
from flowsentry.streaming import jobs, sinks


def _events(t: Tables) -> DataFrame:
    """The event table as a stream, whether it is one file or a folder of part files."""
    reader, path = t.spark.readStream.schema(t.events.schema), f"{t.folder}/events.parquet"
    if is_folder(t.spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(t.folder)


def _folder(t: Tables, name: str) -> str:
    return f"{shared_dir(t.spark)}/streams/{name}-{uuid.uuid4().hex}"


def _settled(t: Tables, folder: str, rows: DataFrame) -> DataFrame:
    """The result of a drained stream, kept apart from its files and state, which are removed."""
    kept = checkpointed(rows)
    remove(t.spark, folder)
    return kept


def _kept(t: Tables, stream: DataFrame, name: str, key: list[str]) -> DataFrame:
    folder = _folder(t, name)
    sinks.keep_updates(stream, folder).awaitTermination()
    return _settled(t, folder, sinks.current_rows(t.spark, folder, key, stream.schema))


def _appended(t: Tables, stream: DataFrame, name: str) -> DataFrame:
    folder = _folder(t, name)
    sinks.append_files(stream, folder).awaitTermination()
    return _settled(t, folder, sinks.appended_rows(t.spark, folder, stream.schema))


@register
def stream_capture(t: Tables) -> DataFrame:
    folder, packets = _folder(t, "capture"), D.packets(_events(t))
    jobs.capture(packets, folder).awaitTermination()
    return _settled(t, folder, sinks.appended_rows(t.spark, folder, packets.schema))


@register
def stream_connections(t: Tables) -> DataFrame:
    folder, packets = _folder(t, "connections"), D.packets(_events(t))
    jobs.running_connections(packets, folder).awaitTermination()
    spans = sinks.current_rows(t.spark, folder, ["span_start", *CONNECTION_KEY], jobs.connection_spans(packets).schema)
    return _settled(t, folder, jobs.connections_so_far(spans))


@register
def stream_buckets(t: Tables) -> DataFrame:
    records = D.predictions(_events(t)).withColumn("threat_level", L.threat_level("prediction"))
    return _kept(t, jobs.threat_buckets(records, "1 hour"), "buckets", ["window_start"])


@register
def stream_active(t: Tables) -> DataFrame:
    windows = jobs.active_windows(D.traffic(_events(t)), "1 day", "6 hours")
    return _kept(t, windows, "active",
                 ["window_start", "src_ip", "dst_ip", "src_port", "dst_port", "protocol"])


@register
def stream_sessions(t: Tables) -> DataFrame:
    closed = _appended(t, jobs.closed_sessions(D.packets(_events(t)), "6 hours"), "sessions")
    still_open = jobs.open_sessions(t.packets, closed, 6 * 3600)
    return closed.withColumn("is_open", F.lit(False)).unionByName(still_open.withColumn("is_open", F.lit(True)))


@register
def stream_notify(t: Tables) -> DataFrame:
    alerts = D.alerts(_events(t)).union(D.alerts(_events(t)))  # every alert arrives twice
    return _appended(t, jobs.new_danger_alerts(alerts), "notify")


def _alerting(t: Tables, part: str) -> DataFrame:
    """One of the two tables that the alerting job leaves behind."""
    def scored(batch: DataFrame) -> DataFrame:
        return stream_scored(D.predictions(batch))

    folder = _folder(t, "alerting")
    jobs.alerting(_events(t), scored, folder, ["id", "ts"]).awaitTermination()
    shape = alerts_from_stream(scored(t.events.limit(0)), ["id", "ts"])
    schema = (shape if part == "alerts" else auto_blocklist(shape)).schema
    return _settled(t, folder, sinks.appended_rows(t.spark, f"{folder}/{part}", schema).drop("batch_id"))


@register
def stream_alerts(t: Tables) -> DataFrame:
    return _alerting(t, "alerts")


@register
def stream_blocklist(t: Tables) -> DataFrame:
    return _alerting(t, "blocklist").distinct()
