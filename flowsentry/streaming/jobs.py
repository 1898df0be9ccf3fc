"""Streaming counterparts of the batch operators.

Event time is a wall-clock timestamp in the tables and an instant in the stream, because watermarks need
one; `to_instant` and `to_wall_clock` convert under the session's UTC zone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from flowsentry.functions.labels import chart_class
from flowsentry.operators.alerts import alerts_from_stream
from flowsentry.operators.blocklist import auto_blocklist
from flowsentry.operators.connections import connection_stats, sessions
from flowsentry.operators.filters import captured
from flowsentry.operators.joins import keys_apart
from flowsentry.schemas import CONNECTION_KEY, FLOW_KEY
from flowsentry.streaming import sinks

# Fixed value: how late a row may be before it is dropped.
LATENESS = "10 minutes"


def to_instant(df: DataFrame, ts: str = "ts") -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def to_wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def timed(stream: DataFrame, lateness: str = LATENESS, ts: str = "ts") -> DataFrame:
    return to_instant(stream, ts).withWatermark(ts, lateness)


def capture(packets: DataFrame, folder: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the packets on capture ports."""
    return sinks.append_files(captured(packets), folder, trigger)


def connection_spans(packets: DataFrame, span: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Packets, bytes, first and last time per connection and span of time. A span's state is given up once the
    watermark has passed it, so state holds the connections of the newest spans only."""
    counted = connection_stats(timed(packets, lateness), [F.window("ts", span).alias("span"), *CONNECTION_KEY])
    flat = counted.select(F.col("span.start").alias("span_start"), *CONNECTION_KEY, "packet_count", "bytes",
                          "first_seen", "last_seen")
    return to_wall_clock(flat, "span_start", "first_seen", "last_seen")


def running_connections(packets: DataFrame, folder: str, trigger: dict | None = None, span: str = "1 day",
                        lateness: str = LATENESS) -> StreamingQuery:
    """Connection spans, updated batch by batch; `connections_so_far` adds them up."""
    return sinks.keep_updates(connection_spans(packets, span, lateness), folder, trigger)


def connections_so_far(spans: DataFrame) -> DataFrame:
    """Packets, bytes, first and last time per connection from the current rows of `running_connections`."""
    return spans.groupBy(*CONNECTION_KEY).agg(
        F.sum("packet_count").alias("packet_count"), F.sum("bytes").alias("bytes"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def open_sessions(packets: DataFrame, closed: DataFrame, gap_seconds: int) -> DataFrame:
    """What `closed_sessions` of the same packets hasn't emitted: the sessions of each source's rows after its last
    closed one. Both sides are plain tables."""
    last = closed.groupBy("src_ip").agg(F.max("session_end").alias("_closed"))
    rest, match, names = keys_apart(last, ["src_ip"])
    rows = packets.join(rest, match, "left").filter(F.col("_closed").isNull() | (F.col("ts") >= F.col("_closed")))
    gap = F.expr(f"INTERVAL {gap_seconds} SECONDS")
    return sessions(rows.drop("_closed", *names), gap_seconds).select(
        "src_ip", "session_start", (F.col("last_seen") + gap).alias("session_end"), "packets", "bytes")


def threat_buckets(records: DataFrame, width: str = "10 seconds", level: str = "threat_level",
                   lateness: str = LATENESS) -> DataFrame:
    """Normal, suspicious and threat counts per tumbling window."""
    series = chart_class(level)
    counted = timed(records, lateness).groupBy(F.window("ts", width)).agg(
        *[F.count_if(series == name).alias(name) for name in ("normal", "suspicious", "threats")])
    flat = counted.select(F.col("window.start").alias("window_start"), "normal", "suspicious", "threats")
    return to_wall_clock(flat, "window_start")


def active_windows(traffic: DataFrame, width: str = "5 minutes", slide: str = "1 minute",
                   lateness: str = LATENESS) -> DataFrame:
    """Connections seen in each sliding window."""
    counted = timed(traffic, lateness).groupBy(F.window("ts", width, slide), *FLOW_KEY).agg(
        F.count("*").alias("packet_count"), F.sum("bytes").alias("bytes"),
        F.max("ts").alias("last_seen"))
    flat = counted.select(F.col("window.start").alias("window_start"), *FLOW_KEY, "packet_count",
                          "bytes", "last_seen")
    return to_wall_clock(flat, "window_start", "last_seen")


def closed_sessions(packets: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    """Activity sessions per source, emitted once the watermark has passed their end."""
    counted = timed(packets, lateness).groupBy(F.session_window("ts", gap), "src_ip").agg(
        F.count("*").alias("packets"), F.sum("packet_size").alias("bytes"))
    flat = counted.select("src_ip", F.col("session_window.start").alias("session_start"),
                          F.col("session_window.end").alias("session_end"), "packets", "bytes")
    return to_wall_clock(flat, "session_start", "session_end")


def new_danger_alerts(alerts: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Danger alerts, each id once."""
    danger = alerts.filter((F.lower("severity") == "danger") & F.col("id").isNotNull())
    return to_wall_clock(timed(danger, lateness).dropDuplicatesWithinWatermark(["id"]), "ts")


def alerting(traffic: DataFrame, score: Callable[[DataFrame], DataFrame], folder: str,
             keep: list[str], trigger: dict | None = None) -> StreamingQuery:
    """Score each micro-batch, raise alerts and block the sources of danger alerts.

    Both results are written per batch, so a batch that is run again changes nothing.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        alerts = alerts_from_stream(score(batch), keep).persist()
        sinks.write_batch(alerts, f"{folder}/alerts/data", batch_id)
        sinks.write_batch(auto_blocklist(alerts), f"{folder}/blocklist/data", batch_id)
        alerts.unpersist()

    return sinks.each_batch(traffic, handle, folder, "append", trigger)
