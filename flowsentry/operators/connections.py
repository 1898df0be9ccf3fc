"""Packets aggregated into connections, flows and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowsentry.functions.clock import AsOf, micros
from flowsentry.functions.text import count_entropy
from flowsentry.functions.network import per_second
from flowsentry.operators.blocklist import with_status
from flowsentry.operators.filters import align_schema, since
from flowsentry.operators.joins import keys_apart
from flowsentry.operators.ordering import previous_time
from flowsentry.schemas import CONNECTION_KEY, FLOW_KEY, SESSION_FEATURES

MICROS = 1e6


def connection_stats(packets: DataFrame, key: list[str] = CONNECTION_KEY) -> DataFrame:
    """Packets, bytes, first and last time of every connection."""
    return packets.groupBy(*key).agg(
        F.count("*").alias("packet_count"), F.sum("packet_size").alias("bytes"),
        F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


def capture_totals(packets: DataFrame) -> DataFrame:
    """Packets, bytes, distinct connections, start and duration of a capture.

    Counting connections first turns the distinct count into a plain one over far fewer rows.
    """
    return connection_stats(packets).agg(
        F.coalesce(F.sum("packet_count"), F.lit(0)).alias("packets_captured"),
        F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes_captured"),
        F.count("*").alias("active_connections"),
        F.min("first_seen").alias("start_time"),
        F.coalesce((micros(F.max("last_seen")) - micros(F.min("first_seen"))) / MICROS, F.lit(0.0))
         .alias("duration"))


def active_connections(traffic: DataFrame, blocklist: DataFrame, window: str = "5 MINUTES",
                       as_of: AsOf = None, limit: int | None = 100) -> DataFrame:
    """Connections seen in the last `window`, newest first, with their blocked/active status.

    `traffic` is in normal form. The blocklist meets the grouped rows, not the traffic. `limit` is the page
    size; None gives all.
    """
    recent = since(traffic, window, as_of)
    grouped = recent.groupBy(*FLOW_KEY).agg(
        F.count("*").alias("packet_count"), F.sum("bytes").alias("bytes"),
        F.max("ts").alias("last_seen"))
    order = [F.col("last_seen").desc(), *[F.col(k).asc() for k in FLOW_KEY]]
    if limit:
        grouped = grouped.orderBy(*order).limit(limit)
    return with_status(grouped, blocklist).orderBy(*order)


def flow_features(packets: DataFrame, tie: str = "packet_id", last_seen: bool = False) -> DataFrame:
    """The 19 flow features of every flow in a batch of packets; with `last_seen` also when its last packet came.

    PacketSize is the first packet's. Features raw packets cannot give are 0. MeanGapMs is added: the
    mean gap between packets needs only first time, last time and count.
    """
    first = F.struct("ts", tie)
    grouped = packets.groupBy(*FLOW_KEY).agg(
        F.min_by("packet_size", first).alias("PacketSize"),
        F.count("*").alias("NumPackets"), F.sum("packet_size").alias("BytesSent"),
        F.sum("payload_size").alias("_payload"), F.count("payload_size").alias("_payloads"),
        F.min("ts").alias("_start"), F.max("ts").alias("_end"))
    span = (micros("_end") - micros("_start")) / MICROS
    length = (F.when(F.col("NumPackets") == 1, 1.0).when(span == 0, 0.001).otherwise(span))
    timed = grouped.withColumn("FlowDuration", length).withColumn("_span", span)
    zero, none = F.lit(0).cast("bigint"), F.lit(0.0)
    return timed.select(
        "PacketSize", none.alias("ResponseTime"), F.col("protocol").alias("Protocol"),
        F.col("src_ip").alias("SrcIP"), F.col("dst_ip").alias("DstIP"),
        F.col("src_port").alias("SrcPort"), F.col("dst_port").alias("DstPort"),
        (F.col("NumPackets") / F.col("FlowDuration")).alias("PacketRate"), "FlowDuration",
        "NumPackets", (F.col("_payload") / F.col("_payloads")).alias("PayloadSize"),
        zero.alias("FlagCount"), none.alias("AnomalyScore"), none.alias("Entropy"), "BytesSent",
        zero.alias("BytesReceived"), (F.col("BytesSent") / F.col("FlowDuration")).alias("FlowRate"),
        F.col("FlowDuration").alias("ActiveTime"), none.alias("IdleTime"),
        F.when(F.col("NumPackets") > 1, F.col("_span") * 1000 / (F.col("NumPackets") - 1))
         .otherwise(0.0).alias("MeanGapMs"),
        *([F.col("_end").alias("LastSeen")] if last_seen else []))


def packet_gaps(packets: DataFrame, tie: str = "packet_id") -> DataFrame:
    """Milliseconds since the previous packet of the same flow, 0 for its first packet."""
    timed = packets.select(*FLOW_KEY, "ts", tie)
    follows = previous_time(timed, FLOW_KEY, tie, name="_previous")
    gap = (micros("ts") - micros("_previous")) / 1000
    return follows.select(tie, *FLOW_KEY, "ts", F.coalesce(gap, F.lit(0.0)).alias("gap_ms"))


def port_entropy(packets: DataFrame) -> DataFrame:
    """Entropy of the destination ports each source talks to. High values point at scans."""
    per_port = packets.groupBy("src_ip", "dst_port").agg(F.count("*").alias("_n"))
    return per_port.groupBy("src_ip").agg(
        F.sum("_n").alias("packets"), F.count("*").alias("ports"),
        count_entropy(F.col("_n"), F.sum("_n")).alias("entropy"))


def session_features(packets: DataFrame, key: tuple[str, ...] = ("src_ip", "dst_ip"),
                     kinds: dict[str, str] | None = None) -> DataFrame:
    """Session statistics that packets can tell, under the session schema's column names; with `kinds` also how many
    messages of the kind named for a column the session carried.

    Ports and packet sizes are counted per value before they meet in the session's row, so what is joined
    is one row per session on either side.
    """
    size = F.col("packet_size")
    totals = packets.groupBy(*key).agg(
        F.count("*").alias("packet_count"), F.sum(size).alias("total_bytes"),
        F.avg(size).alias("avg_packet_size"), F.stddev_pop(size).alias("std_packet_size"),
        F.min(size).alias("min_packet_size"), F.max(size).alias("max_packet_size"),
        F.min("ts").alias("_start"), F.max("ts").alias("_end"),
        F.count_distinct("dst_port").alias("unique_ports"),
        F.count_if(F.col("protocol") == "TCP").alias("_tcp"),
        F.count_if(F.col("protocol") == "UDP").alias("_udp"),
        *[F.count_if(F.col("event_type") == kind).alias(name) for name, kind in (kinds or {}).items()])
    sizes = packets.groupBy(*key, "packet_size").agg(F.count("*").alias("_n"))
    spread = sizes.groupBy(*key).agg(count_entropy(F.col("_n"), F.sum("_n")).alias("entropy_packets"))
    seconds = (micros("_end") - micros("_start")) / MICROS
    spread, match, _ = keys_apart(spread, list(key))
    joined = totals.join(spread, match).withColumn("connection_duration", seconds)
    length, n = F.col("connection_duration"), F.col("packet_count")
    return joined.select(
        *key, "packet_count", "total_bytes", "avg_packet_size", "std_packet_size",
        "min_packet_size", "max_packet_size",
        per_second(F.col("total_bytes"), length).alias("bytes_per_second"),
        per_second(n, length).alias("packets_per_second"), "connection_duration", "unique_ports",
        (F.col("_tcp") / n).alias("protocol_ratio_tcp"), "entropy_packets",
        (F.col("_udp") / n).alias("protocol_ratio_udp"), length.alias("session_length"), *(kinds or {}))


def session_matrix(packets: DataFrame, kinds: dict[str, str],
                   key: tuple[str, ...] = ("src_ip", "dst_ip")) -> DataFrame:
    """The whole session row: every session column that packets can tell, the others 0."""
    return align_schema(session_features(packets, key, kinds), SESSION_FEATURES, keep=list(key))


def session_event_counts(packets: DataFrame, kinds: list[str], key: tuple[str, ...] = ("src_ip", "dst_ip"),
                         kind: str = "event_type") -> DataFrame:
    """How many messages of each kind a session carried, one column per kind."""
    return packets.groupBy(*key).agg(
        *[F.count_if(F.col(kind) == k).alias(f"{k}_count") for k in kinds])


def sessions(packets: DataFrame, gap_seconds: int, key: tuple[str, ...] = ("src_ip",)) -> DataFrame:
    """Activity sessions per key: a silence longer than the gap starts a new one.

    Rows in one gap-sized slot of time always share a session, so they are combined first. A key then
    has at most one row per slot, however many packets it sent.
    """
    slot = F.floor(micros("ts") / F.lit(gap_seconds * 1_000_000))
    slots = packets.groupBy(*key, slot.alias("_slot")).agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"),
        F.count("*").alias("_packets"), F.sum("packet_size").alias("_bytes"))
    along = Window.partitionBy(*key).orderBy("_slot")
    silence = micros("_first") - micros(F.lag("_last").over(along))
    marked = slots.withColumn("_silence", silence).withColumn(
        "_starts", (F.col("_silence").isNull() | (F.col("_silence") > gap_seconds * 1_000_000)).cast("int"))
    numbered = marked.withColumn("_session", F.sum("_starts").over(along))
    start, end = F.min("_first"), F.max("_last")
    return numbered.groupBy(*key, "_session").agg(
        start.alias("session_start"), end.alias("last_seen"),
        F.sum("_packets").alias("packets"), F.sum("_bytes").alias("bytes"),
        ((micros(end) - micros(start)) / MICROS).alias("active_seconds"),
        F.coalesce(F.max(F.when(F.col("_starts") == 1, F.col("_silence"))) / MICROS, F.lit(0.0))
         .alias("idle_seconds")).drop("_session")
