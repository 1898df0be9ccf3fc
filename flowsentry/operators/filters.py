"""Row filters and column selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.clock import AsOf, as_of_column, parse_iso
from flowsentry.functions.labels import severity_rank
from flowsentry.functions.network import byte_count, on_capture_ports, truthy
from flowsentry.operators.toplists import latest
from flowsentry.schemas import CAPTURE_PORTS, FLOW_FEATURES, SEVERITIES, SESSION_FEATURES


def captured(packets: DataFrame, ports: tuple[int, int] = CAPTURE_PORTS) -> DataFrame:
    """TCP packets with either end on a capture port."""
    return packets.filter((F.col("protocol") == "TCP") & on_capture_ports(ports))


def by_severity(alerts: DataFrame, severity: str) -> DataFrame:
    return alerts.filter(F.lower("severity") == severity.lower())


def by_acknowledged(alerts: DataFrame, acknowledged: bool = False) -> DataFrame:
    return alerts.filter(F.col("acknowledged") == acknowledged)


def history_of_source(alerts: DataFrame, source_ip: str, limit: int | None = 50,
                      severity: str | None = None, limit_first: bool = False) -> DataFrame:
    """Alerts of one source, newest first. `limit_first` cuts to the limit before looking at severity."""
    if not source_ip:
        raise ValueError("source_ip is required")
    mine = alerts.filter(F.col("source_ip") == source_ip)
    wanted = F.col("severity") == severity
    if severity and not limit_first:
        mine = mine.filter(wanted)
    newest = latest(mine, limit)
    return newest.filter(wanted) if severity and limit_first else newest


def since(df: DataFrame, window: str, as_of: AsOf = None, ts: str = "ts") -> DataFrame:
    """Rows of the last `window` (such as "1 HOURS") before `as_of`."""
    return df.filter(F.col(ts) >= as_of_column(df, as_of, ts, back=window))


def retained(df: DataFrame, days: int = 30, as_of: AsOf = None, ts: str = "ts") -> DataFrame:
    """Rows young enough to keep."""
    return since(df, f"{int(days)} DAYS", as_of, ts)


def confident(df: DataFrame, min_confidence: float = 0.70, min_severity: str | None = None,
              confidence: str = "confidence", severity: str = "severity") -> DataFrame:
    """Rows sure enough, and severe enough, to act on."""
    keep = F.col(confidence) >= min_confidence
    if min_severity:
        keep = keep & (severity_rank(severity) >= SEVERITIES.index(min_severity))
    return df.filter(keep)


def align_schema(df: DataFrame, columns: list[str] = FLOW_FEATURES,
                 keep: list[str] | None = None) -> DataFrame:
    """Exactly the trained columns, in their order; columns the input lacks are 0."""
    present = set(df.columns)
    return df.select(*(keep or []),
                     *[F.col(c) if c in present else F.lit(0).alias(c) for c in columns])


def normalise_traffic(raw: DataFrame, keep_untimed: bool = False) -> DataFrame:
    """One spelling per field, default protocol, counted bytes; rows with neither address are dropped,
    and so are rows whose timestamp is missing or malformed."""
    def text(name: str, *spellings: str):
        found = [truthy(s, "") for s in spellings if s in raw.columns]
        return F.coalesce(*found, F.lit("")).alias(name)

    def port(name: str, *spellings: str):
        found = [truthy(s, 0) for s in spellings if s in raw.columns]
        return F.coalesce(*found, F.lit(None).cast("int")).alias(name)

    clean = raw.select(
        "record_id", parse_iso("timestamp").alias("ts"),
        text("src_ip", "SrcIP", "src_ip"), text("dst_ip", "DstIP", "dst_ip"),
        port("src_port", "SrcPort", "src_port"), port("dst_port", "DstPort", "dst_port"),
        F.coalesce(truthy("Protocol", ""), F.lit("TCP")).alias("protocol"),
        byte_count().alias("bytes"),
    ).filter((F.col("src_ip") != "") | (F.col("dst_ip") != ""))
    return clean if keep_untimed else clean.filter(F.col("ts").isNotNull())


def flow_to_session(flows: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Session features estimated from one flow. What a flow cannot tell takes a fixed value."""
    size, protocol = F.col("PacketSize"), F.col("Protocol")
    # Size spread factors and the defaults of columns a flow does not carry.
    spread = {"std_packet_size": 0.2, "min_packet_size": 0.5, "max_packet_size": 1.5}
    defaults = {
        "unique_ports": 1, "vnc_commands": 10, "vnc_responses": 10, "framebuffer_updates": 5,
        "key_events": 0, "pointer_events": 0, "mouse_clicks": 0, "keystroke_count": 0,
        "screenshot_count": 0, "file_transfer_size": 0, "compression_ratio": 0.8,
        "encryption_level": 1,
    }
    columns = {
        "packet_count": F.col("NumPackets"),
        "total_bytes": F.col("BytesSent") + F.col("BytesReceived"),
        "avg_packet_size": size,
        "bytes_per_second": F.col("FlowRate"),
        "packets_per_second": F.col("PacketRate"),
        "connection_duration": F.col("FlowDuration"),
        "protocol_ratio_tcp": F.when(protocol == "TCP", 1.0).otherwise(0.0),
        "protocol_ratio_udp": F.when(protocol == "UDP", 1.0).otherwise(0.0),
        "entropy_bytes": F.col("Entropy"),
        "entropy_packets": F.col("Entropy"),
        "anomaly_score": F.col("AnomalyScore"),
        "session_length": F.col("ActiveTime"),
        **{name: size * factor for name, factor in spread.items()},
        **{name: F.lit(value) for name, value in defaults.items()},
    }
    return flows.select(*(keep or []), *[columns[c].alias(c) for c in SESSION_FEATURES])
