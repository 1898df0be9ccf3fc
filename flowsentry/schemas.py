"""Fixed schemas and the value lists that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_STR, _INT, _LONG, _DBL = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

PACKET = _struct(
    packet_id=_LONG, ts=T.TimestampNTZType(), src_ip=_STR, dst_ip=_STR, src_port=_INT,
    dst_port=_INT, protocol=_STR, packet_size=_LONG, payload_size=_LONG, flags=_STR,
    event_type=_STR,
)

FLOW = _struct(
    PacketSize=_LONG, ResponseTime=_DBL, Protocol=_STR, SrcIP=_STR, DstIP=_STR,
    SrcPort=_INT, DstPort=_INT, PacketRate=_DBL, FlowDuration=_DBL, NumPackets=_LONG,
    PayloadSize=_LONG, FlagCount=_LONG, AnomalyScore=_DBL, Entropy=_DBL, BytesSent=_LONG,
    BytesReceived=_LONG, FlowRate=_DBL, ActiveTime=_DBL, IdleTime=_DBL, AttackLabel=_STR,
)

ALERT = _struct(
    id=_LONG, ts=T.TimestampNTZType(), type=_STR, severity=_STR, message=_STR,
    source_ip=_STR, details=_STR, acknowledged=T.BooleanType(),
)

PREDICTION = _struct(
    id=_LONG, ts=T.TimestampNTZType(), prediction=_STR, threat_level=_STR, confidence=_DBL,
    source_ip=_STR,
)

TRAFFIC = _struct(
    record_id=_LONG, ts=T.TimestampNTZType(), src_ip=_STR, dst_ip=_STR, src_port=_INT,
    dst_port=_INT, protocol=_STR, bytes=_LONG,
)

FLOW_LABEL = "AttackLabel"
FLOW_FEATURES = [f.name for f in FLOW.fields if f.name != FLOW_LABEL]
FLOW_KEY = ["src_ip", "dst_ip", "src_port", "dst_port", "protocol"]
CONNECTION_KEY = ["src_ip", "src_port", "dst_ip", "dst_port"]

# The feature columns of a session, in the order models are trained on.
SESSION_FEATURES = [
    "packet_count", "total_bytes", "avg_packet_size", "std_packet_size",
    "min_packet_size", "max_packet_size", "bytes_per_second", "packets_per_second",
    "connection_duration", "unique_ports", "protocol_ratio_tcp", "entropy_bytes",
    "entropy_packets", "vnc_commands", "vnc_responses", "framebuffer_updates",
    "key_events", "pointer_events", "mouse_clicks", "keystroke_count",
    "screenshot_count", "file_transfer_size", "compression_ratio", "encryption_level",
    "anomaly_score", "protocol_ratio_udp", "session_length",
]

# Capture port range, and the order detectors vote in.
CAPTURE_PORTS = (5900, 5910)
DETECTORS = ["random_forest", "svm", "xgboost", "cnn"]

# Label sets behind the threat mappings (compared upper-case unless said otherwise).
DANGER_LABELS = ["DANGER", "DOS", "DDOS", "MALWARE", "PORTSCAN"]
SAFE_LABELS = ["NORMAL", "SAFE"]
STATS_SAFE_LABELS = ["NORMAL", "SAFE", "UNKNOWN", "Normal", "Safe", "Unknown"]  # exact case
CHART_THREATS = ["danger", "attack", "dos", "ddos", "portscan", "malware"]  # lower-case
CHART_SUSPICIOUS = ["suspicious", "warning"]  # lower-case
NAMED_ATTACKS = ["DoS", "PortScan", "Malware", "DDoS"]  # exact case
IGNORED_ALERT_TYPES = ["Normal", "system", "normal"]  # exact case
SEVERITIES = ["safe", "suspicious", "warning", "danger"]  # rising rank
ALARM_SEVERITIES = ["danger", "warning"]

# Advice shown for each attack type.
ADVICE = {
    "Normal": "Traffic is normal. No action required. Continue monitoring.",
    "PortScan": "Port Scan detected! \nRecommendation: \n1. Block the source IP immediately.\n2. Enable firewall rules to limit port access.\n3. Implement IDS/IPS to detect scanning patterns.",
    "DoS": "DoS Attack detected! \nRecommendation: \n1. Implement rate limiting on VNC ports.\n2. Filter traffic from suspicious IPs.\n3. Use a load balancer to distribute traffic (though VNC is stateful).",
    "Malware": "Malware activity detected! \nRecommendation: \n1. Isolate the affected machine immediately.\n2. Run a full system antivirus scan.\n3. Check for unauthorized processes or services.",
    "DDoS": "DDoS Attack detected! \nRecommendation: \n1. Activate DDoS protection services (e.g., Cloudflare, AWS Shield).\n2. Rate limit incoming connections.\n3. Block traffic from known botnet IPs.",
    "File Exfiltration": "Data Exfiltration detected! \nRecommendation: \n1. Terminate the VNC session immediately.\n2. Block the destination IP.\n3. Audit file access logs to determine what was stolen.",
    "Clipboard Hijacking": "Clipboard Hijacking detected! \nRecommendation: \n1. Disable clipboard sharing in VNC server configuration.\n2. Monitor clipboard access by non-standard processes.",
    "Keylogging": "Keylogging detected! \nRecommendation: \n1. Reset all passwords immediately.\n2. Scan for and remove keylogger software.\n3. Use virtual keyboards for sensitive input if possible.",
    "Unencrypted": "Unencrypted VNC traffic detected! \nRecommendation: \n1. Enforce SSH tunneling for VNC connections.\n2. Use VNC over VPN.\n3. Configure VNC server to require encryption.",
}
DEFAULT_ADVICE = "Unknown attack type. Investigate immediately."
