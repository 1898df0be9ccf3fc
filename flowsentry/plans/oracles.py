"""The SQL each registered query is checked against, written over the given tables."""

from __future__ import annotations

from flowsentry.schemas import ADVICE, DEFAULT_ADVICE, FLOW_FEATURES, SESSION_FEATURES

_IP = "('10.0.' || (user_id // 256) || '.' || (user_id % 256))"
_K = "CAST(props->>'$.k' AS INTEGER)"
_TARGET = f"('192.168.1.' || (1 + {_K} % 4))"
_SIZE = "CAST(floor(value * 3) AS BIGINT)"
_ISO = "regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '')"

PACKETS = f"""packets AS (SELECT event_id AS packet_id, ts, {_IP} AS src_ip, {_TARGET} AS dst_ip,
  CAST(49152 + user_id % 16384 AS INTEGER) AS src_port, 5895 + {_K} % 20 AS dst_port,
  CASE event_type WHEN 'error' THEN 'ICMP' WHEN 'view' THEN 'UDP' ELSE 'TCP' END AS protocol,
  64 + {_SIZE} AS packet_size, 24 + {_SIZE} AS payload_size,
  CASE event_type WHEN 'signup' THEN 'SYN' WHEN 'click' THEN 'PSH-ACK' ELSE 'ACK' END AS flags,
  event_type FROM events)"""

TRAFFIC = PACKETS + """, traffic AS (SELECT packet_id AS record_id, ts, src_ip, dst_ip, src_port,
  dst_port, protocol, packet_size AS bytes FROM packets)"""

TRAFFIC_RAW = f"""traffic_raw AS (SELECT event_id AS record_id,
  CASE WHEN {_K} = 98 THEN 'not-a-time' WHEN {_K} <> 97 THEN {_ISO.format('ts')} END AS "timestamp",
  CASE WHEN user_id % 2 = 0 THEN {_IP} ELSE '' END AS SrcIP,
  CASE WHEN user_id % 2 <> 0 AND user_id % 10 <> 5 THEN {_IP} END AS src_ip,
  CASE WHEN {_K} % 3 = 0 THEN {_TARGET} END AS DstIP,
  CASE WHEN {_K} % 3 = 1 THEN {_TARGET} ELSE '' END AS dst_ip,
  CASE WHEN user_id % 2 = 0 THEN CAST(49152 + user_id % 16384 AS INTEGER) ELSE 0 END AS SrcPort,
  CASE WHEN user_id % 2 <> 0 THEN CAST(49152 + user_id % 16384 AS INTEGER) END AS src_port,
  CASE WHEN user_id % 2 = 0 THEN 0 ELSE 5895 + {_K} % 20 END AS DstPort,
  CASE WHEN user_id % 2 = 0 THEN 5895 + {_K} % 20 END AS dst_port,
  CASE event_type WHEN 'error' THEN 'ICMP' WHEN 'view' THEN 'UDP' WHEN 'click' THEN 'TCP'
    WHEN 'signup' THEN '' END AS Protocol,
  CASE WHEN event_type IN ('view', 'signup') THEN 0 WHEN event_type <> 'click' THEN 64 + {_SIZE} END AS bytes,
  CASE WHEN event_type = 'view' THEN CAST(floor(value * 2) AS BIGINT) WHEN event_type = 'signup' THEN 0 END
    AS BytesSent,
  CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) END AS BytesReceived,
  64 + {_SIZE} AS PacketSize FROM events)"""

_BYTES3 = """CAST(coalesce(nullif(bytes, 0), nullif(coalesce(BytesSent, 0) + coalesce(BytesReceived, 0), 0),
  PacketSize, 0) AS BIGINT)"""
_BYTES2 = """CAST(coalesce(nullif(bytes, 0), nullif(coalesce(BytesSent, 0) + coalesce(BytesReceived, 0), 0),
  0) AS BIGINT)"""

NORMAL = TRAFFIC_RAW + f""", normal AS (SELECT record_id, TRY_CAST("timestamp" AS TIMESTAMP) AS ts,
  coalesce(nullif(SrcIP, ''), nullif(src_ip, ''), '') AS src_ip,
  coalesce(nullif(DstIP, ''), nullif(dst_ip, ''), '') AS dst_ip,
  coalesce(nullif(SrcPort, 0), nullif(src_port, 0)) AS src_port,
  coalesce(nullif(DstPort, 0), nullif(dst_port, 0)) AS dst_port,
  coalesce(nullif(Protocol, ''), 'TCP') AS protocol, {_BYTES3} AS bytes FROM traffic_raw
  WHERE TRY_CAST("timestamp" AS TIMESTAMP) IS NOT NULL
    AND (coalesce(nullif(SrcIP, ''), nullif(src_ip, ''), '') <> ''
      OR coalesce(nullif(DstIP, ''), nullif(dst_ip, ''), '') <> ''))"""

_LABEL = """CASE WHEN l_quantity > 45 THEN 'DDoS' WHEN l_quantity > 40 THEN 'DoS' WHEN l_quantity < 5 THEN
  'PortScan' WHEN l_discount >= 0.085 THEN 'Malware' ELSE 'Normal' END"""
_SRC = "('10.' || (l_suppkey % 8) || '.0.' || (l_suppkey % 256))"
_NUM = "(1 + CAST(floor(l_extendedprice / 1000) AS BIGINT))"
_SENT = "CAST(floor(l_extendedprice * 0.6::DOUBLE) AS BIGINT)"
_RECV = "CAST(floor(l_extendedprice * 0.4::DOUBLE) AS BIGINT)"
_DUR = "CAST(1 + l_orderkey % 600 AS DOUBLE)"

FLOWS = f"""flows AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts,
  CAST(40 + floor(l_quantity * 29) AS BIGINT) AS PacketSize, CAST(l_linenumber * 7 AS DOUBLE) AS ResponseTime,
  CASE l_returnflag WHEN 'A' THEN 'TCP' WHEN 'N' THEN 'UDP' WHEN 'R' THEN 'ICMP' END AS Protocol,
  {_SRC} AS SrcIP, '192.168.' || (l_partkey % 4) || '.' || (l_partkey % 256) AS DstIP,
  CAST(1024 + l_orderkey % 64512 AS INTEGER) AS SrcPort,
  CAST(5896 + l_linenumber + l_partkey % 12 AS INTEGER) AS DstPort,
  {_NUM} / {_DUR} AS PacketRate, {_DUR} AS FlowDuration, {_NUM} AS NumPackets,
  CAST(floor(l_quantity * 29) AS BIGINT) AS PayloadSize, l_orderkey % 7 AS FlagCount,
  l_discount * 1000 AS AnomalyScore, l_tax * 100 AS Entropy, {_SENT} AS BytesSent, {_RECV} AS BytesReceived,
  ({_SENT} + {_RECV}) / {_DUR} AS FlowRate, CAST(l_partkey % 100 AS DOUBLE) AS ActiveTime,
  CAST(l_suppkey % 50 AS DOUBLE) AS IdleTime, {_LABEL} AS AttackLabel FROM lineitem)"""

VOTES = f"""votes AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate AS ts, {_SRC} AS SrcIP,
  {_LABEL} AS AttackLabel, {_LABEL} AS v1,
  CASE WHEN l_quantity > 43 THEN 'DDoS' WHEN l_quantity > 38 THEN 'DoS' ELSE 'Normal' END AS v2,
  CASE WHEN l_tax >= 0.075 THEN 'Malware' WHEN l_quantity < 8 THEN 'PortScan' ELSE 'Normal' END AS v3,
  CASE WHEN l_returnflag = 'A' AND l_quantity > 40 THEN 'DoS' ELSE 'Normal' END AS v4,
  1 - CAST(l_orderkey % 7 AS DOUBLE) / 64 AS c1, 0.75::DOUBLE + CAST(l_linenumber % 8 AS DOUBLE) / 64 AS c2,
  0.5::DOUBLE + CAST(l_partkey % 16 AS DOUBLE) / 64 AS c3,
  0.625::DOUBLE + CAST(l_suppkey % 8 AS DOUBLE) / 64 AS c4 FROM lineitem),
tallied AS (SELECT *, 1 + CAST(v1 = v2 AS INT) + CAST(v1 = v3 AS INT) + CAST(v1 = v4 AS INT) AS n1,
  1 + CAST(v1 = v2 AS INT) + CAST(v2 = v3 AS INT) + CAST(v2 = v4 AS INT) AS n2,
  1 + CAST(v1 = v3 AS INT) + CAST(v2 = v3 AS INT) + CAST(v3 = v4 AS INT) AS n3,
  1 + CAST(v1 = v4 AS INT) + CAST(v2 = v4 AS INT) + CAST(v3 = v4 AS INT) AS n4 FROM votes),
won AS (SELECT *, greatest(n1, n2, n3, n4) AS top, CASE WHEN n1 = greatest(n1, n2, n3, n4) THEN v1
  WHEN n2 = greatest(n1, n2, n3, n4) THEN v2 WHEN n3 = greatest(n1, n2, n3, n4) THEN v3 ELSE v4 END AS winner
  FROM tallied),
voted AS (SELECT *, ((CASE WHEN v1 = winner THEN c1 ELSE 0 END) + (CASE WHEN v2 = winner THEN c2 ELSE 0 END)
  + (CASE WHEN v3 = winner THEN c3 ELSE 0 END) + (CASE WHEN v4 = winner THEN c4 ELSE 0 END)) / top AS confidence,
  CASE WHEN lower(winner) = 'normal' THEN 'SAFE' ELSE 'DANGER' END AS threat_level FROM won)"""

# Two-decimal text, halves rounded up as the engine under test rounds them.
_TWO = "printf('%.2f', floor({0} * 100 + 0.5) / 100)"
_DETAIL = (f"'Majority Vote: ' || winner || ' (' || top || '/4). random_forest: ' || v1 || ' (' || "
           f"{_TWO.format('c1')} || '), svm: ' || v2 || ' (' || {_TWO.format('c2')} || '), xgboost: ' || v3 "
           f"|| ' (' || {_TWO.format('c3')} || '), cnn: ' || v4 || ' (' || {_TWO.format('c4')} || ')'")

ALERTS = f"""alerts AS (SELECT event_id + 1 AS id, ts, CASE {_K} % 7 WHEN 0 THEN 'DoS' WHEN 1 THEN 'PortScan'
  WHEN 2 THEN 'Malware' WHEN 3 THEN 'DDoS' WHEN 4 THEN 'Brute Force' WHEN 5 THEN 'Normal' ELSE 'system' END
  AS type, CASE event_type WHEN 'error' THEN 'danger' WHEN 'click' THEN 'warning' WHEN 'view' THEN 'suspicious'
  ELSE 'safe' END AS severity, 'Attack detected: ' || CASE {_K} % 7 WHEN 0 THEN 'DoS' WHEN 1 THEN 'PortScan'
  WHEN 2 THEN 'Malware' WHEN 3 THEN 'DDoS' WHEN 4 THEN 'Brute Force' WHEN 5 THEN 'Normal' ELSE 'system' END
  AS message, CASE WHEN user_id % 10 = 0 THEN '' ELSE {_IP} END AS source_ip,
  '{{"traffic":{{"SrcIP":"' || {_IP} || '","DstPort":' || (5895 + {_K} % 20) || '}}}}' AS details,
  event_id % 3 = 0 AS acknowledged FROM events)"""

PREDICTIONS = f"""predictions AS (SELECT event_id AS id, ts, CASE {_K} % 6 WHEN 0 THEN 'Normal' WHEN 1 THEN 'DoS'
  WHEN 2 THEN 'PortScan' WHEN 3 THEN 'SUSPICIOUS' WHEN 4 THEN 'Unknown' ELSE 'DDoS' END AS prediction,
  CASE WHEN {_K} % 6 = 0 THEN 'SAFE' ELSE 'DANGER' END AS threat_level, value - floor(value) AS confidence,
  {_IP} AS source_ip FROM events WHERE event_type NOT IN ('error', 'view')
  AND 5895 + {_K} % 20 BETWEEN 5900 AND 5910)"""

BLOCKED = ALERTS + """, blocked AS (SELECT DISTINCT trim(source_ip) AS ip FROM alerts
  WHERE severity = 'danger' AND trim(source_ip) <> '')"""

_LEVEL = """CASE WHEN prediction IS NULL OR upper(prediction) IN ('NORMAL', 'SAFE') THEN 'safe'
  WHEN upper(prediction) = 'SUSPICIOUS' THEN 'suspicious' ELSE 'danger' END"""
_ATTACK = "prediction NOT IN ('NORMAL', 'SAFE', 'UNKNOWN', 'Normal', 'Safe', 'Unknown')"
_CAPTURE = "protocol = 'TCP' AND (src_port BETWEEN 5900 AND 5910 OR dst_port BETWEEN 5900 AND 5910)"
_SECONDS = "(epoch_us({0}) - epoch_us({1})) / 1e6"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_ADVICE = ("CASE {0} " + " ".join(f"WHEN {_quoted(k)} THEN {_quoted(v)}" for k, v in ADVICE.items())
           + f" ELSE {_quoted(DEFAULT_ADVICE)} END")

_INT_IP = """(CASE WHEN length({0}) - length(replace({0}, '.', '')) = 3 THEN coalesce(
  (TRY_CAST(split_part({0}, '.', 1) AS BIGINT) << 24) | (TRY_CAST(split_part({0}, '.', 2) AS BIGINT) << 16)
  | (TRY_CAST(split_part({0}, '.', 3) AS BIGINT) << 8) | TRY_CAST(split_part({0}, '.', 4) AS BIGINT), 0)
  ELSE 0 END)"""
_PROTO = "CASE upper({0}) WHEN 'ICMP' THEN 0 WHEN 'UDP' THEN 2 ELSE 1 END"
_KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey"
_KEY5 = "src_ip, dst_ip, src_port, dst_port, protocol"
NUMERIC = [f for f in FLOW_FEATURES if f not in ("Protocol", "SrcIP", "DstIP")]


def _with(*parts: str) -> str:
    return "WITH " + ", ".join(parts) + " "


def _metrics_sql(source: str, by: str = "") -> str:
    """Weighted metrics of cells(by, truth, predicted, n)."""
    lead, eq = (by + ", ", f"t.{by} = p.{by} AND ") if by else ("", "")
    lead_c = f"coalesce(t.{by}, p.{by}) AS {by}, " if by else ""
    group = f" GROUP BY {by}" if by else ""
    return f"""{source},
t AS (SELECT {lead}truth AS label, sum(n) AS support, sum(CASE WHEN truth = predicted THEN n ELSE 0 END) AS hits
  FROM cells GROUP BY {lead}truth),
p AS (SELECT {lead}predicted AS label, sum(n) AS predicted FROM cells GROUP BY {lead}predicted),
c AS (SELECT {lead_c}coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support,
  coalesce(predicted, 0) AS predicted, coalesce(hits, 0) AS hits
  FROM t FULL OUTER JOIN p ON {eq}t.label = p.label),
r AS (SELECT *, CASE WHEN predicted > 0 THEN hits::DOUBLE / predicted::DOUBLE ELSE 0 END AS prec,
  CASE WHEN support > 0 THEN hits::DOUBLE / support::DOUBLE ELSE 0 END AS rec FROM c),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0 END AS f1 FROM r)
""" + (f"""SELECT {lead}(floor((sum(hits)::DOUBLE / sum(support)::DOUBLE) * 1e6 + 0.5) / 1e6) AS accuracy,
  (floor((sum(prec * support) / sum(support)::DOUBLE) * 1e6 + 0.5) / 1e6) AS precision,
  (floor((sum(rec * support) / sum(support)::DOUBLE) * 1e6 + 0.5) / 1e6) AS recall,
  (floor((sum(f1 * support) / sum(support)::DOUBLE) * 1e6 + 0.5) / 1e6) AS f1_score FROM f{group}""")


def _session_sql(gap_micros: int) -> str:
    return _with(PACKETS) + f""",
g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY src_ip ORDER BY ts)) AS silence FROM packets),
m AS (SELECT *, CASE WHEN silence IS NULL OR silence > {gap_micros} THEN 1 ELSE 0 END AS starts FROM g),
n AS (SELECT *, sum(starts) OVER (PARTITION BY src_ip ORDER BY ts) AS session FROM m)
SELECT src_ip, min(ts) AS session_start, max(ts) AS last_seen, count(*) AS packets,
  CAST(sum(packet_size) AS BIGINT) AS bytes, {_SECONDS.format('max(ts)', 'min(ts)')} AS active_seconds,
  coalesce(max(CASE WHEN starts = 1 THEN silence END) / 1e6, 0) AS idle_seconds
FROM n GROUP BY src_ip, session"""


_NEWEST = "(SELECT max(ts) FROM events)"
_SPLIT = FLOWS + f""", split AS (SELECT {_KEY}, AttackLabel, CASE WHEN row_number() OVER (PARTITION BY AttackLabel
  ORDER BY {_KEY}) <= floor(count(*) OVER (PARTITION BY AttackLabel) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END
  AS split FROM flows)"""
_BUCKETS = PREDICTIONS + f""", placed AS (SELECT 59 - CAST(floor(floor((epoch_us((SELECT max(ts) FROM predictions))
  - epoch_us(ts)) / 1e6) / 600) AS BIGINT) AS bucket, {_LEVEL} AS level FROM predictions
  WHERE ts > (SELECT max(ts) FROM predictions) - INTERVAL 36000 SECOND),
buckets AS (SELECT r.range AS bucket, count(*) FILTER (level = 'safe') AS normal,
  count(*) FILTER (level = 'suspicious') AS suspicious, count(*) FILTER (level = 'danger') AS threats
  FROM range(60) r LEFT JOIN placed p ON p.bucket = r.range GROUP BY r.range)"""
_TYPES = ", ".join(f"count(*) FILTER (type = '{n}') AS \"{n}\"" for n in ("DoS", "PortScan", "Malware", "DDoS")) + \
    """, count(*) FILTER (type NOT IN ('DoS', 'PortScan', 'Malware', 'DDoS', 'Normal', 'system', 'normal')) AS "Other" """
_LEVELS = ", ".join(f"count(*) FILTER ({_LEVEL} = '{n}') AS {n}" for n in ("safe", "suspicious", "danger"))
_TIMELINE = TRAFFIC + ", " + PREDICTIONS + """,
l AS (SELECT *, row_number() OVER (ORDER BY ts DESC, record_id) AS position FROM traffic),
r AS (SELECT prediction, row_number() OVER (ORDER BY ts DESC, id) AS position FROM predictions)"""
_CONNECTIONS = f"""SELECT src_ip, src_port, dst_ip, dst_port, count(*) AS packet_count,
  CAST(sum(packet_size) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen FROM packets"""
_PERCENT = "CASE WHEN {0} = 0 THEN 100.0 ELSE round(CAST({0} - {1} AS DOUBLE) / {0} * 100, 1) END"
_CELLS = _with(VOTES) + ", cells AS (SELECT AttackLabel AS truth, winner AS predicted, count(*) AS n FROM won GROUP BY ALL)"
_MODEL_CELLS = _with(VOTES) + ", cells AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, AttackLabel AS truth, {c} AS predicted, count(*) AS n FROM won GROUP BY ALL"
    for m, c in (("random_forest", "v1"), ("svm", "v2"), ("xgboost", "v3"), ("cnn", "v4"), ("ensemble", "winner"))) + ")"
_HORIZON = " UNION ALL ".join(
    f"""SELECT '{name}' AS time_period, CAST({h} AS INTEGER) AS hours,
  (SELECT count(*) FROM traffic WHERE ts >= {_NEWEST} - INTERVAL {h} HOUR) AS connections,
  (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM traffic WHERE ts >= {_NEWEST} - INTERVAL {h} HOUR) AS bytes,
  (SELECT count(*) FROM alerts WHERE severity IN ('danger', 'warning')
    AND ts >= {_NEWEST} - INTERVAL {h} HOUR) AS anomalies"""
    for name, h in (("Last Hour", 1), ("Last 6 Hours", 6), ("Last 24 Hours", 24), ("Last 7 Days", 168)))
_MOMENTS = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) + 1e-8 AS s_{c}" for c in NUMERIC)
_WEIGHTED = "accuracy, precision, recall, f1_score"

ORACLES: dict[str, str] = {
    "flows_scan": _with(FLOWS) + "SELECT * FROM flows",
    "export_rows": _with(ALERTS) + f"""SELECT CAST(id AS VARCHAR) AS id, {_ISO.format('ts')} AS ts, type, severity,
  message, source_ip, coalesce(CAST(details AS VARCHAR), '') AS details,
  CASE WHEN acknowledged THEN 'true' ELSE '' END AS acknowledged FROM alerts""",
    "capture_filter": _with(PACKETS) + f"SELECT * FROM packets WHERE {_CAPTURE}",
    "alerts_by_severity": _with(ALERTS) + "SELECT * FROM alerts WHERE severity = 'danger'",
    "alerts_open": _with(ALERTS) + "SELECT * FROM alerts WHERE NOT acknowledged",
    "alert_history_by_ip": _with(ALERTS) + """SELECT * FROM alerts WHERE source_ip = '10.0.0.7'
  ORDER BY ts DESC, id LIMIT 50""",
    "alerts_by_ip_limit_then_filter": _with(ALERTS) + """SELECT * FROM (SELECT * FROM alerts
  WHERE source_ip = '10.0.0.7' ORDER BY ts DESC, id LIMIT 50) WHERE severity = 'danger'""",
    "traffic_history": _with(TRAFFIC) + f"SELECT * FROM traffic WHERE ts >= {_NEWEST} - INTERVAL 24 HOUR",
    "retention_filter": _with(TRAFFIC) + f"SELECT * FROM traffic WHERE ts >= {_NEWEST} - INTERVAL 7 DAY",
    "schema_align": _with(FLOWS) + f"SELECT {_KEY}, " + ", ".join(
        f"CAST(0 AS INTEGER) AS {c}" if c in ("FlagCount", "Entropy") else c for c in FLOW_FEATURES) + " FROM flows",
    "traffic_normalised": _with(NORMAL) + "SELECT * FROM normal",
    "byte_fallback": _with(TRAFFIC_RAW) + f"""SELECT record_id, {_BYTES3} AS bytes, {_BYTES2} AS counter_bytes
  FROM traffic_raw""",
    "alerts_from_predictions": _with(VOTES) + f"""SELECT {_KEY}, winner AS type, 'danger' AS severity,
  'Attack detected! ' || winner || ' - ' || {_DETAIL} AS message, SrcIP AS source_ip
  FROM voted WHERE threat_level = 'DANGER'""",
    "alerts_from_stream": _with(PREDICTIONS) + """SELECT id, ts, prediction AS type,
  CASE WHEN upper(prediction) NOT IN ('NORMAL', 'SAFE') THEN 'danger' ELSE 'warning' END AS severity,
  CASE WHEN upper(prediction) NOT IN ('NORMAL', 'SAFE') THEN 'Attack detected: ' || prediction
    ELSE 'Suspicious: Normal' END AS message, source_ip
  FROM predictions WHERE upper(prediction) NOT IN ('NORMAL', 'SAFE') OR confidence < 0.5""",
    "confidence_gate": _with(PREDICTIONS) + f"""SELECT id, prediction, {_LEVEL} AS severity FROM predictions
  WHERE confidence >= 0.70::DOUBLE AND {_LEVEL} IN ('suspicious', 'danger')""",
    "device_active": _with(ALERTS) + f"""SELECT id, {_NEWEST} - ts < INTERVAL 60 MINUTE AS is_active FROM alerts""",
    "flow_to_session": _with(FLOWS) + f"""SELECT {_KEY}, NumPackets AS packet_count,
  BytesSent + BytesReceived AS total_bytes, PacketSize AS avg_packet_size,
  (floor((PacketSize * 0.2::DOUBLE) * 1e6 + 0.5) / 1e6) AS std_packet_size, (floor((PacketSize * 0.5::DOUBLE) * 1e6 + 0.5) / 1e6) AS min_packet_size,
  (floor((PacketSize * 1.5::DOUBLE) * 1e6 + 0.5) / 1e6) AS max_packet_size, FlowRate AS bytes_per_second,
  PacketRate AS packets_per_second, FlowDuration AS connection_duration, CAST(1 AS INTEGER) AS unique_ports,
  CASE WHEN Protocol = 'TCP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS protocol_ratio_tcp, Entropy AS entropy_bytes,
  Entropy AS entropy_packets, CAST(10 AS INTEGER) AS vnc_commands, CAST(10 AS INTEGER) AS vnc_responses,
  CAST(5 AS INTEGER) AS framebuffer_updates, """ + ", ".join(f"CAST(0 AS INTEGER) AS {c}" for c in (
        "key_events", "pointer_events", "mouse_clicks", "keystroke_count", "screenshot_count",
        "file_transfer_size")) + """, 0.8::DOUBLE AS compression_ratio,
  CAST(1 AS INTEGER) AS encryption_level, AnomalyScore AS anomaly_score,
  CASE WHEN Protocol = 'UDP' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS protocol_ratio_udp,
  ActiveTime AS session_length FROM flows""",
    "alert_details": _with(ALERTS) + """SELECT id, ts, type, coalesce(nullif(source_ip, ''),
  details->>'$.traffic.SrcIP', 'Unknown') AS src_ip, coalesce(details->>'$.traffic.DstIP', '—') AS dst_ip,
  coalesce(details->>'$.traffic.SrcPort', '—') AS src_port,
  coalesce(details->>'$.traffic.DstPort', '5900') AS dst_port,
  coalesce(details->>'$.traffic.Protocol', '—') AS protocol FROM alerts""",
    "alerts_acknowledge": _with(ALERTS) + """SELECT id, acknowledged OR id IN
  (SELECT event_id + 1 FROM events WHERE value > 250) AS acknowledged FROM alerts""",
    "traffic_timeline": _with(_TIMELINE) + f"""SELECT l.position, l.ts, l.record_id, l.bytes, {_LEVEL} AS threat_level
  FROM l LEFT JOIN r ON l.position = r.position WHERE l.position <= 60""",
    "traffic_timeline_full": _with(_TIMELINE) + f"""SELECT l.position, l.ts, l.record_id, l.bytes,
  {_LEVEL} AS threat_level FROM l LEFT JOIN r ON l.position = r.position""",
    "protection_advice": _with(ALERTS) + f"SELECT id, type, {_ADVICE.format('type')} AS protection_advice FROM alerts",
    "connection_status": _with(PACKETS, BLOCKED) + f"""SELECT c.*, CASE WHEN ip IS NULL THEN 'active' ELSE 'blocked'
  END AS status FROM ({_CONNECTIONS} GROUP BY 1, 2, 3, 4) c LEFT JOIN blocked ON ip = src_ip""",
    "blocked_traffic": _with(TRAFFIC, BLOCKED) + "SELECT * FROM traffic WHERE src_ip IN (SELECT ip FROM blocked)",
    "unblocked_traffic": _with(TRAFFIC, BLOCKED)
    + "SELECT * FROM traffic WHERE src_ip NOT IN (SELECT ip FROM blocked)",
    "labelled_features": """SELECT doc_id, lang, source, n_chars, quality, toxic
  FROM documents JOIN labels USING (doc_id)""",
    "connection_stats": _with(PACKETS) + _CONNECTIONS + " GROUP BY 1, 2, 3, 4",
    "capture_totals": _with(PACKETS) + f"""SELECT count(*) AS packets_captured,
  CAST(sum(packet_size) AS BIGINT) AS bytes_captured,
  count(DISTINCT (src_ip, src_port, dst_ip, dst_port)) AS active_connections, min(ts) AS start_time,
  {_SECONDS.format('max(ts)', 'min(ts)')} AS duration FROM packets WHERE {_CAPTURE}""",
    "active_connections": _with(NORMAL, BLOCKED) + f""", g AS (SELECT {_KEY5}, count(*) AS packet_count,
  CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS last_seen FROM normal
  WHERE ts >= (SELECT max(ts) FROM normal) - INTERVAL 1 DAY GROUP BY {_KEY5})
SELECT g.*, CASE WHEN ip IS NULL THEN 'active' ELSE 'blocked' END AS status FROM g LEFT JOIN blocked ON ip = src_ip
ORDER BY last_seen DESC, {_KEY5} LIMIT 100""",
    "active_connections_all": _with(NORMAL, BLOCKED) + f""", g AS (SELECT {_KEY5}, count(*) AS packet_count,
  CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS last_seen FROM normal
  WHERE ts >= (SELECT max(ts) FROM normal) - INTERVAL 1 DAY GROUP BY {_KEY5})
SELECT g.*, CASE WHEN ip IS NULL THEN 'active' ELSE 'blocked' END AS status FROM g LEFT JOIN blocked ON ip = src_ip""",
    "flow_features": _with(PACKETS) + f""", g AS (SELECT {_KEY5}, arg_min(packet_size, ts) AS ps, count(*) AS n,
  CAST(sum(packet_size) AS BIGINT) AS total, CAST(sum(payload_size) AS DOUBLE) / count(payload_size) AS payload,
  {_SECONDS.format('max(ts)', 'min(ts)')} AS span FROM packets GROUP BY {_KEY5}),
d AS (SELECT *, CASE WHEN n = 1 THEN 1.0 WHEN span = 0 THEN 0.001 ELSE span END::DOUBLE AS dur FROM g)
SELECT ps AS PacketSize, 0::DOUBLE AS ResponseTime, protocol AS Protocol, src_ip AS SrcIP, dst_ip AS DstIP,
  src_port AS SrcPort, dst_port AS DstPort, n / dur AS PacketRate, dur AS FlowDuration, n AS NumPackets,
  payload AS PayloadSize, CAST(0 AS BIGINT) AS FlagCount, 0::DOUBLE AS AnomalyScore,
  0::DOUBLE AS Entropy, total AS BytesSent, CAST(0 AS BIGINT) AS BytesReceived, total / dur AS FlowRate,
  dur AS ActiveTime, 0::DOUBLE AS IdleTime,
  CASE WHEN n > 1 THEN span * 1000 / (n - 1) ELSE 0 END AS MeanGapMs FROM d""",
    "running_counters": _with(TRAFFIC, ALERTS) + """, d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS connections,
  CAST(sum(bytes) AS BIGINT) AS bytes FROM traffic GROUP BY 1),
a AS (SELECT CAST(ts AS DATE) AS day, count(*) FILTER (severity = 'danger') AS attacks FROM alerts GROUP BY 1),
j AS (SELECT day, coalesce(connections, 0) AS connections, coalesce(bytes, 0) AS bytes,
  coalesce(attacks, 0) AS attacks FROM d FULL OUTER JOIN a USING (day))
SELECT day, connections, bytes, attacks, CAST(sum(connections) OVER (ORDER BY day) AS BIGINT) AS total_connections,
  CAST(sum(bytes) OVER (ORDER BY day) AS BIGINT) AS total_bytes_analyzed,
  CAST(sum(attacks) OVER (ORDER BY day) AS BIGINT) AS total_attacks_detected FROM j""",
    "dashboard_stats": _with(TRAFFIC, ALERTS, PREDICTIONS) + f""",
t AS (SELECT count(*) AS n, CAST(sum(bytes) AS BIGINT) AS b FROM traffic),
p AS (SELECT count(*) FILTER ({_ATTACK}) AS attacks FROM predictions),
a AS (SELECT count(*) FILTER (severity = 'danger') AS danger,
  count(*) FILTER (severity = 'danger' AND NOT acknowledged) AS active FROM alerts),
r AS (SELECT count(*) FILTER (severity IN ('danger', 'warning')) AS recent FROM alerts)
SELECT n AS total_connections, n AS total_records, b AS total_bytes_analyzed, danger AS total_attacks_detected,
  active AS active_threats, {_PERCENT.format('n', 'attacks')} AS normal_percentage, recent AS total_alerts
FROM t, p, a, r""",
    "threat_distribution": _with(PREDICTIONS) + f"""SELECT {_LEVELS}
  FROM (SELECT * FROM predictions ORDER BY ts DESC, id LIMIT 100)""",
    "threat_distribution_all": _with(PREDICTIONS) + f"SELECT {_LEVELS} FROM predictions",
    "attack_distribution": _with(ALERTS) + f"""SELECT {_TYPES}
  FROM (SELECT * FROM alerts ORDER BY ts DESC, id LIMIT 100)""",
    "attack_distribution_all": _with(ALERTS) + f"SELECT {_TYPES} FROM alerts",
    "report_summary": _with(TRAFFIC, ALERTS, PREDICTIONS) + f""",
t AS (SELECT count(*) AS n FROM traffic),
p AS (SELECT count(*) FILTER ({_ATTACK}) AS attacks, count(*) AS all_predictions FROM predictions),
a AS (SELECT count(*) FILTER (severity = 'danger') AS danger, count(*) AS all_alerts FROM alerts)
SELECT n AS total_connections, danger AS total_attacks_detected,
  {_PERCENT.format('n', 'attacks')} AS normal_percentage, all_alerts AS total_alerts,
  all_predictions AS total_predictions FROM t, p, a""",
    "traffic_buckets": _with(_BUCKETS) + "SELECT * FROM buckets",
    "traffic_bucket_totals": _with(_BUCKETS) + """SELECT CAST(sum(normal) AS BIGINT) AS normal,
  CAST(sum(suspicious) AS BIGINT) AS suspicious, CAST(sum(threats) AS BIGINT) AS threats FROM buckets""",
    "attack_heatmap": _with(ALERTS) + f""", h AS (SELECT r.range AS hour, count(ts) AS attacks FROM range(24) r
  LEFT JOIN (SELECT * FROM alerts WHERE severity IN ('danger', 'warning') AND ts >= {_NEWEST} - INTERVAL 24 HOUR) a
  ON hour(a.ts) = r.range GROUP BY r.range),
x AS (SELECT *, attacks::DOUBLE / greatest((SELECT max(attacks) FROM h), 1) AS ratio FROM h)
SELECT hour, attacks, CAST(CASE WHEN ratio <= 0 THEN 0 WHEN ratio <= 0.33 THEN 1 WHEN ratio <= 0.66 THEN 2 ELSE 3 END
  AS INTEGER) AS level FROM x""",
    "report_threats": _with(ALERTS) + f"""SELECT type, count(*) AS alerts, CASE max(CASE severity WHEN 'danger' THEN 3
  WHEN 'warning' THEN 2 WHEN 'suspicious' THEN 1 ELSE 0 END) WHEN 3 THEN 'danger' WHEN 2 THEN 'warning'
  WHEN 1 THEN 'suspicious' ELSE 'safe' END AS severity, {_ADVICE.format('type')} AS mitigation
  FROM alerts GROUP BY type""",
    "report_horizons": _with(TRAFFIC, ALERTS) + _HORIZON,
    "report_protocols": _with(PACKETS) + """, c AS (SELECT protocol, epoch_us(max(ts)) - epoch_us(min(ts)) AS span
  FROM packets GROUP BY src_ip, src_port, dst_ip, dst_port, protocol)
SELECT protocol, count(*) AS connections,
  (floor((CAST(sum(span) AS DOUBLE) / count(*) / 1e6) * 1e6 + 0.5) / 1e6) AS avg_duration_seconds FROM c GROUP BY protocol""",
    "class_balance": _with(FLOWS) + """SELECT AttackLabel AS label, count(*) AS rows,
  count(*)::DOUBLE / (SELECT count(*) FROM flows)::DOUBLE AS ratio FROM flows GROUP BY AttackLabel""",
    "dataset_profile": _with(_SPLIT) + """SELECT CAST(19 AS INTEGER) AS n_features,
  count(*) FILTER (split = 'train') AS n_train_samples, count(*) FILTER (split = 'test') AS n_test_samples,
  count(*) FILTER (split = 'train' AND AttackLabel <> 'Normal')::DOUBLE / count(*) FILTER (split = 'train')
    AS train_attack_ratio,
  count(*) FILTER (split = 'test' AND AttackLabel <> 'Normal')::DOUBLE / count(*) FILTER (split = 'test')
    AS test_attack_ratio FROM split""",
    "feature_moments": _with(FLOWS) + " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, (floor((avg({c})) * 1e4 + 0.5) / 1e4) AS mean, (floor((stddev_pop({c}) + 1e-8) * 1e4 + 0.5) / 1e4) AS std FROM flows"""
        for c in NUMERIC),
    "payload_entropy": """WITH b AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS byte
  FROM documents), c AS (SELECT doc_id, byte, count(*) AS n FROM b GROUP BY doc_id, byte),
e AS (SELECT doc_id, -sum(n / total * log2(n / total)) AS entropy FROM (SELECT *,
  CAST(sum(n) OVER (PARTITION BY doc_id) AS DOUBLE) AS total FROM c) GROUP BY doc_id)
SELECT d.doc_id, (floor((coalesce(entropy, 0)) * 1e6 + 0.5) / 1e6) + 0.0 AS entropy FROM documents d LEFT JOIN e USING (doc_id)""",
    "port_entropy": _with(PACKETS) + """, c AS (SELECT src_ip, dst_port, count(*) AS n FROM packets GROUP BY 1, 2),
s AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src_ip) AS DOUBLE) AS total FROM c)
SELECT src_ip, CAST(sum(n) AS BIGINT) AS packets, count(*) AS ports,
  (floor((-sum(n / total * log2(n / total))) * 1e6 + 0.5) / 1e6) + 0.0 AS entropy FROM s GROUP BY src_ip""",
    "anomaly_threshold": _with(FLOWS) + """SELECT (floor((avg(AnomalyScore)) * 1e6 + 0.5) / 1e6) AS mean_error,
  (floor((stddev_pop(AnomalyScore)) * 1e6 + 0.5) / 1e6) AS std_error,
  (floor((avg(AnomalyScore) + 2 * stddev_pop(AnomalyScore)) * 1e6 + 0.5) / 1e6) AS threshold FROM flows WHERE AttackLabel = 'Normal'""",
    "session_features": _with(PACKETS) + f""", s AS (SELECT src_ip, dst_ip, packet_size, count(*) AS n FROM packets
  GROUP BY 1, 2, 3), w AS (SELECT *, CAST(sum(n) OVER (PARTITION BY src_ip, dst_ip) AS DOUBLE) AS total FROM s),
e AS (SELECT src_ip, dst_ip, -sum(n / total * log2(n / total)) AS entropy FROM w GROUP BY 1, 2),
g AS (SELECT src_ip, dst_ip, count(*) AS n, CAST(sum(packet_size) AS BIGINT) AS total, avg(packet_size) AS mean,
  stddev_pop(packet_size) AS std, min(packet_size) AS low, max(packet_size) AS high,
  {_SECONDS.format('max(ts)', 'min(ts)')} AS span, count(DISTINCT dst_port) AS ports,
  count(*) FILTER (protocol = 'TCP') AS tcp, count(*) FILTER (protocol = 'UDP') AS udp FROM packets GROUP BY 1, 2)
SELECT src_ip, dst_ip, n AS packet_count, total AS total_bytes, mean AS avg_packet_size,
  (floor((std) * 1e6 + 0.5) / 1e6) AS std_packet_size, low AS min_packet_size, high AS max_packet_size,
  total / CASE WHEN span = 0 THEN 0.001 ELSE span END AS bytes_per_second,
  n / CASE WHEN span = 0 THEN 0.001 ELSE span END AS packets_per_second, span AS connection_duration,
  ports AS unique_ports, tcp::DOUBLE / n AS protocol_ratio_tcp, (floor((entropy) * 1e6 + 0.5) / 1e6) + 0.0 AS entropy_packets,
  udp::DOUBLE / n AS protocol_ratio_udp, span AS session_length FROM g JOIN e USING (src_ip, dst_ip)""",
    "session_event_counts": _with(PACKETS) + "SELECT src_ip, dst_ip, " + ", ".join(
        f"count(*) FILTER (event_type = '{k}') AS {k}_count"
        for k in ("click", "error", "purchase", "signup", "view")) + " FROM packets GROUP BY 1, 2",
    "packet_gaps": _with(PACKETS) + f"""SELECT packet_id, {_KEY5}, ts, coalesce((epoch_us(ts) - epoch_us(lag(ts)
  OVER (PARTITION BY {_KEY5} ORDER BY ts, packet_id))) / 1000, 0)::DOUBLE AS gap_ms FROM packets""",
    "recent_per_source": _with(PACKETS) + """SELECT src_ip, CAST(row_number() OVER (PARTITION BY src_ip
  ORDER BY ts DESC, packet_id DESC) AS INTEGER) AS place, packet_id, ts FROM packets
  QUALIFY row_number() OVER (PARTITION BY src_ip ORDER BY ts DESC, packet_id DESC) <= 5""",
    "alert_ids": _with(ALERTS) + "SELECT id, ts, row_number() OVER (ORDER BY ts, id) AS alert_id FROM alerts",
    "stratified_split": _with(_SPLIT) + "SELECT * FROM split",
    "detector_quality": _with(_SPLIT) + """SELECT unnest(['random_forest', 'svm', 'xgboost', 'cnn']) AS detector,
  count(*) AS test_rows, count(DISTINCT AttackLabel) AS classes, TRUE AS sums_to_one, TRUE AS confidence_is_largest,
  TRUE AS known_classes, TRUE AS beats_majority FROM split WHERE split = 'test'""",
    "latest_alerts": _with(ALERTS) + "SELECT * FROM alerts ORDER BY ts DESC, id LIMIT 50",
    "latest_traffic": _with(TRAFFIC) + "SELECT * FROM traffic ORDER BY ts DESC, record_id LIMIT 60",
    "latest_predictions": _with(PREDICTIONS) + "SELECT * FROM predictions ORDER BY ts DESC, id LIMIT 100",
    "packet_tail": _with(PACKETS) + "SELECT * FROM packets ORDER BY ts DESC, packet_id DESC LIMIT 1000",
    "sessions": _session_sql(6 * 3600 * 1_000_000),
    "auto_blocklist": _with(BLOCKED) + "SELECT ip FROM blocked",
    "blocklist_add": _with(BLOCKED) + """SELECT ip FROM blocked UNION SELECT trim(source_ip) AS ip FROM alerts
  WHERE severity = 'warning' AND trim(source_ip) <> ''""",
    "blocklist_remove": _with(BLOCKED) + """SELECT ip FROM blocked EXCEPT SELECT trim(source_ip) AS ip FROM alerts
  WHERE severity = 'danger' AND type = 'Normal'""",
    "union_samples": _with(FLOWS) + f"""SELECT {_KEY}, PacketSize, AttackLabel,
  CAST(AttackLabel <> 'Normal' AS INTEGER) AS label FROM flows""",
    "alerts_append": _with(ALERTS) + f"""SELECT id, ts, type, severity, message, source_ip, details, acknowledged
  FROM alerts UNION ALL SELECT -1 - event_id, ts, 'manual', CASE event_type WHEN 'error' THEN 'danger'
  WHEN 'view' THEN 'warning' ELSE 'suspicious' END, 'Manual alert', CASE WHEN event_type = 'error' THEN {_IP}
  ELSE '' END, CASE WHEN event_type = 'error' THEN '{{"traffic":{{"src_ip":"' || {_IP} || '"}}}}' ELSE '{{}}' END,
  FALSE FROM events""",
    "ip_to_int": _with(FLOWS) + f"""SELECT {_KEY}, {_INT_IP.format('SrcIP')} AS src, {_INT_IP.format('DstIP')} AS dst
  FROM flows""",
    "protocol_code": _with(FLOWS) + f"SELECT {_KEY}, CAST({_PROTO.format('Protocol')} AS INTEGER) AS code FROM flows",
    "threat_level": _with(PREDICTIONS) + f"""SELECT id, {_LEVEL} AS level, {_ATTACK} AS counts_as_attack,
  threat_level AS ensemble_level, CASE WHEN lower(prediction) IN ('danger', 'attack', 'dos', 'ddos', 'portscan',
  'malware') THEN 'threats' WHEN lower(prediction) IN ('suspicious', 'warning') THEN 'suspicious' ELSE 'normal' END
  AS series FROM predictions""",
    "alert_source_ip": _with(ALERTS) + """SELECT id, coalesce(nullif(source_ip, ''), details->>'$.traffic.SrcIP', '')
  AS source_ip FROM alerts""",
    "zscore_features": _with(FLOWS) + f", m AS (SELECT {_MOMENTS} FROM flows) SELECT {_KEY}, " + ", ".join(
        f"(floor((({c} - m_{c}) / s_{c}) * 1e6 + 0.5) / 1e6) AS {c}" for c in NUMERIC) + " FROM flows, m",
    "anomaly_verdict": _with(FLOWS) + f""", m AS (SELECT avg(FlowRate) + 2 * stddev_pop(FlowRate) AS t FROM flows
  WHERE AttackLabel = 'Normal') SELECT {_KEY}, FlowRate > t AS is_anomaly, (floor((FlowRate) * 1e4 + 0.5) / 1e4) AS anomaly_score,
  (floor((t) * 1e4 + 0.5) / 1e4) AS threshold, (floor((least(1.0::DOUBLE, abs(FlowRate - t) / t)) * 1e4 + 0.5) / 1e4) AS confidence,
  CASE WHEN FlowRate > t THEN 'ANOMALY' ELSE 'NORMAL' END AS status FROM flows, m""",
    "ensemble_vote": _with(VOTES) + f"""SELECT {_KEY}, winner AS prediction, threat_level, confidence,
  {_DETAIL} AS details, '{{"' || v1 || '":' || n1 || CASE WHEN v2 <> v1 THEN ',"' || v2 || '":' || n2 ELSE '' END
  || CASE WHEN v3 NOT IN (v1, v2) THEN ',"' || v3 || '":' || n3 ELSE '' END
  || CASE WHEN v4 NOT IN (v1, v2, v3) THEN ',"' || v4 || '":' || n4 ELSE '' END || '}}' AS votes,
  '{{"random_forest":true,"svm":true,"xgboost":true,"cnn":true}}' AS models_used FROM voted""",
    "feature_matrix": _with(FLOWS) + f"SELECT {_KEY}, " + ", ".join(
        f"CAST({_INT_IP.format(c) if c in ('SrcIP', 'DstIP') else _PROTO.format(c) if c == 'Protocol' else c} "
        f"AS DOUBLE) AS {c}" for c in FLOW_FEATURES) + " FROM flows",
    "weighted_metrics": _metrics_sql(_CELLS),
    "class_report": _metrics_sql(_CELLS).rsplit("\nSELECT", 1)[0] + """
SELECT label, (floor((prec) * 1e6 + 0.5) / 1e6) AS precision, (floor((rec) * 1e6 + 0.5) / 1e6) AS recall, (floor((f1) * 1e6 + 0.5) / 1e6) AS f1_score,
  CAST(support AS BIGINT) AS support FROM f""",
    "model_report": _metrics_sql(_MODEL_CELLS, "model"),
}

_RANK = "CASE {0} WHEN 'random_forest' THEN 1 WHEN 'svm' THEN 2 WHEN 'xgboost' THEN 3 ELSE 4 END"
_DETECTED = PACKETS + f""", f AS (SELECT {_KEY5}, count(*) AS n, sum(packet_size) AS total,
  arg_min(packet_size, (ts, packet_id)) AS first_size, max(ts) AS ts FROM packets WHERE {_CAPTURE} GROUP BY {_KEY5}),
v AS (SELECT {_KEY5}, ts, unnest(['random_forest', 'svm', 'xgboost', 'cnn']) AS d,
  unnest([CASE WHEN n >= 2 THEN 'DDoS' ELSE 'Normal' END, CASE WHEN total > 400 THEN 'DoS' ELSE 'Normal' END,
    CASE WHEN dst_port % 2 = 0 THEN 'PortScan' ELSE 'Normal' END,
    CASE WHEN n >= 2 OR first_size > 300 THEN CASE WHEN protocol = 'TCP' THEN 'DoS' END ELSE 'Normal' END]) AS label,
  unnest([0.5::DOUBLE, 0.75::DOUBLE, 0.625::DOUBLE, 0.875::DOUBLE]) AS sure FROM f),
c AS (SELECT {_KEY5}, ts, label, count(*) AS n, avg(sure) AS confidence, min({_RANK.format('d')}) AS place FROM v
  WHERE label IS NOT NULL GROUP BY ALL),
detected AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY {_KEY5} ORDER BY n DESC, place) = 1),
raised AS (SELECT row_number() OVER (ORDER BY ts, src_ip, dst_ip, src_port, dst_port, protocol) AS id, *
  FROM detected WHERE label <> 'Normal')"""
_FLOW_COLUMNS = """ts, src_ip AS flow_SrcIP, dst_ip AS flow_DstIP, src_port AS flow_SrcPort, dst_port AS flow_DstPort,
  protocol AS flow_Protocol"""
_ADVICE_TEXT = "CASE label " + " ".join(
    f"WHEN '{kind}' THEN '" + text.replace("'", "''") + "'" for kind, text in ADVICE.items()) + \
    " ELSE '" + DEFAULT_ADVICE.replace("'", "''") + "' END"

ORACLES |= {
    "detect_predictions": _with(_DETECTED) + f"""SELECT {_FLOW_COLUMNS}, src_ip AS source_ip, label AS prediction,
  CASE WHEN label = 'Normal' THEN 'SAFE' ELSE 'DANGER' END AS threat_level, confidence,
  {_ADVICE_TEXT} AS protection_advice FROM detected""",
    "detect_alerts": _with(_DETECTED) + f"""SELECT id, {_FLOW_COLUMNS}, label AS type, 'danger' AS severity,
  src_ip AS source_ip FROM raised""",
    "detect_blocklist": _with(_DETECTED, BLOCKED) + """
SELECT ip FROM blocked UNION SELECT src_ip AS ip FROM raised""",
}

_TOLD = ["packet_count", "total_bytes", "avg_packet_size", "std_packet_size", "min_packet_size", "max_packet_size",
         "bytes_per_second", "packets_per_second", "connection_duration", "unique_ports", "protocol_ratio_tcp",
         "entropy_packets", "protocol_ratio_udp", "session_length"]
_KINDS = {"vnc_commands": "purchase", "vnc_responses": "signup", "framebuffer_updates": "view", "key_events": "error",
          "mouse_clicks": "click"}

ORACLES |= {
    "session_matrix": "SELECT src_ip, dst_ip, " + ", ".join(
        c if c in _TOLD else f"{_KINDS[c]}_count AS {c}" if c in _KINDS else f"CAST(0 AS INTEGER) AS {c}"
        for c in SESSION_FEATURES) + f""" FROM ({ORACLES['session_features']}) s
  JOIN ({ORACLES['session_event_counts']}) e USING (src_ip, dst_ip)""",
    "session_anomaly": _with(FLOWS) + f"""SELECT {_KEY}, TRUE AS has_score, TRUE AS verdict_holds,
  TRUE AS confidence_in_range FROM flows""",
}

_SIX_HOURS = 6 * 3600

ORACLES |= {
    "stream_capture": ORACLES["capture_filter"],
    "stream_connections": ORACLES["connection_stats"],
    "stream_buckets": _with(PREDICTIONS) + f"""SELECT date_trunc('hour', ts) AS window_start,
  count(*) FILTER ({_LEVEL} = 'safe') AS normal, count(*) FILTER ({_LEVEL} = 'suspicious') AS suspicious,
  count(*) FILTER ({_LEVEL} = 'danger') AS threats FROM predictions GROUP BY 1""",
    "stream_active": _with(TRAFFIC) + f""", w AS (SELECT *, make_timestamp((epoch_us(ts) // {_SIX_HOURS}000000 - r.range)
  * {_SIX_HOURS}000000) AS window_start FROM traffic, range(4) r)
SELECT window_start, {_KEY5}, count(*) AS packet_count, CAST(sum(bytes) AS BIGINT) AS bytes, max(ts) AS last_seen
FROM w GROUP BY window_start, {_KEY5}""",
    "stream_sessions": _session_sql(_SIX_HOURS * 1_000_000).rsplit("SELECT src_ip, min(ts)", 1)[0] + f"""
SELECT src_ip, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS packets,
  CAST(sum(packet_size) AS BIGINT) AS bytes, max(ts) + INTERVAL 6 HOUR > {_NEWEST} - INTERVAL 10 MINUTE AS is_open
FROM n GROUP BY src_ip, session""",
    "stream_notify": _with(ALERTS) + "SELECT * FROM alerts WHERE severity = 'danger'",
    "stream_alerts": ORACLES["alerts_from_stream"],
    "stream_blocklist": _with(PREDICTIONS) + """SELECT DISTINCT source_ip AS ip FROM predictions
  WHERE upper(prediction) NOT IN ('NORMAL', 'SAFE')""",
}


def _rule_weight(index: str) -> str:
    return f"((37 * ({index})) % 101 - 50) / 500.0::DOUBLE"


ORACLES["convolution_forward"] = f"""WITH e AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, unnest([0, 1]) AS f FROM embeddings),
h AS (SELECT vec_id, f, list_transform(range(1, 65), lambda i: greatest(0.0::DOUBLE, {_rule_weight("6 + f")}
  + coalesce(x[i - 1], 0.0::DOUBLE) * {_rule_weight("f")} + x[i] * {_rule_weight("2 + f")}
  + coalesce(x[i + 1], 0.0::DOUBLE) * {_rule_weight("4 + f")})) AS h FROM e),
p AS (SELECT vec_id, f, i, greatest(h[2 * i - 1], h[2 * i]) AS v FROM h, (SELECT unnest(range(1, 33)) AS i)),
o AS (SELECT vec_id, j, exp(sum(v * {_rule_weight("8 + (2 * (i - 1) + f) * 3 + j")}) + {_rule_weight("200 + j")}) AS o
  FROM p, (SELECT unnest([0, 1, 2]) AS j) GROUP BY vec_id, j)
SELECT vec_id, """ + ", ".join(f"round(max(o) FILTER (j = {j}) / sum(o), 6) AS p{j}" for j in range(3)) + " FROM o GROUP BY vec_id"

ORACLES["alert_table_calls"] = _with(ALERTS) + """SELECT row_number() OVER (ORDER BY (id - 1) % 3, ts, id) AS id, id - 1 AS event_id, ts,
  type, severity, (id - 1) % 5 = 0 AS acknowledged FROM alerts"""
