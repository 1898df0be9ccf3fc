"""Packets, traffic, flows, alerts and predictions derived from the given star-schema and event tables.

Each adapter is one projection over the whole table, so filters and pruned columns reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsentry.functions.clock import iso_text
from flowsentry.functions.labels import ensemble_level


def _with_k(events: DataFrame) -> DataFrame:
    """Parse the event's properties once; every other column is derived from the number."""
    return events.withColumn("_k", F.get_json_object("props", "$.k").cast("int"))


def _dotted(*parts) -> Column:
    """Parts of an address joined by dots."""
    return F.concat_ws(".", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _pick(pairs: list[tuple[Column, str]], default=None) -> Column:
    """First text whose condition holds."""
    chain = F.when(pairs[0][0], pairs[0][1])
    for condition, text in pairs[1:]:
        chain = chain.when(condition, text)
    return chain if default is None else chain.otherwise(default)


def _user_ip() -> Column:
    return _dotted("10.0", F.expr("user_id div 256"), F.col("user_id") % 256)


def _size() -> Column:
    return F.floor(F.col("value") * 3).cast("bigint")


def packets(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return _with_k(events).select(
        F.col("event_id").alias("packet_id"), "ts",
        _user_ip().alias("src_ip"),
        _dotted("192.168.1", 1 + F.col("_k") % 4).alias("dst_ip"),
        (49152 + F.col("user_id") % 16384).cast("int").alias("src_port"),
        (5895 + F.col("_k") % 20).alias("dst_port"),
        _pick([(kind == "error", "ICMP"), (kind == "view", "UDP")], "TCP").alias("protocol"),
        (64 + _size()).alias("packet_size"),
        (24 + _size()).alias("payload_size"),
        _pick([(kind == "signup", "SYN"), (kind == "click", "PSH-ACK")], "ACK").alias("flags"),
        "event_type",
    )


def traffic_raw(events: DataFrame) -> DataFrame:
    """Free-form traffic records: two spellings, zeros, blanks, missing and malformed values."""
    user, kind = F.col("user_id"), F.col("event_type")
    even, port = user % 2 == 0, (49152 + user % 16384).cast("int")
    target = _dotted("192.168.1", 1 + F.col("_k") % 4)
    listening = 5895 + F.col("_k") % 20
    return _with_k(events).select(
        F.col("event_id").alias("record_id"),
        F.when(F.col("_k") == 98, "not-a-time").when(F.col("_k") != 97, iso_text("ts")).alias("timestamp"),
        F.when(even, _user_ip()).otherwise("").alias("SrcIP"),
        F.when(~even & (user % 10 != 5), _user_ip()).alias("src_ip"),
        F.when(F.col("_k") % 3 == 0, target).alias("DstIP"),
        F.when(F.col("_k") % 3 == 1, target).otherwise("").alias("dst_ip"),
        F.when(even, port).otherwise(0).alias("SrcPort"),
        F.when(~even, port).alias("src_port"),
        F.when(even, 0).otherwise(listening).alias("DstPort"),
        F.when(even, listening).alias("dst_port"),
        _pick([(kind == "error", "ICMP"), (kind == "view", "UDP"), (kind == "click", "TCP"),
               (kind == "signup", "")]).alias("Protocol"),
        F.when(kind.isin("view", "signup"), 0).when(kind != "click", 64 + _size())
         .cast("bigint").alias("bytes"),
        F.when(kind == "view", F.floor(F.col("value") * 2)).when(kind == "signup", 0)
         .cast("bigint").alias("BytesSent"),
        F.when(kind == "view", F.floor("value")).cast("bigint").alias("BytesReceived"),
        (64 + _size()).alias("PacketSize"),
    )


def flows(lineitem: DataFrame) -> DataFrame:
    order, part, supp, line = (F.col(c) for c in
                               ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    quantity, price, discount = (F.col(c) for c in
                                 ("l_quantity", "l_extendedprice", "l_discount"))
    flag = F.col("l_returnflag")
    packets_sent = (1 + F.floor(price / 1000)).cast("bigint")
    duration = (1 + order % 600).cast("double")
    sent = F.floor(price * 0.6).cast("bigint")
    received = F.floor(price * 0.4).cast("bigint")
    return lineitem.select(
        order, line, part, supp, F.col("l_shipdate").alias("ts"),
        (40 + F.floor(quantity * 29)).cast("bigint").alias("PacketSize"),
        (line * 7).cast("double").alias("ResponseTime"),
        _pick([(flag == "A", "TCP"), (flag == "N", "UDP"), (flag == "R", "ICMP")]).alias("Protocol"),
        _flow_source().alias("SrcIP"),
        _dotted("192.168", part % 4, part % 256).alias("DstIP"),
        (1024 + order % 64512).cast("int").alias("SrcPort"),
        (5896 + line + part % 12).cast("int").alias("DstPort"),
        (packets_sent / duration).alias("PacketRate"),
        duration.alias("FlowDuration"),
        packets_sent.alias("NumPackets"),
        F.floor(quantity * 29).cast("bigint").alias("PayloadSize"),
        (order % 7).alias("FlagCount"),
        (discount * 1000).alias("AnomalyScore"),
        (F.col("l_tax") * 100).alias("Entropy"),
        sent.alias("BytesSent"), received.alias("BytesReceived"),
        ((sent + received) / duration).alias("FlowRate"),
        (part % 100).cast("double").alias("ActiveTime"),
        (supp % 50).cast("double").alias("IdleTime"),
        _attack_label().alias("AttackLabel"),
    )


FLOW_ROW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _attack_label() -> Column:
    quantity = F.col("l_quantity")
    return _pick([(quantity > 45, "DDoS"), (quantity > 40, "DoS"), (quantity < 5, "PortScan"),
                  (F.col("l_discount") >= 0.085, "Malware")], "Normal")


def flow_votes(lineitem: DataFrame) -> DataFrame:
    """Four rule votes per flow with confidences, standing in for fitted detectors.

    Confidences are multiples of 1/64, so that sums and averages are exact on every engine.
    """
    quantity = F.col("l_quantity")
    votes = {
        "random_forest": _attack_label(),
        "svm": _pick([(quantity > 43, "DDoS"), (quantity > 38, "DoS")], "Normal"),
        "xgboost": _pick([(F.col("l_tax") >= 0.075, "Malware"), (quantity < 8, "PortScan")], "Normal"),
        "cnn": _pick([((F.col("l_returnflag") == "A") & (quantity > 40), "DoS")], "Normal"),
    }
    confidences = {
        "random_forest": 1 - F.col("l_orderkey") % 7 / 64,
        "svm": 0.75 + F.col("l_linenumber") % 8 / 64,
        "xgboost": 0.5 + F.col("l_partkey") % 16 / 64,
        "cnn": 0.625 + F.col("l_suppkey") % 8 / 64,
    }
    return lineitem.select(
        *FLOW_ROW_KEY, F.col("l_shipdate").alias("ts"), _flow_source().alias("SrcIP"),
        _attack_label().alias("AttackLabel"),
        *[vote.alias(name) for name, vote in votes.items()],
        *[score.alias(f"{name}_confidence") for name, score in confidences.items()],
    )


def _flow_source() -> Column:
    return _dotted("10", F.col("l_suppkey") % 8, "0", F.col("l_suppkey") % 256)


def alerts(events: DataFrame) -> DataFrame:
    user, kind = F.col("user_id"), F.col("event_type")
    slot = F.col("_k") % 7
    named = _pick([(slot == 0, "DoS"), (slot == 1, "PortScan"), (slot == 2, "Malware"),
                   (slot == 3, "DDoS"), (slot == 4, "Brute Force"), (slot == 5, "Normal")], "system")
    return _with_k(events).select(
        (F.col("event_id") + 1).alias("id"), "ts", named.alias("type"),
        _pick([(kind == "error", "danger"), (kind == "click", "warning"),
               (kind == "view", "suspicious")], "safe").alias("severity"),
        F.concat(F.lit("Attack detected: "), named).alias("message"),
        F.when(user % 10 == 0, "").otherwise(_user_ip()).alias("source_ip"),
        F.concat(F.lit('{"traffic":{"SrcIP":"'), _user_ip(), F.lit('","DstPort":'),
                 (5895 + F.col("_k") % 20).cast("string"), F.lit("}}")).alias("details"),
        (F.col("event_id") % 3 == 0).alias("acknowledged"),
    )


def predictions(events: DataFrame) -> DataFrame:
    """One prediction per captured packet: what the port filter lets through is what gets scored."""
    slot = F.col("_k") % 6
    label = _pick([(slot == 0, "Normal"), (slot == 1, "DoS"), (slot == 2, "PortScan"),
                   (slot == 3, "SUSPICIOUS"), (slot == 4, "Unknown")], "DDoS")
    port = 5895 + F.col("_k") % 20
    captured = ~F.col("event_type").isin("error", "view") & port.between(5900, 5910)
    return _with_k(events).filter(captured).select(
        F.col("event_id").alias("id"), "ts", label.alias("prediction"),
        ensemble_level(label).alias("threat_level"),
        (F.col("value") - F.floor("value")).alias("confidence"),
        _user_ip().alias("source_ip"),
    )


def traffic(events: DataFrame) -> DataFrame:
    """Traffic already in normal form, one record per event."""
    p = packets(events)
    return p.select(F.col("packet_id").alias("record_id"), "ts", "src_ip", "dst_ip", "src_port",
                    "dst_port", "protocol", F.col("packet_size").alias("bytes"))
