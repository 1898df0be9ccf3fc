from datetime import datetime

import pytest
from pyspark.sql import functions as F

from flowsentry.functions import labels as L
from flowsentry.functions import network as N
from flowsentry.functions.clock import iso_text, parse_iso
from flowsentry.functions.scores import clip, mean_squared_error
from flowsentry.functions.text import alert_source, byte_entropy, parse_details


def column(df, expression):
    return [r[0] for r in df.select(expression).collect()]


def test_ip_to_int(spark):
    ips = ["192.168.1.50", "1.2.3", "a.b.c.d", "300.1.1.1", "", "1.2.3.4.5", None, "0.0.0.1"]
    df = spark.createDataFrame([(i,) for i in ips], "ip string")
    assert column(df, N.ip_to_int("ip")) == [
        192 << 24 | 168 << 16 | 1 << 8 | 50, 0, 0, 300 << 24 | 1 << 16 | 1 << 8 | 1, 0, 0, 0, 1]


def test_protocol_code(spark):
    df = spark.createDataFrame([("tcp",), ("Icmp",), ("UDP",), ("SCTP",), (None,)], "p string")
    assert column(df, N.protocol_code("p")) == [1, 0, 2, 1, 1]


def test_label_mappings_disagree_on_unknown(spark):
    labels = ["Normal", "SAFE", "Unknown", "DDOS", "Brute Force", "suspicious", None]
    df = spark.createDataFrame([(x,) for x in labels], "l string")
    assert column(df, L.threat_level("l")) == [
        "safe", "safe", "danger", "danger", "danger", "suspicious", "safe"]
    assert column(df, L.counts_as_attack("l")) == [False, False, False, True, True, True, False]
    assert column(df, L.ensemble_level("l"))[:3] == ["SAFE", "DANGER", "DANGER"]


def test_attack_bucket_and_chart_class(spark):
    kinds = ["DoS", "dos", "Normal", "system", "normal", "Keylogging", None]
    df = spark.createDataFrame([(x,) for x in kinds], "k string")
    assert column(df, L.attack_bucket("k")) == ["DoS", "Other", None, None, None, "Other", None]
    assert column(df, L.chart_class("k")) == ["threats", "threats", *["normal"] * 5]


def test_severity_rank_and_title(spark):
    df = spark.createDataFrame([("Danger",), ("warning",), ("odd",)], "s string")
    assert column(df, L.severity_rank("s")) == [3, 2, 0]
    assert column(df, L.severity_name(L.severity_rank("s"))) == ["danger", "warning", "safe"]
    assert column(spark.createDataFrame([("port_scan",)], "s string"), L.title_case("s")) == ["Port Scan"]


def test_byte_count_skips_zero_and_missing(spark):
    rows = [(5, 1, 1, 9), (0, 2, 3, 9), (None, None, 4, 9), (0, 0, 0, 9), (None, None, None, None)]
    df = spark.createDataFrame(rows, "bytes long, BytesSent long, BytesReceived long, PacketSize long")
    assert column(df, N.byte_count()) == [5, 5, 4, 9, 0]
    assert column(df, N.byte_count(packet=None)) == [5, 5, 4, 0, 0]


def test_times(spark):
    df = spark.createDataFrame([("2024-01-01T00:00:00",), ("not-a-time",), (None,)], "t string")
    parsed = column(df, parse_iso("t"))
    assert parsed == [datetime(2024, 1, 1), None, None]
    stamped = df.select(parse_iso("t").alias("t"))
    assert column(stamped, iso_text("t"))[0] == "2024-01-01T00:00:00"


def test_byte_entropy_counts_bytes_of_the_whole_text(spark):
    df = spark.createDataFrame([("ab",), ("aaaa",), ("",), (None,), ("é",), ("ab" * 50_000,)], "t string")
    assert column(df, byte_entropy("t")) == [1.0, 0.0, 0.0, 0.0, 1.0, 1.0]


def test_alert_source_spellings(spark):
    rows = [("1.1.1.1", "{}"), ("", '{"SrcIP":"2.2.2.2"}'), (None, '{"src_ip":"3.3.3.3"}'),
            ("", '{"traffic":{"SrcIP":"","src_ip":"4.4.4.4"}}'), ("", "broken"), ("", None)]
    df = spark.createDataFrame(rows, "ip string, d string")
    assert column(df, alert_source("ip", parse_details("d"))) == [
        "1.1.1.1", "2.2.2.2", "3.3.3.3", "4.4.4.4", "", ""]


def test_connection_label(spark):
    df = spark.createDataFrame([("a", 1, "b", None, "TCP")],
                               "src_ip string, src_port int, dst_ip string, dst_port int, protocol string")
    assert column(df, N.connection_label(True)) == ["a:1-b:-TCP"]


def test_vector_arithmetic(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 4.0])], "a array<double>, b array<double>")
    assert column(df, mean_squared_error(F.col("a"), F.col("b"))) == [2.0]
    assert column(df, clip(F.lit(7), 0, 5)) == [5]
    assert column(df, N.per_second(F.lit(4.0), F.lit(0.0))) == [pytest.approx(4000.0)]
