import pytest
from pyspark.sql import functions as F

from flowsentry.operators.connections import connection_stats
from flowsentry.operators.filters import captured
from flowsentry.plans import QUERIES
from flowsentry.sources.tables import packet_stream
from flowsentry.schemas import PACKET
from flowsentry.streaming import jobs, sinks

KEY = ["src_ip", "src_port", "dst_ip", "dst_port"]


def packet(i, ts, src="a"):
    return (i, ts, src, "z", 50000, 5900, "TCP", 100, 60, "ACK", "click")


@pytest.fixture
def arriving(spark, tmp_path):
    """Files of packets that a stream reads one per micro-batch, in the order given."""
    import os
    folder = str(tmp_path / "in")

    def build(*files):
        names = "packet_id, cast(ts as timestamp_ntz) ts, src_ip, dst_ip, src_port, dst_port, protocol, " \
                "packet_size, payload_size, flags, event_type".split(", ")
        for n, rows in enumerate(files):
            df = spark.createDataFrame(rows, "packet_id long, ts string, src_ip string, dst_ip string, "
                                             "src_port int, dst_port int, protocol string, packet_size long, "
                                             "payload_size long, flags string, event_type string")
            df.selectExpr(*names).coalesce(1).write.mode("append").parquet(folder)
            for name in os.listdir(folder):
                if name.endswith(".parquet") and not name.startswith("seen"):
                    path = os.path.join(folder, f"seen-{n}-{name}")
                    os.rename(os.path.join(folder, name), path)
                    os.utime(path, (1_700_000_000 + n * 100,) * 2)
        return packet_stream(spark, folder, max_files=1)

    return build


def times(*minutes, src="a", start=0):
    return [packet(start + i, f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", src) for i, m in enumerate(minutes)]


def finish(query):
    query.awaitTermination()
    assert query.exception() is None
    return query


def test_running_connections_equal_the_batch(spark, tmp_path, arriving):
    stream = arriving(times(0, 5), times(7, src="b", start=10), times(20, 21, 22, start=20))
    query = finish(jobs.running_connections(stream, str(tmp_path / "out")))
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == 3
    spans = sinks.current_rows(spark, str(tmp_path / "out"), ["span_start", *KEY])
    got = jobs.connections_so_far(spans).orderBy("src_ip").collect()
    batch = spark.read.schema(PACKET).parquet(str(tmp_path / "in"))
    assert got == connection_stats(batch).select(got[0].__fields__).orderBy("src_ip").collect()


def test_capture_appends_each_packet_once(spark, tmp_path, arriving):
    stream = arriving(times(0, 1), times(2, start=5))
    finish(jobs.capture(stream, str(tmp_path / "out")))
    assert sinks.appended_rows(spark, str(tmp_path / "out")).count() == 3
    finish(jobs.capture(packet_stream(spark, str(tmp_path / "in")), str(tmp_path / "out")))  # a restart
    assert captured(sinks.appended_rows(spark, str(tmp_path / "out"))).count() == 3


def test_late_rows_are_dropped_and_counted(spark, tmp_path, arriving):
    # By the fourth batch the watermark is ten minutes behind 01:40, too late for the row of 00:00.
    stream = arriving(times(0), times(100, start=5), times(101, start=7), times(0, 102, start=9))
    levelled = stream.withColumn("threat_level", F.lit("danger"))
    query = finish(sinks.keep_updates(jobs.threat_buckets(levelled, "10 minutes"), str(tmp_path / "out")))
    got = sinks.current_rows(spark, str(tmp_path / "out"), ["window_start"]).orderBy("window_start").collect()
    assert [r.threats for r in got] == [1, 3]
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1


def test_updates_have_no_batch_without_rows(spark, tmp_path, arriving):
    stream = arriving(times(0), times(100, start=5), times(200, start=7))
    levelled = stream.withColumn("threat_level", F.lit("danger"))
    query = finish(sinks.keep_updates(jobs.threat_buckets(levelled, "10 minutes"), str(tmp_path / "out")))
    assert [p["numInputRows"] for p in query.recentProgress] == [1, 1, 1]
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", "true") == "true"
    # what the watermark has passed is dropped by the next batch with rows
    assert sum(op["numRowsRemoved"] for p in query.recentProgress for op in p["stateOperators"]) == 1


def test_sessions_are_emitted_when_the_watermark_passes(spark, tmp_path, arriving):
    stream = arriving(times(0, 5, 9), times(200, start=10))
    finish(sinks.append_files(jobs.closed_sessions(stream, "30 minutes"), str(tmp_path / "out")))
    got = sinks.appended_rows(spark, str(tmp_path / "out")).collect()
    assert [(r.packets, r.bytes) for r in got] == [(3, 300)]


def test_alerting_is_idempotent_per_batch(spark, tmp_path, arriving):
    def score(batch):
        return batch.select(F.col("packet_id").alias("id"), "ts", F.col("src_ip").alias("source_ip"),
                            F.lit("DoS").alias("prediction"), F.lit("DANGER").alias("threat_level"))

    stream = arriving(times(0, 1), times(2, src="b", start=5))
    out = str(tmp_path / "out")
    finish(jobs.alerting(stream, score, out, ["id", "ts"]))
    alerts = sinks.appended_rows(spark, f"{out}/alerts")
    second = alerts.filter("batch_id = 1").drop("batch_id")
    again = spark.createDataFrame(second.collect(), second.schema)
    sinks.write_batch(again, f"{out}/alerts/data", 1)
    assert sinks.appended_rows(spark, f"{out}/alerts").count() == 3
    assert {r.ip for r in sinks.appended_rows(spark, f"{out}/blocklist").collect()} == {"a", "b"}


def test_notifications_come_once(spark, tmp_path, arriving):
    stream = arriving(times(0, 1), times(1, start=0))  # id 0 twice
    alerts = stream.select(F.col("packet_id").alias("id"), "ts", F.lit("DANGER").alias("severity"))
    finish(sinks.append_files(jobs.new_danger_alerts(alerts), str(tmp_path / "out")))
    assert sorted(r.id for r in sinks.appended_rows(spark, str(tmp_path / "out")).collect()) == [0, 1]


def test_compacted_rows_and_later_updates_agree(spark, tmp_path):
    out = str(tmp_path / "out")

    def batch(number, *rows):
        sinks.write_batch(spark.createDataFrame(rows, "k string, n int"), f"{out}/data", number)

    def current():
        return {r.k: r.n for r in sinks.current_rows(spark, out, ["k"]).collect()}

    batch(0, ("a", 1), ("b", 1))
    batch(1, ("a", 2))
    assert current() == {"a": 2, "b": 1}
    assert sinks.compact(spark, out, ["k"]) == 1
    assert current() == {"a": 2, "b": 1}
    batch(2, ("b", 5), ("c", 7))
    assert current() == {"a": 2, "b": 5, "c": 7}
    assert sinks.compact(spark, out, ["k"]) == 2
    batch(3, ("a", 9))
    assert current() == {"a": 9, "b": 5, "c": 7}


STREAMS = [name for name in QUERIES if name.startswith("stream_")]


@pytest.fixture(scope="module")
def parted(spark, tmp_path_factory):
    """The event table as a folder of several part files."""
    folder = str(tmp_path_factory.mktemp("parted"))
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(4).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", STREAMS)
def test_streams_read_folders_of_files_too(spark, parted, name):
    one, many = QUERIES[name](spark, "/root/testdata/sf0.001"), QUERIES[name](spark, parted)
    many = many.select(one.columns)
    assert one.count() > 0 and one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_empty_streams_give_empty_tables(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(0).write.parquet(str(tmp_path / "events.parquet"))
    for name in STREAMS:
        assert QUERIES[name](spark, str(tmp_path)).count() == 0, name
