import pytest

from flowsentry.operators.filters import normalise_traffic
from flowsentry.operators.profile import stratified_split
from flowsentry.schemas import ALERT, FLOW, FLOW_LABEL
from flowsentry.sources import sinks, tables


def test_flow_csv_in_any_column_order(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("AttackLabel,SrcPort,Extra,Entropy\nDoS,443,x,0.5\n")
    flows = tables.read_flows(spark, str(path))
    assert dict(flows.dtypes) == {"AttackLabel": "string", "SrcPort": "int", "Extra": "string", "Entropy": "double"}
    assert flows.first().SrcPort == 443


def test_flow_csv_needs_labels(spark, tmp_path):
    path = tmp_path / "flows.csv"
    path.write_text("SrcPort\n443\n")
    with pytest.raises(ValueError, match=FLOW_LABEL):
        tables.read_flows(spark, str(path))


def test_features_and_labels_join_on_key(spark, tmp_path):
    (tmp_path / "x.csv").write_text("row,a\n1,5\n2,6\n3,7\n")
    (tmp_path / "y.csv").write_text("row,label\n3,1\n1,0\n")
    got = tables.read_features_and_labels(spark, str(tmp_path / "x.csv"), str(tmp_path / "y.csv"), "row", "csv")
    assert sorted((r.row, r.a, r.label) for r in got.collect()) == [(1, 5, 0), (3, 7, 1)]


def test_json_records_in_both_spellings(spark):
    texts = ['{"timestamp":"2024-01-01T00:00:00","SrcIP":"a","dst_ip":"b","SrcPort":1,"protocol":"UDP","bytes":7}',
             '{"timestamp":"2024-01-01T00:00:00","src_ip":"c","Protocol":"","BytesSent":1,"BytesReceived":2}',
             'broken']
    df = spark.createDataFrame(list(enumerate(texts)), "record_id long, record string")
    got = normalise_traffic(tables.parse_records(df)).orderBy("record_id").collect()
    assert [(r.src_ip, r.dst_ip, r.protocol, r.bytes) for r in got] == [("a", "b", "UDP", 7), ("c", "", "TCP", 3)]
    assert tables.typed_traffic(normalise_traffic(tables.parse_records(df))).count() == 2


def test_csv_exports_skip_empty_tables(spark, tmp_path):
    full = spark.sql("SELECT 1 AS id, named_struct('SrcIP', 'a') AS details, 'say \"hi\", twice' AS message")
    names = sinks.export_tables({"alerts": full, "traffic": full.limit(0)}, str(tmp_path))
    assert names == ["alerts"]
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "alerts.csv")).first()
    assert (back.id, back.details, back.message) == ("1", '{"SrcIP":"a"}', 'say "hi", twice')
    assert sinks.write_capture(full.limit(0), str(tmp_path / "none")) is None
    assert sinks.write_capture(full, str(tmp_path / "some")) is not None


def test_snapshot_keeps_the_newest(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:00:{i:02d}") for i in range(5)]
    df = spark.createDataFrame(rows, "id long, ts string").selectExpr("id", "cast(ts as timestamp_ntz) ts")
    sinks.save_snapshot({"alerts": df}, str(tmp_path))
    got = sinks.load_snapshot(spark, str(tmp_path), {"alerts": ALERT}, {"alerts": 2})["alerts"]
    assert [r.id for r in got.collect()] == [4, 3] and got.columns == ALERT.fieldNames()
    assert sinks.load_snapshot(spark, str(tmp_path), {"alerts": ALERT}, {})["alerts"].count() == 5


def test_splits_land_in_their_folders(spark, tmp_path):
    df = spark.range(50).selectExpr("id", "'x' AS label")
    sinks.write_splits(stratified_split(df, "label", ["id"]), str(tmp_path / "set"))
    assert spark.read.parquet(str(tmp_path / "set/split=train")).count() == 40
    assert "split" in spark.read.parquet(str(tmp_path / "set")).columns


def test_flow_schema_order():
    assert FLOW.fieldNames()[0] == "PacketSize" and FLOW.fieldNames()[-1] == FLOW_LABEL
